"""URL filters: a blocked Bloom filter before an exact hash join."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import Scratch

#: Rules of the query: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Listed URLs of the query besides those of pages on hosts with one of the names; blocked where no rule fits.
LISTED = ("http://malware.test/", "http://phishing.test/login", "http://tracker.test/pixel?id=1")
LISTED_HOSTS = "casino-win|free-bets|cheap-pills"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
TRACKING = r"(utm_[A-Za-z0-9_]*|gclid|fbclid|ref)(=|$)"
_TRACKING = re.compile(TRACKING)


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: str) -> str:
    """Host (lower case, without a default port, `www.` or a last dot), path
    without its last slash, and the query without tracking parameters, sorted."""
    rest = url.partition("://")[2].partition("#")[0]
    before, mark, query = rest.partition("?")
    name, slash, tail = before.partition("/")
    name = name.translate(_FOLD)
    name = re.sub(r":(80|443)$", "", name).rstrip(".").removeprefix("www.")
    kept = sorted(p for p in query.split("&") if p and not _TRACKING.match(p)) if mark else []
    return name + (slash + tail).rstrip("/") + ("?" + "&".join(kept) if kept else "")


def _hash(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) - 2**63


def rule_table(spark, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules as a table: verdict, host, path."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def listed_table(spark, urls: Iterable[str] = LISTED) -> DataFrame:
    return spark.createDataFrame([(u,) for u in urls], "url string")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, max_log2_blocks: int = bloom.MAX_LOG2_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of `pages`.

    A rule fits its host and all subdomains if the path starts with its path;
    the longest wins, of equal ones the greater text.  Where none fits, a URL
    whose canonical form is listed is blocked and every other is allowed.  Keys
    of rules (host and path) and of listed URLs go into one Bloom filter; the
    possible hits of a URL are joined exactly with the keys.  Null URLs and ones
    without :// have empty parts, no rule, and are allowed.  Repeated rows stay;
    rules or URLs that are null, and URLs without ://, are left out; other columns
    are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")

    @F.arrow_udf("string")
    def canon(urls: pa.Array) -> pa.Array:
        return pa.array([u.as_py() and canonical(u.as_py()) for u in urls], pa.string())

    @F.arrow_udf("long")
    def hashed(keys: pa.Array) -> pa.Array:
        return pa.array([None if k.as_py() is None else _hash(k.as_py()) for k in keys], pa.int64())

    known = rules.where("host is not null and path is not null and verdict is not null").select(F.concat(F.lit("r "), "host", "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict", "host", "path")
    urls = listed.where("url like '%://%'").select(F.concat(F.lit("u "), canon("url")).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path")).distinct()
    keys = scratch.save(known.unionByName(urls).withColumn("h", hashed("key")), "keys")
    log2 = bloom.size_for(keys.count(), max_log2_blocks=max_log2_blocks)
    # labels of a rule's host and lengths of its path: the shapes that a URL is cut to
    shapes = sorted((r.labels, r.size) for r in keys.where("host is not null").select((F.size(F.split("host", r"\.")) + 0).alias("labels"), F.length("path").alias("size")).distinct().collect())
    sent = spark.sparkContext.broadcast((bloom.build(keys, "h", log2), shapes))

    @F.arrow_udf("array<string>")
    def possible(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import numpy as np

        words, cuts = sent.value
        for url_s, host_s, path_s in batches:
            found: list[str] = []
            ends = []
            for url, name, tail in zip(url_s.to_pylist(), host_s.to_pylist(), path_s.to_pylist()):
                if url is not None and "://" in url:
                    labels = name.split(".")
                    for n, size in cuts:
                        if n <= len(labels) and size <= len(tail):
                            found.append("r " + ".".join(labels[-n:]) + tail[:size])
                    found.append("u " + canonical(url))
                ends.append(len(found))
            may = bloom.might_have(words, np.array([_hash(k) for k in found], np.int64), log2) if found else []
            out, at = [], 0
            for end in ends:
                out.append([k for k, m in zip(found[at:end], may[at:end]) if m])
                at = end
            yield pa.array(out, pa.list_(pa.string()))

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    hits = read.select("url", F.explode(possible("url", "host", "path")).alias("key")).distinct()
    exact = hits.join(keys.select("key", "rule", "verdict"), "key")
    best = exact.groupBy("url").agg(F.max(F.struct(F.col("rule").isNotNull().alias("ruled"), F.length("rule").alias("size"), "rule", "verdict")).alias("best"))
    decided = scratch.save(best.select("url", "best.rule", "best.verdict"), "decided")
    return read.join(decided, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
