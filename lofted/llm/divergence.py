"""How far each source's words lie from those of its language's other sources.

Word counts of texts are summed where the texts are, dealt to shards by a hash
of (lang, term), and counted there in DuckDB: which terms a language keeps, and
how often each source has them.  With the groups' totals known, each shard sums
the divergences of pairs of sources over its terms and ranks its own terms;
Spark adds up the shards' sums and merges their rankings.

For source a with probabilities p and another, b, with q, a term adds
f = (p - q)^2 div q.  Terms that a lacks all have one p, so a pair's sum is

    sum over all terms of f(p, q0)                  from a's histogram of counts
  + sum over b's terms of f(p0, q) - f(p0, q0)      from b's histogram
  + sum over common terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

with p0, q0 for a count of 0.  Only the last part needs terms, those of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, q, table

#: Documents of a language that must have a term.
MIN_DOCS = 3
#: Ranks reported of a group's terms.
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Rows of word counts in one shard.
SHARD_ROWS = 1_000_000
#: Rows of word counts held where the texts are before they are passed on.
HELD_ROWS = 400_000
#: Bytes of text that are split into words at once.
SLICE_BYTES = 4 << 20
#: Groups whose totals go to every executor; more are joined by a shuffle.
SENT_GROUPS = 100_000
#: Tasks that one language's sources are dealt to when they meet.
SALTS = 16

#: The fixed pattern of what stands between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _run(db: duckdb.DuckDBPyConnection, sql: str) -> list[tuple]:
    """Runs statements to their end."""
    return db.execute(sql).fetchall()


def _database() -> duckdb.DuckDBPyConnection:
    made = duckdb.connect()
    _run(made, "set threads = 1; set memory_limit = '600MB'; set preserve_insertion_order = false; set temp_directory = ''")
    return made


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term); an empty term marks each (lang, source)."""
    db = _database()
    _run(db, "create table held (lang varchar, source varchar, term varchar, n bigint, docs bigint)")
    summed = "select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from held group by all"

    def passed() -> list[pa.RecordBatch]:
        out = db.sql(summed).to_arrow_table().cast(_COUNTS).to_batches()
        _run(db, "truncate held")
        return out

    for batch in batches:
        lang, source, text = (batch.column(k) for k in range(3))
        low, size = 0, 0
        for k in range(batch.num_rows):
            size += len(text[k].as_buffer() or b"")
            if size < SLICE_BYTES and k + 1 < batch.num_rows:
                continue
            db.register("docs", pa.table({"i": pa.array(range(low, k + 1)), "lang": lang.slice(low, k + 1 - low), "source": source.slice(low, k + 1 - low), "text": text.slice(low, k + 1 - low)}))
            _run(db, f"""
                insert into held
                with words as (select i, lang, source, unnest(string_split(regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), '{BETWEEN}', ' ', 'g'), ' ')) as term from docs),
                each_doc as (select i, lang, source, term, count(*) as n from words where term <> '' group by all)
                select lang, source, term, sum(n), count(*) from each_doc group by all
                union all select distinct lang, source, '', 0, 0 from docs""")
            low, size = k + 1, 0
            if _run(db, "select count(*) from held")[0][0] > HELD_ROWS:
                _run(db, f"create or replace temp table less as {summed}; truncate held; insert into held from less; drop table less")
                if _run(db, "select count(*) from held")[0][0] > HELD_ROWS // 2:
                    yield from passed()
    yield from passed()


_KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("in_lang", pa.int64()), ("first", pa.bool_())])


def _loaded(batches: Iterator[pa.RecordBatch], db: duckdb.DuckDBPyConnection) -> bool:
    """Puts a shard's rows into the table `rows`; whether there are any."""
    made = False
    for batch in batches:
        db.register("part", pa.Table.from_batches([batch]))
        _run(db, "insert into rows from part" if made else "create table rows as from part")
        made = True
    return made


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's terms that their language keeps, with their counts; `first` marks one row of a term."""
    db = _database()
    if _loaded(batches, db):
        yield from db.sql(f"""
            with summed as (select lang, source, term, sum(n)::bigint as n, sum(docs) as docs from rows group by all),
            whole as (select lang, term, sum(n)::bigint as in_lang, min(source) as one from summed group by all having sum(docs) >= {MIN_DOCS})
            select lang, source, term, n, in_lang, source = one as first from summed join whole using (lang, term)""").to_arrow_table().cast(_KEPT).to_batches()


_SUMS = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("n", pa.int64()), ("value", pa.int64())])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a shard's terms: parts of the sums of pairs (`pair`), how many terms each source
    has n times (`histogram`), and the terms that may be among a group's first (`term`)."""
    db = _database()
    if not _loaded(batches, db):
        return
    p, f = "(1 + {s}::hugeint * (({n}) + 1) // ({d}))::bigint", "(({p}) - ({q})) * (({p}) - ({q})) // ({q})"
    _run(db, f"create macro f(p, q) as {f.format(p='p', q='q')}")
    one = {"n": "n", "d": "total + terms", "s": SCALE}
    _run(db, f"""
        create table c as select lang, source, term, n, {p.format(**one)} as p, {p.format(**one | {'n': '0'})} as p0,
            {p.format(n='in_lang', d='lang_total + terms', s=SCALE)} as ql from rows""")
    yield from db.sql(f"""
        select 'pair' as part, a.lang, a.source, b.source as item, 0::bigint as n, sum(f(a.p, b.p) - f(a.p, b.p0) - f(a.p0, b.p) + f(a.p0, b.p0))::bigint as value
            from c a join c b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
        union all select 'histogram', lang, source, '', n, count(*) from c group by all
        union all (select 'term', lang, source, term, n, f(p, ql) from c where p > ql
            qualify row_number() over (partition by lang, source order by f(p, ql) desc, term) <= {TOP_TERMS})""").to_arrow_table().cast(_SUMS).to_batches()


def _p(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exactly."""
    return F.call_function("div", (n.cast("decimal(20,0)") + 1) * F.lit(SCALE), (total.cast("decimal(20,0)") + terms)) + 1


def _f(p: Column, q_: Column) -> Column:
    return F.call_function("div", (p - q_) * (p - q_), q_)


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of every group (lang, source) of `docs`.

    Part `pair`: item is another source of the language, value how far the group
    lies from it, all ranks.  Part `term`: item is a term the group has more
    often than its language, value its part of the divergence, to rank 200.
    Ranks go by value, descending, then item in the order of UTF-8 bytes.

    Null lang, source or text is empty; a text of any length counts whole;
    repeated rows are documents of their own; a language of one source has no
    pairs; an empty table gives no rows.  Other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "divergence")
    named = docs.select(*(F.coalesce(q(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = scratch.save(named.mapInArrow(_counted, "lang string, source string, term string, n long, docs long"), "counts")
    shards = max(1, -(-counts.count() // SHARD_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = scratch.save(counts.where("term <> ''").repartition(shards, "lang", "term").mapInArrow(_kept, "lang string, source string, term string, n long, in_lang long, first boolean"), "kept")

    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("terms"))
    groups = counts.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = scratch.save(groups.na.fill(0, ["total", "own", "lang_total", "terms"]), "groups")
    if groups.count() <= SENT_GROUPS:
        groups = F.broadcast(groups)
    rows = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "in_lang", "total", "lang_total", "terms")
    sums = scratch.save(rows.repartition(shards, "lang", "term").mapInArrow(_summed, "part string, lang string, source string, item string, n long, value long"), "sums")

    # each source's histogram meets the totals of its language's others, dealt to SALTS tasks a language
    histogram = sums.where("part = 'histogram'").groupBy("lang", "source", "n").agg(F.sum("value").alias("terms_of_n"))
    none = groups.select("lang", "source", F.lit(0).cast("long").alias("n"), (F.col("terms") - F.col("own")).alias("terms_of_n"))
    own = groups.select("lang", "source", "total", "terms")
    bars = histogram.unionByName(none).join(own, ["lang", "source"]).withColumn("salt", F.pmod(F.xxhash64("source", "n"), F.lit(SALTS)))
    other = groups.select("lang", F.col("source").alias("other"), F.col("total").alias("other_total"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = bars.join(other.withColumn("salt", F.col("salt").cast("long")), ["lang", "salt"]).where("source <> other")
    zero = F.lit(0).cast("long")
    some = F.col("terms") > 0
    met = met.withColumns({"p": F.when(some, _p(F.col("n"), F.col("total"), F.col("terms"))), "p0": F.when(some, _p(zero, F.col("total"), F.col("terms"))), "o0": F.when(some, _p(zero, F.col("other_total"), F.col("terms")))})
    as_a = F.coalesce(F.col("terms_of_n") * _f(F.col("p"), F.col("o0")), zero)
    as_b = F.coalesce(F.col("terms_of_n") * (_f(F.col("o0"), F.col("p")) - _f(F.col("o0"), F.col("p0"))), zero)
    two = met.select("lang", F.explode(F.array(F.struct(F.col("source"), F.col("other").alias("item"), as_a.alias("value")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"), as_b.alias("value")))).alias("x")).select("lang", "x.*")
    pairs = two.unionByName(sums.where("part = 'pair'").select("lang", "source", "item", "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = sums.where("part = 'term'").select("lang", "source", "item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [d.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for d, part in ((pairs, "pair"), (terms, "term"))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= TOP_TERMS))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
