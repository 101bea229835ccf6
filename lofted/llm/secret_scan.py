"""Secret scans: keyword prefilter, anchored expressions, embedded checksums."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, q

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
# Keywords and patterns of each kind.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
GITHUB_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_MIN_ASSIGN, _MIN_ACCESS = 12, 18


def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("github", GITHUB_WORDS), ("npm", ("npm_",))):
        for w in words:
            made.add_word(w, (kind, len(w)))
    made.make_automaton()
    return made


_WORDS = _automaton()


def checksum_holds(token: str) -> bool:
    """Whether the last six of a token's base-62 digits are the CRC-32 of those after its prefix."""
    body, n = token[4:-6], 0
    for c in token[-6:]:
        n = n * 62 + BASE62.index(c)
    return n == zlib.crc32(body.encode())


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as in KINDS.

    assign, access and hex spans are the leftmost non-overlapping matches, kind
    by kind, that are long enough; a match that is too short still takes its
    place.  github and npm tokens count only if their checksum holds.
    """
    if not text:
        return []
    found = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lower-cased
        low = "".join(c.lower() if c < "\x80" else c for c in text)
    taken = {"assign": 0, "access": 0}
    for last, (kind, size) in _WORDS.iter(low):
        at = last - size + 1
        if kind == "assign":
            if at >= taken[kind] and (m := ASSIGN.match(text, at)):
                taken[kind] = m.end()
                if len(m[2]) >= _MIN_ASSIGN:
                    found.append((kind, at, m.end()))
        elif kind == "access":
            if at >= taken[kind] and (m := ACCESS.match(text, at)):
                taken[kind] = m.end()
                if m.end() - at >= _MIN_ACCESS:
                    found.append((kind, at, m.end()))
        elif (m := (GITHUB if kind == "github" else NPM).match(text, at)) and checksum_holds(m[0]):
            found.append((kind, at, m.end()))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return found


def _listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` and a column `secrets` of structs (kind, start, end), in order.

    Null and empty texts have an empty list.  Where `docs` has a column called
    `secrets` the new one gets underscores before it.  Rows and their other
    columns stay as they are, repeated ones too.
    """
    (name,) = fresh(docs, "secrets")
    kind = "array<struct<kind:string,start:long,end:long>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(kind)
    def find(column: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans(t.as_py())] for t in column], arrow)

    return docs.withColumn(name, find(q(text).cast("string")))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for text in b.column(1):
                found = spans(text.as_py())
                base = [s for s in found if s[0] in KINDS[:3]]
                n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(found)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with each secret of `text` put as [kind]; overlapping spans merge
    under the first one's kind.  Clean and null texts stay as they are."""

    def clean(text: str | None) -> str | None:
        found = spans(text)
        if not found:
            return text
        out, at, end = [], 0, -1
        for kind, a, b in found:
            if a < end:
                end = max(end, b)
                continue
            if end >= 0:
                at = end
            out += [text[at:a], f"[{kind}]"]
            end = b
        return "".join([*out, text[end:]])

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([clean(t.as_py()) for t in column], pa.string())

    return docs.withColumn("text", run(F.col("text")))
