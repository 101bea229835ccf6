"""Language ID by compression against per-language zstandard dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, q

#: Bounds of the training sample: documents of a language, code points of each and of all, languages.
SAMPLE_DOCS, SAMPLE_CHARS, LANGUAGE_CHARS, LANGUAGES = 256, 2048, 1 << 16, 100
#: Bytes that are compressed at a time, so that the dictionary counts throughout a long text.
CHUNK = 2048
#: Matches of four bytes, searched for well enough to tell related words apart.
SETTINGS = {"window_log": 18, "hash_log": 16, "chain_log": 17, "search_log": 3, "min_match": 4, "target_length": 8, "strategy": zstandard.STRATEGY_LAZY2}
#: Documents whose margin is below this are rejected.
MARGIN = 0.01
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_REST = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The words of a text in lower case, without marks and digits."""
    return f" {_REST.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace")


@dataclass(frozen=True)
class Model:
    """Raw-content dictionaries by language, that of most documents first."""

    contents: tuple[tuple[str, bytes], ...]

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        out, settings = [], zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **SETTINGS)
        for lang, content in self.contents:
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(compression_params=settings)
            out.append((lang, zstandard.ZstdCompressor(dict_data=made, compression_params=settings)))
        return out


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """Dictionaries from rows of doc_id, text, lang that are not held out.

    The sample is bounded: of each language the first of the `docs_per_lang`
    documents of the least hash of doc_id, up to `chars` code points of each and
    `LANGUAGE_CHARS` of all.  More than `LANGUAGES` languages raise.  Rows without
    doc_id, lang or a letter are not learned from; of rows repeated under one
    doc_id and lang the least text is.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
    ranked = usable.select("doc_id", "lang").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= docs_per_lang)
    picked = {(r.doc_id, r.lang): r.r for r in ranked.collect()}  # the bound of the sample
    by_lang: dict[str, dict[int, bytes]] = {}
    if picked:
        rows = usable.where(F.col("doc_id").isin(sorted({d for d, _ in picked}))).select("doc_id", "lang", F.substring("text", 1, chars).alias("text"))
        for r in rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect():
            if (r.doc_id, r.lang) in picked:
                by_lang.setdefault(r.lang, {})[picked[r.doc_id, r.lang]] = letters(r.text)
    # zstandard favours what stands last, so the order is fixed by rank
    order_of, contents = sorted(by_lang, key=lambda lang: (-counts[lang], lang)), []
    for lang in order_of:
        held, size = [], 0
        for _, t in sorted(by_lang[lang].items()):
            if size < LANGUAGE_CHARS:
                held.append(t)
                size += len(t)
        contents.append((lang, b"".join(held)))
    return Model(tuple(contents))


def classify(raw: bytes, compressors: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float]:
    """Language of the smallest encoding of the whole text and the margin to the
    second, as a share of the second's size; equal sizes go to the first language."""
    sizes = np.zeros(len(compressors), np.int64)
    for at in range(0, len(raw), CHUNK):
        piece = raw[at : at + CHUNK]
        for k, (_, c) in enumerate(compressors):
            sizes[k] += len(c.compress(piece))
    best = int(np.argmin(sizes))
    if len(sizes) == 1:
        return compressors[0][0], 1.0
    second = int(np.partition(sizes, 1)[1])
    return compressors[best][0], float((second - sizes[best]) / second)


def predict(docs: DataFrame, model: Model, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """`docs` with lang_pred, score (the margin, 0 to 1) and rejected.

    Texts that are null or have no letter, and all texts of a model without
    languages, are `und` with score 0 and rejected.  Others always get a learned
    language; `rejected` says that the margin is under `margin`.  New columns
    whose names `docs` has already get underscores before them.
    """
    names = fresh(docs, "lang_pred", "score", "rejected")
    (made,) = fresh(docs, "__language")
    model_of = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model_of.value.compressors()
        for column in columns:
            rows = []
            for t in column:
                t = t.as_py()
                if not own or t is None or not _LETTER.search(t):
                    rows.append({"lang": UNKNOWN, "score": 0.0})
                else:
                    lang, score = classify(letters(t), own)
                    rows.append({"lang": lang, "score": score})
            yield pa.array(rows, kind)

    out = docs.withColumn(made, run(q(text).cast("string")))
    lang, score = q(made).getField("lang"), q(made).getField("score")
    return out.select(*[q(c) for c in docs.columns], lang.alias(names[0]), score.alias(names[1]), ((score < margin) | (lang == UNKNOWN)).alias(names[2]))
