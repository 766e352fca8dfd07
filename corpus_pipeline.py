"""The corpus pipeline: STAGES in order, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents; n_chars is that of the new
text. SQL cannot express the stages (a learned score, sketches, an online packer), so ORACLE_SQL is
None and tests hold ``run`` against a plain Python version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import lines, neardup, packing, substrings, toxicity
from quarry.llm.common import Scratch, table

#: Documents with this toxicity or more go.
TOXIC = 0.3
LINE_CHARS = 10
SHINGLE, SIMILAR_PERCENT = 5, 80
WINDOW = 50
SEQUENCE, END_ID = 1024, 0
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of documents, with another text."""
    if text is not None:
        docs = docs.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are toxic. Null texts score as empty ones."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out=None)
    return _documents(toxicity.score(docs, model).where(F.col("toxicity") < TOXIC))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a document with a smaller doc_id holds."""
    out = lines.dedupe_lines(docs, least=LINE_CHARS)
    return _documents(out, F.col("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates, and rows
    without doc_id."""
    found = neardup.near_duplicates(docs, SHINGLE, SIMILAR_PERCENT)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return _documents(docs.join(gone, "doc_id", "left_anti"))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops words in windows that a document with a smaller doc_id holds; texts that lose none keep
    their layout."""
    out = substrings.dedupe_windows(docs, WINDOW, keep_layout=True)
    return _documents(out, F.col("kept"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, one row per piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), SEQUENCE, END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_passages),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, writing each result to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
