"""Embedding of chunk cards: a cache by content, priorities, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import index_tokens, l2_normalized

#: What tests and chunks without a symbol count for, priorities of changed files and of
#: their neighbours.
TEST_SHARE, PLAIN_SHARE, CHANGED, NEAR = 0.3, 0.5, 10.0, 6.0


def hashed_vector(text: Column, size: int = 64) -> Column:
    """A unit vector of hashed token counts: a deterministic stand-in where no model can be run."""
    places = F.transform(index_tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    return l2_normalized(counts)


def cached_vectors(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """chunks (chunk, card_hash) with the vector that the cache (card_hash, model, vector) has."""
    own = cache.where(F.col("model") == model).select("card_hash", "vector").dropDuplicates(["card_hash"])
    return chunks.join(own, "card_hash", "left")


def priority(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunks (chunk, path, symbol) with priority: the file's rank, less for tests and for chunks
    without a symbol."""
    share = F.when(F.col("is_test"), TEST_SHARE).otherwise(1.0) * F.when(F.col("symbol").isNull(), PLAIN_SHARE).otherwise(1.0)
    return chunks.join(files.select("path", "rank", "is_test"), "path").withColumn("priority", F.round(F.col("rank") * share, 6)).drop("rank", "is_test")


def boosted(chunks: DataFrame, changed: DataFrame, near: DataFrame) -> DataFrame:
    """chunks (path, priority, embedded) with the priority raised for changed files and their
    neighbours (path), where not embedded yet."""
    marks = changed.select("path").distinct().withColumn("_c", F.lit(True)).join(near.select("path").distinct().withColumn("_n", F.lit(True)), "path", "full")
    raised = F.when(F.col("embedded"), F.col("priority")).when(F.col("_c"), CHANGED).when(F.col("_n"), F.greatest("priority", F.lit(NEAR))).otherwise(F.col("priority"))
    return chunks.join(marks, "path", "left").withColumn("priority", raised).drop("_c", "_n")


def pending(chunks: DataFrame, limit: int, least: float | None = None) -> DataFrame:
    """The next ``limit`` chunks to embed: the highest priority, then the smallest id."""
    rows = chunks.where(~F.col("embedded"))
    if least is not None:
        rows = rows.where(F.col("priority") >= least)
    return rows.orderBy(F.desc("priority"), "chunk").limit(limit)


def progress(chunks: DataFrame, cache: DataFrame, model: str, limit: int, encode) -> tuple[DataFrame, DataFrame]:
    """One step of embedding: new cache rows (card_hash, model, vector) for the pending cards that the
    cache lacks, each once, and the chunks that have a vector after it. ``encode``: a column of cards
    to a column of vectors."""
    todo = pending(chunks, limit)
    lacking = todo.join(cache.where(F.col("model") == model).select("card_hash"), "card_hash", "left_anti").dropDuplicates(["card_hash"])
    new = lacking.select("card_hash", F.lit(model).alias("model"), encode(F.col("card")).alias("vector"))
    return new, todo.select("chunk").withColumn("embedded", F.lit(True))


def coverage(chunks: DataFrame, by: str = "snapshot") -> DataFrame:
    """Chunks, and those embedded, of each snapshot."""
    return chunks.groupBy(by).agg(F.count_if("embedded").alias("embedded"), F.count("*").alias("chunks"))
