"""Channels and their fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import dot

RRF_K = 60
#: Vectors that a query meets at a time.
BLOCK = 512


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, within: str | None = None) -> DataFrame:
    """query, id, score, rank: the k vectors (id, v) of largest inner product with each query (query,
    q), or of those with the query's value of the column ``within``.

    Neither side need be small: each query meets the vectors a block at a time, and only k rows a
    query and block go on to be ranked. A null product comes last.
    """
    block = F.floor(F.monotonically_increasing_id() / BLOCK)
    key = [within] if within else []
    blocks = vectors.select(*key, block.alias("block"), F.struct("id", "v").alias("row")).groupBy(*key, "block").agg(F.collect_list("row").alias("rows"))
    score = lambda r: F.round(dot(r["v"], F.col("q")), 6)
    found = F.transform("rows", lambda r: F.struct((-score(r)).alias("s"), r["id"].alias("id")))
    found = F.transform(found, lambda x: F.struct(x["s"].isNull().alias("none"), x["s"].alias("s"), x["id"].alias("id")))
    met = blocks.join(queries, within) if within else blocks.crossJoin(queries)
    best = met.select("query", F.inline(F.slice(F.array_sort(found), 1, k)))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("none", "s", "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "id", (-F.col("s")).alias("score"), "rank")


def ranked(scores: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def rrf(channels: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """query, id, score, ranks: reciprocal rank fusion of channels (query, id, rank).

    Ties go by the first channel, in the order given, that has the id, then by its rank there.
    """
    rows = reduce(DataFrame.unionByName, (df.select("query", "id", "rank").withColumns({"channel": F.lit(name), "turn": F.lit(i)}) for i, (name, df) in enumerate(channels.items())))
    fused = rows.groupBy("query", "id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "rank")))).alias("ranks"),
        F.min(F.struct("turn", "rank")).alias("first"),
    )
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), F.col("first.turn"), F.col("first.rank"), "id"))
    return fused.withColumn("place", order).select("query", "id", F.round("score", 9).alias("score"), "ranks", "place")


def blend(fused: DataFrame, rerank: DataFrame) -> DataFrame:
    """0.7 of the reranker's score over its largest magnitude, 0.3 of the fused score times 60."""
    joined = fused.join(rerank, ["query", "id"])
    most = F.max(F.abs("rr")).over(Window.partitionBy("query"))
    share = F.when(most > 0, F.col("rr") / most).otherwise(0.0)
    return joined.withColumn("blended", F.round(0.7 * share + 0.3 * F.col("score") * RRF_K, 6))


def asof(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """For each point (key, point, at) the span (key, span, start) with the largest start <= at.

    One sort of both sides by key: the last span seen is carried to the points behind it, so a key
    costs its rows, not their product.
    """
    rows = points.select(key, F.col("at").alias("_t"), F.lit(1).alias("_kind"), "point", F.lit(None).cast("long").alias("span"), F.lit(None).cast("long").alias("start"))
    rows = rows.unionByName(spans.select(key, F.col("start").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("point"), "span", "start"))
    before = Window.partitionBy(key).orderBy("_t", "_kind", "span").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("_kind") == 0, F.struct("span", "start")), ignorenulls=True).over(before)
    return rows.withColumn("hit", carried).where("_kind = 1").select(key, "point", F.col("_t").alias("at"), F.col("hit.span").alias("span"), F.col("hit.start").alias("start"))


def _bins(low: Column, high: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def innermost(points: DataFrame, spans: DataFrame, key: str, width: int = 256) -> DataFrame:
    """For each point (key, point, line) the shortest span (key, span, low, high) that holds it; of
    equal ones the first. Spans go to the bins of ``width`` lines that they touch, so a point meets
    those of its bin and not all of its key."""
    dealt = spans.where(F.col("low") <= F.col("high")).select("*", _bins(F.col("low"), F.col("high"), width).alias("bin"))
    held = points.withColumn("bin", F.floor(F.col("line") / width)).join(dealt, [key, "bin"]).where(F.col("line").between(F.col("low"), F.col("high")))
    return held.groupBy(key, "point", "line").agg(F.min_by("span", F.struct(F.col("high") - F.col("low"), "span")).alias("span"))


def overlapping(a: DataFrame, b: DataFrame, key: str, slack: int = 0, width: int = 256) -> DataFrame:
    """Pairs of spans (key, x, x_low, x_high) and (key, y, y_low, y_high) that overlap within slack.

    Both go to bins of ``width`` lines; a pair is made in the first bin that both touch."""
    left = a.withColumns({"_a": F.col("x_low") - slack, "_b": F.col("x_high") + slack}).where("_a <= _b").withColumn("bin", _bins(F.col("_a"), F.col("_b"), width))
    right = b.where("y_low <= y_high").withColumn("bin", _bins(F.col("y_low"), F.col("y_high"), width))
    met = left.join(right, [key, "bin"]).where((F.col("_b") >= F.col("y_low")) & (F.col("_a") <= F.col("y_high")) & (F.col("bin") == F.floor(F.greatest("_a", "y_low") / width)))
    return met.drop("bin", "_a", "_b")
