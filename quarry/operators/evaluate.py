"""Retrieval and detection metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """query, recall_k, acc_k (all gold within k), mrr from hits (query, id, rank) and gold (query, id)."""
    rows = gold.join(hits, ["query", "id"], "left").groupBy("query").agg(F.count("*").alias("n"), F.min("rank").alias("first"), *(F.count_if(F.col("rank") <= k).alias(f"in_{k}") for k in ks))
    out = [F.col("query")]
    for k in ks:
        out += [F.round(F.col(f"in_{k}") / F.col("n"), 6).alias(f"recall_{k}"), (F.col(f"in_{k}") == F.col("n")).alias(f"acc_{k}")]
    return rows.select(*out, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def pass_k(runs: DataFrame) -> DataFrame:
    """pass_all and pass_any: shares of ids (id, ok) that succeed in every run, or in one."""
    per = runs.groupBy("id").agg(F.bool_and("ok").alias("every"), F.bool_or("ok").alias("some"))
    return per.agg(F.round(F.avg(F.col("every").cast("int")), 6).alias("pass_all"), F.round(F.avg(F.col("some").cast("int")), 6).alias("pass_any"))


def first_places(hits: DataFrame) -> DataFrame:
    """query, id, rank of hits (query, id, rank) that repeat an id: its first place, ranks closed up."""
    first = hits.groupBy("query", "id").agg(F.min("rank").alias("at"))
    return first.select("query", "id", F.row_number().over(Window.partitionBy("query").orderBy("at", "id")).alias("rank"))


def function_recall(hits: DataFrame, gold: DataFrame, depth: int = 10) -> DataFrame:
    """query, recall: the share of gold symbols (query, symbol, path, low, high) that one of the first
    ``depth`` hits (query, rank, path, low, high) overlaps."""
    h = hits.where(F.col("rank") <= depth).select("query", "path", F.col("low").alias("a"), F.col("high").alias("b"))
    met = gold.join(h, ["query", "path"]).where((F.col("a") <= F.col("high")) & (F.col("b") >= F.col("low"))).select("query", "symbol").distinct().withColumn("met", F.lit(1))
    return gold.join(met, ["query", "symbol"], "left").groupBy("query").agg(F.round(F.avg(F.coalesce("met", F.lit(0))), 6).alias("recall"))


def gold_symbols(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """query, path, symbol: for each changed range (query, path, low, high) the shortest symbol (path,
    symbol, first, last) that it overlaps, each once."""
    held = ranges.join(symbols, "path").where((F.col("first") <= F.col("high")) & (F.col("last") >= F.col("low")))
    best = held.groupBy("query", "path", "low", "high").agg(F.min_by("symbol", F.struct(F.col("last") - F.col("first"), "symbol")).alias("symbol"))
    return best.select("query", "path", "symbol").distinct()


def mean_metrics(rows: DataFrame, by: list[str], names: list[str], digits: int = 3) -> DataFrame:
    """The mean of each metric by group; rows without it don't count."""
    return rows.groupBy(*by).agg(*[F.round(F.avg(n), digits).alias(n) for n in names], F.count("*").alias("n"))


def sweep(configurations: dict[str, DataFrame], gold: DataFrame, names: tuple[str, ...] = ("recall_1", "recall_5", "recall_10", "mrr")) -> DataFrame:
    """configuration and mean metrics of each set of hits (query, id, rank)."""
    rows = [retrieval_metrics(hits, gold).withColumn("configuration", F.lit(name)) for name, hits in configurations.items()]
    return mean_metrics(reduce(DataFrame.unionByName, rows), ["configuration"], list(names))


def detection_summary(rows: DataFrame) -> DataFrame:
    """One row over reviews (detected, detected_before, others, cost, seconds): shares found after and
    before verification, other findings a review, share of reviews without, mean cost, upper median of
    seconds."""
    share = lambda c: F.round(F.avg(c.cast("int")), 3)
    nth = F.row_number().over(Window.orderBy("seconds"))
    # a benchmark's tasks: one partition holds them
    ordered = rows.withColumns({"_nth": nth, "_n": F.count("*").over(Window.partitionBy())})
    median = F.max(F.when(F.col("_nth") == F.floor(F.col("_n") / 2) + 1, F.col("seconds")))
    return ordered.agg(
        F.count("*").alias("tasks"), share(F.col("detected")).alias("detection"), share(F.col("detected_before")).alias("before"),
        F.round(F.avg("others"), 2).alias("others"), share(F.col("others") == 0).alias("clean"), F.round(F.avg("cost"), 4).alias("cost"), median.alias("p50"),
    )


def detected(findings: DataFrame, regions: DataFrame, slack: int = 3) -> DataFrame:
    """findings (id, low, high) with hit: within ``slack`` lines of a region (id, low, high)."""
    r = regions.select("id", F.col("low").alias("a"), F.col("high").alias("b"))
    near = findings.join(r, "id").where((F.col("high") + slack >= F.col("a")) & (F.col("low") - slack <= F.col("b")))
    return findings.join(near.select("id", "low", "high").distinct().withColumn("hit", F.lit(True)), ["id", "low", "high"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def stratified(rows: DataFrame, stratum: str, id_column: str, n: int, seed: int = 7) -> DataFrame:
    """n rows of each stratum, chosen by a hash of seed and id."""
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), id_column), id_column))
    return rows.withColumn("_n", nth).where(F.col("_n") <= n).drop("_n")
