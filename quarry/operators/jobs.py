"""The job plane: queues, caches, rates and event logs over (id, kind, client, ts, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def queue_position(queued: DataFrame) -> DataFrame:
    """id, position: how many of the same kind were queued before."""
    return queued.select("id", "kind", (F.row_number().over(Window.partitionBy("kind").orderBy("ts", "id")) - 1).alias("position"))


def latest_cached(jobs: DataFrame, key: list[str], now, ttl_days: int = 14) -> DataFrame:
    """The newest job of each key that is at most ttl_days older than ``now`` (a column)."""
    fresh = jobs.where(F.col("ts") > now - F.expr(f"INTERVAL {ttl_days} DAYS"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ts"), F.desc("id")))
    return fresh.withColumn("nth", nth).where("nth = 1").drop("nth")


def trailing_count(rows: DataFrame, by: list[str], seconds: int) -> DataFrame:
    """n: rows of the same key in the ``seconds`` before each row, itself included, the far boundary not."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(*by).orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return rows.withColumn("n", F.count("*").over(w))


def upper_median(rows: DataFrame, by: list[str], value: str, last: int | None = None) -> DataFrame:
    """The element at n // 2 of the sorted values (of the ``last`` newest)."""
    if last:
        nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("id")))
        rows = rows.withColumn("_n", nth).where(F.col("_n") <= last)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    size = F.count("*").over(Window.partitionBy(*by))
    return rows.withColumns({"_at": place, "_size": size}).where(F.col("_at") == F.floor(F.col("_size") / 2) + 1).select(*by, F.col(value).alias("median"))


def statistics(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def after(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """The next events behind an offset."""
    return rows.where(F.col("id") > offset).orderBy("id").limit(limit)


def claimed(jobs: DataFrame, by: str = "kind") -> DataFrame:
    """The oldest queued job (id, ts, status) of each ``by``: what a worker takes next. A batch has one
    planner, so no job is taken twice."""
    return jobs.where("status = 'queued'").groupBy(by).agg(F.min_by("id", F.struct("ts", "id")).alias("id"))


def stale(jobs: DataFrame, now, seconds: int = 1800) -> DataFrame:
    """jobs (id, ts, status) with status failed for those that run longer than ``seconds``."""
    late = (F.col("status") == "running") & (F.col("ts") < now - F.expr(f"INTERVAL {seconds} SECONDS"))
    return jobs.withColumn("status", F.when(late, "failed").otherwise(F.col("status")))


def first_in_ttl(jobs: DataFrame, key: list[str], days: int = 14) -> DataFrame:
    """The jobs (key, ts, id) that no kept job of the same key came before within ``days``."""
    ttl = days * 86_400_000_000
    rows = jobs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "id"))).alias("x"))
    none = F.array().cast("array<struct<t:bigint,id:bigint>>")
    keep = F.aggregate("x", none, lambda kept, e: F.when((F.size(kept) == 0) | (e["t"] >= F.get(kept, F.size(kept) - 1)["t"] + ttl), F.array_append(kept, e)).otherwise(kept))
    return rows.select(*key, F.explode(keep).alias("e")).select(*key, "e.id", F.timestamp_micros("e.t").alias("ts"))
