"""Change history: commits (sha, author, ts) and their files (sha, path)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECENT_DAYS, LEAST_FILES, MOST_FILES = 90, 2, 50


def churn(changes: DataFrame, recent_days: int = RECENT_DAYS) -> DataFrame:
    """path, churn, churn_recent, authors, last from (sha, path, author, ts); recent counts back from
    the newest change."""
    newest = changes.agg(F.max("ts").alias("newest"))
    rows = changes.crossJoin(F.broadcast(newest))  # one row
    recent = F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {recent_days} DAYS")
    return rows.groupBy("path").agg(F.count("*").alias("churn"), F.count_if(recent).alias("churn_recent"), F.count_distinct("author").alias("authors"), F.max("ts").alias("last"))


def cochange(changes: DataFrame, least: int = 2) -> DataFrame:
    """a, b, n: pairs of paths that changed together at least ``least`` times.

    Commits of fewer than 2 or more than 50 files say nothing; so a commit gives at most 1,225 pairs.
    """
    files = changes.select("sha", "path").distinct()
    # sizes are counted first: no commit of any size is gathered in one row
    sized = files.groupBy("sha").agg(F.count("*").alias("n")).where(F.col("n").between(LEAST_FILES, MOST_FILES)).select("sha")
    sets = files.join(sized, "sha", "left_semi").groupBy("sha").agg(F.sort_array(F.collect_list("path")).alias("p"))
    pairs = sets.select(F.explode(F.flatten(F.transform("p", lambda x, i: F.transform(F.slice(F.col("p"), i + 2, F.size("p")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("e"))
    return pairs.groupBy("e.a", "e.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def cochange_weight(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """a, b, n, weight: n over the smaller churn of the two, three decimals."""
    c = lambda name: counts.select(F.col("path").alias(name), F.col("churn").alias(f"c_{name}"))
    rows = pairs.join(c("a"), "a", "left").join(c("b"), "b", "left")
    least = F.greatest(F.lit(1), F.least(F.coalesce("c_a", F.lit(1)), F.coalesce("c_b", F.lit(1))))
    return rows.select("a", "b", "n", F.round(F.col("n") / least, 3).alias("weight"))
