"""Repository analytics over files (path, lang, complexity, is_test) and their history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import reached


def hotspots(files: DataFrame, counts: DataFrame, limit: int = 12) -> DataFrame:
    """Files whose change and complexity are both high, each over its largest value."""
    rows = files.where("not is_test and complexity > 0").join(counts, "path")
    rows = rows.withColumns({"c": F.log1p(F.col("churn") + 2 * F.col("churn_recent")), "x": F.log1p("complexity")})
    most = rows.agg(F.max("c").alias("mc"), F.max("x").alias("mx"))
    part = lambda v, m: F.when(F.col(m) > 0, F.col(v) / F.col(m)).otherwise(F.col(v))
    rows = rows.crossJoin(F.broadcast(most)).withColumn("score", F.round(part("c", "mc") * part("x", "mx"), 3))  # one row
    return rows.where("score > 0").orderBy(F.desc("score"), "path").limit(limit).select("path", "score", "churn", "churn_recent", "complexity")


def hidden_coupling(pairs: DataFrame, files: DataFrame, imports: DataFrame, least: int = 4, limit: int = 10) -> DataFrame:
    """Pairs (a, b, n, weight) that change together without an import (src, dst) either way, in one
    language and not tests; most weight * n first."""
    f = lambda name: files.select(F.col("path").alias(name), F.col("lang").alias(f"l_{name}"), F.col("is_test").alias(f"t_{name}"))
    rows = pairs.where(F.col("n") >= least).join(f("a"), "a").join(f("b"), "b").where("l_a = l_b and not t_a and not t_b")
    linked = imports.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    rows = rows.join(linked, ["a", "b"], "left_anti").withColumn("strength", F.round(F.col("weight") * F.col("n"), 6))
    return rows.orderBy(F.desc("strength"), "a", "b").limit(limit).select("a", "b", "n", "weight", "strength")


def test_gaps(symbols: DataFrame, calls: DataFrame, tests: DataFrame, least_callers: int = 3, hops: int = 3, limit: int = 12) -> DataFrame:
    """Symbols (node, name) with several callers that no test (src, dst) names or reaches.

    The four times ``limit`` most called are taken first, then those reached are left out.
    """
    callers = calls.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("callers")).where(F.col("callers") >= least_callers)
    rows = symbols.where(~F.col("name").startswith("_")).join(callers, "node")
    rows = rows.join(tests.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    rows = rows.orderBy(F.desc("callers"), "node").limit(4 * limit)
    found = reached(tests.select(F.col("dst").alias("node")), calls, hops)
    return rows.join(found.select("node"), "node", "left_anti").orderBy(F.desc("callers"), "node").limit(limit)


def repo_map(files: DataFrame, symbols: DataFrame, calls: DataFrame, n_files: int = 18, per_file: int = 6) -> DataFrame:
    """The most called symbols of the top-ranked files (path, rank)."""
    top = files.orderBy(F.desc("rank"), "path").limit(n_files)
    count = calls.groupBy(F.col("dst").alias("node")).agg(F.count("src").alias("callers"))
    rows = symbols.join(F.broadcast(top), "path").join(count, "node", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("callers"), "node"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= per_file).select("path", "node", "callers", "nth")
