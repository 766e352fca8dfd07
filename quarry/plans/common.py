"""The driver's tables as the library's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, customers as authors, the distinct parts of an order as changed files."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return items.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("sha"), F.col("l_partkey").alias("path"), "author", "ts")


CHANGES_SQL = "changes AS (SELECT DISTINCT o_orderkey AS sha, l_partkey AS path, o_custkey AS author, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files: brand as language, size as complexity, every seventh a test."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("lang"), F.col("p_size").cast("long").alias("complexity"), (F.col("p_partkey") % 7 == 0).alias("is_test"))


PARTS_SQL = "files AS (SELECT p_partkey AS path, p_brand AS lang, p_size::BIGINT AS complexity, p_partkey % 7 = 0 AS is_test FROM part)"


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from customers to suppliers (ids -1 - key), weighted by quantity."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    return i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).agg(F.sum("l_quantity").alias("weight"))


TRADE_SQL = "edges AS (SELECT o_custkey AS src, -l_suppkey - 1 AS dst, sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs: type as kind, user as client."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("client"), "ts", "value")


JOBS_SQL = "jobs AS (SELECT event_id AS id, event_type AS kind, user_id AS client, ts, value FROM events)"
