"""Working trees and histories as DataFrames, and sinks of snapshots."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.paths import is_parsed, is_test_path, language

#: Folders that hold no sources, and the limits of an admissible file.
EXCLUDED = [".git", "node_modules", "vendor", "third_party", "dist", "build", ".venv", "venv", "__pycache__", ".tox", ".mypy_cache", "site-packages", "target", ".next", "coverage"]
MOST_BYTES, MOST_MEAN_LINE, NUL_WITHIN = 400_000, 400, 8_000


def working_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, content, lang, is_test, loc of the admissible source files below ``root``."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_extract("path", r"^(?:file:)?/*(?:" + re.escape(base.lstrip("/")) + r")/(.*)$", 1)
    rows = raw.where(F.col("length").between(1, MOST_BYTES)).select(path.alias("path"), "length", "content")
    parts = F.split("path", "/")
    rows = rows.where(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in EXCLUDED])) & ~F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.startswith(".")))
    head = F.substring("content", 1, NUL_WITHIN)
    rows = rows.where(~F.hex(head).rlike("^(..)*00"))
    # bytes that are no UTF-8 are replaced, one by one
    rows = rows.withColumn("content", F.make_valid_utf8(F.col("content").cast("string"))).withColumn("loc", F.size(F.split("content", "\n")))
    rows = rows.where(F.col("length") / F.col("loc") <= MOST_MEAN_LINE)
    return rows.withColumns({"lang": language(F.col("path")), "parsed": is_parsed(F.col("path")), "is_test": is_test_path(F.col("path"))}).where("lang is not null").drop("length")


def git_log(spark: SparkSession, log: str) -> DataFrame:
    """sha, author, ts, path from the text of a log whose commits begin with \\x1e and whose fields
    (sha, author, unix time, file names by line) are parted by \\x1f."""
    raw = spark.read.text(log, lineSep="\x1e").where(F.char_length("value") > 0)
    f = F.split("value", "\x1f")
    rows = raw.select(F.get(f, F.lit(0)).alias("sha"), F.get(f, F.lit(1)).alias("author"), F.timestamp_seconds(F.get(f, F.lit(2)).cast("long")).alias("ts"), F.explode(F.split(F.get(f, F.lit(3)), "\n")).alias("path"))
    return rows.where("path <> ''")


def file_log(commits: DataFrame, limit: int = 8) -> DataFrame:
    """path, sha, author, ts, nth: the last ``limit`` commits (sha, author, ts, path) of each path."""
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ts"), "sha"))
    return commits.withColumn("nth", nth).where(F.col("nth") <= limit)


def json_records(spark: SparkSession, where: str, schema=None) -> DataFrame:
    """Rows of JSON files, each one object or an array of them: manifests, payloads of a code host,
    analyzer reports. A file that is no JSON gives a row of nulls with a schema, an error without."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema is not None else reader).json(where)


def write_csv(df: DataFrame, where: str) -> None:
    """Rows as CSV with a header, quotes doubled inside quotes."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(where)


def write_json(df: DataFrame, where: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(where)


def delete_snapshot(spark: SparkSession, tables: list[str], snapshot: int, column: str = "snapshot_id") -> None:
    """Drops a snapshot's partition of every table (a folder of ``write_snapshot``)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(f"{table.rstrip('/')}/{column}={int(snapshot)}")
        path.getFileSystem(conf).delete(path, True)


def write_snapshot(df: DataFrame, where: str, partition: str = "snapshot_id") -> None:
    """Replaces the partitions that ``df`` holds, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(where)


def append_new(spark: SparkSession, df: DataFrame, where: str, key: list[str]) -> DataFrame:
    """Appends the rows whose key the table at ``where`` does not hold; returns them."""
    new = df.dropDuplicates(key)
    try:
        held = spark.read.parquet(where).select(*key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        new = new.join(held, key, "left_anti")
    new.write.mode("append").parquet(where)
    return new
