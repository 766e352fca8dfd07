"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import WORD_SEPARATORS, Scratch, fresh, shuffle_partitions

KEYS = ["h1", "h2"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped of white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WORD_SEPARATORS)), _UPPER, _LOWER)


def line_places(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, row, at, h1, h2 for each line whose key has ``least`` code points or more.

    h1 and h2 are a 128-bit hash of the key; row is a hash of the text, which tells apart rows that
    repeat a doc_id.
    """
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    keyed = lines.select("doc_id", "row", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    return keyed.select("doc_id", "row", "at", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))


class LineRuns:
    """A log-structured index: line hash -> smallest doc_id that holds the line.

    Each run is a table bucketed and sorted by hash, so a batch is merge-joined to it without
    shuffling the run. A batch adds one run of the hashes that no run has; as soon as a level has
    ``fanout`` runs they are compacted into one of the next level, so every hash is rewritten once
    a level and n batches leave at most fanout * log(n) runs. Batches must come in ascending order
    of doc_id for the first holder to be the smallest.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = 3):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.buckets = shuffle_partitions(spark)
        self.levels: list[list[str]] = []
        self.n = 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, df: DataFrame) -> str:
        self.n += 1
        name = "run_" + self.scratch.root.rpartition("-")[2] + f"_{self.n}"
        # as many partitions as buckets, dealt like buckets: one sorted file a bucket
        df.repartition(self.buckets, *KEYS).write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS).option("path", f"{self.scratch.root}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = []

    def add(self, places: DataFrame) -> DataFrame:
        """Takes one batch in; returns the places (doc_id, row, at) of lines that must go."""
        first = places.groupBy(*KEYS).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        new, old = first, []
        for run in self.runs():
            old.append(first.join(run.withColumnRenamed("first", "before"), KEYS).select(*KEYS, F.least("before", "first").alias("first"), "last", F.lit(False).alias("new")))
            new = new.join(run.select(*KEYS), KEYS, "left_anti")
        known = self.scratch.write(reduce(DataFrame.unionByName, old, new.withColumn("new", F.lit(True))), f"known_{self.n}")
        self._push(0, self._write(known.where("new").select(*KEYS, "first")))
        shared = known.where(F.col("last") > F.col("first")).select(*KEYS, "first")
        return places.join(shared, KEYS).where(F.col("doc_id") > F.col("first")).select("doc_id", "row", "at")

    def _push(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merging = self.levels[level]
            merged = self._write(reduce(DataFrame.unionByName, [self.spark.table(x) for x in merging]))
            for x in merging:
                self._drop(x)
            self.levels[level] = []
            self._push(level + 1, merged)


def dedupe_lines(docs: DataFrame, least: int = 10, batches: int = 4) -> DataFrame:
    """``docs`` with kept (the text without dropped lines), n_lines and n_dropped.

    A key of ``least`` code points or more found under several doc_ids keeps its lines under the
    smallest one only; repeats within a document stay. Null or empty text: one empty line, kept as
    the empty text. Rows that repeat a doc_id count as one document. A row with a null doc_id loses
    nothing and takes nothing from others. Other columns come through, whatever their names, but
    for the three that are added, which replace columns of those names. An empty table stays empty.

    The corpus goes through ``LineRuns`` in ``batches`` ranges of doc_id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    docs = docs.drop("kept", "n_lines", "n_dropped")
    places = line_places(docs, least)
    cuts = docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted(set(cuts or []))
    batch = sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    places = scratch.write(places.withColumn("batch", batch), "places", partition_by="batch")
    index = LineRuns(spark, scratch)
    gone = None
    try:
        for b in range(len(cuts) + 1):
            out = scratch.write(index.add(places.where(F.col("batch") == b).drop("batch")), f"gone_{b}")
            gone = out if gone is None else gone.unionByName(out)
    finally:
        index.close()
    scratch.drop("places", *[f"known_{i}" for i in range(2 * len(cuts) + 2)])
    id_, row, lost = fresh(docs.columns, "id", "row", "lost")
    gone = gone.groupBy(F.col("doc_id").alias(id_), F.col("row").alias(row)).agg(F.collect_set("at").alias(lost))
    joined = docs.join(gone, (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(row)), "left")
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")

    def keep(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    kept = F.when(F.col(lost).isNull(), text).otherwise(F.get(F.transform(F.array(lines), keep), F.lit(0)))
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return joined.withColumns({"kept": kept, "n_lines": n_lines.cast("long"), "n_dropped": F.coalesce(F.size(lost), F.lit(0)).cast("long")}).drop(id_, row, lost)
