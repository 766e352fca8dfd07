"""Shared pieces of the training-data operators: tables, scratch storage, byte-level word splitting."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at a time (one longer text is handled alone).
SLICE_BYTES = 2 << 20
WORD_SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"


#: Bytes of an Arrow batch that Spark hands to a Python worker. Spark's own 64 MB are held several
#: times over by each task: in the JVM's direct memory, in the worker and in what it makes of them.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES, where they are larger. The setting counts
    when a plan runs, so it has to outlast the call of an operator: results are lazy."""
    found = re.fullmatch(r"(-?\d+)([bkmg]?)b?", str(spark.conf.get(_BATCH_SETTING)).lower())
    unit = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    size = int(found[1]) * unit[found[2]] if found else -1
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names for internal columns that no column in ``taken`` has (in any case)."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables in the shared folder that ``spark.checkpoint.dir`` names.

    A written table cuts lineage: a lost executor costs the tasks that read it, not the jobs that
    made it. Only where the setting is absent (tests, a plain local session) is an own folder made.
    Tables that a later written table replaces are dropped by the operators with ``drop``; what a
    returned DataFrame still reads goes when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.gettempdir()
        self.root = f"{base.rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"
        bound_batches(spark)
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        with self._shuffles_end():
            writer.parquet(f"{self.root}/{name}")
        return self.read(name, df.schema)

    @contextlib.contextmanager
    def _shuffles_end(self) -> Iterator[None]:
        """Shuffle files of a write are of no use after it: Spark deletes them when it ends."""
        before = self.spark.conf.get(_CLEANUP_SETTING, "false")
        self.spark.conf.set(_CLEANUP_SETTING, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_CLEANUP_SETTING, before)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM has gone already
            pass

    def _delete(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trim_memory() -> None:
    """Gives freed memory of this worker back to the system: workers live on for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(text_lengths(batch.column(column)))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offset of each text in them (null: empty)."""
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, as spans of bytes.

    ``starts`` and ``ends`` are byte positions in ``data``; the words of text i are those numbered
    ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = text_bytes(column)
        if lower:
            upper = (self.data - np.uint8(65)) < 26
            self.data = self.data + upper.astype(np.uint8) * np.uint8(32)
        inside = ~((self.data == 32) | ((self.data - np.uint8(9)) < 5))
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        if len(inside):
            edges = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
            before[0] = after[-1] = False
            before[edges] = False
            after[edges - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    def array(self) -> pa.Array:
        """All words as one Arrow array of strings."""
        packed = self.data[self.inside]
        offsets = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        return pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(offsets), pa.py_buffer(packed))

    def joined(self, keep: np.ndarray | None = None) -> pa.Array:
        """The (kept) words of each text, joined by one space."""
        rows = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        length = self.ends - self.starts
        if keep is None:
            packed, n_texts = self.data[self.inside], len(self.first) - 1
        else:
            packed, n_texts = self.data[self.inside][np.repeat(keep, length)], len(self.first) - 1
            rows, length = rows[keep], length[keep]
        gap = np.zeros(len(rows), np.int64)
        gap[:-1] = rows[1:] == rows[:-1]
        ends = np.cumsum(length + gap)
        out = spread(packed, length, np.cumsum(gap) - gap, int(ends[-1]) if len(ends) else 0)
        offsets = np.zeros(n_texts + 1, np.int64)
        filled = np.searchsorted(rows, np.arange(n_texts), side="right")
        offsets[1:] = np.where(filled > 0, ends[np.maximum(filled, 1) - 1], 0) if len(ends) else 0
        return pa.LargeStringArray.from_buffers(n_texts, pa.py_buffer(offsets), pa.py_buffer(out))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in its bytes, then mixed."""
        return mix(segment_sums(self.data, self.starts, self.ends))


def spread(packed: np.ndarray, length: np.ndarray, shift: np.ndarray, size: int, block: int = 1 << 16) -> np.ndarray:
    """``size`` spaces with the words of ``packed``, each ``shift`` bytes further on; a block of words
    at a time, since places take eight bytes for each one of text."""
    out = np.full(size, 32, np.uint8)
    a = 0
    for k in range(0, len(length), block):
        own = length[k : k + block]
        b = a + int(own.sum())
        out[np.arange(a, b) + np.repeat(shift[k : k + block], own)] = packed[a:b]
        a = b
    return out


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:
            _POWERS[int(base)] = have
    return have[:n]


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """sum(values[i] * base**(i - start)) over each segment [start, end), modulo 2**64.

    Segments are ascending by start and by end. Blocks of them are summed at a time, so that the
    powers needed are few.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + block, side="right")))
        last = int(ends[to - 1])
        sums = np.zeros(last - base + 1, np.uint64)
        np.cumsum(values[base:last].astype(np.uint64) * powers(_BASE, last - base), out=sums[1:])
        begin = starts[at:to] - base
        out[at:to] = (sums[ends[at:to] - base] - sums[begin]) * powers(_INVERSE, last - base + 1)[begin]
        at = to
    return out


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finaliser of splitmix64)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_column(text) -> "F.Column":
    """Array of the words of a text column, in Spark expressions (null: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR_RUN), "")


def crc_remainder(column: str, modulus: int) -> "F.Column":
    """crc32 of a column as text, modulo ``modulus`` (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
