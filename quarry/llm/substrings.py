"""Dedup of repeated word windows by super-k-mer partitioning.

A window is ``length`` consecutive words. Its minimiser is the smallest hash of its runs of ``SEED``
words. Consecutive windows with one minimiser make a super-k-mer: it travels to the bucket of the
minimiser as one packed string, so every text is sent about three times rather than ``length``
times, and equal windows always meet. In a bucket, windows are sorted and compared word by word.

Runs of words that fill much of the corpus (a passage that a third of the documents share) get the
largest hashes, so a window that has any rarer run in it goes elsewhere; what stays is the passage
itself, whose packed strings are equal and are merged before they travel. Results go back per
packed string and are joined to its occurrences, which Spark can split when they are many.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Words, bound_batches, fresh, mix, segment_sums, shuffle_partitions, sliced, spread, trim_memory

SEED = 6
#: Runs of SEED words that make up more than 1 / HOT of the corpus are put last; so they are fewer than
#: HOT. With many buckets it is HOT_BUCKETS times their number: no other seed fills much of a bucket.
HOT, HOT_BUCKETS = 4096, 4
#: Windows in one packed string at most.
LONGEST = 512
#: Parts of a shuffle partition that are counted one after the other.
PARTS = 4
#: Bytes of text packed at a time: larger slices merge more equal strings, and so send less.
SLICE = 4 << 20
#: Bytes of text at a time where the size of a slice changes nothing of what is sent.
SMALL_SLICE = 1 << 20


def seeds(words: Words) -> np.ndarray:
    """A hash of the run of SEED words from each word on (past the end of a text: never used)."""
    h = words.hashes()
    x = np.zeros_like(h)
    padded = np.concatenate([h, np.zeros(SEED, np.uint64)])
    for k in range(SEED):
        x = x * np.uint64(0xD1342543DE82EF95) + padded[k : k + len(h)]
    return mix(x, 1) >> np.uint64(1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width]; short at the end."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class SuperKmers:
    """The super-k-mers of a slice of texts: words from ``first`` on, ``count`` windows each."""

    def __init__(self, words: Words, length: int, hot: np.ndarray):
        n_words = np.diff(words.first)
        n_windows = np.maximum(n_words - length + 1, 0)
        total = int(n_windows.sum())
        self.first = self.count = np.zeros(0, np.int64)
        self.minimiser, self.text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if not total:
            return
        x = seeds(words)
        if len(hot):
            x |= np.isin(x, hot, kind="sort").astype(np.uint64) << np.uint64(63)
        least = sliding_min(x, length - SEED + 1)
        text = np.repeat(np.arange(len(n_words)), n_windows)
        begin = np.cumsum(n_windows) - n_windows
        at = words.first[text] + np.arange(total) - begin[text]
        value = least[at]
        new = np.ones(total, bool)
        new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        start = np.flatnonzero(new)
        count = np.diff(start, append=total)
        if len(count) and count.max() > LONGEST:
            pieces = -(-count // LONGEST)
            base = np.repeat(start, pieces)
            k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            end = np.repeat(start + count, pieces)
            start = base + k * LONGEST
            count = np.minimum(LONGEST, end - start)
        self.first, self.count, self.minimiser, self.text = at[start], count, value[start], text[start]

    def strings(self, words: Words, length: int) -> list[bytes]:
        """Each super-k-mer's words, joined by one space."""
        if not len(self.first):
            return []
        size = words.ends - words.starts
        offsets = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size + 1, out=offsets[1:])
        data = spread(words.data[words.inside], size, np.arange(len(size)), int(offsets[-1])).tobytes()
        return [data[a:b] for a, b in zip(offsets[self.first].tolist(), (offsets[self.first + self.count + length - 1] - 1).tolist(), strict=True)]


def heavy_seeds(docs: DataFrame, share: int = HOT) -> np.ndarray:
    """Hashes of the runs of SEED words that are more than 1 / share of all runs (fewer than share).

    Each task counts all runs of its texts and passes on, slice by slice, those that make up
    1 / (4 * share) of what it has seen; the sums of these are too low by a quarter of the threshold at
    most. The list only decides where windows are compared, never the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, counts, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in sliced(batches, most=SLICE):
            words = Words(batch.column("text"))
            if not len(words):
                continue
            x = seeds(words)
            seen += len(x)
            new, n = np.unique(x, return_counts=True)
            many = n > 1
            merged = np.concatenate([kept, new[many]])
            kept, back = np.unique(merged, return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n[many]]), len(kept)).astype(np.int64)
            strong = counts * (4 * share) >= seen
            kept, counts = kept[strong], counts[strong]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept.view(np.int64), 0)), pa.array(np.append(counts, 0)), pa.array(np.append(np.zeros(len(kept), np.int64), seen))], names=["x", "n", "seen"])

    found = docs.select("text").mapInArrow(run, "x long, n long, seen long").groupBy("x").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    # the row of x = 0 has the total; the others over the threshold are fewer than the share
    rows = found.orderBy(F.desc("seen"), F.desc("n")).limit(share + 1).collect()
    total = sum(r["seen"] for r in rows)
    return np.sort(np.array([r["x"] for r in rows if r["n"] * share > total], np.int64).view(np.uint64))


class Buckets:
    """Packed strings of a slice, merged when equal, as one compressed blob for each bucket.

    A blob holds, for each string: minimiser, smallest and largest doc_id, length in bytes; then
    the strings.
    """

    @staticmethod
    def pack(found: SuperKmers, strings: list[bytes], ids: list[int], buckets: int) -> Iterator[tuple[int, bytes]]:
        merged: dict[bytes, list] = {}
        for string, text, minimiser in zip(strings, found.text.tolist(), found.minimiser.tolist(), strict=True):
            doc = ids[text]
            have = merged.get(string)
            if have is None:
                merged[string] = [minimiser, doc, doc]
            elif doc < have[1]:
                have[1] = doc
            elif doc > have[2]:
                have[2] = doc
        if not merged:
            return
        head = np.array([v[0] for v in merged.values()], np.uint64)
        docs = np.array([v[1:] for v in merged.values()], np.int64)
        size = np.array([len(s) for s in merged], np.int64)
        strings = list(merged)
        bucket = (mix(head, 2) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        codec = zstandard.ZstdCompressor(level=9)
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = order[a:b]
            parts = [np.int64(len(own)).tobytes(), head[own].tobytes(), docs[own, 0].tobytes(), docs[own, 1].tobytes(), size[own].tobytes(), *[strings[i] for i in own.tolist()]]
            yield int(bucket[own[0]]), codec.compress(b"".join(parts))

    @staticmethod
    def unpack(blob: bytes) -> Iterator[tuple[bytes, int, int, int]]:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        head = np.frombuffer(data, np.uint64, n, 8).tolist()
        low, high, size = (np.frombuffer(data, np.int64, n, 8 + 8 * n * k).tolist() for k in (1, 2, 3))
        at = 8 + 32 * n
        for k in range(n):
            yield data[at : at + size[k]], head[k], low[k], high[k]
            at += size[k]


def shared_windows(strings: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(string, first window, windows, doc): runs of windows that the document ``doc`` holds, the
    smallest of all that do, where some holder of the string has a larger doc_id.

    Windows are sorted by a hash of their words; neighbours of one hash are compared word by word.
    """
    words = Words(pa.array(strings, pa.large_binary()).view(pa.large_string()))
    ids = words.array().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_windows = np.diff(words.first) - length + 1
    total = int(n_windows.sum())
    string = np.repeat(np.arange(len(strings)), n_windows)
    begin = np.cumsum(n_windows) - n_windows
    at = words.first[string] + np.arange(total) - begin[string]
    h = mix(segment_sums(mix(ids.view(np.uint64), 3), at, at + length))
    order = np.argsort(h, kind="stable")
    new = np.ones(total, bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    same = np.flatnonzero(~new)
    for a in range(0, len(same), 1 << 16):
        part = same[a : a + (1 << 16)]
        equal = np.ones(len(part), bool)
        left, right = at[order[part - 1]], at[order[part]]
        for k in range(length):
            equal &= ids[left + k] == ids[right + k]
        if not equal.all():
            new[part[~equal]] = True
    # windows of one hash that differ may lie mixed: put equal ones of such a hash together
    clash = np.flatnonzero(new[1:] & (h[order[1:]] == h[order[:-1]])) + 1
    for value in np.unique(h[order[clash]]):
        a, b = np.searchsorted(h[order], [value, value]) + [0, int((h == value).sum())]
        own = sorted(order[a:b].tolist(), key=lambda i: tuple(ids[at[i] : at[i] + length]))
        order[a:b] = own
        new[a] = True
        for j in range(a + 1, b):
            new[j] = not np.array_equal(ids[at[order[j]] : at[order[j]] + length], ids[at[order[j - 1]] : at[order[j - 1]] + length])
    groups = np.flatnonzero(new)
    least = np.minimum.reduceat(low[string[order]], groups)
    first = np.empty(total, np.int64)
    first[order] = np.repeat(least, np.diff(groups, append=total))
    gone = first < high[string]
    cut = np.ones(total, bool)
    cut[1:] = (first[1:] != first[:-1]) | (string[1:] != string[:-1]) | (gone[1:] != gone[:-1])
    starts = np.flatnonzero(cut)
    sizes = np.diff(starts, append=total)
    for a, n in zip(starts[gone[starts]].tolist(), sizes[gone[starts]].tolist(), strict=True):
        yield int(string[a]), a - int(begin[string[a]]), n, int(first[a])


def fingerprints(strings: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each string, in two columns."""
    data = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), ">i8").reshape(-1, 2).astype(np.int64)
    return data[:, 0], data[:, 1]


def _count(length: int, most: int = 8 << 20):
    """Of the blobs of a partition, sorted by bucket: which windows of which strings are shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["f1", "f2", "skip", "n", "first"]

        def settle(merged: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
            holders: dict[int, int] = {}
            for value, _, _ in merged.values():
                holders[value] = holders.get(value, 0) + 1
            rows: list[tuple] = []
            several: list[tuple] = []
            for s, (value, low, high) in merged.items():
                if holders[value] > 1:
                    several.append((value, s, low, high))
                elif low != high:
                    rows.append((s, 0, s.count(b" ") + 2 - length, low))
            several.sort(key=lambda x: x[0])
            a = 0
            while a < len(several):  # whole minimisers, up to `most` bytes of strings
                b, size = a, 0
                while b < len(several) and (size < most or several[b][0] == several[b - 1][0]):
                    size += len(several[b][1])
                    b += 1
                part = several[a:b]
                for k, skip, n, first in shared_windows([x[1] for x in part], np.array([x[2] for x in part]), np.array([x[3] for x in part]), length):
                    rows.append((part[k][1], skip, n, first))
                a = b
            if rows:
                strings, *rest = zip(*rows, strict=True)
                columns = [*fingerprints(strings), *(np.array(r, np.int64) for r in rest)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        bucket, merged = None, {}
        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                if b != bucket:
                    yield from settle(merged)
                    bucket, merged = b, {}
                for s, value, low, high in Buckets.unpack(blob.as_buffer()):
                    have = merged.get(s)
                    if have is None:
                        merged[s] = [value, low, high]
                    else:
                        have[1], have[2] = min(have[1], low), max(have[2], high)
        yield from settle(merged)
        merged = {}
        trim_memory()

    return run


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, row, spans: words [a, b) of a document that lie in a window which also starts in a
    document with a smaller doc_id; row is a hash of the text. Documents without any are left out."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    bound_batches(spark)
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    hot = heavy_seeds(docs, max(HOT, HOT_BUCKETS * n * PARTS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=SLICE):
            words = Words(batch.column("text"))
            found = SuperKmers(words, length, hot)
            rows = list(Buckets.pack(found, found.strings(words, length), batch.column("doc_id").to_pylist(), n * PARTS))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])
        trim_memory()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=SMALL_SLICE):
            words = Words(batch.column("text"))
            found = SuperKmers(words, length, hot)
            columns = [*fingerprints(found.strings(words, length)), batch.column("doc_id").to_numpy()[found.text], batch.column("row").to_numpy()[found.text], (found.first - words.first[found.text]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["f1", "f2", "doc_id", "row", "at"])
        trim_memory()

    blobs = docs.mapInArrow(send, "bucket int, blob binary")
    blobs = blobs.repartitionById(n, (F.col("bucket") / PARTS).cast("int")).sortWithinPartitions("bucket")
    shared = blobs.mapInArrow(_count(length), "f1 long, f2 long, skip long, n long, first long")
    places = docs.withColumn("row", F.xxhash64("text")).mapInArrow(place, "f1 long, f2 long, doc_id long, row long, at int")
    gone = places.join(shared, ["f1", "f2"]).where(F.col("doc_id") > F.col("first"))
    start = F.col("at") + F.col("skip")
    span = F.struct(start.cast("int").alias("a"), (start + F.col("n") + length - 1).cast("int").alias("b"))
    return gone.groupBy("doc_id", "row").agg(F.collect_list(span).alias("spans"))


def dedupe_windows(docs: DataFrame, length: int = 50, keep_layout: bool = False) -> DataFrame:
    """``docs`` with kept (the words that stay, joined by one space), n_words and n_removed.

    A word goes when it lies in a window of ``length`` words that also starts in a document with a
    smaller doc_id. Words are the runs of bytes other than white space. Windows are judged on the
    input. With ``keep_layout``, kept holds the text as it was where nothing is removed. Null or
    empty text, or fewer words than a window: nothing is removed. Rows that repeat a doc_id count as
    one document and never remove from one another. A row with a null doc_id stays as it is. Other
    columns come through, but for those that are added. An empty table stays empty.
    """
    docs = docs.drop("kept", "n_words", "n_removed")
    own = docs.columns
    id_, row, lost = fresh(own, "id", "row", "spans")
    spans = repeated_spans(docs, length).select(F.col("doc_id").alias(id_), F.col("row").alias(row), F.col("spans").alias(lost))
    joined = docs.join(spans, (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(row)), "left").drop(id_, row)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["kept string", "n_words long", "n_removed long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=SMALL_SLICE):
            words = Words(batch.column("text"))
            spans = batch.column(lost)
            keep = np.ones(len(words), bool)
            touched = spans.is_valid().to_numpy(zero_copy_only=False)
            lists = spans.to_pylist() if touched.any() else []
            for i in np.flatnonzero(touched).tolist():
                base = int(words.first[i])
                for s in lists[i]:
                    keep[base + s["a"] : base + s["b"]] = False
            n_words = np.diff(words.first)
            left = np.add.reduceat(np.append(keep, False).astype(np.int64), words.first[:-1]) if len(n_words) else n_words
            left = np.where(n_words > 0, left, 0)
            kept = words.joined(keep if touched.any() else None).cast(pa.string())
            if keep_layout:
                import pyarrow.compute as pc

                kept = pc.if_else(pa.array(left == n_words), batch.column("text").cast(pa.string()), kept)
            columns = [batch.column(c) for c in own] + [kept, pa.array(n_words), pa.array(n_words - left)]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, "kept", "n_words", "n_removed"])
        trim_memory()

    return joined.select(*own, lost).mapInArrow(run, schema)
