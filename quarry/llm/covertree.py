"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data share one index. Its top level is a set of at most CENTERS centres; every vector
belongs to the nearest one, and a centre's vectors form blocks of about BLOCK. Inside a block a
cover tree is built over the data and one over each group of queries. A pair of a query node and a
data node is dropped when no pair of their vectors can reach the worst k-th score of the node's
queries: with centres c, e and covering radii r, s the inner product of any two is at most
c.e + r|e| + s|c| + rs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, bound_batches, shuffle_partitions

CENTERS = 512
#: Distinct vectors that the centres are chosen from; the choice decides speed, never results.
CANDIDATES = 4096
BLOCK = 2048
QUERY_GROUP = 1024
LEAF = 48
FAN = 12
#: Room for rounding in the bounds, which are compared with integers.
SLACK = 1e-6
LOWEST = np.iinfo(np.int64).min


def farthest_first(x: np.ndarray, most: int, until: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Up to ``most`` centres, each the point farthest from those before, until all points are
    within ``until``; the nearest centre of each point and its distance."""
    centers, owner = [0], np.zeros(len(x), np.int64)
    distance = np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(centers) < most:
        far = int(np.argmax(distance))
        if distance[far] <= until:
            break
        d = np.sqrt(((x - x[far]) ** 2).sum(1))
        nearer = d < distance
        owner[nearer] = len(centers)
        distance[nearer] = d[nearer]
        centers.append(far)
    return centers, owner, distance


class Node:
    __slots__ = ("center", "norm", "radius", "rows", "children")

    def __init__(self, x: np.ndarray, rows: np.ndarray, at: int):
        self.center = x[at]
        own = x[rows]
        self.norm = float(np.sqrt(self.center @ self.center))
        self.radius = float(np.sqrt(((own - self.center) ** 2).sum(1).max()))
        self.rows = rows
        self.children: list[Node] = []
        if len(rows) > LEAF and self.radius > 0:
            local = np.concatenate([[at], rows[rows != at]])
            centers, owner, _ = farthest_first(x[local], FAN, self.radius / 2)
            if len(centers) > 1:
                self.children = [Node(x, np.sort(local[owner == j]), int(local[c])) for j, c in enumerate(centers)]


def cover_tree(x: np.ndarray) -> Node:
    """Each node covers its rows within its radius; a child's radius is about half its parent's, or
    as small as FAN children allow. Equal points stay in one leaf."""
    at = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    return Node(x, np.arange(len(x)), at)


class Best:
    """The k best rows for each query so far: of equal scores the smaller row, rows being in order of
    id. ``worst`` is what a score must reach."""

    def __init__(self, n_queries: int, n_rows: int, bars: np.ndarray, k: int):
        self.n, self.k = n_rows, k
        self.keys = np.full((n_queries, k), LOWEST, np.int64)  # score * n + (n - 1 - row)
        self.worst = bars.astype(np.float64)

    def offer(self, q: np.ndarray, rows: np.ndarray, queries: np.ndarray, data: np.ndarray) -> None:
        scores = np.rint(queries[q].astype(np.float64) @ data[rows].astype(np.float64).T).astype(np.int64)
        keys = scores * self.n + (self.n - 1 - rows)
        keys[scores < self.worst[q, None]] = LOWEST
        hit = np.flatnonzero((keys > LOWEST).any(1))
        if len(hit):
            merged = np.concatenate([self.keys[q[hit]], keys[hit]], 1)
            merged = np.partition(merged, merged.shape[1] - self.k, 1)[:, -self.k :]
            self.keys[q[hit]] = merged
            kth = merged.min(1)
            self.worst[q[hit]] = np.where(kth == LOWEST, self.worst[q[hit]], np.maximum(self.worst[q[hit]], kth // self.n))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, row, score."""
        q, place = np.nonzero(self.keys > LOWEST)
        score, at = np.divmod(self.keys[q, place], self.n)
        return q, self.n - 1 - at, score


class WideBest:
    """The same for products that a double or a 64-bit key can't hold, in whole numbers of any size;
    scores beyond 64 bits are given as the nearest 64-bit number."""

    def __init__(self, n_queries: int, n_rows: int, bars: np.ndarray, k: int):
        self.k = k
        self.lists: list[list[tuple[int, int]]] = [[] for _ in range(n_queries)]
        self.worst = bars.astype(np.float64)

    def offer(self, q: np.ndarray, rows: np.ndarray, queries: np.ndarray, data: np.ndarray) -> None:
        scores = queries[q].astype(object) @ data[rows].astype(object).T
        minus = (-rows).tolist()
        for i, own in zip(q.tolist(), scores.tolist(), strict=True):
            best = heapq.nlargest(self.k, [*self.lists[i], *zip(own, minus, strict=True)])
            self.lists[i] = best
            if len(best) == self.k:
                self.worst[i] = max(self.worst[i], float(best[-1][0]))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = [(i, -minus, min(max(score, LOWEST + 1), -LOWEST - 1)) for i, own in enumerate(self.lists) for score, minus in own]
        q, rows, scores = (np.array(x, np.int64) for x in zip(*flat, strict=True)) if flat else (np.zeros(0, np.int64),) * 3
        return q, rows, scores


def search(queries: np.ndarray, data: np.ndarray, tree: Node, bars: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, row of data, score: the k best rows for each query, or all if there are fewer; rows
    below a query's bar may be left out. ``queries`` and ``data`` hold whole numbers, ``tree`` is over
    ``data`` as doubles, whose rounding SLACK covers."""
    points = queries.astype(np.float64)
    reach = float(np.sqrt((points**2).sum(1).max()) * np.sqrt((data.astype(np.float64) ** 2).sum(1).max()))
    kind = Best if reach < 2**52 and reach * len(data) < 2**61 else WideBest
    best = kind(len(queries), len(data), bars, k)
    stack = [(cover_tree(points), tree)]

    def bound(q: Node, d: Node) -> float:
        return float(q.center @ d.center) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius

    while stack:
        q, d = stack.pop()
        reach = bound(q, d)
        if reach + SLACK * (1 + abs(reach)) < best.worst[q.rows].min():
            continue
        if not q.children and not d.children:
            best.offer(q.rows, d.rows, queries, data)
        elif d.children and (not q.children or d.radius >= q.radius):
            stack += sorted(((q, c) for c in d.children), key=lambda p: bound(*p))
        else:
            stack += [(c, d) for c in q.children]
    return best.found()


def _vectors(column: pa.Array) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), np.int64)
    return data.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def quantized(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, vec: each component floor(scale * x), as little-endian 64-bit integers. Rows without
    vec_id, and vectors that are null, empty or hold a null or non-finite component, or one whose
    floor(scale * x) needs more than 64 bits, are left out."""
    bound_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if vec_id is None or not v or any(x is None for x in v):
                    continue
                x = np.floor(scale * np.asarray(v, np.float64))
                if np.isfinite(x).all() and np.abs(x).max() < 2**63:
                    ids.append(vec_id)
                    out.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, vec binary")


def _centers(rows: DataFrame) -> dict[int, np.ndarray]:
    """Centres for each vector length, at most CENTERS of each."""
    found = rows.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(CANDIDATES).collect()
    out = {}
    for size in {len(r["vec"]) for r in found}:
        x = np.array([np.frombuffer(r["vec"], np.int64) for r in found if len(r["vec"]) == size], np.float64)
        picked, _, _ = farthest_first(x, max(1, min(CENTERS, len(x) // 64)))
        out[size] = x[picked]
    return out


def top_k(vectors: DataFrame, k: int, is_query: Column) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that ``is_query`` holds for, its k rows
    of largest inner product, itself left out, ties to the smaller vec_id; all, if there are fewer.

    ``vectors`` has vec_id and vec (see ``quantized``); is_query is over vec_id. Vectors of another
    length than the query's take no part. Of equal vectors only the k + 1 smallest ids can be in a
    result, so only these are searched, and equal queries are searched once. A row that repeats a
    vec_id and vector is a candidate each time, and is asked once; rows of the query's vec_id are its
    own. Scores are exact; one beyond 64 bits is given as the nearest 64-bit number. An empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    n = shuffle_partitions(spark)
    by_id = Window.partitionBy("vec").orderBy("vec_id")
    all_rows = scratch.write(vectors.groupBy("vec_id", "vec").agg(F.count("*").alias("copies")), "all")
    asked = all_rows.where(is_query).select("vec").distinct().withColumn("asked", F.lit(True))
    kept = all_rows.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    centers = _centers(all_rows)
    if not centers:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            center, distance = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            size = np.array([len(v) for v in batch.column("vec").to_pylist()], np.int64)
            for length, c in centers.items():
                own = np.flatnonzero(size == length)
                if len(own):
                    x = _vectors(batch.column("vec").take(pa.array(own))).astype(np.float64)
                    d = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]).clip(0)
                    center[own] = d.argmin(1)
                    distance[own] = np.sqrt(((x - c[center[own]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(center), pa.array(distance), pa.array(size)], names=[*batch.schema.names, "center", "distance", "size"])

    # a vector length that no candidate has gets no centre: it is its own (rare) block, number -1
    placed = kept.join(asked, "vec", "left").select("vec_id", "vec", "copies", "nth", F.coalesce("asked", F.lit(False)).alias("asked"))
    placed = scratch.write(placed.mapInArrow(place, "vec_id long, vec binary, copies long, nth int, asked boolean, center int, distance double, size long"), "placed")
    summary = placed.groupBy("size", "center").agg(F.count("*").alias("n"), F.max("distance").alias("r"), F.sum(F.when(F.col("asked") & (F.col("nth") == 1), 1).otherwise(0)).alias("q"))
    info = {(r["size"], r["center"]): r for r in summary.collect()}
    number = {key: i for i, key in enumerate(sorted(info))}

    def lookup(value) -> Column:
        return F.create_map(*[F.lit(x) for key, i in number.items() for x in (f"{key[0]}/{key[1]}", value(info[key], i))])[F.concat_ws("/", "size", "center")]

    cell = lookup(lambda r, i: i)
    blocks = lookup(lambda r, i: -(-r["n"] // BLOCK))
    groups = lookup(lambda r, i: max(1, -(-r["q"] // QUERY_GROUP)))
    salt = lambda of, seed: F.pmod(F.xxhash64(F.lit(seed), "vec", "vec_id"), of).cast("int")
    data = placed.select(cell.alias("cell"), salt(blocks, 1).alias("part"), "vec_id", "vec", "copies")
    queries = placed.where(F.col("asked") & (F.col("nth") == 1)).select(cell.alias("qcell"), salt(groups, 2).alias("qpart"), "vec")
    n_blocks = {number[key]: -(-r["n"] // BLOCK) for key, r in info.items()}

    def answer(sent: DataFrame) -> DataFrame:
        """sent: queries with the block (cell, part) that they go to and their bar."""
        rows = data.select("cell", "part", F.lit(0).alias("kind"), F.lit(0).alias("qcell"), F.lit(0).alias("qpart"), "vec_id", "vec", "copies", F.lit(0).cast("long").alias("bar"))
        rows = rows.unionByName(sent.select("cell", "part", F.lit(1).alias("kind"), "qcell", "qpart", F.lit(0).cast("long").alias("vec_id"), "vec", F.lit(0).cast("long").alias("copies"), "bar"))
        rows = rows.repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "kind", "qcell", "qpart", "vec_id")
        return rows.mapInArrow(lambda batches: _search_blocks(batches, k + 1), "vec binary, vec_id long, score long, copies long")

    low = F.lit(LOWEST + 1).cast("long")
    home = queries.select(F.col("qcell").alias("cell"), F.explode(F.sequence(F.lit(0), _of_cell(n_blocks, "qcell") - 1)).alias("part"), "qcell", "qpart", "vec", low.alias("bar"))
    best = Window.partitionBy("vec").orderBy(F.desc("score"), "vec_id")
    near = scratch.write(answer(home).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1), "near")
    bars = near.where(F.col("nth") == k + 1).select("vec", F.col("score").alias("bar"))
    queries = scratch.write(queries.join(bars, "vec", "left").select("qcell", "qpart", "vec", F.coalesce("bar", low).alias("bar")), "queries")
    worst = {r["qcell"]: r["bar"] for r in queries.groupBy("qcell").agg(F.min("bar").alias("bar")).collect()}
    targets = _targets(info, number, centers, worst)
    # pairs of cells: at most CENTERS ** 2 for each length of vectors
    to = spark.createDataFrame([(q, cell) for q, cells in targets.items() for cell in cells], "qcell int, cell int")
    sent = queries.join(F.broadcast(to), "qcell").withColumn("part", F.explode(F.sequence(F.lit(0), _of_cell(n_blocks, "cell") - 1)))
    found = answer(sent).unionByName(near.select("vec", "vec_id", "score", "copies"))
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    asking = all_rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("asked"))
    pairs = asking.join(found.withColumnRenamed("vec", "asked"), "asked").where(F.col("query_id") != F.col("vec_id"))
    # no more copies than can be in a result
    pairs = pairs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return pairs.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _of_cell(values: dict[int, int], column: str) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])[F.col(column)]


def _targets(info: dict, number: dict, centers: dict, worst: dict) -> dict[int, list[int]]:
    """For each cell of queries the other cells that its worst k-th score doesn't rule out."""
    out: dict[int, list[int]] = {}
    for (size, qc), i in number.items():
        if i not in worst:
            continue
        own = [(key, j) for key, j in number.items() if key[0] == size and j != i]
        out[i] = []
        for (_, dc), j in own:
            if qc >= 0 and dc >= 0:
                a, b = centers[size][qc], centers[size][dc]
                r, s = info[size, qc]["r"], info[size, dc]["r"]
                reach = float(a @ b) + r * float(np.sqrt(b @ b)) + s * float(np.sqrt(a @ a)) + r * s
                if reach + SLACK * (1 + abs(reach)) < worst[i]:
                    continue
            out[i].append(j)
    return out


def _search_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: the data of a block, then its groups of queries. One block and one
    group of queries are in memory at a time."""
    block = group = tree = ids = copies = data = None
    held: list[pa.RecordBatch] = []

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal tree, ids, copies, data
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        if group == (0, 0, 0):
            ids, copies, data = rows.column("vec_id").to_numpy(), rows.column("copies").to_numpy(), _vectors(rows.column("vec"))
            tree = cover_tree(data.astype(np.float64))
        elif data is not None and len(data):
            q, row, score = search(_vectors(rows.column("vec")), data, tree, rows.column("bar").to_numpy(), k)
            out = [rows.column("vec").take(pa.array(q)), pa.array(ids[row]), pa.array(score), pa.array(copies[row])]
            yield pa.RecordBatch.from_arrays(out, names=["vec", "vec_id", "score", "copies"])

    for batch in batches:
        names = ["cell", "part", "kind", "qcell", "qpart"]
        keys = np.stack([batch.column(c).to_numpy() for c in names], 1)
        cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if a == b:
                continue
            key = tuple(keys[a].tolist())
            if (key[:2], key[2:]) != (block, group):
                yield from settle()
                if key[:2] != block:
                    tree = ids = copies = data = None
                block, group = key[:2], key[2:]
            held.append(batch.slice(a, b - a))
    yield from settle()
