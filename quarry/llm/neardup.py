"""MinHash near-duplicate detection with bottom-k sketches of one hash function.

A document's set is its distinct word shingles, hashed. Documents with one set are one class, and
only its smallest doc_id goes on. A sketch is the K smallest hashes of a set. Inverted lists are
kept for the retained values, each together with the next two in the sketch, since a single common
shingle says little. Two sets of Jaccard similarity 0.8 share no such triple with probability
1.43 ** -K, about 1e-10: in the order of hashes each element of their union is in both with
probability 0.8, and what is looked for is any three in a row. Sets of 6 to K elements always share
one (of u elements in the union at most u / 5 part the others into runs, one of which has three);
smaller ones are listed by pairs.

Lists generate overlaps in three ways, so that a large list costs a multiple of its length:
1. every member with the smallest member of the list, first for each member the one that shares most
   of its lists, then the others that are still in another component;
2. members of crowded lists with a few drawn partners each, which joins large groups of copies;
3. members of different components so far, where a list's cross pairs are few;
4. of the rest, a member with fewer than SAFE crowded lists has other lists with any partner
   (two similar sets share fewer than SAFE triples with probability 1.4e-8); members with more
   are compared by the rarest fifth of their full sets, which an exact argument says must meet,
   and paired only if their bits, which no similar pair can fail, allow it.
Pairs are filtered by size and by the estimate of the union's sketch, then verified on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, Words, mix, sliced
from quarry.llm.components import components

K = 64
#: K, the triples and LEAST_SHARED are made for similarities of at least so many hundredths.
LEAST_PERCENT = 80
#: Of the K smallest of a union at least so many must be in both; at 0.8, fewer come with chance 1e-9.
LEAST_SHARED = 28
CROWDED = 100
SAFE = 3
#: Partners drawn for each member of crowded lists, from parts of about so many members.
DRAWS, PART = 6, 64
#: Bits by which sets from crowded lists are compared before they are paired.
BITS = 1024
#: Ids of documents whose sets are wanted are sent to all executors up to this many (8 MB).
MOST_BROADCAST = 1 << 20
#: Sets up to this size are listed by pairs, those from TRIPLES on by triples.
PAIRS, TRIPLES = 7, 5


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer than ``size`` words the whole."""
    h = words.hashes()
    x = np.zeros_like(h)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    for k in range(size):
        x = x * np.uint64(0xD1342543DE82EF95) + padded[k : k + len(h)]
    x = mix(x, 4)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(x[a : b - size + 1])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for value in h[a:b]:
                whole = mix(whole * np.uint64(0xD1342543DE82EF95) + value, 5)
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, f1, f2, sketch: size of the set, its 128-bit fingerprint, its K smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for s in shingle_sets(Words(batch.column("text"), lower=True), size):
                f1, f2 = (int(mix(s, seed).sum(dtype=np.uint64)) - (1 << 63) for seed in (6, 7))
                rows.append((len(s), f1, f2, s[:K].tobytes()))
            n, f1, f2, sketch = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sketch, pa.binary())], names=["doc_id", "n", "f1", "f2", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sketch binary")


def entries(reps: DataFrame) -> DataFrame:
    """key, rep, n: the inverted lists of neighbouring retained values."""
    step = np.uint64(0xD1342543DE82EF95)

    def keys(s: np.ndarray) -> np.ndarray:
        two = s[:-1] * step + s[1:]
        out = []
        if len(s) <= PAIRS:
            out.append(mix(two, 8))
        if len(s) >= TRIPLES:
            out.append(mix(two[:-1] * step + s[2:], 9))
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [keys(np.frombuffer(x, np.uint64)) for x in batch.column("sketch").to_pylist()]
            count = np.array([len(p) for p in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(batch.column("rep").to_numpy(), count)), pa.array(np.repeat(batch.column("n").to_numpy(), count))], names=["key", "rep", "n"])

    return reps.select("rep", "n", "sketch").mapInArrow(run, "key long, rep long, n long")


def sizes_allow(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _flag_pairs(pairs: DataFrame, column: str, keep) -> DataFrame:
    """The pairs (a, b) for which keep(set of a, set of b) holds; rows carry both as x and y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
                good = [keep(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.mapInArrow(run, "a long, b long")


def _with_both(pairs: DataFrame, sets: DataFrame, value: str) -> DataFrame:
    return pairs.join(sets.select(F.col("rep").alias("a"), F.col(value).alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col(value).alias("y")), "b").select("a", "b", "x", "y")


def _estimate(percent: int):
    def keep(x: np.ndarray, y: np.ndarray) -> bool:
        both = np.sort(np.concatenate([x, y]))
        twice = both[1:][both[1:] == both[:-1]]
        if len(x) < K and len(y) < K:
            return len(twice) * 100 >= percent * (len(both) - len(twice))
        union = np.unique(both)
        return int(np.searchsorted(twice, union[min(K, len(union)) - 1], side="right")) >= LEAST_SHARED

    return keep


def _exact(percent: int):
    def keep(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both * 100 >= percent * (len(x) + len(y) - both)

    return keep


class NearDuplicates:
    """One run of near-duplicate detection; see the module for the method."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs, size, percent
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "neardup")
        self.step = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.step += 1
        return self.scratch.write(df, f"{name}_{self.step}")

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id of each row of docs with a doc_id."""
        size = self.size
        docs = self.docs.where(F.col("doc_id").isNotNull())
        rows = self.write(sketches(docs, size), "rows")
        reps = rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
        # a doc_id may come with several texts: its classes are one component
        members = self.write(reps, "reps")
        lists = entries(members)
        heads = lists.groupBy("key").agg(F.min("rep").alias("head"), F.min_by("n", "rep").alias("head_n"), F.count("*").alias("m")).where("m > 1")
        shared = self.write(lists.join(heads, "key"), "lists")
        stars = shared.where((F.col("rep") != F.col("head")) & sizes_allow(F.col("n"), F.col("head_n"), self.percent))
        stars = stars.groupBy(F.col("head").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("overlap"))
        stars = self.write(stars, "stars")
        self.sketch_of = members.select("rep", "sketch")
        best = stars.groupBy("b").agg(F.max_by("a", F.struct("overlap", -F.col("a"))).alias("a"))
        links = self.write(self.verify(self.estimated(best.select("a", "b"))), "links")
        label = components(links, self.scratch, f"cc{self.step}")
        label = self.write(label, "label")
        drawn = self.write(self.drawn_pairs(self.open_lists(shared, label).where(F.col("cross") > CROWDED)), "drawn")
        links = self.write(links.unionByName(self.verify(self.estimated(drawn))), "links")
        label = self.write(components(links, self.scratch, f"cc{self.step}"), "label")
        # of a group of copies one component is left by now, so few pairs are left of others
        rest = self.different(stars, label).unionByName(self.cross_pairs(self.write(self.open_lists(shared, label), "open"))).distinct()
        links = self.write(links.unionByName(self.verify(self.estimated(self.write(rest, "rest")))), "links")
        same = rows.where("n > 0").join(members.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"]).select("doc_id", "rep")
        repeated = same.where(F.col("doc_id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        links = links.select("a", "b").unionByName(repeated)
        label = components(links, self.scratch, f"cc{self.step}")
        out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(label.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))

    def different(self, pairs: DataFrame, label: DataFrame) -> DataFrame:
        """The pairs whose ends are not yet in one component."""
        a, b = (label.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in ("a", "b"))
        joined = pairs.select("a", "b").join(a, "a", "left").join(b, "b", "left")
        return joined.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """The pairs that their sketches don't rule out."""
        return _flag_pairs(_with_both(pairs, self.sketch_of, "sketch"), "sketch", _estimate(self.percent))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are similar on full sets."""
        pairs = self.write(pairs, "pairs")
        needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        sets = self.write(self.sets_of(needed), "sets")
        return _flag_pairs(_with_both(pairs, sets, "set"), "set", _exact(self.percent)).distinct()

    def sets_of(self, needed: DataFrame) -> DataFrame:
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                sets = [s.tobytes() for s in shingle_sets(Words(batch.column("text"), lower=True), size)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["rep", "set"])

        needed = self.write(needed, "needed")
        if needed.count() <= MOST_BROADCAST:  # else both sides are shuffled
            needed = F.broadcast(needed)
        docs = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needed, "doc_id", "left_semi")
        return docs.mapInArrow(run, "rep long, set binary")

    def open_lists(self, shared: DataFrame, label: DataFrame) -> DataFrame:
        """The lists whose members are still in several components, with the number of their pairs
        across components."""
        named = shared.select("key", "rep", "n", "m").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        of_component = named.groupBy("key", "component").agg(F.count("*").alias("c"))
        per_list = of_component.groupBy("key").agg(F.count("*").alias("k"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).cast("long").alias("cross")).where("k > 1").select("key", "cross")
        return named.join(per_list, "key").select("key", "rep", "n", "m", "component", "cross")

    def drawn_pairs(self, lists: DataFrame) -> DataFrame:
        """For each member DRAWS partners: lists are dealt at random into parts of about PART, and of
        the smallest hashes of a part, by DRAWS hash functions, a member takes the smallest of all its
        parts. So the members of a large group meet the same few partners, though no part is large."""
        parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("m") / PART, F.lit(1.0))))).cast("long")
        dealt = lists.select("key", F.xxhash64("key", "rep").bitwiseAND(parts - 1).alias("part"), "rep", "n", "component")
        heads = dealt.groupBy("key", "part").agg(*[F.min(F.struct(F.xxhash64(F.lit(i), "rep").alias("mark"), "rep", "n", "component")).alias(f"h{i}") for i in range(DRAWS)])

        def taken(i: int) -> Column:
            head = F.col(f"h{i}")
            return F.min(F.when((head["component"] != F.col("component")) & sizes_allow(F.col("n"), head["n"], self.percent), F.struct(head["mark"].alias("mark"), head["rep"].alias("rep")))).alias(f"t{i}")

        found = dealt.join(heads, ["key", "part"]).groupBy(F.col("rep").alias("b")).agg(*[taken(i) for i in range(DRAWS)])
        pairs = found.select("b", F.explode(F.array_compact(F.array(*[F.col(f"t{i}.rep") for i in range(DRAWS)]))).alias("a"))
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def cross_pairs(self, lists: DataFrame) -> DataFrame:
        """Pairs from lists whose members are still in several components."""
        few = lists.where(F.col("cross") <= CROWDED).select("key", "rep", "n", "component")
        pairs = self._cross(few)
        bound = lists.where(F.col("cross") > CROWDED).groupBy("rep", "n", "component").agg(F.count("*").alias("crowded")).where(F.col("crowded") >= F.least(F.lit(SAFE), F.greatest(F.col("n") - 2, F.lit(1))))
        bound = self.write(bound.select("rep", "n", "component"), "bound")
        if not bound.isEmpty():
            pairs = pairs.unionByName(self._cross(self.rarest(bound))).distinct()
        return pairs

    def _cross(self, lists: DataFrame) -> DataFrame:
        """Distinct pairs of ``_met``."""
        return self._met(lists).distinct()

    def _met(self, lists: DataFrame) -> DataFrame:
        """Pairs of members of one list in different components, of sizes that allow similarity and,
        where the lists have ``bits``, of bits that do: each bit that one set has and the other has
        not is an element that only one of them has. Where they have ``rest``, the number of a set's
        elements from the list's on: at the first element that two sets share, the smaller ``rest``
        bounds what they share, so a pair is left out of the lists where that is too little; similar
        sets always meet at their first one."""
        left, right = (lists.select("key", *[F.col(c).alias(f"{c}_{x}") for c in lists.columns if c != "key"]) for x in ("a", "b"))
        n_a, n_b = F.col("n_a"), F.col("n_b")
        allowed = (F.col("rep_a") < F.col("rep_b")) & (F.col("component_a") != F.col("component_b")) & sizes_allow(n_a, n_b, self.percent)
        if "bits" in lists.columns:
            words = [F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(BITS // 64)]
            allowed &= reduce(Column.__add__, words) * (100 + self.percent) <= (n_a + n_b) * (100 - self.percent)
        if "rest" in lists.columns:
            allowed &= F.least("rest_a", "rest_b") * (100 + self.percent) >= (n_a + n_b) * self.percent
        return left.join(right, "key").where(allowed).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))

    def rarest(self, bound: DataFrame) -> DataFrame:
        """Lists of single shingles: for a set of n, its n - ceil(0.8 n) + 1 rarest among ``bound``,
        with the number of its elements from there on (``rest``) and BITS bits of the whole set.

        In an order that is the same for all, two sets that share that many of their elements share
        one of these.
        """

        def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [np.frombuffer(x, np.int64) for x in batch.column("set").to_pylist()]
                count = np.array([len(s) for s in sets], np.int64)
                for a in range(0, len(sets), 256):
                    own = slice(a, a + 256)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets[own])), pa.array(np.repeat(batch.column("rep").to_numpy()[own], count[own]))], names=["key", "rep"])

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                has = np.zeros((batch.num_rows, BITS), bool)
                for row, x in enumerate(batch.column("set").to_pylist()):
                    has[row, (np.frombuffer(x, np.uint64) % np.uint64(BITS)).astype(np.int64)] = True
                words = np.packbits(has, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(list(words), pa.list_(pa.int64()))], names=["rep", "bits"])

        sets = self.write(self.sets_of(bound.select(F.col("rep").alias("doc_id"))), "sets")
        found = self.write(sets.mapInArrow(elements, "key long, rep long"), "elements")
        often = found.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
        # elements found once can't be shared, but come first in the order: they use up places
        ranked = found.join(often, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("x"))
        ranked = ranked.join(bound, "rep").withColumn("single", F.col("n") - F.size("x"))
        places = F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1 - F.col("single")
        taken = ranked.where(places > 0).select("rep", "n", "component", F.size("x").alias("size"), F.posexplode(F.slice("x", F.lit(1), places.cast("int"))).alias("at", "e"))
        return taken.select(F.col("e.key").alias("key"), "rep", "n", "component", (F.col("size") - F.col("at")).alias("rest")).join(sets.mapInArrow(bits, "rep long, bits array<long>"), "rep")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text) that has a doc_id.

    Two documents are linked when their sets of ``size``-word shingles (A-Z lower-cased) have a
    Jaccard similarity of ``percent`` (80 to 100; the sketches are made for no less, so other values
    raise ValueError) or more; a component is named by its smallest doc_id. With
    fewer words than ``size`` the whole sequence is one shingle; null or empty texts have none and
    are linked with nothing. Rows that repeat a doc_id are one node, with the links of all their
    texts. Rows without doc_id and other columns are left out. An empty table gives no rows.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100")
    return NearDuplicates(docs.select("doc_id", "text"), size, percent).run()
