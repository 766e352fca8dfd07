"""Scores of texts under a unigram base and under a causal self-attention model of subword ids.

The model reads a text as the ids of its lower-cased words (each with a space in front) and an end
id; every id of the tokenizer counts. Ids are clustered by what stands around them, into FINE classes
that the model reads and COARSE ones that it predicts:

    P(id | ids before) = P(coarse class | context) * P(id | coarse class, fine class before)

The second factor and a prior of the first, P(coarse class | the two fine classes before), are
smoothed counts over all training documents. One head of causal self-attention over the last ids adds
its logits to the prior's. It is trained in numpy on all windows of all training documents, by shards
of about SHARD_IDS ids that a hash of the document chooses; a shard goes through its documents in an
order that their contents give, and the shards' weights are averaged in whole numbers. So the model
depends on the documents and not on how they are partitioned. All of its tables have a fixed size,
whatever the corpus: FINE * FINE * COARSE and FINE times the vocabulary.

A text is scored in blocks of BLOCK ids, each attending to itself and the block before: windows of
2 * BLOCK that overlap by half, in which every id is scored once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, Words, sliced, text_bytes, text_lengths, trim_memory
from quarry.llm.packing import ByteBPE, byte_bpe, forget_encoders

#: The end of a text among its words; no word holds it.
END = "\n"
FINE, COARSE = 256, 64
#: Ids that are classes of their own, the most frequent ones; as many clusters hold the others.
FINE_SINGLES, COARSE_SINGLES = 128, 32
WIDTH, BLOCK = 16, 16
SPAN = 2 * BLOCK
#: What an id is clustered by: the BANDS - 1 most frequent ids, and the others, at these distances.
BANDS, DISTANCES = 48, (1, -1, 6)
CLUSTER_ROUNDS, CLUSTER_PRIOR = 15, 20.0
PAIR_PRIOR, CLASS_PRIOR, WITHIN_PRIOR, ID_PRIOR = 5.0, 8.0, 4.0, 0.05
#: log10 P(id | coarse class, fine class before) is held in 16 bits, in steps of 1 / STEPS.
STEPS = 2048
SHARD_IDS, BUFFER, BATCH, RATE = 4_000_000, 4096, 64, 0.01
FIXED_POINT = 1 << 12
#: Rows of logits handled at a time; scores and logits that can't be larger need no maximum taken out.
ROWS, SAFE = 512, 40.0
#: Words whose counts every worker holds; the others' are joined.
HEAD = 1 << 17
SLICE = 1 << 20


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # sooner than to_pylist


def ids_of_texts(w: Words, codes: np.ndarray, words: list[str], n_bytes: np.ndarray, encode: ByteBPE, end: int, id_type: str) -> pa.Array:
    """The ids of a slice's texts, those of their words, each after a space, and ``end``, as binary of
    ``id_type``. ``words`` are the slice's distinct words, ``codes`` which of them each word is."""
    ids, count, odd = encode.of_words(words, n_bytes)
    ids, count = np.append(ids, end).astype(id_type), np.append(count, 1)
    codes = np.insert(codes, w.first[1:], len(words))
    length = count[codes]
    ends = np.cumsum(length)
    ids = ids[np.repeat((np.cumsum(count) - count)[codes] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]
    bounds = np.append(0, ends[w.first[1:] + np.arange(len(w.first) - 1)]) * ids.itemsize
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.first) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
    if odd.any():
        whole = np.add.reduceat(np.append(odd, False)[codes], np.append(0, w.first[1:-1] + np.arange(1, len(w.first) - 1)))
        last, texts, own = np.array([end], id_type).tobytes(), w.joined(), out.to_pylist()
        for i in np.flatnonzero(whole).tolist():
            own[i] = np.frombuffer(encode(" " + texts[i].as_py()), "<u4").astype(id_type).tobytes() + last
        out = pa.array(own, pa.large_binary())
    return out.cast(pa.binary())


class Streams:
    """The ids of a slice's texts, one text after the other; ``one`` and ``two`` are the ids one and
    two places before in the text, the end id in front of it."""

    def __init__(self, column: pa.Array, id_type: str, end: int):
        data, offsets = text_bytes(column.view(pa.string()))
        self.ids = np.frombuffer(data.tobytes(), id_type).astype(np.int64)
        self.start = offsets[:-1] // np.dtype(id_type).itemsize
        self.length = np.diff(offsets) // np.dtype(id_type).itemsize
        self.one = np.concatenate([[end], self.ids[:-1]])[: len(self.ids)]
        self.one[self.start] = end
        self.two = np.concatenate([[end], self.one[:-1]])[: len(self.ids)]
        self.two[self.start] = end


@dataclass
class Classes:
    """``fine`` and ``coarse`` class of each id, its count, and where to read ids."""

    fine: np.ndarray
    coarse: np.ndarray
    counts: np.ndarray
    id_type: str
    end: int


def _sums(docs: DataFrame, count, size: int, id_type: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all ids of ``docs`` of the keys below ``size`` that ``count`` makes of a slice's
    ``Streams``: the keys, ascending, and how often each came. Summed by task before the shuffle, in
    a table of all keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in sliced(batches, "ids", SLICE):
            np.add.at(sums, count(Streams(batch.column("ids"), id_type, end)), 1)
        keys = np.flatnonzero(sums)
        for a in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000]), pa.array(sums[keys[a : a + 100_000]])], names=["k", "n"])
        del sums
        trim_memory()

    found = docs.select("ids").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = found.column("k").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(k)
    return k[order], n[order]


def _dense(keys: np.ndarray, counts: np.ndarray, *shape: int) -> np.ndarray:
    out = np.zeros(math.prod(shape), np.float32)
    out[keys] = counts
    return out.reshape(shape)


def learn_classes(docs: DataFrame, id_type: str, end: int, vocabulary: int) -> Classes:
    """Clusters of ids, from the counts of their neighbours: at most vocabulary * BANDS numbers for
    each of the DISTANCES reach the driver."""
    counts = _dense(*_sums(docs, lambda s: s.ids, vocabulary, id_type, end), vocabulary).astype(np.float64)
    order = np.argsort(-counts, kind="stable")
    band = np.full(vocabulary, BANDS - 1)
    band[order[: BANDS - 1]] = np.arange(BANDS - 1)

    def around(s: Streams) -> np.ndarray:
        text = np.repeat(np.arange(len(s.length)), s.length)
        out = []
        for i, d in enumerate(DISTANCES):
            a, b = (slice(None, -d), slice(d, None)) if d > 0 else (slice(-d, None), slice(None, d))
            same = text[a] == text[b]
            out.append(((i * vocabulary) + s.ids[a][same]) * BANDS + band[s.ids[b][same]])
        return np.concatenate(out)

    found = _dense(*_sums(docs, around, len(DISTANCES) * vocabulary * BANDS, id_type, end), len(DISTANCES), vocabulary, BANDS)
    features = []
    for k in found:
        share = k.sum(0) / max(k.sum(), 1)
        features.append(np.sqrt((k + CLUSTER_PRIOR * share) / (k.sum(1, keepdims=True) + CLUSTER_PRIOR)))
    x = np.concatenate(features, 1).astype(np.float32)
    return Classes(_clusters(x, counts, order, FINE_SINGLES, FINE), _clusters(x, counts, order, COARSE_SINGLES, COARSE), counts, id_type, end)


def _clusters(x: np.ndarray, counts: np.ndarray, order: np.ndarray, singles: int, n: int) -> np.ndarray:
    """The first ``singles`` of ``order`` by themselves, the others to the nearest of n - singles
    means, which start from the next ones of ``order``."""
    out = np.empty(len(x), np.int64)
    out[order[:singles]] = np.arange(singles)
    rest = order[singles:]
    means = x[rest[: n - singles]].copy()

    def nearest(rows: np.ndarray) -> np.ndarray:
        return ((means**2).sum(1)[None] - 2 * x[rows] @ means.T).argmin(1)

    seen = rest[counts[rest] > 0]
    weight = np.sqrt(counts[seen])
    for _ in range(CLUSTER_ROUNDS if len(seen) else 0):
        own = nearest(seen)
        mass = np.bincount(own, weight, len(means))
        sums = np.zeros(means.shape)
        np.add.at(sums, own, x[seen] * weight[:, None])
        means[mass > 0] = (sums[mass > 0] / mass[mass > 0, None]).astype(np.float32)
    out[rest] = singles + nearest(rest)
    return out


@dataclass
class Tables:
    """``prior``: P(coarse class | two fine classes before), by two * FINE + one; ``within``: log10
    P(id | coarse class, fine class before) in STEPS, by fine class before and id."""

    prior: np.ndarray
    within: np.ndarray

    @classmethod
    def of(cls, classes: Classes, triples: np.ndarray, pairs: np.ndarray) -> Tables:
        """triples: counts by (two, one, coarse class), pairs: by (one, id)."""
        by_class = np.stack([np.bincount(classes.coarse, row, COARSE) for row in pairs])
        total = by_class.sum(0)
        plain = (total + 0.5) / (total.sum() + 0.5 * COARSE)
        after_one = (by_class + PAIR_PRIOR * plain) / (by_class.sum(1, keepdims=True) + PAIR_PRIOR)
        prior = (triples + CLASS_PRIOR * after_one[None]) / (triples.sum(2, keepdims=True) + CLASS_PRIOR)
        mass = classes.counts + ID_PRIOR
        share = mass / np.bincount(classes.coarse, mass, COARSE)[classes.coarse]
        within = np.empty(pairs.shape, np.int16)
        for one, row in enumerate(pairs):
            p = (row + WITHIN_PRIOR * share) / (by_class[one] + WITHIN_PRIOR)[classes.coarse]
            within[one] = np.maximum(np.rint(STEPS * np.log10(p)), -(1 << 15))
        return cls(prior.reshape(FINE * FINE, COARSE).astype(np.float32), within)


def learn_tables(docs: DataFrame, classes: Classes) -> Tables:
    shared = docs.sparkSession.sparkContext.broadcast((classes.fine, classes.coarse))
    vocabulary = len(classes.fine)

    def both(s: Streams) -> np.ndarray:
        fine, coarse = shared.value
        one = fine[s.one]
        return np.concatenate([(fine[s.two] * FINE + one) * COARSE + coarse[s.ids], FINE * FINE * COARSE + one * vocabulary + s.ids])

    keys, counts = _sums(docs, both, FINE * (FINE * COARSE + vocabulary), classes.id_type, classes.end)
    cut = int(np.searchsorted(keys, FINE * FINE * COARSE))
    return Tables.of(classes, _dense(keys[:cut], counts[:cut], FINE, FINE, COARSE), _dense(keys[cut:] - FINE * FINE * COARSE, counts[cut:], FINE, vocabulary))


def start_weights() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    normal = lambda *shape: (rng.standard_normal(shape) / math.sqrt(WIDTH)).astype(np.float32)
    return {
        "embed": normal(FINE, WIDTH), "query": normal(WIDTH, WIDTH), "key": normal(WIDTH, WIDTH), "value": normal(WIDTH, WIDTH),
        "out": 0.1 * normal(WIDTH, COARSE), "near": (-0.02 * np.arange(SPAN)).astype(np.float32),
    }


_DISTANCE = np.arange(SPAN)[:, None] - np.arange(SPAN)[None]
_AHEAD = _DISTANCE < 0
_BEHIND = np.maximum(_DISTANCE, 0)
#: Places of the sums by class of what comes back for queries, keys and values.
_CELLS = np.arange(FINE * 3 * WIDTH).reshape(FINE, 3 * WIDTH)


def windows_of(streams: Streams) -> np.ndarray:
    """Successive windows of SPAN ids that cover each text whole, each with the two ids before it;
    -1 behind the text's end."""
    n = -(-streams.length // SPAN)
    text = np.repeat(np.arange(len(n)), n)
    place = ((np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * SPAN)[:, None] + np.arange(SPAN)[None]
    inside = place < streams.length[text][:, None]
    at = np.where(inside, streams.start[text][:, None] + place, 0)
    if not len(at):
        return np.zeros((0, SPAN + 2), np.int32)
    return np.concatenate([streams.two[at[:, :1]], streams.one[at[:, :1]], np.where(inside, streams.ids[at], -1)], 1).astype(np.int32)


def gradients(weights: dict[str, np.ndarray], windows: np.ndarray, classes: Classes, prior: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean of -ln P(coarse class | context) over the ids of some windows, and its gradient.

    Queries, keys and values depend on a fine class, not on a place, so they are rows of small tables.
    The softmax is divided by its sum after it met the values, which have a column of ones for it.
    Rows of logits go by ROWS, which stay near the processor.
    """
    w, scale = weights, np.float32(1 / math.sqrt(WIDTH))
    rows = np.where(windows < 0, classes.end, windows)
    inside = (windows[:, 2:] >= 0).reshape(-1)
    fine = classes.fine.take(rows[:, :-1])
    now, target = fine[:, 1:].reshape(-1), classes.coarse.take(rows[:, 2:]).reshape(-1)
    context = (fine[:, :-1] * FINE + fine[:, 1:]).reshape(-1)
    n = now.size
    q_of, k_of, v_of = w["embed"] @ w["query"] * scale, w["embed"] @ w["key"], w["embed"] @ w["value"]
    kind = v_of.dtype
    places = (-1, SPAN, WIDTH)
    q, k = q_of.take(now, 0).reshape(places), k_of.take(now, 0).reshape(places)
    v = np.concatenate([v_of, np.ones((FINE, 1), kind)], 1).take(now, 0).reshape(-1, SPAN, WIDTH + 1)
    att = q @ k.transpose(0, 2, 1)
    att += np.where(_AHEAD, np.float32(-1e9), w["near"][_BEHIND])
    if _length(q_of) * _length(k_of) + np.abs(w["near"]).max() > SAFE:
        att -= att.max(-1, keepdims=True)
    np.exp(att, out=att)
    o = (att @ v).reshape(n, WIDTH + 1)
    share = 1 / o[:, WIDTH:]
    o *= share
    large = np.abs(v_of @ w["out"]).max() > SAFE
    used = max(int(inside.sum()), 1)
    one = (inside / used).astype(kind)  # places behind a text's end teach nothing
    back, ones = np.ascontiguousarray(w["out"].T), np.ones(COARSE, kind)
    chosen, do, d_out = np.empty(n, kind), np.empty((n, WIDTH + 1), kind), np.zeros((WIDTH, COARSE), kind)
    z_room, prior_room = np.empty((ROWS, COARSE), kind), np.empty((ROWS, COARSE), prior.dtype)
    for a in range(0, n, ROWS):
        b = min(a + ROWS, n)
        z = np.matmul(o[a:b, :WIDTH], w["out"], out=z_room[: b - a])
        if large:
            z -= z.max(-1, keepdims=True)
        np.exp(z, out=z)
        z *= prior.take(context[a:b], 0, out=prior_room[: b - a], mode="clip")
        at = np.arange(b - a) * COARSE + target[a:b]
        total = z @ ones
        chosen[a:b] = z.take(at) / total
        z *= (one[a:b] / total)[:, None]
        z.reshape(-1)[at] -= one[a:b]
        d_out += o[a:b, :WIDTH].T @ z
        do[a:b, :WIDTH] = z @ back
    loss = -float(np.log(chosen[inside]).sum()) / used
    grad = {"out": d_out}
    do[:, WIDTH] = -np.einsum("ij,ij->i", do[:, :WIDTH], o[:, :WIDTH])
    do *= share
    do = do.reshape(v.shape)
    dv = att.transpose(0, 2, 1) @ do[..., :WIDTH]
    datt = do @ v.transpose(0, 2, 1)
    datt *= att
    grad["near"] = np.bincount(_BEHIND[~_AHEAD], datt.sum(0)[~_AHEAD], SPAN).astype(np.float32)
    by_place = np.concatenate([datt @ k, datt.transpose(0, 2, 1) @ q, dv], 2)
    by_class = np.bincount(_CELLS.take(now, 0).reshape(-1), by_place.reshape(-1), _CELLS.size).reshape(_CELLS.shape).astype(np.float32)
    dq, dk, dv = by_class[:, :WIDTH] * scale, by_class[:, WIDTH : 2 * WIDTH], by_class[:, 2 * WIDTH :]
    grad |= {name: w["embed"].T @ d for name, d in (("query", dq), ("key", dk), ("value", dv))}
    grad["embed"] = dq @ w["query"].T + dk @ w["key"].T + dv @ w["value"].T
    return loss, grad


def _length(rows: np.ndarray) -> float:
    """The largest norm of a row."""
    return math.sqrt(float(np.einsum("ij,ij->i", rows, rows).max()))


class Training:
    """Weights under Adam. Windows come in any portions; steps are over BATCH of them, drawn from
    BUFFER successive ones, so portions don't matter. One pass."""

    def __init__(self, classes: Classes, prior: np.ndarray):
        self.classes, self.prior = classes, prior
        start = start_weights()
        self.flat = np.concatenate([v.reshape(-1) for v in start.values()])
        cuts = np.cumsum([v.size for v in start.values()])[:-1]
        self.weights = {k: part.reshape(v.shape) for (k, v), part in zip(start.items(), np.split(self.flat, cuts))}  # views
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.rng, self.step, self.windows = np.random.default_rng(11), 0, 0
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, windows: np.ndarray) -> None:
        self.waiting.append(windows)
        self.n_waiting += len(windows)
        while self.n_waiting >= BUFFER:
            held = np.concatenate(self.waiting)
            self._learn(held[:BUFFER])
            self.waiting, self.n_waiting = [held[BUFFER:]], len(held) - BUFFER

    def finish(self) -> dict[str, np.ndarray]:
        if self.n_waiting:
            self._learn(np.concatenate(self.waiting))
        return self.weights

    def _learn(self, windows: np.ndarray) -> None:
        self.windows += len(windows)
        order = self.rng.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            _, grad = gradients(self.weights, windows[order[a : a + BATCH]], self.classes, self.prior)
            self.step += 1
            g = np.concatenate([grad[k].reshape(-1) for k in self.weights])
            self.first += 0.1 * (g - self.first)
            self.second += 0.01 * (g * g - self.second)
            self.flat -= RATE * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.99**self.step)) + 1e-8)


def learn_attention(docs: DataFrame, classes: Classes, tables: Tables) -> dict[str, np.ndarray]:
    """Weights of the attention, averaged over shards by their windows. ``docs`` has doc_id and ids.

    A shard gives one row for each number of the model, and these are summed in whole numbers."""
    names = {k: v.shape for k, v in start_weights().items()}
    shards = max(1, math.ceil(classes.counts.sum() / SHARD_IDS))
    shared = docs.sparkSession.sparkContext.broadcast((classes, tables.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, prior = shared.value
        training, shard = None, None

        def settle() -> Iterator[pa.RecordBatch]:
            if training is not None:
                weights = training.finish()
                flat = np.concatenate([weights[k].reshape(-1) for k in names]).astype(np.float64)
                values = np.rint(flat * (training.windows * FIXED_POINT)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(values))), pa.array(np.concatenate([[training.windows], values]))], names=["k", "v"])

        for batch in sliced(batches, "ids", SLICE):
            ours = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ours)) + 1).tolist(), len(ours)]
            for a, b in zip(cuts, cuts[1:]):
                if ours[a] != shard:
                    yield from settle()
                    training, shard = Training(classes, prior), ours[a]
                training.add(windows_of(Streams(batch.column("ids").slice(a, b - a), classes.id_type, classes.end)))
        yield from settle()
        training = None
        trim_memory()

    mark = F.xxhash64("doc_id", "ids")
    rows = docs.select(F.pmod(mark, F.lit(shards)).cast("int").alias("shard"), mark.alias("mark"), "doc_id", "ids")
    rows = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "mark", "doc_id", "ids").select("shard", "ids")
    found = rows.mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    v = found.column("v").to_numpy()[np.argsort(found.column("k").to_numpy())]
    weights, at = start_weights(), 1
    if len(v) and v[0]:
        for name, shape in names.items():
            size = math.prod(shape)
            weights[name] = (v[at : at + size] / (v[0] * FIXED_POINT)).reshape(shape).astype(np.float32)
            at += size
    return weights


def log_probabilities(streams: Streams, weights: dict[str, np.ndarray], tables: Tables, classes: Classes, blocks_at_once: int = 32) -> np.ndarray:
    """log10 P(id | the ids before) of each id of the streams."""
    n_blocks = -(-streams.length // BLOCK)
    total = int(n_blocks.sum())
    block_start = np.cumsum(n_blocks) - n_blocks
    text = np.repeat(np.arange(len(n_blocks)), streams.length)
    place = np.arange(len(streams.ids)) - streams.start[text] + block_start[text] * BLOCK
    end_class = classes.fine[classes.end]
    one_class = classes.fine[streams.one]
    now = np.full(total * BLOCK, end_class)
    now[place] = one_class
    context = np.zeros(total * BLOCK, np.int64)
    context[place] = classes.fine[streams.two] * FINE + one_class
    target = np.zeros(total * BLOCK, np.int64)
    target[place] = classes.coarse[streams.ids]
    opening = np.zeros(total, bool)
    opening[block_start] = True
    distance = (np.arange(BLOCK) + BLOCK)[:, None] - np.arange(SPAN)[None]
    near = np.where(distance >= 0, np.exp(weights["near"][np.maximum(distance, 0)]), 0).astype(np.float32)
    # queries, keys and values depend on a class, not on its place: so does the exponential of each
    # pair's score (less its row's largest, which the normalisation takes out)
    pair = (weights["embed"] @ weights["query"]) @ (weights["embed"] @ weights["key"]).T / math.sqrt(WIDTH)
    pair = np.exp(np.maximum(pair - pair.max(1, keepdims=True), -60)).astype(np.float32)
    v_of = weights["embed"] @ weights["value"]
    large = np.abs(v_of @ weights["out"]).max() > SAFE
    v_of = np.concatenate([v_of, np.ones((FINE, 1), v_of.dtype)], 1)  # the last column sums the attention
    out = np.zeros(total * BLOCK, np.float32)
    att_room = np.empty((blocks_at_once, BLOCK, SPAN), pair.dtype)
    prior_room = np.empty((blocks_at_once * BLOCK, COARSE), tables.prior.dtype)
    for a in range(0, total, blocks_at_once):
        b = min(a + blocks_at_once, total)
        here = slice(a * BLOCK, b * BLOCK)
        own = now[here].reshape(-1, BLOCK)
        prior = now[max(a - 1, 0) * BLOCK : (b - 1) * BLOCK].reshape(-1, BLOCK) if a else np.concatenate([own[:1], own[:-1]])
        keys = np.concatenate([prior, own], 1)
        att = pair.take(own[:, :, None] * FINE + keys[:, None, :], out=att_room[: b - a], mode="clip")
        att *= near
        att[opening[a:b], :, :BLOCK] = 0
        o = (att @ v_of.take(keys, 0)).reshape(-1, WIDTH + 1)
        o /= o[:, WIDTH:].copy()
        z = o[:, :WIDTH] @ weights["out"]
        if large:
            z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        p = tables.prior.take(context[here], 0, out=prior_room[: len(z)], mode="clip")
        at = np.arange(len(z)) * COARSE + target[here]
        out[here] = np.log10(z.take(at) * p.take(at) / np.einsum("ij,ij->i", z, p))
    return out[place] + tables.within.take(one_class * tables.within.shape[1] + streams.ids) / np.float32(STEPS)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over all texts, END once a text; summed by task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "c"])
            counts.clear()
            return batch

        for batch in sliced(batches, most=4 << 20):
            found = Words(batch.column("text"), lower=True).array().value_counts()
            for word, n in zip(_strings(found.field("values")), found.field("counts").to_numpy().tolist(), strict=True):
                counts[word] = counts.get(word, 0) + n
            counts[END] = counts.get(END, 0) + batch.num_rows
            if len(counts) > 300_000:
                yield out()
        if counts:
            yield out()
        trim_memory()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def coded(docs: DataFrame, tokenizer: str, end: int, id_type: str, head: pa.Table, n_train: int, room: float) -> DataFrame:
    """Each text's ids, and its base score as far as the words of ``head`` make it: a row number, doc_id,
    training, n_tokens, known, sums, the ids, and the other words, ``tail``. Words are split once."""
    shared = docs.sparkSession.sparkContext.broadcast((head.column("word").to_pylist(), head.column("c").to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cs = shared.value
        position = {w: i for i, w in enumerate(words)}
        log_of = np.log10((np.append(np.array(cs, np.int64), 0) + 0.5) / room)
        at_end, number = position.get(END, -1), TaskContext.get().partitionId() << 33
        encode = byte_bpe(tokenizer)
        for batch in sliced(batches, most=4 << 20):
            n_texts = batch.num_rows
            w = Words(batch.column("text"), lower=True)
            found = w.array().dictionary_encode()
            codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            own = _strings(found.dictionary)
            ids = ids_of_texts(w, codes, own, text_lengths(found.dictionary), encode, end, id_type)
            at = np.array([position.get(x, -1) for x in own], np.int64)[codes]
            text = np.repeat(np.arange(n_texts), np.diff(w.first))
            in_head = at >= 0
            sums = np.bincount(text, np.where(in_head, log_of[at], 0.0), n_texts) + log_of[at_end]
            known = np.bincount(text, in_head, n_texts).astype(np.int64) + (n_train > 0)
            rare = np.flatnonzero(~in_head)
            offsets = np.searchsorted(text[rare], np.arange(n_texts + 1)).astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(offsets), pc.cast(found.dictionary.take(pa.array(codes[rare])), pa.string()))
            columns = [pa.array(np.arange(n_texts) + number), batch.column("doc_id").cast(pa.int64()), batch.column("training"), pa.array(np.diff(w.first) + 1), pa.array(known), pa.array(sums), ids, tail]
            number += n_texts
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "training", "n_tokens", "known", "sums", "ids", "tail"])
        del encode
        forget_encoders()

    return docs.mapInArrow(run, "row long, doc_id long, training boolean, n_tokens long, known long, sums double, ids binary, tail array<string>")


def score(docs: DataFrame, is_training: Column, tokenizer: str, end: int = 50256, vocabulary: int = 50257) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Both models learn from the rows that ``is_training`` holds for, over all their words and ids.
    base_score is the sum over words and the end of log10((c + 0.5) / (N + 0.5 * (V + 1))); score is
    the attention model's log10 probability of the text. Null or empty text: the end alone. Repeated
    rows are scored each. Other columns are left out. With no training rows all counts are 0 and the
    model is untrained. An empty table gives no rows.

    ``docs`` is read twice, to count words and to code the texts, and has to give the same rows.
    Counts of the HEAD most frequent words go to every worker; a text's other words are joined to
    the table of counts by word, which only moves words that are rare in training.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "scoring")
    id_type = "<u2" if vocabulary <= 1 << 16 else "<u4"
    docs = docs.select("doc_id", "text", F.coalesce(is_training, F.lit(False)).alias("training"))
    counts = scratch.write(word_counts(docs.where("training")), "counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, room = totals["n"], totals["n"] + 0.5 * (totals["v"] + 1)
    head = counts.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    texts = scratch.write(coded(docs, tokenizer, end, id_type, head, n_train, room), "coded")
    rare = texts.select("row", F.explode("tail").alias("word")).join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.groupBy("row").agg(F.sum(F.log10((F.col("c") + 0.5) / F.lit(float(room)))).alias("rare"), F.sum((F.col("c") > 0).cast("long")).alias("more"))
    rare = scratch.write(rare, "rare")
    scratch.drop("counts")
    training = texts.where("training").select("doc_id", "ids")
    classes = learn_classes(training, id_type, end, vocabulary)
    tables = learn_tables(training, classes)
    weights = learn_attention(training, classes, tables)
    shared = spark.sparkContext.broadcast((classes, weights, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, weights, tables = shared.value
        for batch in sliced(batches, "ids", SLICE):
            s = Streams(batch.column("ids"), classes.id_type, classes.end)
            logs = log_probabilities(s, weights, tables, classes).astype(np.float64)
            columns = [*batch.columns[:-1], pa.array(np.add.reduceat(logs, s.start))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score"])
        trim_memory()

    scored = texts.select("row", "doc_id", "n_tokens", "known", "sums", "ids").mapInArrow(run, "row long, doc_id long, n_tokens long, known long, sums double, score double")
    scored = scratch.write(scored, "scored")
    scratch.drop("coded")
    out = scored.join(rare, "row", "left")
    return out.select(
        "doc_id", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("rare", F.lit(0.0))).alias("base_score"),
        "score",
    )
