"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are lower-cased runs of word characters. The score of a token is its log-odds between toxic
and other documents, with a Dirichlet prior that gives each token PRIOR documents in the corpus's
own class shares; a token that was not seen often enough scores as its longest known prefix does.
Tokens without evidence cost PENALTY each, so scores drift downwards outside toxic passages. A
linear scan finds all maximal segments of a text. With the Karlin-Altschul parameters lambda and K
of the scores over other documents, a segment of score S in n tokens has lambda * S - ln(K * n)
nats of evidence; a text has that of its best segment, calibrated to a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Words, bound_batches, crc_remainder, mix, sliced, trim_memory
from quarry.llm.neardup import shingle_sets

TOKEN = re.compile(r"\w+")
PREFIXES = (6, 5, 4)
PRIOR = 5.0
PENALTY = 0.1
LEAST_DOCS = 3
LEAST_SCORE, LEAST_Z = 1.5, 3.0
#: Labelled rows to learn from. They bound the tokens that the driver and each worker hold too: only
#: those found in LEAST_DOCS toxic ones, with LEAST_SCORE and LEAST_Z, are.
MOST_LABELLED = 200_000
CACHE_TOKENS = 200_000
#: Labelled rows are copies when all minimal hashes of a band agree: with sets of 3-word shingles of
#: similarity 0.9 with probability 0.95, of 0.5 with 0.06.
BANDS, BAND = 4, 6
BIN = 0.25
LIMIT = 400.0


@dataclass
class Model:
    """scores: of tokens and, marked ``^``, of prefixes; lam, k: Karlin-Altschul parameters;
    slope, offset: of the calibration."""

    scores: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = -2.0

    def evidence(self, scores: list[float], n: int) -> float:
        """Nats of evidence of a text of n tokens whose maximal segments have these scores."""
        room = self.log_k + math.log(max(n, 1))
        if not scores:
            return max(-room, -LIMIT)
        return min(self.lam * max(scores) - room, LIMIT)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * evidence + self.offset))))


class Scores(dict):
    """Score of each token (0: no evidence), by the token or by its longest known prefix."""

    def __init__(self, known: dict[str, float]):
        super().__init__()
        self.known = known

    def __missing__(self, token: str) -> float:
        score = self.known.get(token, 0.0)
        if not score:
            for size in PREFIXES:
                if len(token) > size and (score := self.known.get("^" + token[:size], 0.0)):
                    break
        if len(self) >= CACHE_TOKENS:
            self.clear()
        self[token] = score
        return score


def segments(hits: list[tuple[int, float]], penalty: float = PENALTY) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, after the last token, score) of a text.

    ``hits`` are the positions with positive scores; every other token costs ``penalty``. One pass;
    each candidate is merged once, so time is linear in the hits.
    """
    found: list[list] = []  # first, after last, sum before, sum after, the last one that begins lower
    total, at = 0.0, 0
    for place, score in hits:
        total -= penalty * (place - at)
        first, low = place, total
        total += score
        at = place + 1
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append([first, at, low, total, j])
                break
            # what began lower and ended lower grows into one segment
            first, low = found[j][0], found[j][2]
            del found[j:]
            j -= 1
    return [(a, b, high - low) for a, b, low, high, _ in found]


def hits_of(text: str | None, scores: Scores) -> tuple[list[tuple[int, float]], int]:
    tokens = TOKEN.findall((text or "").lower())
    values = list(map(scores.__getitem__, tokens))
    return [(i, v) for i, v in enumerate(values) if v], len(values)


def labelled(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None, most: int = MOST_LABELLED) -> DataFrame:
    """text, toxic, part of at most ``most`` labelled documents, chosen by a hash of doc_id.

    ``held_out`` (modulus, remainder of crc32(doc_id)) rows are never read. ``part`` 0 teaches token
    scores, part 1 the calibration. Null labels, and doc_ids with several labels, are left out.
    """
    bound_batches(docs.sparkSession)
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    if held_out:
        rows = rows.where(crc_remainder("doc_id", held_out[0]) != held_out[1])
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)) == 0).cast("int").alias("part"))
    # at most `most` rows of 16 bytes, whatever the tables hold
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", "toxic", "part")
    # copies of a document would each repeat its chance words: only the first stays
    marks = rows.select("id", "text").mapInArrow(_marks, "id long, " + ", ".join(f"b{i} long" for i in range(BANDS)))
    first = marks.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"b{i}").alias("b")) for i in range(BANDS)])).alias("x"), "id").groupBy("x").agg(F.min("id").alias("id"))
    kept = first.groupBy("id").count().where(F.col("count") == BANDS).select("id")
    return rows.join(F.broadcast(kept), "id").select("text", "toxic", "part")


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bands of minimal hashes of each row; texts without words have all the same."""
    for batch in sliced(batches):
        bands = np.zeros((BANDS, batch.num_rows), np.uint64)
        for row, s in enumerate(shingle_sets(Words(batch.column("text"), lower=True), 3)):
            for k in range(BANDS * BAND if len(s) else 0):
                at = k // BAND
                bands[at, row] = mix(bands[at, row : row + 1] + mix(s, 11 + k).min())[0]
        yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), *(pa.array(b.view(np.int64)) for b in bands)], names=["id", *(f"b{i}" for i in range(BANDS))])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, toxic and other documents and tokens of a task; the empty token counts all."""
    counts: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        columns = list(zip(*counts.values(), strict=True))
        batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["token", "d1", "d0", "t1", "t0"])
        counts.clear()
        return batch

    for batch in sliced(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            seen: dict[str, int] = {}
            tokens = TOKEN.findall((text or "").lower())
            for t in tokens:
                seen[t] = seen.get(t, 0) + 1
            for t, n in list(seen.items()):
                for size in PREFIXES:
                    if len(t) > size:
                        p = "^" + t[:size]
                        seen[p] = seen.get(p, 0) + n
            seen[""] = len(tokens)
            at = 0 if toxic else 1
            for t, n in seen.items():
                have = counts.get(t)
                if have is None:
                    have = counts[t] = [0, 0, 0, 0]
                have[at] += 1
                have[at + 2] += n
        if len(counts) > 150_000:
            yield out()
    if counts:
        yield out()


def fit(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = (4, 2), most: int = MOST_LABELLED) -> Model:
    """Learns from labelled documents; without toxic and other ones, a model that finds nothing."""
    spark = docs.sparkSession
    rows = labelled(docs, labels, held_out, most)
    counts = rows.where("part = 0").select("text", "toxic").mapInArrow(_count, "token string, d1 long, d0 long, t1 long, t0 long").groupBy("token").agg(*(F.sum(c).alias(c) for c in ("d1", "d0", "t1", "t0")))
    model = Model()
    counts = counts.where((F.col("d1") >= LEAST_DOCS) | (F.col("token") == "")).persist()
    top = counts.where("token = ''").first()
    if top is None or not top["d1"] or not top["d0"]:
        counts.unpersist()
        return model
    share = top["d1"] / (top["d1"] + top["d0"])
    ratio = (F.col("d1") + PRIOR * share) / (F.col("d0") + PRIOR * (1 - share))
    odds = F.log(ratio) - math.log(top["d1"] / top["d0"])
    deviation = F.sqrt(1 / (F.col("d1") + PRIOR * share) + 1 / (F.col("d0") + PRIOR * (1 - share)))
    table = counts.where("token <> ''").withColumn("odds", odds).withColumn("z", odds / deviation).where((F.col("odds") >= LEAST_SCORE) & (F.col("z") >= LEAST_Z))
    found = table.orderBy(F.desc("z"), "token").collect()
    counts.unpersist()
    model.scores = {r["token"]: r["odds"] for r in found}
    # frequencies over other documents of the scores of tokens; unseen ones cost the penalty
    seen = [(r["odds"], r["t0"] / top["t0"]) for r in found if not r["token"].startswith("^")]
    model.lam = _solve_lambda(seen)
    return _calibrate(spark, rows.where("part = 1"), model)


def _solve_lambda(seen: list[tuple[float, float]]) -> float:
    """The positive root of sum(p * exp(lambda * score)) = 1; 1, where the mean isn't negative."""
    score = np.array([s for s, _ in seen] + [-PENALTY])
    p = np.array([f for _, f in seen] + [max(0.0, 1 - sum(f for _, f in seen))])
    p[p == 0] = 1e-12
    excess = lambda x: float((p * np.exp(np.minimum(x * score, 700))).sum() - p.sum())
    if (p * score).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 16:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return min(high, 4.0)


def _calibrate(spark, rows: DataFrame, model: Model) -> Model:
    """K from the mean of the best scores of other documents (Gumbel's law: its mean is the
    location plus Euler's constant), then a logistic fit of the label on the evidence, both over
    counts in bins of BIN nats."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rows = shared.value, []
        scores = Scores(model.scores)
        for batch in sliced(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                hits, n = hits_of(text, scores)
                nats = model.evidence([s for _, _, s in segments(hits)], n)
                rows.append((toxic, round(nats / BIN)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*rows, strict=True)], names=["toxic", "bin"])

    def bins() -> list:
        return rows.select("text", "toxic").mapInArrow(run, "toxic int, bin int").groupBy("toxic", "bin").count().collect()

    found = [(r["toxic"], r["bin"] * BIN, r["count"]) for r in bins()]
    other = [(x, n) for toxic, x, n in found if not toxic and x < 0.9 * LIMIT]
    toxic = [(x, n) for toxic, x, n in found if toxic]
    if not other or not toxic:
        return model
    # half the mass in the middle, so that mislabelled documents don't move the location
    values = np.repeat([x for x, _ in sorted(other)], [n for _, n in sorted(other)])
    model.log_k = float(np.median(values)) + math.log(math.log(2))
    x = np.array([x for _, x, _ in found]) - model.log_k
    y = np.array([1.0 if t else 0.0 for t, _, _ in found])
    w = np.array([n for _, _, n in found], float)
    x = np.clip(x, -20, 20)
    a, b = _logistic(x, y, w)
    model.slope, model.offset = float(max(a, 0.05)), float(b)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset that maximise the weighted likelihood, by Newton steps that are halved until
    they improve it; a weak pull towards (0.5, -2) settles separable data."""

    def loss(t: np.ndarray) -> float:
        z = t[0] * x + t[1]
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + 0.05 * ((t - start) ** 2).sum())

    start = np.array([0.5, -2.0])
    at = start.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-(at[0] * x + at[1])))
        g = np.array([(w * (p - y) * x).sum(), (w * (p - y)).sum()]) + 0.1 * (at - start)
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + 0.1 * np.eye(2)
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with toxicity (0 to 1) and passages (first token, after the last, nats of evidence).

    Null or empty text: no tokens, the score of a text without evidence. Repeated rows are scored
    each. Other columns come through, but for those that are added. An empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("toxicity", "passages")
    own = docs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["toxicity double", "passages array<struct<first:int,after:int,nats:double>>"])
    passage = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("nats", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = Scores(model.scores)
        for batch in sliced(batches):
            out, passages = [], []
            for text in batch.column("text").to_pylist():
                hits, n = hits_of(text, scores)
                found = segments(hits)
                out.append(model.probability(model.evidence([s for _, _, s in found], n)))
                room = model.log_k + math.log(max(n, 1))
                passages.append([{"first": a, "after": b, "nats": model.lam * s - room} for a, b, s in found if model.lam * s > room])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64()), pa.array(passages, passage)], names=[*own, "toxicity", "passages"])
        del scores
        trim_memory()

    return docs.mapInArrow(run, schema)
