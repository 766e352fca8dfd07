"""The training-data operators against brute force, on odd inputs: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, components, covertree, lines, neardup, packing, pieces, quality, scoring, substrings, toxicity
from quarry.llm.common import Scratch, Words

tokenizers = pytest.importorskip("public_tokenizers")
BPE, SP = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed: int = 1, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("the", "on", "Ér", "x,") for b in ("a", "ti", "ng.", "漢")]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(k))
    passage = text(70)
    rows: list[tuple] = [(i, text(rng.randrange(120))) for i in range(n)]
    for i in range(6):
        rows.append((n + i, text(5) + passage + text(7)))
    near = text(200).split()
    for i in range(6):
        w = list(near)
        w[rng.randrange(len(w))] = f"other{i}"
        rows.append((n + 10 + i, " ".join(w)))
    rows += [(n + 20, None), (n + 21, ""), (n + 22, " \n "), (None, passage), (n + 23, "one"), (n + 24, "one"), (n + 25, "a " * 3000), (n, rows[n][1]), (n + 26, "\x85odd　white \x1f space <|endoftext|> ▁▁ x")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"kept": F.lit("mine"), "row": F.lit(1), "ids": F.lit(2)}) if extra else df


def test_words():
    import pyarrow as pa

    texts = [t for _, t in corpus()]
    w = Words(pa.array(texts))
    found = w.array().to_pylist()
    assert [found[a:b] for a, b in zip(w.first[:-1], w.first[1:])] == [WORD.findall(t or "") for t in texts]
    assert w.joined().to_pylist() == [" ".join(WORD.findall(t or "")) for t in texts]
    assert len(set(zip(found, w.hashes().tolist()))) == len(set(found)) == len(set(w.hashes().tolist()))


def test_substring_dedup(spark):
    rows = corpus()
    first: dict = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    expected = []
    for i, t in rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for k in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        expected.append((i, len(w), keep.count(False), " ".join(x for x, y in zip(w, keep) if y)))
    out = substrings.dedupe_windows(frame(spark, rows), 50)
    assert {"row", "ids"} <= set(out.columns)
    got = [tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert Counter(got) == Counter(expected) and sum(e[2] for e in expected) > 200
    assert substrings.dedupe_windows(frame(spark, []), 50).count() == 0


def test_equal_hashes_are_told_apart(monkeypatch):
    strings = [b" ".join(b"w%d" % (i % 7 if i < 60 else i + s) for i in range(61)) for s in range(3)]
    low, high = np.array([5, 3, 9]), np.array([5, 3, 9])
    plain = sorted(substrings.shared_windows(strings, low, high, 50))
    monkeypatch.setattr(substrings, "segment_sums", lambda v, a, b: np.zeros(len(a), np.uint64))
    assert sorted(substrings.shared_windows(strings, low, high, 50)) == plain and plain


def test_packed_strings_take_little_memory():
    """Places of bytes are not held for a whole slice; words are joined as before."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(4)
    texts = ["".join(f"w{rng.randrange(5000)}" + rng.choice([" ", "\n\t"]) for _ in range(70_000)) for _ in range(4)] + ["", "é x"]
    words = Words(pa.array(texts))
    found = substrings.SuperKmers(words, 50, np.zeros(0, np.uint64))
    tracemalloc.start()
    strings = found.strings(words, 50)
    joined = words.joined()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert joined.to_pylist() == [" ".join(t.split()) for t in texts]
    first = joined[0].as_py().split(" ")
    assert strings[0].decode() == " ".join(first[: int(found.count[0]) + 49])
    kept = sum(map(len, strings)) + 33 * len(strings)
    assert most - kept < 12 * sum(map(len, texts))


def test_line_dedup(spark):
    rows = corpus(2) + [(900, "A shared line here\nshort\n  a SHARED line here "), (901, "a shared line here\nshort\nmine alone, this one")]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first: dict = {}
    for i, t in rows:
        for x in (t or "").split("\n") if i is not None else ():
            first[key(x)] = min(i, first.get(key(x), i))
    expected = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if i is None or len(key(x)) < 10 or first[key(x)] == i]
        expected.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    for batches in (1, 5):
        out = lines.dedupe_lines(frame(spark, rows), 10, batches)
        assert Counter(tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "kept").collect()) == Counter(expected)
    assert lines.dedupe_lines(frame(spark, [])).count() == 0


def test_near_duplicates(spark):
    rows = corpus(3)
    for size in (2, 5):
        sets: dict = {}
        for i, t in rows:
            w = WORD.findall((t or "").translate(LOWER))
            s = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
            if i is not None:
                sets[i] = s
        parent = {i: i for i in sets}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows), size, 80).collect()}
        assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_crowded_sets_meet_where_they_may_be_similar(spark):
    """Copies of one text with some words changed, similar ones and others: each similar pair meets,
    and not once for every rare shingle that two sets share."""
    rng = random.Random(8)
    base, rows = [f"w{k}" for k in range(300)], []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(300), rng.randrange(2, 24)):
            words[k] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 2]) for k in range(299)} for i, t in rows}
    similar = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    found = neardup.NearDuplicates(frame(spark, rows), 2, 80)
    bound = spark.createDataFrame([(i, len(s), i) for i, s in sets.items()], "rep long, n long, component long")
    lists = found.rarest(bound).persist()
    met = [(r["a"], r["b"]) for r in found._met(lists).collect()]
    assert similar and similar <= set(met)
    assert len(met) * 3 < found._met(lists.drop("rest")).count()
    lists.unpersist()


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, i) for i in range(201, 230)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    rows = [r for r in corpus(4) if r[0] is not None]
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows}
    out = packing.pack(frame(spark, rows).coalesce(2), BPE, 64).collect()
    seen, windows = Counter(), {}
    for r in out:
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] += r["length"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == Counter(i for i, _ in rows for _ in ids[i])
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)
    assert packing.pack(frame(spark, []), BPE).count() == 0


def test_sum_of_squares_takes_the_least():
    rng = random.Random(6)
    out: list = []
    p = packing.SumOfSquares(20, lambda w, n: out.append((sum(x[2] for x in w), n)))
    for k in range(400):
        length = rng.randrange(1, 20)
        levels = p.levels.copy()
        cost = {}
        for h in range(0, 20 - length + 1):
            if h == 0 or levels[h]:
                after = levels.copy()
                after[h] -= h > 0
                after[h + length] += 1
                cost[h] = int((after[1:20] ** 2).sum())
        p.add((k, 0, length))
        assert int((p.levels[1:20] ** 2).sum()) == min(cost.values())
    p.finish()
    assert all(a == b for a, b in out)


def brute_path(m, t):
    best, back = [0.0] + [-np.inf] * len(t), [None] * (len(t) + 1)
    for e in range(1, len(t) + 1):
        for s in range(max(0, e - m.longest), e):
            f = m.vocabulary.get(t[s:e])
            if f and best[s] + f[0] > best[e]:
                best[e], back[e] = best[s] + f[0], (s, f[1])
        if t[e - 1] not in m.vocabulary and best[e - 1] + m.unknown_score > best[e]:
            best[e], back[e] = best[e - 1] + m.unknown_score, (e - 1, None)
    out, e = [], len(t)
    while e:
        s, i = back[e]
        out.append((s, e, i))
        e = s
    return out[::-1]


def test_viterbi_of_scores_on_whole_texts():
    m = pieces.PieceModel(SP)
    m.merges = False  # the same pieces, read as a unigram model
    for _, t in [*corpus(7), (0, "x" * 3000 + "ab=" * 900)]:
        x = m.normalize(t or "")
        assert list(m.viterbi(x)) == brute_path(m, x)


def test_viterbi_commits_early(monkeypatch):
    m, held = pieces.PieceModel(SP), []
    meeting = m._meeting
    monkeypatch.setattr(m, "_meeting", lambda best, back: held.append(len(best)) or meeting(best, back))
    rng = random.Random(16)
    text = "".join(rng.choices("etaoinshrdlu", [9, 9, 8, 8, 7, 7, 6, 6, 5, 4, 3, 2], k=5_000_000))
    ids = m.encode(text)  # 5 MB without a space
    assert len(held) > 100_000 and max(held) <= 16 * m.longest
    assert m.decode(ids) == text


def test_sentencepiece(spark):
    rows = corpus(7)
    out = pieces.decode(pieces.encode(frame(spark, rows), SP), SP)
    assert Counter((r["doc_id"], r["decoded"]) for r in out.collect()) == Counter((i, t or "") for i, t in rows)
    empty = pieces.decode(pieces.encode(frame(spark, []), SP), SP)
    assert empty.count() == 0


def test_sentencepiece_gives_the_models_ids():
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=SP)
    m, rng = pieces.piece_model(SP), random.Random(15)
    texts = [t.replace("▁", "_") for _, t in corpus(7) if t]
    texts += ["the", "  the  other   ", " ", "\x00 \n\t<s> <0x41> </s>", "the" * 400, "a" * 777, "=" * 500 + "ab" * 99, "".join(rng.choices("aetho nsi-", k=5000)), "".join(rng.choices("aethonsi漢é", k=3000))]
    texts += ["".join(rng.choices("etaoinshr", k=rng.randrange(1, 130))) for _ in range(300)]
    texts += ["".join(rng.choices("aab=-  ..", k=rng.randrange(1, 200))) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(m.encode(t), "<i4").tolist() == sp.encode(t)
        assert m.decode(m.encode(t)) == t
        x = m.normalize(t)
        assert b"".join(m._ids(w) for w in [x]) == m.encode(t)  # whole texts, not cut at spaces


def test_chat(spark):
    rows = [(1, 0, "user", "hi ### there"), (1, 1, "user", "again </turn>+"), (1, 2, "assistant", "\\s \\ ###"), (1, 2, "assistant", "\\s \\ ###"), (2, None, None, None), (2, 1, "a: b\n", ""), (None, 1, "assistant", "x"), (3, 1, "assistant", "####"), (3, 2, "user", "\\### Assistant: </turn> ok")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0)))
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.parse_formatted(F.col("formatted")).alias("turns"), chat.masked_texts(F.col("formatted"), F.col("spans")).alias("loss")).collect()}
    for c in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [tuple(t) for t in got[c]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c]["loss"] == [r[3] for r in own if r[2] == "assistant"]
    assert got[1]["formatted"].count("### ") == 2
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quality(spark):
    rows = corpus(8) + [(500 + i, "Some plain words of the text that it is to say. " + " ".join(f"w{i}{k} of" for k in range(60)) + ".") for i in range(30)] + [(700 + i, " ".join(f"j{i}{k}###" for k in range(80))) for i in range(4)]
    out = {}
    for r in quality.weak_supervision(frame(spark, rows)).collect():
        out[r["doc_id"]] = r
    for i, t in rows:
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        often = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(5)}
        body = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(body) - len(set(body)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert all(out[500 + i]["kept"] for i in range(30)) and not any(out[700 + i]["kept"] for i in range(4))


def test_segments_are_maximal():
    rng = random.Random(9)
    for _ in range(60):
        scores = [rng.choice([-0.5, -0.5, -0.5, 2.0, 1.0]) for _ in range(30)]
        hits = [(i, s) for i, s in enumerate(scores) if s > 0]

        def split(a, b):  # the definition: the best segment, then those left and right of it
            best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            return [*split(a, best[2]), round(best[0], 6), *split(best[3], b)]

        assert sorted(round(s, 6) for _, _, s in toxicity.segments(hits, 0.5)) == sorted(split(0, 30))


def test_toxicity(spark):
    rng = random.Random(10)
    plain = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(400):
        w = rng.choices(plain, k=60)
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["scum", "moron", "trash"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = frame(spark, [*rows, (None, "scum"), (1000, None), (1001, "")])
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int"))
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((out[i] >= 0.3) == (i % 5 == 0) for i in held) >= 0.9 * len(held)
    assert all(0 <= x <= 1 for x in out.values()) and out[1000] == out[1001] < 0.3
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, nothing).where("toxicity >= 0.3").count() == 0


def test_scoring(spark):
    rows = corpus(11)
    out = scoring.score(frame(spark, rows), F.col("doc_id") % 5 != 1, BPE).collect()
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), "\n"]
    c = Counter(w for i, t in rows if i is not None and i % 5 != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    expected = Counter((i, len(w := tokens(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)


def toy_model():
    rng = np.random.default_rng(3)
    n = 400
    classes = scoring.Classes(rng.integers(0, scoring.FINE, n), np.arange(n) % scoring.COARSE, rng.integers(0, 50, n).astype(float), "<u2", n - 1)
    triples = rng.integers(0, 2, (scoring.FINE, scoring.FINE, scoring.COARSE)).astype(np.float32)
    tables = scoring.Tables.of(classes, triples, rng.integers(0, 3, (scoring.FINE, n)).astype(np.float32))
    weights = {k: x + rng.normal(size=x.shape).astype(np.float32) * 0.3 for k, x in scoring.start_weights().items()}
    return rng, classes, tables, weights


def streams_of(rng, n, lengths):
    import pyarrow as pa

    data = [rng.integers(0, n, k).astype("<u2").tobytes() for k in lengths]
    return scoring.Streams(pa.array(data, pa.binary()), "<u2", n - 1)


def plain_log10(weights, tables, classes, before, target, near_start):
    """log10 P(target | before), attending from position near_start of the ids before."""
    x = [classes.end, classes.end, *before]
    fine = classes.fine[x]
    e = weights["embed"][fine[1 + near_start :]]
    att = np.exp((e @ weights["key"]) @ (e[-1] @ weights["query"]) / 4 + weights["near"][np.arange(len(e) - 1, -1, -1)])
    z = np.exp((att / att.sum()) @ (e @ weights["value"]) @ weights["out"]) * tables.prior[fine[-2] * scoring.FINE + fine[-1]]
    c = classes.coarse[target]
    return math.log10(z[c] / z.sum()) + tables.within[fine[-1], target] / scoring.STEPS


def test_blocks_agree_with_plain_attention():
    rng, classes, tables, weights = toy_model()
    s = streams_of(rng, 400, [1, 3, 16, 17, 100, 33])
    got = scoring.log_probabilities(s, weights, tables, classes, blocks_at_once=3)
    for a, n in zip(s.start, s.length):
        ids = s.ids[a : a + n].tolist()
        for t in range(n):
            lo = max(0, (t // scoring.BLOCK - 1) * scoring.BLOCK)
            assert abs(plain_log10(weights, tables, classes, ids[:t], ids[t], lo) - got[a + t]) < 1e-4
    # each factor sums to one over what it chooses from
    assert np.allclose(tables.prior.sum(1), 1, atol=1e-4)
    for one in (0, 7, 200):
        p = 10.0 ** (tables.within[one] / scoring.STEPS)
        assert np.allclose(np.bincount(classes.coarse, p, scoring.COARSE), 1, atol=2e-3)


def test_attention_gradients():
    rng, classes, tables, weights = toy_model()
    windows = scoring.windows_of(streams_of(rng, 400, [5, 40, 70]))
    assert len(windows) == 1 + 2 + 3
    weights = {k: v.astype(np.float64) for k, v in weights.items()}
    _, grad = scoring.gradients(weights, windows, classes, tables.prior.astype(np.float64))
    for name, w in weights.items():
        for _ in range(8):
            at = tuple(rng.integers(0, k) for k in w.shape)
            if name == "embed":
                at = (int(rng.choice(classes.fine[windows[windows >= 0]])), at[1])
            losses = []
            for step in (1e-4, -1e-4):
                moved = {k: v.copy() for k, v in weights.items()}
                moved[name][at] += step
                losses.append(scoring.gradients(moved, windows, classes, tables.prior.astype(np.float64))[0])
            assert abs((losses[0] - losses[1]) / 2e-4 - grad[name][at]) < 2e-5


def test_large_scores_and_logits_do_not_overflow():
    rng, classes, tables, weights = toy_model()
    most = lambda x: np.float32(np.abs(x).max())
    e = weights["embed"]
    large = weights | {"query": weights["query"] * (240 / most((e @ weights["query"]) @ (e @ weights["key"]).T)), "out": weights["out"] * (44 / most(e @ weights["value"] @ weights["out"]))}
    s = streams_of(rng, 400, [1, 17, 40])
    got = scoring.log_probabilities(s, large, tables, classes)
    for a, n in zip(s.start, s.length):
        ids = s.ids[a : a + n].tolist()
        for t in range(n):
            assert abs(plain_log10(large, tables, classes, ids[:t], ids[t], max(0, (t // scoring.BLOCK - 1) * scoring.BLOCK)) - got[a + t]) < 5e-3 * max(1, abs(got[a + t]))
    huge = {k: x * np.float32(1 if k == "near" else 40) for k, x in weights.items()}
    loss, grad = scoring.gradients(huge, scoring.windows_of(s), classes, np.maximum(tables.prior, np.float32(1e-6)))
    assert not np.isnan(loss) and all(np.isfinite(g).all() for g in grad.values())


def test_ids_of_distinct_words_are_those_of_whole_texts():
    import pyarrow as pa

    encode, last = packing.byte_bpe(BPE), np.array([50256], "<u2").tobytes()
    texts = ["a B", None, "", "<|endoftext|> x y", "a<|endoftext|>b c", "q\xa0r s it's 12ab", "\xa0", "  x  ", "<| endoftext|>", "\u00e9\u65e5\u672c ab", "\x85 z", "y" * 5000, "\u3000", "a\x1cb", "A B'S a b"]
    rng = np.random.default_rng(5)
    for k in range(30):
        some = texts if k == 0 else [texts[i] for i in rng.integers(0, len(texts), 1 + k % 5)]
        w = scoring.Words(pa.array(some, pa.string()), lower=True)
        found = w.array().dictionary_encode()
        codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = found.dictionary.to_pylist()
        got = scoring.ids_of_texts(w, codes, words, np.array([len(x.encode()) for x in words], np.int64), encode, 50256, "<u2").to_pylist()
        assert got == [(np.frombuffer(encode(" " + t), "<u4").astype("<u2").tobytes() if t else b"") + last for t in w.joined().to_pylist()]


def test_windows_cover_whole_texts_in_any_portions():
    rng, classes, tables, _ = toy_model()
    s = streams_of(rng, 400, [1, 31, 32, 33, 500])
    w = scoring.windows_of(s)
    assert w[:, 2:][w[:, 2:] >= 0].tolist() == s.ids.tolist()
    assert (w[0, :2] == classes.end).all() and w[-1, :2].tolist() == s.ids[s.start[-1] + 478 : s.start[-1] + 480].tolist()
    once, parts = scoring.Training(classes, tables.prior), scoring.Training(classes, tables.prior)
    many = np.concatenate([w] * 300)
    once.add(many)
    for a in range(0, len(many), 777):
        parts.add(many[a : a + 777])
    left, right = once.finish(), parts.finish()
    assert all(np.array_equal(left[k], right[k]) for k in left) and once.windows == len(many)


def test_scores_learn_and_do_not_depend_on_partitions(spark):
    rng = random.Random(14)
    tongue = [[a + b for a in x for b in x] for x in (("the", "on", "ing", "er"), ("que", "la", "os", "ar"))]
    rows = []
    for i in range(400):
        words = tongue[i % 2]
        rows.append((i, " ".join(rng.choice(words) + rng.choice(words) for _ in range(600))))
    rows += [(500, None), (501, ""), (502, "one " * 3000), (None, "theon"), (3, rows[3][1])]
    docs = frame(spark, rows).withColumns({"training": F.lit(False), "row": F.lit(3)})
    train = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True))
    one = {(r["doc_id"], r["score"]) for r in scoring.score(docs.coalesce(1), train, BPE).collect()}
    out = scoring.score(docs.repartition(5), train, BPE).collect()
    assert {(r["doc_id"], r["score"]) for r in out} == one and len(out) == len(rows)
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 5 == 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # words of the other tongue among a text's own are less likely than its own
    odd = [(1, " ".join(["theon"] * 20 + ["erer"])), (2, " ".join(["theon"] * 20 + ["quela"]))]
    a, b = scoring.score(frame(spark, [*rows, (901, odd[0][1]), (906, odd[1][1])]), train, BPE).where("doc_id > 900").orderBy("doc_id").collect()
    assert a["score"] > b["score"]
    assert scoring.score(frame(spark, []), train, BPE).count() == 0
    untrained = scoring.score(frame(spark, [(1, "a b"), (2, None)]), F.lit(False), BPE).collect()
    assert all(r["train_tokens"] == r["n_known"] == 0 and r["score"] < 0 for r in untrained)


def brute_top_k(rows, k, step):
    data = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v))]
    out = Counter()
    for i, v in {(i, tuple(v)) for i, v in data if i % step == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in data if j != i and len(w) == len(v))
        out.update((i, rank + 1, j, -s) for rank, (s, j) in enumerate(best[:k]))
    return out


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = [rng.normal(size=6).tolist() for _ in range(120)]
    rows: list = [(i, v) for i, v in enumerate(x)] + [(200 + i, x[3]) for i in range(30)] + [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, x[0]), (304, []), (320, [0.5])]
    # rows that repeat, one id with two vectors, products beyond doubles and beyond 64-bit keys
    rows += [(7, x[7]), (7, x[7]), (10, x[10]), (7, x[8]), (400, [1e7] * 6), (401, [1e7] * 5 + [0.9e7]), (402, [1e7, -1e7, 1e7, 0.5, 1.0, 2.0]), (403, [2.0**24, 0.0, 0.0, 0.0, 0.0, 1 / 64]), (410, [1 / 64, 0.0, 0.0, 0.0, 0.0, 2.0**24])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cell": F.lit(1), "vec": F.lit("x"), "copies": F.lit(5)})
    q = covertree.quantized(frame)
    got = Counter(tuple(r) for r in covertree.top_k(q, 5, F.col("vec_id") % 10 == 0).collect())
    assert got == brute_top_k(rows, 5, 10)
    assert covertree.top_k(q.limit(0), 5, F.col("vec_id") % 10 == 0).count() == 0
    too_large = covertree.quantized(spark.createDataFrame([(1, [1e300]), (2, [2.0**60]), (10, [2.0**50])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in covertree.top_k(too_large, 5, F.col("vec_id") == 10).collect()] == []
    two = covertree.quantized(spark.createDataFrame([(2, [2.0**50]), (3, [2.0**49]), (10, [2.0**50])], "vec_id long, embedding array<double>"))
    assert [r["score"] for r in covertree.top_k(two, 5, F.col("vec_id") == 10).collect()] == [2**63 - 1] * 2


def plain_lines(docs: dict, least: int = 10) -> dict:
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first: dict = {}
    for i, t in docs.items():
        for x in t.split("\n"):
            first[key(x)] = min(i, first.get(key(x), i))
    return {i: "\n".join(x for x in t.split("\n") if len(key(x)) < least or first[key(x)] == i) for i, t in docs.items()}


def plain_near(docs: dict, size: int = 5) -> dict:
    sets = {}
    for i, t in docs.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    group = {i: i for i in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return {i: t for i, t in docs.items() if group[i] == i}


def plain_passages(docs: dict, size: int = 50) -> dict:
    first: dict = {}
    words = {i: WORD.findall(t) for i, t in docs.items()}
    for i in sorted(docs):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), i)
    out = {}
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                keep[k : k + size] = [False] * size
        out[i] = docs[i] if all(keep) else " ".join(x for x, y in zip(w, keep) if y)
    return out


def test_pipeline(spark, tmp_path):
    """Against plain Python, stage by stage; toxic words mark the labelled documents."""
    import corpus_pipeline as p

    rng = random.Random(21)
    rows = {i: t for i, t in corpus(13) if i is not None}
    plain = [f"w{k}" for k in range(300)]
    toxic = set()
    for i in range(1000, 1300):
        w = rng.choices(plain, k=40)
        if i % 5 == 0:
            toxic.add(i)
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["scum", "moron", "trash"]))
        rows[i] = " ".join(w)
    rows[2000] = "one shared line of text\nand one of its own"
    rows[2001] = " One SHARED line of text\nand another one here"
    rows[2002] = "z " * 500_000  # a megabyte
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.char_length("text").cast("long"), "extra": F.lit(1)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(1000, 1300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    expected = {i: t or "" for i, t in rows.items() if i not in toxic}
    steps = [lambda d: d, plain_lines, plain_near, plain_passages]
    for (name, stage), plainly in zip(p.STAGES[:-1], steps):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == p.COLUMNS, name
        expected = plainly(expected)
        got = {r["doc_id"]: r for r in docs.collect()}
        assert {i: r["text"] or "" for i, r in got.items()} == expected, name
        assert name == "toxicity" or all(r["n_chars"] == len(r["text"] or "") for i, r in got.items() if rows[i] is not None), name
        docs = spark.createDataFrame(list(got.values()), docs.schema)
    assert 2001 in expected and expected[2001] == "and another one here"
    whole: dict = {}
    for r in sorted(p.run(spark, str(tmp_path)).collect(), key=lambda r: r["start"]):
        whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + r["ids"]
    encode = packing.byte_bpe(BPE)
    assert whole == {i: encode(t) + b"\0\0\0\0" for i, t in expected.items()}


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    tables = {"empty": [], "odd": [(None, None, None, None, None), (1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (1, "other text", None, "s", None), (None, "x" * 200_000, "en", None, 1), (2, "", "en", "s", 0)]}
    for name, rows in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(None, None, None), (1, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = p.run(spark, f"{tmp_path}/{name}").collect()
        assert sum(r["start"] == 0 for r in out) == len(rows)


CLASHING = ["id", "_id", "row", "_row", "lost", "_lost", "spans", "_spans", "part", "key", "kept", "n_words", "n_lines", "ids", "toxicity", "passages", "training", "text_", "first", "word", "c", "mark", "shard", "component", "rep", "n"]


@pytest.mark.parametrize("name", ["lines", "substrings", "neardup", "toxicity", "packing", "pieces", "quality", "scoring"])
def test_clashing_columns_and_odd_rows(spark, name):
    rows = [(1, "some words of a text\nand a second line of it"), (2, "some words of a text\nand a second line of it"), (2, None), (3, ""), (None, "some words of a text"), (None, None), (4, "y" * 5_000_000 if name not in ("quality", "scoring") else "y" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").withColumns({"id": F.lit(1), "part": F.lit(2), "text": F.lit("x")})
    run = {
        "lines": lambda d: lines.dedupe_lines(d), "substrings": lambda d: substrings.dedupe_windows(d, 50), "neardup": lambda d: neardup.near_duplicates(d), "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "packing": lambda d: packing.pack(d, BPE), "pieces": lambda d: pieces.decode(pieces.encode(d, SP), SP), "quality": lambda d: quality.weak_supervision(d), "scoring": lambda d: scoring.score(d, F.col("doc_id") > 1, BPE),
    }[name]
    found = Counter(r["doc_id"] for r in run(docs).select("doc_id").collect())
    if name == "neardup":
        assert found == Counter({1: 1, 2: 2, 3: 1, 4: 1})  # rows without doc_id are left out
    elif name == "packing":
        assert {i for i in found} == {1, 2, 3, 4, None}
    else:
        assert found == Counter(r[0] for r in rows)
    assert run(docs.limit(0)).count() == 0
