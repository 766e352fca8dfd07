"""Unit vectors of the functions and operators, on small inline inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import paths, text
from quarry.operators import change, chunks, embedding, evaluate, graph, history, resolve, retrieval, review, search
from quarry.sources import files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_split_identifier(spark):
    assert one(spark, text.split_identifier(F.lit("parseHTTPRequest_v2"))) == ["parse", "http", "request", "v", "2"]


def test_query_terms_are_safe(spark):
    terms = one(spark, text.query_terms(F.lit('self.get_user("x"); DROP TABLE users; -- "quoted"')))
    assert "get_user" in terms and "self" not in terms and "user" in terms


def test_identifier_terms_order_and_parts(spark):
    assert one(spark, text.identifier_terms(F.lit("getUser getuser parse_it")))[:5] == ["getuser", "get", "user", "parse_it", "parse"]


def test_paths(spark):
    for path, expected in (("tests/test_x.py", True), ("src/a.spec.ts", True), ("src/contest.py", False)):
        assert one(spark, paths.is_test_path(F.lit(path))) is expected
    assert one(spark, paths.language(F.lit("a/b.PY"))) == "python"


def test_links(spark):
    assert one(spark, paths.repository_of(F.lit("https://github.com/A/b/tree/main/x"))) == "a/b"
    assert tuple(one(spark, paths.pull_of(F.lit("https://github.com/Owner/repo/pull/12/files")))) == ("owner/repo", 12)
    for bad in ("https://github.com/a", "ftp://github.com/a/b", "github.com/a/b", "https://github.com/a/b/c/d", "https://host.org/a/b"):
        assert one(spark, paths.repository_of(F.lit(bad))) is None


def test_patch(spark):
    patch = "@@ -10,3 +10,4 @@ def f\n a\n-b\n+c\n+d\n e\n@@ -30 +31,0 @@\n-x\n\\ No newline"
    rows = spark.createDataFrame([(1, patch), (2, None), (3, "")], "id long, patch string")
    h, g = change.hunks(rows).orderBy("hunk").collect()
    assert h["added"] == [11, 12] and h["removed"] == [11] and h["header"] == "def f" and (h["old_start"], h["old_len"], h["new_len"]) == (10, 3, 4)
    assert g["removed"] == [30] and g["added"] == [] and (g["old_len"], g["new_len"]) == (1, 0)
    text = change.annotated(change.hunks(rows)).first()["text"].split("\n")
    assert text == ["@@ old 10,3 new 10,4 @@ def f", "   10   a", "      - b", "   11 + c", "   12 + d", "   13   e", "@@ old 30,1 new 31,0 @@ ", "      - x"]
    back = one(spark, change.reversed_patch(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/x\n" + patch)))
    assert back == "@@ -10,4 +10,3 @@ def f\n a\n+b\n-c\n-d\n e\n@@ -31,0 +30 @@\n+x\n\\ No newline\n"
    assert [tuple(r)[1:] for r in change.gold_ranges(change.hunks(rows)).orderBy("hunk").collect()] == [(0, 13, 13), (1, 33, 33)]
    assert [tuple(r)[1:] for r in change.gold_regions(change.hunks(rows)).orderBy("hunk").collect()] == [(0, 11, 12), (1, 33, 35)]


def test_parse_python():
    found = chunks.parse_python("from .m import helper as h\nclass A(Base):\n    def run(self):\n        return h(1) if self else 0\n")
    assert [s["qualname"] for s in found["symbols"]] == ["A", "A.run"]
    assert found["symbols"][1]["kind"] == "method"
    assert {(r["name"], r["kind"]) for r in found["refs"]} == {("Base", "inherits"), ("h", "call")}
    assert found["imports"] == [{"module": ".m", "name": "helper", "alias": "h", "line": 1}]
    assert chunks.parse_python("def (") is None


def test_line_chunks():
    assert chunks.chunk_lines("") == [] and chunks.chunk_lines(None) == []
    parts = chunks.chunk_lines("\n".join(f"line {i}" if i % 10 else "" for i in range(400)), 300)
    assert parts[0][0] == 1 and all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))


SHOP = {
    "shop/cart.py": "from shop.pricing import apply_discount\n\n\nclass Cart:\n    def total(self):\n        return apply_discount(sum(self.items))\n",
    "shop/pricing.py": "DISCOUNT_THRESHOLD = 100\n\n\ndef apply_discount(x):\n    return x * 0.9 if x > DISCOUNT_THRESHOLD else x\n",
    "tests/test_pricing.py": "from shop import pricing\nfrom urllib.parse import unquote\n\n\ndef test_discount():\n    assert pricing.apply_discount(200) == 180 and unquote('a')\n",
    "shop/other.py": "def unquote(x):\n    return x\n",
}


def test_resolution(spark):
    files = spark.createDataFrame(list(SHOP.items()), ["path", "content"])
    parsed = chunks.parse_files(files).cache()
    symbols = parsed.select("path", F.posexplode("symbols").alias("i", "s")).select(F.concat_ws("#", "path", "i").alias("symbol"), "path", "s.name")
    refs = parsed.select("path", F.posexplode("refs").alias("i", "r")).select(F.concat_ws("@", "path", "i").alias("ref"), "path", "r.name", "r.qualifier", F.concat_ws("#", "path", "r.scope").alias("scope"))
    imports = parsed.select("path", F.explode("imports").alias("m")).select("path", "m.*")
    found = resolve.resolve(refs, symbols, resolve.import_edges(files, imports), imports).collect()
    links = {(r["path"], r["target"].split("#")[0]): (r["strategy"], r["confidence"]) for r in found}
    assert links[("shop/cart.py", "shop/pricing.py")] == ("imported_name", 0.95)
    assert links[("tests/test_pricing.py", "shop/pricing.py")] == ("qualified", 0.95)
    assert ("tests/test_pricing.py", "shop/other.py") not in links  # an external name


def test_pagerank(spark):
    edges = [(0, 2, 1.0), (1, 2, 1.0), (2, 3, 2.0), (2, 0, 1.0), (3, 3, 5.0)]
    got = {r["node"]: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, "src long, dst long, weight double"), rounds=12).collect()}
    a = np.zeros((4, 4))
    for s, d, w in edges:
        if s != d:
            a[s, d] += w
    out, r = a.sum(1), np.full(4, 0.25)
    for _ in range(12):
        r = 0.15 / 4 + 0.85 * ((a / np.where(out > 0, out, 1)[:, None]).T @ r) + 0.85 * r[out == 0].sum() / 4
    assert np.allclose([got[i] for i in range(4)], r) and abs(sum(got.values()) - 1) < 1e-9


def test_rrf_agreement(spark):
    ch = lambda ids: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "query long, id long, rank int")
    top = retrieval.rrf({"lexical": ch([1, 2, 3]), "dense": ch([3, 4, 1])}).orderBy("place").limit(2).collect()
    assert {r["id"] for r in top} == {1, 3}


def test_asof_and_innermost_against_brute_force(spark):
    rng = random.Random(3)
    points = [(rng.randrange(3), i, rng.randrange(50)) for i in range(60)]
    spans = [(rng.randrange(3), i, rng.randrange(50)) for i in range(30)]
    got = {r["point"]: r["span"] for r in retrieval.asof(spark.createDataFrame(points, "k long, point long, at long"), spark.createDataFrame(spans, "k long, span long, start long"), "k").collect()}
    for k, p, at in points:
        held = [(s, i) for kk, i, s in spans if kk == k and s <= at]
        assert got[p] == (max(held)[1] if held else None)


def test_history(spark):
    rows = [("c1", p, "a", "2024-01-01") for p in "xyz"] + [("c2", p, "b", "2024-06-01") for p in "xy"] + [("c3", "x", "a", "2024-06-02")]
    df = spark.createDataFrame(rows, ["sha", "path", "author", "d"]).withColumn("ts", F.to_timestamp("d"))
    counts = {r["path"]: r for r in history.churn(df).collect()}
    assert (counts["x"]["churn"], counts["x"]["churn_recent"], counts["x"]["authors"]) == (3, 2, 2)
    assert [(r["a"], r["b"], r["n"], r["weight"]) for r in history.cochange_weight(history.cochange(df), history.churn(df)).collect()] == [("x", "y", 2, 1.0)]


def test_admit_skips_but_goes_on(spark):
    rows = [("g", 1, False, 90), ("g", 2, False, 20), ("g", 3, False, 10), ("g", 4, True, 1)]
    got = {r["id"]: r["admitted"] for r in change.admit(spark.createDataFrame(rows, "group string, id long, is_test boolean, size long"), 50, 100).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


@pytest.mark.parametrize("of", ["findings", "spans"])
def test_earlier_findings_win(spark, of):
    """Against every pair; one review holds many, spans may be inverted, nulls clash with nothing."""
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        low = rng.randrange(60)
        rows.append((0 if i % 3 else rng.randrange(9), i, rng.choice("ab"), rng.choice(["x", "x", None]), rng.choice([low, low, low, None]), low + rng.randrange(-4, 9)))
    rows += [(10, 5, None, "x", 1, 9), (10, 6, None, "x", 2, 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "review long, id long, path string, category string, low long, high long")

    def clash(a, b):
        if of == "findings":
            own = [a[2:4], b[2:4]]
            meet = lambda: a[4] <= b[5] and b[4] <= a[5]
        else:
            own = [a[2:3], b[2:3]]
            meet = lambda: b[4] <= a[4] and a[5] <= b[5]
        return own[0] == own[1] and None not in (*own[0], a[4], a[5], b[4], b[5]) and meet()

    expected, kept = {}, {}
    for row in sorted(rows):
        held = kept.setdefault(row[0], [])
        expected[row[1]] = not any(clash(row, other) for other in held)
        if expected[row[1]]:
            held.append(row)
    found = change.collapse_findings(df) if of == "findings" else change.collapse_spans(df)
    assert {r["id"]: r["kept"] for r in found.collect()} == expected


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 10, 2), (1, 11, 7)], "query long, id long, rank long")
    gold = spark.createDataFrame([(1, 10), (1, 11)], "query long, id long")
    r = evaluate.retrieval_metrics(hits, gold).first()
    assert (r["recall_1"], r["recall_5"], r["acc_10"], r["mrr"]) == (0.0, 0.5, True, 0.5)


def test_working_tree(spark, tmp_path):
    from quarry.sources import files

    for path, content in {**SHOP, "node_modules/a.js": "x", ".git/b.py": "x", "empty.py": "", "bin.py": "a\0b"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    assert {r["path"] for r in files.working_tree(spark, str(tmp_path)).collect()} == set(SHOP)
    log = tmp_path / "log"
    log.write_text("\x1es1\x1fann\x1f1700000000\x1fa.py\nb.py\n\x1es2\x1fbob\x1f1700000100\x1fa.py\n")
    assert [(r["sha"], r["path"]) for r in files.git_log(spark, str(log)).collect()] == [("s1", "a.py"), ("s1", "b.py"), ("s2", "a.py")]


@pytest.mark.parametrize("slack,expected", [(0, False), (3, True)])
def test_overlap_slack(spark, slack, expected):
    a = spark.createDataFrame([("p", 1, 1, 5)], "k string, x long, x_low long, x_high long")
    b = spark.createDataFrame([("p", 2, 8, 9)], "k string, y long, y_low long, y_high long")
    assert (retrieval.overlapping(a, b, "k", slack).count() == 1) is expected


def test_dense_search_asks_for_every_hundredth(spark, tmp_path):
    import random

    from quarry.operators import retrieval
    from quarry.plans import catalog

    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(1250)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in catalog.QUERIES["dense_topk"](spark, str(tmp_path)).collect()}
    expected = {}
    for q, a in rows[::100]:
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows)[:10]
        expected |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == expected and len(got) == 130 and len(rows) > 2 * retrieval.BLOCK


def test_hybrid_search_over_all_channels(spark):
    """A small code base: each query is answered through another channel."""
    chunks = spark.createDataFrame(
        [(1, "store.py", 1, 20, "store.py :: class Cart", "class Cart:\n    def addItem(self, item): ..."), (2, "store.py", 21, 40, "store.py :: in Cart", "    def total_price(self): return sum(self.items)"),
         (3, "tax.py", 1, 30, "tax.py", "def vat(amount): return amount * RATE"), (4, "tests/test_store.py", 1, 9, "tests/test_store.py", "def test_it(): assert Cart().total_price() == 0"), (5, "notes.md", 1, 3, "notes.md", "unrelated words on gardens")],
        "chunk long, path string, low long, high long, header string, text string",
    )
    symbols = spark.createDataFrame(
        [(10, "store.py", "store.py", "store.py", "module", 1, 40), (11, "store.py", "Cart", "Cart", "class", 1, 40), (12, "store.py", "total_price", "Cart.total_price", "method", 25, 30), (20, "tax.py", "tax.py", "tax.py", "module", 1, 30),
         (21, "tax.py", "vat", "vat", "function", 1, 3), (40, "tests/test_store.py", "test_store.py", "tests/test_store.py", "module", 1, 9), (41, "tests/test_store.py", "test_it", "test_it", "function", 1, 9)],
        "symbol long, path string, name string, qualname string, kind string, low long, high long",
    )
    edges = spark.createDataFrame([("tests", 41, 12, 0.9), ("calls", 12, 21, 0.6), ("calls", 12, 11, 0.3), ("cochange", 10, 20, 0.4)], "kind string, src long, dst long, weight double")
    queries = spark.createDataFrame([("lex", "item"), ("sym", "how does Cart.total_price work"), ("none", "the of")], "query string, text string").withColumn("q", embedding.hashed_vector(F.col("text")))
    vectors = chunks.select(F.col("chunk").alias("id"), embedding.hashed_vector(F.col("text")).alias("v"))

    def ids(**more):
        rows = search.hybrid(queries, chunks, symbols, edges, **more).orderBy("query", "place").collect()
        return {q: [r["id"] for r in rows if r["query"] == q] for q in ("lex", "sym", "none")}, rows

    lexical, rows = ids(channels=("lexical",))
    assert lexical["lex"] == [1] and lexical["none"] == [] and set(lexical["sym"]) == {1, 2, 4}
    assert all(r["text"] and r["header"] for r in rows)
    named, _ = ids(channels=("symbols",))
    assert named["sym"] == [2, 1] and named["lex"] == []
    linked, _ = ids(channels=("symbols", "graph"))
    assert set(linked["sym"]) == {1, 2, 3, 4}
    everything, _ = ids(vectors=vectors, k=2)
    assert everything["sym"][0] == 2 and len(everything["sym"]) == 2 and everything["lex"][0] == 1
    gone, _ = ids(channels=("lexical",), exclude=spark.createDataFrame([("lex", 1)], "query string, id long"))
    assert gone["lex"] == []
    stub = lambda hits: hits.select("query", "id", F.when(F.col("id") == 4, 1.0).otherwise(0.0).alias("rr"))
    reranked, _ = ids(channels=("lexical", "symbols"), rerank=stub)
    assert reranked["sym"][0] == 4
    seeded, _ = ids(channels=("graph",), seeds=spark.createDataFrame([("lex", 12)], "query string, symbol long"))
    assert set(seeded["lex"]) == {3, 4}


def test_search_cuts_texts_once(spark):
    """A search of two fields reads each document one time; names go by the rule whatever their number."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = [(i, "h", f"parseHTTP_v{i} word common " + " ".join(f"n{k}_x" for k in range(i * 20))) for i in range(30)] + [(90, None, None)]
    chunks = spark.createDataFrame(docs, "chunk long, header string, text string").mapInArrow(count, "chunk long, header string, text string")
    queries = spark.createDataFrame([(1, "parseHTTP common"), (2, "n7_x")], "query long, text string")
    found = search.lexical_channel(chunks, queries).collect()
    assert read.value == len(docs)
    assert {r["id"] for r in found if r["query"] == 1} == set(range(30))
    assert {r["id"] for r in found if r["query"] == 2} == set(range(1, 30))
    columns = text.identifier_tokens(F.col("text")).alias("t"), search.tokens_of(text.identifier_terms(F.col("text"))).alias("same")
    both = chunks.select("chunk", *columns).collect()
    assert all(r["t"] == r["same"] for r in both)
    tokens = {r["chunk"]: r["t"] for r in both}
    assert tokens[90] == [] and tokens[1][:6] == ["parsehttp", "v1", "parse", "http", "word", "common"]


def test_embedding_progress(spark):
    rows = spark.createDataFrame([(1, "h1", "a b", 0.1, False), (2, "h1", "a b", 0.5, False), (3, "h2", "c", 0.9, False), (4, "h3", "d", 0.8, False), (5, "h4", "e", 1.0, True)], "chunk long, card_hash string, card string, priority double, embedded boolean")
    cache = spark.createDataFrame([("h3", "m", [1.0]), ("h2", "other", [1.0])], "card_hash string, model string, vector array<double>")
    new, done = embedding.progress(rows, cache, "m", 3, embedding.hashed_vector)
    assert sorted(r["card_hash"] for r in new.collect()) == ["h1", "h2"] and sorted(r["chunk"] for r in done.collect()) == [2, 3, 4]
    assert all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-9 for r in new.collect())


def test_report(spark):
    reviews = spark.createDataFrame([(1, "#1: a", "fine", "low"), (2, "#2: b", "clean", None)], "id long, title string, summary string, risk string")
    rows = spark.createDataFrame([(1, 0, "a.py", 3, "major", "t", "why", "+x\n-y"), (1, 1, "b.py", 4, "minor", "u", "so", None)], "id long, nth int, path string, line_start int, severity string, title string, explanation string, suggestion string")
    out = {r["id"]: r["text"] for r in review.markdown(reviews, rows).collect()}
    assert "**MAJOR** `a.py:3` t" in out[1] and "```diff\n+x\n-y\n```" in out[1] and "**MINOR** `b.py:4` u\n\nso" in out[1] and "**Risk:** low" in out[1]
    assert out[2].endswith("No blocking issues found.") and "**Risk:** unknown" in out[2]


def test_sinks_and_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "x", y', 7), (2, None, 8)], "id long, label string, snapshot_id long")
    files.write_csv(rows, f"{tmp_path}/csv")
    assert spark.read.option("header", "true").option("escape", '"').csv(f"{tmp_path}/csv").where("id = 1").first()["label"] == 'say "x", y'
    files.write_json(rows, f"{tmp_path}/json")
    assert files.json_records(spark, f"{tmp_path}/json", "id long, label string").count() == 2
    files.write_snapshot(rows, f"{tmp_path}/t")
    files.write_snapshot(rows.where("id = 2"), f"{tmp_path}/t")
    files.delete_snapshot(spark, [f"{tmp_path}/t"], 7)
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/t").collect()] == [2]
    assert files.append_new(spark, rows, f"{tmp_path}/n", ["id"]).count() == 2
    assert files.append_new(spark, rows, f"{tmp_path}/n", ["id"]).count() == 0


def test_files_with_bad_bytes(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "vendor").mkdir()
    (tmp_path / "src" / "latin.py").write_bytes("x = 'caf\xe9'\n".encode("latin-1"))
    (tmp_path / "out" / "kept.py").write_text("y = 1\n")
    (tmp_path / "vendor" / "gone.py").write_text("z = 1\n")
    got = {r["path"]: r["content"] for r in files.working_tree(spark, str(tmp_path)).collect()}
    assert got == {"src/latin.py": "x = 'caf�'\n", "out/kept.py": "y = 1\n"}
