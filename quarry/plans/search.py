"""Text and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths, text
from quarry.operators import chunks, evaluate, lexical, retrieval, search
from quarry.plans.common import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Identifier terms as the rule goes, one identifier after the other: each with its parts, until there
#: are 400; those that are there already are passed over.
PARTS_SQL = r"list_transform(regexp_extract_all(regexp_replace(n, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p))"


def _identifier_terms_sql(column: str) -> str:
    groups = f"list_transform(regexp_extract_all({column}, '[A-Za-z_][A-Za-z0-9_]{{1,63}}'), lambda n: [lower(n)] || CASE WHEN len({PARTS_SQL}) > 1 THEN list_filter({PARTS_SQL}, lambda p: length(p) > 1) ELSE [] END)"
    return f"list_reduce({groups}, lambda seen, g: CASE WHEN len(seen) >= 400 OR list_contains(seen, g[1]) THEN seen ELSE seen || list_filter(list_distinct(g), lambda x: NOT list_contains(seen, x)) END, []::VARCHAR[])"


IDENT_SQL = "regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]{1,63}')"
STOP_SQL = "(" + ", ".join(f"'{s}'" for s in text.STOP_NAMES) + ")"
DOC_TOKENS_SQL = f"tokens AS (SELECT doc_id AS doc, lower(unnest({IDENT_SQL})) AS term FROM documents)"
QUERY_SQL = f"""qi AS (SELECT item_id, generate_subscripts({IDENT_SQL}, 1) AS pos, lower(unnest({IDENT_SQL})) AS term FROM benchmark),
q1 AS (SELECT item_id, term, min(pos) AS pos FROM qi WHERE term NOT IN {STOP_SQL} GROUP BY 1, 2),
terms AS (SELECT item_id AS query, term FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS k FROM q1) WHERE k <= 24)"""
BM25_SQL = f"""{DOC_TOKENS_SQL}, {QUERY_SQL},
tf AS (SELECT doc, term, count(*)::DOUBLE AS tf FROM tokens GROUP BY 1, 2),
dl AS (SELECT doc, sum(tf) AS len FROM tf GROUP BY 1),
tot AS (SELECT count(*) AS n, avg(len) AS avglen FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
scored AS (SELECT query, doc, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen))), 6) AS score
  FROM terms JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc) CROSS JOIN tot GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored)"""


def _low(column="text"):
    return F.transform(text.identifiers(F.col(column)), F.lower)


def _terms(spark, sf_dir):
    """The search terms of the benchmark texts."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(text.query_terms(F.col("text"))).alias("term"))
    return rows


def _scored(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), "doc_id", {"body": (_low(), 1.0)}, _terms(spark, sf_dir))


@query(f"SELECT doc_id, len({IDENT_SQL})::BIGINT AS n, len(list_distinct(list_transform({IDENT_SQL}, lambda x: lower(x))))::BIGINT AS n_distinct FROM documents")
def ident_tokens(spark, sf_dir):
    names = text.identifiers(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(names).cast("long").alias("n"), F.size(F.array_distinct(F.transform(names, F.lower))).cast("long").alias("n_distinct"))


@query(r"""WITH i AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{1,63}')) AS name FROM benchmark),
p AS (SELECT item_id, unnest(regexp_extract_all(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')) AS part FROM i)
SELECT item_id, lower(part) AS part, count(*) AS n FROM p GROUP BY 1, 2""")
def ident_subtokens(spark, sf_dir):
    names = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.identifiers(F.col("text"))).alias("name"))
    return names.select("item_id", F.explode(text.split_identifier(F.col("name"))).alias("part")).groupBy("item_id", "part").agg(F.count("*").alias("n"))


@query(f"WITH {QUERY_SQL} SELECT query, count(*) AS n, string_agg(term, ' ' ORDER BY term) AS terms FROM terms GROUP BY query")
def query_terms(spark, sf_dir):
    return _terms(spark, sf_dir).groupBy("query").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("term")), " ").alias("terms"))


@query(f"""WITH {QUERY_SQL},
n AS (SELECT doc_id, len({_identifier_terms_sql("coalesce(text, '')")})::BIGINT AS n FROM documents)
SELECT doc_id AS id, n, NULL AS search FROM n UNION ALL SELECT query, NULL, string_agg(term, ' ' ORDER BY pos) FROM (SELECT item_id AS query, term, pos, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS k FROM q1) WHERE k <= 24 GROUP BY query""")
def index_terms(spark, sf_dir):
    """Terms to index of all documents, and search terms of the benchmark texts in order."""
    terms = text.identifier_terms(F.col("text"), 400)
    indexed = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.size(terms).cast("long").alias("n"), F.lit(None).cast("string").alias("search"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit(None).cast("long").alias("n"), F.array_join(text.query_terms(F.col("text")), " ").alias("search"))
    return indexed.unionByName(asked)


@query(f"WITH {DOC_TOKENS_SQL} SELECT term, count(DISTINCT doc) AS df, count(*) AS cf FROM tokens GROUP BY term")
def postings_stats(spark, sf_dir):
    index = lexical.postings(table(spark, sf_dir, "documents"), "doc_id", {"body": (_low(), 1.0)})
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("hits").alias("cf"))


@query(f"WITH {BM25_SQL} SELECT query, doc, score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return lexical.top(_scored(spark, sf_dir), 10).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
o AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t)
SELECT w[i] || ' ' || w[i + 1] AS phrase, doc_id AS doc, count(*) AS n FROM o WHERE w[i] = 'of' AND w[i + 1] = 'the' GROUP BY 1, 2""")
def bm25_phrase(spark, sf_dir):
    index = lexical.postings(table(spark, sf_dir, "documents"), "doc_id", {"body": (text.index_tokens(F.col("text")), 1.0)}, positions=True)
    phrase = spark.sql("SELECT * FROM VALUES ('of the', 0, 'of'), ('of the', 1, 'the') AS p(query, at, term)")
    return lexical.phrase_hits(index.where(F.col("term").isin("of", "the")), phrase).select(F.col("query").alias("phrase"), "doc", "n")


DENSE_SQL = """WITH vq AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q, label AS of FROM embeddings WHERE vec_id % 100 = 0),
ds AS (SELECT query, vec_id AS id, of = label AS same, round(list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings CROSS JOIN vq)"""


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.col("label").alias("of"))
    return v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label"), asked


@query(f"{DENSE_SQL} SELECT * FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM ds) WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    """Every row whose id is divisible by 100 against all rows."""
    rows, asked = _vectors(spark, sf_dir)
    return retrieval.dense_top(rows.drop("label"), asked.drop("of"), 10).select("query", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"{DENSE_SQL} SELECT * FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM ds WHERE same) WHERE rank <= 10")
def dense_topk_by_label(spark, sf_dir):
    """The same among the rows of the query's label: a search within a tenant."""
    rows, asked = _vectors(spark, sf_dir)
    return retrieval.dense_top(rows.withColumnRenamed("label", "tenant"), asked.withColumnRenamed("of", "tenant"), 10, within="tenant").select("query", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH n AS (SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)
SELECT vec_id, round(norm, 6) AS norm, CASE WHEN norm > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS after FROM n""")
def l2_normalize(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    unit = text.l2_normalized(F.col("embedding"))
    return v.select("vec_id", F.round(F.sqrt(text.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.round(F.sqrt(text.dot(unit, unit)), 6).alias("after"))


FUSED_SQL = f"""{BM25_SQL},
lex AS (SELECT query, doc AS id, rank FROM bm WHERE rank <= 40),
len AS (SELECT query, doc AS id, row_number() OVER (PARTITION BY query ORDER BY n_chars, doc) AS rank FROM bm JOIN documents ON doc = doc_id WHERE rank <= 40),
ch AS (SELECT query, id, rank, 0 AS turn FROM lex UNION ALL SELECT query, id, rank, 1 FROM len),
fused AS (SELECT query, id, round(sum(1.0 / (60 + rank)), 9) AS score, min(turn * 1000 + rank) AS first FROM ch GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, first, id) AS place FROM fused)"""


def _fused(spark, sf_dir):
    lex = lexical.top(_scored(spark, sf_dir), 40).select("query", F.col("doc").alias("id"), "rank")
    size = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    short = retrieval.ranked(lex.drop("rank").join(size, "id"), ["query"], [F.col("n_chars"), F.col("id")])
    return retrieval.rrf({"lexical": lex, "short": short})


@query(f"WITH {FUSED_SQL} SELECT query, id, score, place FROM placed WHERE place <= 10")
def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir).where("place <= 10").select("query", "id", "score", F.col("place").cast("long").alias("place"))


@query(f"""WITH {FUSED_SQL},
rr AS (SELECT p.query, p.id, p.score, p.place, (SELECT count(*) FROM tf WHERE tf.doc = p.id AND tf.term IN (SELECT term FROM terms WHERE terms.query = p.query))::DOUBLE AS rr FROM placed p WHERE place <= 20),
b AS (SELECT *, round(0.7 * CASE WHEN max(rr) OVER (PARTITION BY query) > 0 THEN rr / max(rr) OVER (PARTITION BY query) ELSE 0 END + 0.3 * score * 60, 6) AS blended FROM rr)
SELECT query, id, blended FROM b""")
def rerank_blend(spark, sf_dir):
    """A stand-in reranker: how many of the query's terms a document holds."""
    top = _fused(spark, sf_dir).where("place <= 20")
    asked = _terms(spark, sf_dir).groupBy("query").agg(F.collect_list("term").alias("terms"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(_low()).alias("held"))
    held = top.select("query", "id").join(asked, "query").join(docs, "id").select("query", "id", F.size(F.array_intersect("terms", "held")).cast("double").alias("rr"))
    return retrieval.blend(top, held).select("query", "id", "blended")


GOLD_SQL = "gold AS (SELECT item_id AS query, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _gold(spark, sf_dir):
    """Documents that hold a whole benchmark passage, found by the passage's longest word first."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("passage"))
    words = lambda c: F.array_distinct(F.split(c, r"\s+"))
    inner = F.slice(F.split("passage", r"\s+"), F.lit(2), F.greatest(F.size(F.split("passage", r"\s+")) - 2, F.lit(1)))
    key = F.array_max(F.transform(inner, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    by_word = d.select("id", "text", F.explode(words(F.col("text"))).alias("w")).join(F.broadcast(b.withColumn("w", key)), "w")
    return by_word.where(F.contains("text", F.col("passage"))).select("query", "id").distinct()


@query(f"""WITH {BM25_SQL}, {GOLD_SQL},
j AS (SELECT g.query, count(*) AS n, min(rank) AS first, count(*) FILTER (rank <= 1) AS a, count(*) FILTER (rank <= 5) AS b, count(*) FILTER (rank <= 10) AS c FROM gold g LEFT JOIN bm ON bm.query = g.query AND bm.doc = g.id GROUP BY 1)
SELECT query, round(a / n, 6) AS recall_1, a = n AS acc_1, round(b / n, 6) AS recall_5, b = n AS acc_5, round(c / n, 6) AS recall_10, c = n AS acc_10, round(coalesce(1.0 / first, 0), 6) AS mrr FROM j""")
def recall_at_k(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    hits = retrieval.ranked(scored.withColumn("score", F.round("score", 6)), ["query"], [F.desc("score"), F.col("doc")]).select("query", F.col("doc").alias("id"), "rank")
    return evaluate.retrieval_metrics(hits, _gold(spark, sf_dir))


@query("SELECT round(avg(CASE WHEN e THEN 1 ELSE 0 END), 6) AS pass_all, round(avg(CASE WHEN s THEN 1 ELSE 0 END), 6) AS pass_any FROM (SELECT lang, bool_and(quality = 1) AS e, bool_or(quality = 1) AS s FROM labels JOIN documents USING (doc_id) GROUP BY source, lang)")
def pass_k(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return evaluate.pass_k(rows.select(F.concat_ws("/", "source", "lang").alias("id"), (F.col("quality") == 1).alias("ok")))


@query(r"""WITH l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: substr(x, 1, 1500)) AS lines FROM documents),
e AS (SELECT doc_id, lines, list_transform(lines, lambda x, i: {'size': length(x)::BIGINT, 'held': (trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) = '' OR x[1] = '#')::BIGINT, 'starts': [i::BIGINT]}) AS parts FROM l),
s AS (SELECT doc_id, lines, list_reduce(parts, lambda a, x: CASE WHEN a.held > 0 AND (a.size + x.size > 1500 AND x.held = 1 OR a.size > 1950) THEN {'size': x.size + 1, 'held': 1::BIGINT, 'starts': a.starts || x.starts}
  ELSE {'size': a.size + x.size + 1, 'held': a.held + 1, 'starts': CASE WHEN len(a.starts) = 0 THEN x.starts ELSE a.starts END} END, {'size': 0::BIGINT, 'held': 0::BIGINT, 'starts': []::BIGINT[]}).starts AS starts FROM e),
c AS (SELECT doc_id, lines, unnest(starts) AS a, unnest(list_transform(starts, lambda x, i: coalesce(starts[i + 1] - 1, len(lines)))) AS b FROM s),
t AS (SELECT doc_id, a, b, array_to_string(lines[a:b], chr(10)) AS body FROM c)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INTEGER AS chunk, a::INTEGER AS first_line, b::INTEGER AS last_line, length(body)::INTEGER AS n_chars FROM t WHERE regexp_matches(body, '[^\s]')""")
def line_chunks(spark, sf_dir):
    return chunks.line_chunks(table(spark, sf_dir, "documents")).select("doc_id", "chunk", "first_line", "last_line", F.char_length("text").alias("n_chars"))


@query("""WITH l AS (SELECT doc_id, source, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x)) > 0), chr(10)) AS body FROM documents)
SELECT sha256(substr(source || chr(10) || body, 1, 600)) AS card, count(*) AS n, min(doc_id) AS first FROM l GROUP BY 1""")
def card_dedupe(spark, sf_dir):
    cards = table(spark, sf_dir, "documents").select("doc_id", text.card_hash(text.card(F.col("source"), F.coalesce("text", F.lit("")))).alias("card"))
    return cards.groupBy("card").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


#: Links and what they should give, taken from the rules and not from the expressions.
LINKS = [
    ("https://github.com/Owner/Repo", "owner/repo", None), ("http://www.github.com/a/b.git", "a/b", None), ("https://github.com/a/b/tree/main/src", "a/b", None),
    ("https://github.com/a/b/blob/main/x.py?plain=1", "a/b", None), ("https://github.com/a/b/?tab=readme", "a/b", None), ("https://example.com/a/b", None, None),
    ("https://github.com/a", None, None), ("https://github.com/-a/b", None, None), ("https://github.com/a/..", None, None), ("  https://github.com/a/b.c_d-e  ", "a/b.c_d-e", None),
    ("https://github.com/A/B/pull/12", None, 12), ("https://github.com/a/b/pull/12/files#diff", None, 12), ("https://github.com/a/b/pull/12345678", None, None),
    ("https://github.com/a/b/pull/x", None, None), ("git@github.com:a/b.git", None, None), ("https://github.com.evil.org/a/b", None, None),
]


def _values(rows) -> str:
    quoted = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, (bool, int)) else "'" + x + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


@query(f"SELECT page_id, url, repo, number FROM pages JOIN (VALUES {_values([(i, *x) for i, x in enumerate(LINKS)])}) v(i, url_, repo, number) ON page_id % {len(LINKS)} = i".replace("page_id, url,", "page_id, url_ AS url,"))
def url_parse(spark, sf_dir):
    """A link of the list for each page."""
    listed = F.array(*[F.lit(x[0]) for x in LINKS])
    p = table(spark, sf_dir, "pages").select("page_id", F.get(listed, (F.col("page_id") % len(LINKS)).cast("int")).alias("url"))
    return p.select("page_id", "url", paths.repository_of(F.col("url")).alias("repo"), paths.pull_of(F.col("url"))["number"].alias("number"))


@query("SELECT lang, sum(n_chars)::BIGINT AS chars, count(*) AS n FROM documents GROUP BY lang ORDER BY chars DESC, lang LIMIT 8")
def lang_breakdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("n")).orderBy(F.desc("chars"), "lang").limit(8)


#: Paths, their language and whether they are tests.
PATHS = [
    ("src/a.py", "python", False), ("src/A.PY", "python", False), ("web/x.tsx", "tsx", False), ("m/x.MJS", "javascript", False), ("lib/x.cs", "csharp", False), ("a/FooTest.java", "java", True),
    ("a/xtests.cs", "csharp", True), ("pkg/x_test.go", "go", True), ("x_test.py", "python", True), ("x_test.rs", "rust", False), ("test_x.rb", "ruby", True), ("a/b_spec.rb", "ruby", True),
    ("a/b.spec.ts", "typescript", True), ("a/b.test.jsx", "javascript", True), ("tests/data.json", "json", True), ("a/__tests__/x.js", "javascript", True), ("spec/x.kt", "kotlin", True),
    ("specs/x.kt", "kotlin", False), ("testing/x.scala", "scala", True), ("conftest.py", "python", True), ("a/Dockerfile", "dockerfile", False), ("Dockerfile.dev", "dockerfile", False),
    ("Makefile", "make", False), ("README", "markdown", False), ("README.md", "markdown", False), ("x.yml", "yaml", False), ("x.cfg", "ini", False), ("main.tf", "hcl", False), ("x.r", "r", False),
    ("x.bin", None, False), ("noext", None, False), ("a.b/noext", None, False), ("latest/x.php", "php", False), ("src/test/x.swift", "swift", True),
]


def _paths(spark, sf_dir):
    listed = F.array(*[F.lit(x[0]) for x in PATHS])
    return table(spark, sf_dir, "pages").select("page_id", F.get(listed, (F.col("page_id") % len(PATHS)).cast("int")).alias("path"))


PATHS_SQL = f"pages JOIN (VALUES {_values([(i, *x) for i, x in enumerate(PATHS)])}) v(i, path, lang, is_test) ON page_id % {len(PATHS)} = i"


@query(f"SELECT page_id, path, lang FROM {PATHS_SQL}")
def lang_detect(spark, sf_dir):
    return _paths(spark, sf_dir).withColumn("lang", paths.language(F.col("path")))


@query(f"SELECT page_id, path, is_test FROM {PATHS_SQL}")
def test_path(spark, sf_dir):
    return _paths(spark, sf_dir).withColumn("is_test", paths.is_test_path(F.col("path")))


#: The lexical channel of hybrid search: identifiers weigh 2, the text 1; N and lengths over both fields.
TWO_FIELDS_SQL = rf"""{QUERY_SQL},
f AS (SELECT doc_id AS doc, source || chr(10) || coalesce(text, '') AS whole FROM documents),
i0 AS (SELECT doc, unnest({_identifier_terms_sql("whole")}) AS name FROM f),
i AS (SELECT doc, unnest(list_filter(regexp_split_to_array(name, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS term FROM i0),
b AS (SELECT doc, unnest(list_filter(regexp_split_to_array(lower(whole), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS term FROM f),
o AS (SELECT doc, term, 2.0 AS w FROM i UNION ALL SELECT doc, term, 1.0 FROM b),
tf2 AS (SELECT doc, term, sum(w)::DOUBLE AS tf FROM o GROUP BY 1, 2),
dl2 AS (SELECT doc, count(*) AS len FROM o GROUP BY 1),
tot2 AS (SELECT count(*) AS n, avg(len) AS avglen FROM dl2),
df2 AS (SELECT term, count(*) AS df FROM tf2 GROUP BY 1),
s2 AS (SELECT query, doc, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen))), 6) AS score
  FROM terms JOIN df2 USING (term) JOIN tf2 USING (term) JOIN dl2 USING (doc) CROSS JOIN tot2 GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT query, doc AS id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s2) WHERE rank <= 40)"""
#: Documents as chunks of a file each; the first word of three letters or more names its symbol.
NAMED_SQL = f"""names AS (SELECT doc_id AS id, regexp_extract(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]{{2,}}') AS name, n_chars FROM documents),
asked AS (SELECT item_id AS query, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}'))) AS name FROM benchmark),
sym AS (SELECT * FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY n_chars DESC, id) AS rank FROM names JOIN asked USING (name) WHERE lower(name) NOT IN {STOP_SQL}) WHERE rank <= 20)"""


def _corpus(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("chunk"), F.col("doc_id").alias("path"), F.lit(0).cast("long").alias("low"), F.col("n_chars").alias("high"), F.col("source").alias("header"), F.coalesce("text", F.lit("")).alias("text"))
    name = F.regexp_extract(F.coalesce("text", F.lit("")), r"[A-Za-z_][A-Za-z0-9_]{2,}", 0)
    symbols = d.select(F.col("doc_id").alias("symbol"), F.col("doc_id").alias("path"), name.alias("name"), name.alias("qualname"), F.lit("function").alias("kind"), F.lit(0).cast("long").alias("low"), F.col("n_chars").alias("high"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return chunks, symbols, queries


@query(f"WITH {NAMED_SQL} SELECT query, id, rank FROM sym")
def exact_name_match(spark, sf_dir):
    chunks, symbols, queries = _corpus(spark, sf_dir)
    return search.symbol_matches(symbols, queries).select("query", F.col("symbol").alias("id"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {TWO_FIELDS_SQL}, {NAMED_SQL},
ch AS (SELECT query, id, rank, 0 AS turn FROM lex UNION ALL SELECT query, id, rank, 1 FROM sym),
fused AS (SELECT query, id, round(sum(1.0 / (60 + rank)), 9) AS score, min(turn * 1000 + rank) AS first FROM ch GROUP BY 1, 2)
SELECT query, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, first, id) AS place FROM fused) WHERE place <= 10""")
def hybrid_search(spark, sf_dir):
    """Two-field BM25 and the symbol channel, fused; the other channels have tests of their own."""
    chunks, symbols, queries = _corpus(spark, sf_dir)
    found = search.hybrid(queries, chunks, symbols, channels=("lexical", "symbols"))
    return found.select("query", "id", "score", F.col("place").cast("long").alias("place"))
