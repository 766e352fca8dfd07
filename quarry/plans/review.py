"""Queries of review, evaluation and embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import change, embedding, evaluate, retrieval, review
from quarry.plans.common import CHANGES_SQL, changes, table
from quarry.plans.search import PATHS, PATHS_SQL, _paths
from quarry.plans.service import PATCH_SQL, _patches
from quarry.sources import files

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT page_id, (lang IS NOT NULL AND path NOT IN ('go.sum') AND page_id % 5 <> 0) AS ok FROM {PATHS_SQL}")
def reviewable_files(spark, sf_dir):
    """Every fifth page has no patch."""
    patch = F.when(F.col("page_id") % 5 != 0, F.lit("@@ -1 +1 @@"))
    return _paths(spark, sf_dir).select("page_id", review.reviewable(F.col("path"), patch).alias("ok"))


@query("""SELECT doc_id AS id, 0 AS nth, doc_id % 7 <> 0 AS valid, CASE doc_id % 3 WHEN 0 THEN 'major' ELSE 'minor' END AS severity, (doc_id % 50)::INTEGER AS line_end, 'new' AS side FROM labels WHERE doc_id % 11 <> 0""")
def finding_defaults(spark, sf_dir):
    """Replies with prose around the object; some lack a title, a severity or the whole object."""
    i = F.col("doc_id")
    title = F.when(i % 7 != 0, F.lit('"title": "t", ')).otherwise(F.lit(""))
    severity = F.when(i % 3 == 0, F.lit('"severity": "major", ')).otherwise(F.lit(""))
    body = F.concat(F.lit('Sure:\n```json\n{"summary": "s", "findings": [{'), title, severity, F.lit('"path": "a.py", "explanation": "e", "line_start": '), (i % 50).cast("string"), F.lit("}]}\n```"))
    replies = table(spark, sf_dir, "labels").select(i.alias("id"), F.when(i % 11 == 0, F.lit("no object")).otherwise(body).alias("reply"))
    return review.findings(replies).select("id", "nth", "valid", "severity", "line_end", "side")


@query(r"SELECT conv_id, turn, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) >= 8 AS ok FROM conversations WHERE role = 'assistant'")
def answer_length(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", review.answered(F.col("text")).alias("ok"))


@query("""WITH r AS (SELECT l_partkey AS path, l_linenumber AS line, l_returnflag AS code FROM lineitem), c AS (SELECT DISTINCT l_partkey AS path, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R')
SELECT path, line, code FROM r SEMI JOIN c USING (path, line) ORDER BY path, line, code LIMIT 40""")
def changed_line_reports(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    reports = i.select(F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("code"))
    lines = i.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("line"))
    return review.on_changed_lines(reports, lines)


@query(f"""WITH {PATCH_SQL} SELECT p.id, array_to_string(list_transform(string_split(patch, chr(10)), lambda x: CASE WHEN x[1] = '@' THEN
  '@@ -' || regexp_extract(x, '\\+(\\d+,\\d+)', 1) || ' +' || regexp_extract(x, '-(\\d+,\\d+)', 1) || ' @@' WHEN x[1] = '+' THEN '-' || x[2:] WHEN x[1] = '-' THEN '+' || x[2:] ELSE x END), chr(10)) || chr(10) AS patch FROM p""")
def reverse_patch(spark, sf_dir):
    return _patches(spark, sf_dir).select("id", change.reversed_patch(F.col("patch")).alias("patch"))


@query("""SELECT l_orderkey AS id, string_agg('@@ old ' || (l_linenumber * 20) || ',2 new ' || (l_linenumber * 20 + 1) || ',3 @@ ' || chr(10) || lpad((l_linenumber * 20 + 1)::VARCHAR, 5, ' ') || '   a' || chr(10) || '      - b' || chr(10)
  || lpad((l_linenumber * 20 + 2)::VARCHAR, 5, ' ') || ' + c' || chr(10) || lpad((l_linenumber * 20 + 3)::VARCHAR, 5, ' ') || ' + d', chr(10) ORDER BY l_linenumber) AS text FROM lineitem GROUP BY 1""")
def annotate_patch(spark, sf_dir):
    return change.annotated(change.hunks(_patches(spark, sf_dir)))


GOLD_SQL = "gold AS (SELECT l_orderkey AS query, l_linenumber * 20 + 3 AS low, greatest(l_linenumber * 20 + 3, l_linenumber * 20 + 2 - 4) AS high FROM lineitem)"


@query(f"WITH {GOLD_SQL} SELECT query AS id, low, high FROM gold")
def gold_from_patch(spark, sf_dir):
    return change.gold_ranges(change.hunks(_patches(spark, sf_dir))).select("id", "low", "high")


SYMBOLS_SQL = "symbols AS (SELECT l_orderkey AS path, (l_orderkey * 10 + l_linenumber)::BIGINT AS symbol, l_linenumber * 15 AS first, l_linenumber * 15 + 5 + min(l_suppkey) % 40 AS last FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def _symbols(spark, sf_dir):
    i, n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s")), F.col("l_linenumber")
    return i.select(F.col("l_orderkey").alias("path"), (F.col("l_orderkey") * 10 + n).cast("long").alias("symbol"), (n * 15).alias("first"), (n * 15 + 5 + F.col("s") % 40).alias("last"))


@query(f"""WITH {GOLD_SQL}, {SYMBOLS_SQL}, j AS (SELECT query, symbol, row_number() OVER (PARTITION BY query, low, high ORDER BY last - first, symbol) AS k FROM gold JOIN symbols ON path = query WHERE first <= high AND last >= low)
SELECT DISTINCT query, symbol FROM j WHERE k = 1""")
def gold_symbols(spark, sf_dir):
    ranges = change.gold_ranges(change.hunks(_patches(spark, sf_dir))).select(F.col("id").alias("query"), F.col("id").alias("path"), "low", "high")
    return evaluate.gold_symbols(_symbols(spark, sf_dir), ranges).select("query", "symbol")


@query(f"""WITH {SYMBOLS_SQL}, hits AS (SELECT path, symbol % 10 AS rank, first + 9 AS low, first + 12 AS high FROM symbols),
g AS (SELECT s.path AS query, s.symbol, max((h.rank <= 3)::INT) AS met FROM symbols s LEFT JOIN hits h ON h.path = s.path AND h.low <= s.last AND h.high >= s.first AND h.rank <= 3 GROUP BY 1, 2)
SELECT query, round(avg(coalesce(met, 0)), 6) AS recall FROM g GROUP BY 1""")
def function_recall(spark, sf_dir):
    s = _symbols(spark, sf_dir)
    hits = s.select(F.col("path").alias("query"), "path", (F.col("symbol") % 10).alias("rank"), (F.col("first") + 9).alias("low"), (F.col("first") + 12).alias("high"))
    gold = s.select(F.col("path").alias("query"), "path", "symbol", F.col("first").alias("low"), F.col("last").alias("high"))
    return evaluate.function_recall(hits, gold, 3)


RUNS_SQL = "runs AS (SELECT l_orderkey AS id, l_returnflag AS repo, l_quantity > 25 AS detected, l_quantity > 10 AS detected_before, (l_linenumber - 1)::BIGINT AS others, CASE WHEN l_tax > 0.01 THEN l_tax END AS cost, l_extendedprice AS seconds FROM lineitem WHERE l_linenumber = 1)"


def _runs(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    return i.select(F.col("l_returnflag").alias("repo"), (F.col("l_quantity") > 25).alias("detected"), (F.col("l_quantity") > 10).alias("detected_before"), (F.col("l_linenumber") - 1).cast("long").alias("others"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("cost"), F.col("l_extendedprice").alias("seconds"))


@query(f"WITH {RUNS_SQL} SELECT count(*) AS tasks, round(avg(detected::INT), 3) AS detection, round(avg(detected_before::INT), 3) AS before, round(avg(others), 2) AS others, round(avg((others = 0)::INT), 3) AS clean, round(avg(cost), 4) AS cost, list_sort(list(seconds))[count(*) // 2 + 1] AS p50 FROM runs")
def detection_summary(spark, sf_dir):
    return evaluate.detection_summary(_runs(spark, sf_dir))


@query(f"WITH {RUNS_SQL} SELECT repo, round(avg(cost), 3) AS cost, count(*) AS n FROM runs GROUP BY repo")
def mean_by_repo(spark, sf_dir):
    return evaluate.mean_metrics(_runs(spark, sf_dir), ["repo"], ["cost"])


SWEEP_SQL = """gold AS (SELECT l_orderkey AS query, l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
base AS (SELECT l_orderkey AS query, l_partkey AS id, min(l_linenumber) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1, 2),
hits AS (SELECT 'by_line' AS configuration, query, id, row_number() OVER (PARTITION BY query ORDER BY a, id) AS rank FROM base UNION ALL SELECT 'by_supplier', query, id, row_number() OVER (PARTITION BY query ORDER BY b, id) FROM base),
m AS (SELECT configuration, g.query, round(count(*) FILTER (rank <= 1) / count(*), 6) AS recall_1, round(count(*) FILTER (rank <= 5) / count(*), 6) AS recall_5, round(coalesce(1.0 / min(rank), 0), 6) AS mrr FROM gold g JOIN hits h ON h.query = g.query AND h.id = g.id GROUP BY 1, 2)"""


@query(f"WITH {SWEEP_SQL} SELECT configuration, round(avg(recall_1), 3) AS recall_1, round(avg(recall_5), 3) AS recall_5, round(avg(mrr), 3) AS mrr, count(*) AS n FROM m GROUP BY 1")
def config_sweep(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("id"), "l_linenumber", "l_suppkey", "l_returnflag")
    gold = i.where("l_returnflag = 'R'").select("query", "id").distinct()
    base = i.groupBy("query", "id").agg(F.min("l_linenumber").alias("a"), F.max("l_suppkey").alias("b"))
    rank = lambda c: retrieval.ranked(base, ["query"], [F.col(c), F.col("id")]).select("query", "id", "rank")
    return evaluate.sweep({"by_line": rank("a"), "by_supplier": rank("b")}, gold, ("recall_1", "recall_5", "mrr"))


@query("""WITH h AS (SELECT l_orderkey AS path, l_partkey AS symbol, count(*) AS h FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2), b AS (SELECT l_orderkey AS path, l_partkey AS symbol, count(*) AS b FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2)
SELECT path, symbol, CASE WHEN b IS NULL THEN 'added' WHEN h IS NULL THEN 'removed' ELSE 'modified' END AS status, coalesce(h, b) AS lines FROM h FULL JOIN b USING (path, symbol)""")
def symbol_status(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("symbol"), "l_linenumber")
    side = lambda c: i.where(c).groupBy("path", "symbol").agg(F.count("*").alias("lines"))
    return review.symbol_status(side("l_linenumber <= 4"), side("l_linenumber >= 3"))


@query("""WITH changed AS (SELECT o_custkey AS review, l_partkey AS symbol, count(*) AS lines, l_partkey % 7 = 0 AS is_test FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 4),
top AS (SELECT *, row_number() OVER (PARTITION BY review ORDER BY is_test, lines DESC, symbol) AS place FROM changed QUALIFY place <= 10),
rel AS (SELECT l_partkey AS symbol, CASE l_suppkey % 5 WHEN 0 THEN 'caller' WHEN 1 THEN 'test' WHEN 2 THEN 'subclass' WHEN 3 THEN 'callee' ELSE 'other' END AS kind, l_suppkey AS item, max(l_quantity) AS weight, max(l_quantity * 10)::BIGINT AS size FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY weight DESC, item) AS nth FROM rel),
q AS (SELECT * FROM (VALUES ('caller', 1, 3), ('test', 2, 2), ('subclass', 3, 2), ('callee', 4, 3)) v(kind, turn, quota)),
r AS (SELECT review, symbol, kind, item, size, (place, turn, nth, item) AS pos FROM top JOIN k USING (symbol) JOIN q USING (kind) WHERE nth <= quota),
o AS (SELECT *, row_number() OVER (PARTITION BY review, item ORDER BY pos) AS once FROM r QUALIFY once = 1),
u AS (SELECT *, sum(size) OVER (PARTITION BY review ORDER BY pos)::BIGINT AS used FROM o)
SELECT review, symbol, kind, item, size, used FROM u WHERE used <= 2000""")
def context_pack(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("review"))
    changed = i.join(o, "l_orderkey").groupBy("review", F.col("l_partkey").alias("symbol")).agg(F.count("*").alias("lines")).withColumn("is_test", F.col("symbol") % 7 == 0)
    m = F.col("l_suppkey") % 5
    kind = F.when(m == 0, "caller").when(m == 1, "test").when(m == 2, "subclass").when(m == 3, "callee").otherwise("other")
    relations = i.groupBy(F.col("l_partkey").alias("symbol"), kind.alias("kind"), F.col("l_suppkey").alias("item")).agg(F.max("l_quantity").alias("weight"), F.round(F.max(F.col("l_quantity") * 10)).cast("long").alias("size"))
    return review.context_pack(changed, relations, 2000)


CHUNKS_SQL = """files AS (SELECT p_partkey AS path, round(p_retailprice / 3000, 6) AS rank, p_partkey % 7 = 0 AS is_test FROM part),
chunks AS (SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS chunk, l_partkey AS path, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END AS symbol, l_linestatus = 'F' AS embedded, l_returnflag AS snapshot FROM lineitem),
ranked AS (SELECT c.*, round(rank * (CASE WHEN is_test THEN 0.3 ELSE 1.0 END * CASE WHEN symbol IS NULL THEN 0.5 ELSE 1.0 END), 6) AS priority FROM chunks c JOIN files USING (path))"""


def _chunks(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.round(F.col("p_retailprice") / 3000, 6).alias("rank"), (F.col("p_partkey") % 7 == 0).alias("is_test"))
    c = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("chunk"), F.col("l_partkey").alias("path"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey")).alias("symbol"),
        (F.col("l_linestatus") == "F").alias("embedded"), F.col("l_returnflag").alias("snapshot"),
    )
    return embedding.priority(c, p)


@query(f"WITH {CHUNKS_SQL} SELECT chunk, priority FROM ranked")
def embed_priority(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk", "priority")


@query(f"WITH {CHUNKS_SQL} SELECT chunk, CASE WHEN embedded THEN priority WHEN path % 40 = 0 THEN 10.0 WHEN path % 20 = 0 THEN greatest(priority, 6.0) ELSE priority END AS priority FROM ranked")
def embed_boost(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"))
    return embedding.boosted(_chunks(spark, sf_dir), p.where("path % 40 = 0"), p.where("path % 20 = 0")).select("chunk", "priority")


@query(f"WITH {CHUNKS_SQL} SELECT chunk, priority FROM ranked WHERE NOT embedded AND priority >= 0.2 ORDER BY priority DESC, chunk LIMIT 96")
def embed_pending(spark, sf_dir):
    return embedding.pending(_chunks(spark, sf_dir), 96, 0.2).select("chunk", "priority")


@query(f"WITH {CHUNKS_SQL} SELECT snapshot, count(*) FILTER (embedded) AS embedded, count(*) AS chunks FROM ranked GROUP BY 1")
def dense_coverage(spark, sf_dir):
    return embedding.coverage(_chunks(spark, sf_dir))


@query("""WITH cards AS (SELECT doc_id AS chunk, sha256(coalesce(text, '')) AS card_hash FROM documents), cache AS (SELECT card_hash, min(chunk) AS vector FROM cards WHERE chunk % 3 = 0 GROUP BY 1)
SELECT chunk, vector IS NOT NULL AS cached FROM cards LEFT JOIN cache USING (card_hash)""")
def cached_vectors(spark, sf_dir):
    cards = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("card_hash"))
    cache = cards.where("chunk % 3 = 0").select("card_hash", F.lit("m").alias("model"), F.array(F.lit(1.0)).alias("vector"))
    return embedding.cached_vectors(cards, cache, "m").select("chunk", F.col("vector").isNotNull().alias("cached"))


@query(f"WITH {CHANGES_SQL} SELECT path, sha, nth FROM (SELECT path, sha, row_number() OVER (PARTITION BY path ORDER BY ts DESC, sha) AS nth FROM changes) WHERE nth <= 8")
def file_log(spark, sf_dir):
    return files.file_log(changes(spark, sf_dir)).select("path", "sha", F.col("nth").cast("long").alias("nth"))


@query("WITH s AS (SELECT l_orderkey AS file, l_partkey AS symbol, l_linenumber = 1 AS is_module FROM lineitem) SELECT DISTINCT s.symbol AS seed, m.symbol AS module FROM s JOIN s m ON m.file = s.file AND m.is_module")
def module_of_symbol(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("symbol"), "l_linenumber")
    return s.select("file", F.col("symbol").alias("seed")).join(s.where("l_linenumber = 1").select("file", F.col("symbol").alias("module")), "file").select("seed", "module").distinct()


@query("SELECT page_id, substr(html, 1, 3000) AS head FROM pages WHERE page_id % 34 IN (23, 24)")
def readme_head(spark, sf_dir):
    """The pages whose path, in any case, is a readme's."""
    found = _paths(spark, sf_dir).where(F.lower("path").isin("readme.md", "readme.rst", "readme")).select("page_id")
    return table(spark, sf_dir, "pages").join(found, "page_id").select("page_id", F.substring("html", 1, 3000).alias("head"))


@query("SELECT l_orderkey AS id, l_linenumber AS low, l_quantity::INTEGER AS n, EXISTS (SELECT 1 FROM lineitem g WHERE g.l_orderkey = l.l_orderkey AND g.l_returnflag = 'R' AND l.l_linenumber + 3 >= g.l_linenumber * 5 AND l.l_linenumber - 3 <= g.l_linenumber * 5 + 1) AS hit FROM lineitem l")
def detected_findings(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    found = i.select(F.col("l_orderkey").alias("id"), n.alias("low"), n.alias("high"), F.round("l_quantity").cast("int").alias("n"))
    regions = i.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), (n * 5).alias("low"), (n * 5 + 1).alias("high"))
    return evaluate.detected(found, regions).select("id", "low", "n", "hit")


assert len(PATHS) == 34  # readme_head's SQL counts on the places of the readmes
