"""Graph, history and analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import analytics, graph, history, retrieval
from quarry.plans.common import CHANGES_SQL, PARTS_SQL, TRADE_SQL, changes, parts, table, trade

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {TRADE_SQL} SELECT src, dst, weight FROM edges")
def edge_sum(spark, sf_dir):
    return trade(spark, sf_dir)


@query("""SELECT l_returnflag AS kind, l_suppkey AS src, l_partkey AS dst, max(l_quantity) AS weight,
  arg_max(l_linenumber, l_quantity * 1e12 - (l_orderkey * 10 + l_linenumber)) AS line FROM lineitem GROUP BY 1, 2, 3""")
def edge_max_weight(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    e = i.select(F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("weight"), F.col("l_linenumber").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return graph.strongest(e)


@query(f"WITH {TRADE_SQL} SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges")
def edge_symmetric(spark, sf_dir):
    return graph.both_ways(trade(spark, sf_dir))


def _pagerank_sql(base: str) -> str:
    return f"""WITH RECURSIVE {TRADE_SQL},
nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
base AS (SELECT node, {base} AS b FROM nodes),
shares AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges),
stuck AS (SELECT node FROM nodes WHERE node NOT IN (SELECT src FROM edges)),
pr(i, node, r) AS (
  SELECT 0, node, b FROM base
  UNION ALL
  SELECT i, node, 0.15 * any_value(b) + 0.85 * sum(flow) + 0.85 * any_value(b) * any_value(d) FROM (
    SELECT pr.i + 1 AS i, shares.dst AS node, pr.r * share AS flow FROM pr JOIN shares ON pr.node = shares.src WHERE pr.i < 40
    UNION ALL SELECT pr.i + 1, pr.node, 0.0 FROM pr WHERE pr.i < 40) f
  JOIN base USING (node)
  CROSS JOIN (SELECT coalesce(sum(r), 0) AS d FROM pr WHERE node IN (SELECT node FROM stuck)) GROUP BY i, node)
SELECT node, round(r, 9) AS rank FROM pr WHERE i = 40"""


@query(_pagerank_sql("1.0 / (SELECT count(*) FROM nodes)"))
def pagerank(spark, sf_dir):
    return graph.pagerank(trade(spark, sf_dir)).select("node", F.round("rank", 9).alias("rank"))


@query(_pagerank_sql("CASE WHEN node BETWEEN 1 AND 10 THEN 1.0 ELSE 0.0 END / (SELECT count(*) FROM customer WHERE c_custkey BETWEEN 1 AND 10)"))
def pagerank_personalized(spark, sf_dir):
    start = table(spark, sf_dir, "customer").where("c_custkey between 1 and 10").select(F.col("c_custkey").alias("node"), F.lit(1.0).alias("weight"))
    return graph.pagerank(trade(spark, sf_dir), restart=start).select("node", F.round("rank", 9).alias("rank"))


@query(f"""WITH {TRADE_SQL},
w AS (SELECT * FROM (VALUES ('trade', 'out', 1.0, 20.0), ('trade', 'in', 0.5, 20.0)) v(kind, direction, factor, floor)),
steps AS (SELECT 'out' AS direction, src AS node, dst AS other, weight FROM edges UNION ALL SELECT 'in', dst, src, weight FROM edges),
f AS (SELECT s.query, st.direction, st.other, st.weight, round(factor * weight, 6) AS s, row_number() OVER (PARTITION BY s.query, st.direction ORDER BY weight DESC, st.node, other) AS nth
  FROM (SELECT c_custkey % 97 AS query, c_custkey AS node FROM customer UNION ALL SELECT s_suppkey % 97, -s_suppkey - 1 FROM supplier) s JOIN steps st USING (node) JOIN w USING (direction) WHERE weight >= floor),
b AS (SELECT query, other AS node, max(s) AS score FROM f WHERE nth <= 60 GROUP BY 1, 2),
x AS (SELECT * FROM b WHERE (query, node) NOT IN (SELECT c_custkey % 97, c_custkey FROM customer UNION ALL SELECT s_suppkey % 97, -s_suppkey - 1 FROM supplier)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank FROM x)
SELECT query, node, score, rank FROM r WHERE rank <= 40""")
def graph_expand(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 97).alias("query"), F.col("c_custkey").alias("node"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 97).alias("query"), (-F.col("s_suppkey") - 1).alias("node"))
    weights = spark.sql("SELECT * FROM VALUES ('trade', 'out', 1.0D, 20.0D), ('trade', 'in', 0.5D, 20.0D) AS v(kind, direction, factor, floor)")
    found = graph.expand(c.unionByName(s), trade(spark, sf_dir).withColumn("kind", F.lit("trade")), weights)
    return found.select("query", "node", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {TRADE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM edges WHERE weight >= 10) SELECT src, dst, weight, rank FROM r WHERE rank <= 4")
def neighbours_topk(spark, sf_dir):
    return graph.neighbours(trade(spark, sf_dir), 4, 10.0).select("src", "dst", "weight", F.col("rank").cast("long").alias("rank"))


SUPPLY_SQL = "calls AS (SELECT DISTINCT l_partkey AS src, l_partkey * 7 % (SELECT max(p_partkey) FROM part) + l_suppkey AS dst FROM lineitem WHERE l_quantity >= 40)"


def _calls(spark, sf_dir, least=40):
    """A second graph: parts that name other parts."""
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("n"))
    i = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= least).crossJoin(F.broadcast(n))  # one row
    return i.select(F.col("l_partkey").alias("src"), (F.col("l_partkey") * 7 % F.col("n") + F.col("l_suppkey")).alias("dst")).distinct()


BFS_SQL = """h1 AS (SELECT DISTINCT dst AS node FROM s JOIN calls ON node = src WHERE dst NOT IN (SELECT node FROM s)),
h2 AS (SELECT DISTINCT dst AS node FROM h1 JOIN calls ON node = src WHERE dst NOT IN (SELECT node FROM s UNION SELECT node FROM h1)),
h3 AS (SELECT DISTINCT dst AS node FROM h2 JOIN calls ON node = src WHERE dst NOT IN (SELECT node FROM s UNION SELECT node FROM h1 UNION SELECT node FROM h2)),
seen AS (SELECT node, 0 AS hop FROM s UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2 UNION ALL SELECT node, 3 FROM h3)"""


@query(f"WITH {SUPPLY_SQL}, s AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 100 = 1), {BFS_SQL} SELECT node, hop FROM seen")
def bfs_3hop(spark, sf_dir):
    start = table(spark, sf_dir, "part").where("p_partkey % 100 = 1").select(F.col("p_partkey").alias("node"))
    return graph.reached(start, _calls(spark, sf_dir), 3)


FEW_SQL = SUPPLY_SQL.replace("l_quantity >= 40", "l_quantity >= 46")


@query(f"""WITH {FEW_SQL}, tests AS (SELECT DISTINCT src, dst FROM calls WHERE src % 50 = 0), s AS (SELECT DISTINCT dst AS node FROM tests), {BFS_SQL},
callers AS (SELECT dst AS node, count(DISTINCT src) AS callers FROM calls GROUP BY 1 HAVING count(DISTINCT src) >= 2),
c AS (SELECT p_partkey AS node, callers FROM part JOIN callers ON p_partkey = node WHERE node NOT IN (SELECT dst FROM tests) ORDER BY callers DESC, node LIMIT 48)
SELECT node, callers FROM c WHERE node NOT IN (SELECT node FROM seen) ORDER BY callers DESC, node LIMIT 12""")
def test_gaps(spark, sf_dir):
    calls = _calls(spark, sf_dir, 46)
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"))
    return analytics.test_gaps(symbols, calls, calls.where("src % 50 = 0"), least_callers=2).select("node", "callers")


CHURN_SQL = f"{CHANGES_SQL}, counts AS (SELECT path, count(*) AS churn, count(*) FILTER (ts >= (SELECT max(ts) FROM changes) - INTERVAL 90 DAY) AS churn_recent, count(DISTINCT author) AS authors, max(ts) AS last FROM changes GROUP BY path)"


@query(f"WITH {CHURN_SQL} SELECT path, churn, churn_recent, authors, strftime(last, '%Y-%m-%d') AS last FROM counts")
def churn(spark, sf_dir):
    return history.churn(changes(spark, sf_dir)).withColumn("last", F.date_format("last", "yyyy-MM-dd"))


PAIRS_SQL = f"{CHURN_SQL}, sized AS (SELECT sha, path FROM changes WHERE sha IN (SELECT sha FROM changes GROUP BY sha HAVING count(*) BETWEEN 2 AND 50)), pairs AS (SELECT a.path AS a, b.path AS b, count(*) AS n FROM sized a JOIN sized b ON a.sha = b.sha AND a.path < b.path GROUP BY 1, 2 HAVING count(*) >= 2), weighted AS (SELECT a, b, n, round(n / greatest(1, least(x.churn, y.churn)), 3) AS weight FROM pairs JOIN counts x ON a = x.path JOIN counts y ON b = y.path)"


def _weighted(spark, sf_dir):
    c = changes(spark, sf_dir)
    return history.cochange_weight(history.cochange(c), history.churn(c))


@query(f"WITH {PAIRS_SQL} SELECT a, b, n FROM pairs")
def cochange_pairs(spark, sf_dir):
    return history.cochange(changes(spark, sf_dir))


@query(f"WITH {PAIRS_SQL} SELECT a, b, n, weight FROM weighted")
def cochange_weight(spark, sf_dir):
    return _weighted(spark, sf_dir)


@query(f"""WITH {CHURN_SQL}, {PARTS_SQL},
r AS (SELECT path, churn, churn_recent, complexity, ln(1 + churn + 2 * churn_recent) AS c, ln(1 + complexity) AS x FROM files JOIN counts USING (path) WHERE NOT is_test AND complexity > 0),
s AS (SELECT path, churn, churn_recent, complexity, round(c / max(c) OVER () * (x / max(x) OVER ()), 3) AS score FROM r)
SELECT path, score, churn, churn_recent, complexity FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 12""")
def hotspots(spark, sf_dir):
    return analytics.hotspots(parts(spark, sf_dir), history.churn(changes(spark, sf_dir)))


@query(f"""WITH {PAIRS_SQL}, {PARTS_SQL}, {SUPPLY_SQL},
l AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM calls)
SELECT a, b, n, weight, round(weight * n, 6) AS strength FROM weighted JOIN files f ON a = f.path JOIN files g ON b = g.path
WHERE f.lang = g.lang AND NOT f.is_test AND NOT g.is_test AND (a, b) NOT IN (SELECT a, b FROM l) ORDER BY strength DESC, a, b LIMIT 10""")
def hidden_coupling(spark, sf_dir):
    return analytics.hidden_coupling(_weighted(spark, sf_dir), parts(spark, sf_dir), _calls(spark, sf_dir), least=2)


@query(f"""WITH {SUPPLY_SQL}, top AS (SELECT p_brand AS path, sum(p_retailprice) AS rank FROM part GROUP BY 1 ORDER BY round(rank, 2) DESC, path LIMIT 18),
c AS (SELECT dst AS node, count(src) AS callers FROM calls GROUP BY 1),
r AS (SELECT p_brand AS path, p_partkey AS node, coalesce(callers, 0) AS callers FROM part JOIN top ON p_brand = path LEFT JOIN c ON p_partkey = node),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY callers DESC, node) AS nth FROM r)
SELECT path, node, callers, nth FROM n WHERE nth <= 6""")
def repo_map(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    files = p.groupBy(F.col("p_brand").alias("path")).agg(F.round(F.sum("p_retailprice"), 2).alias("rank"))
    symbols = p.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("node"))
    return analytics.repo_map(files, symbols, _calls(spark, sf_dir)).select("path", "node", "callers", F.col("nth").cast("long").alias("nth"))


@query(f"WITH {TRADE_SQL}, m AS (SELECT c_custkey AS m FROM customer UNION ALL SELECT -s_suppkey - 1 FROM supplier) SELECT m, dst AS other FROM edges JOIN m ON src = m UNION SELECT m, src FROM edges JOIN m ON dst = m")
def or_join_neighbours(spark, sf_dir):
    """The two directions as two equi-joins."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("m"))
    s = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("m"))
    e = graph.both_ways(trade(spark, sf_dir))
    return c.union(s).join(e, F.col("m") == F.col("src")).select("m", F.col("dst").alias("other")).distinct()


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def semi_join(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1"))
    return table(spark, sf_dir, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query(f"WITH {PAIRS_SQL}, {SUPPLY_SQL} SELECT a, b FROM pairs WHERE NOT EXISTS (SELECT 1 FROM calls WHERE (src = a AND dst = b) OR (src = b AND dst = a))")
def anti_join_bidir(spark, sf_dir):
    linked = _calls(spark, sf_dir).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return history.cochange(changes(spark, sf_dir)).join(linked, ["a", "b"], "left_anti").select("a", "b")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_count(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 3 = 0), s AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 3 <> 0),
j AS (SELECT p.event_id AS point, s.event_id AS span, row_number() OVER (PARTITION BY p.event_id ORDER BY s.ts DESC, s.event_id DESC) AS k FROM p LEFT JOIN s ON p.user_id = s.user_id AND s.ts <= p.ts)
SELECT point, span FROM j WHERE k = 1""")
def asof_chunk(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    points = e.where("event_id % 3 = 0").select("user_id", F.col("event_id").alias("point"), F.col("t").alias("at"))
    spans = e.where("event_id % 3 <> 0").select("user_id", F.col("event_id").alias("span"), F.col("t").alias("start"))
    return retrieval.asof(points, spans, "user_id").select("point", "span")


SPANS_SQL = "spans AS (SELECT l_partkey AS path, l_orderkey * 10 + l_linenumber AS span, l_orderkey AS low, l_orderkey + (l_quantity * 40)::BIGINT AS high FROM lineitem), points AS (SELECT l_partkey AS path, l_orderkey * 10 + l_linenumber AS point, l_orderkey + 7 AS line FROM lineitem WHERE l_linenumber = 1)"


def _spans(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    own = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    spans = i.select(F.col("l_partkey").alias("path"), own.alias("span"), F.col("l_orderkey").alias("low"), (F.col("l_orderkey") + F.round(F.col("l_quantity") * 40).cast("long")).alias("high"))
    points = i.where("l_linenumber = 1").select(F.col("l_partkey").alias("path"), own.alias("point"), (F.col("l_orderkey") + 7).alias("line"))
    return spans, points


@query(f"WITH {SPANS_SQL}, j AS (SELECT path, point, line, span, row_number() OVER (PARTITION BY path, point, line ORDER BY high - low, span) AS k FROM points JOIN spans USING (path) WHERE line BETWEEN low AND high) SELECT path, point, line, span FROM j WHERE k = 1")
def innermost_range(spark, sf_dir):
    spans, points = _spans(spark, sf_dir)
    return retrieval.innermost(points, spans, "path")


@query(f"WITH {SPANS_SQL}, SELECT a.path, a.span AS x, b.span AS y FROM spans a JOIN spans b ON a.path = b.path AND a.span < b.span AND a.high + 3 >= b.low AND a.low - 3 <= b.high")
def interval_overlap(spark, sf_dir):
    spans, _ = _spans(spark, sf_dir)
    side = lambda n: spans.select("path", F.col("span").alias(n), F.col("low").alias(f"{n}_low"), F.col("high").alias(f"{n}_high"))
    return retrieval.overlapping(side("x"), side("y"), "path", 3).where("x < y").select("path", "x", "y")
