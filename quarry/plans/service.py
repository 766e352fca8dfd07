"""Queries of changes, jobs, statements and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import change, jobs
from quarry.plans.common import JOBS_SQL, table
from quarry.plans.common import jobs as job_rows
from quarry.storage import Written
from quarry.streaming import events as stream

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NOW = "(SELECT max(ts) FROM jobs)"


def _now(rows):
    return rows.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("now"))))  # one row


@query(f"WITH {JOBS_SQL} SELECT id, kind, (row_number() OVER (PARTITION BY kind ORDER BY ts, id) - 1)::BIGINT AS position FROM jobs")
def queue_position(spark, sf_dir):
    return jobs.queue_position(job_rows(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {JOBS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY kind, client ORDER BY ts DESC, id DESC) AS k FROM jobs WHERE ts > {NOW} - INTERVAL 14 DAY) SELECT kind, client, id FROM r WHERE k = 1")
def latest_cached(spark, sf_dir):
    rows = _now(job_rows(spark, sf_dir))
    return jobs.latest_cached(rows, ["kind", "client"], F.col("now")).select("kind", "client", "id")


@query(f"WITH {JOBS_SQL} SELECT a.id, count(*) AS n FROM jobs a JOIN jobs b ON a.client = b.client AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 1 HOUR GROUP BY a.id")
def rate_1h(spark, sf_dir):
    return jobs.trailing_count(job_rows(spark, sf_dir), ["client"], 3600).select("id", "n")


@query(f"WITH {JOBS_SQL} SELECT id, count(*) OVER (PARTITION BY kind ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n FROM jobs")
def rate_24h(spark, sf_dir):
    return jobs.trailing_count(job_rows(spark, sf_dir), ["kind"], 86400).select("id", "n")


@query(f"WITH {JOBS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, id DESC) AS k FROM jobs WHERE value > 5), m AS (SELECT kind, list_sort(list(value)) AS v FROM l WHERE k <= 25 GROUP BY kind) SELECT kind, v[len(v) // 2 + 1] AS median FROM m")
def typical_seconds(spark, sf_dir):
    return jobs.upper_median(job_rows(spark, sf_dir).where("value > 5"), ["kind"], "value", last=25)


@query(f"WITH {JOBS_SQL} SELECT kind, count(*) AS n, round(avg(value), 6) AS mean FROM jobs WHERE ts > {NOW} - INTERVAL 7 DAY GROUP BY kind")
def job_stats(spark, sf_dir):
    rows = _now(job_rows(spark, sf_dir)).where(F.col("ts") > F.col("now") - F.expr("INTERVAL 7 DAYS"))
    return jobs.statistics(rows, ["kind"])


@query(f"WITH {JOBS_SQL} SELECT id, kind, value FROM jobs WHERE id > 100 ORDER BY id LIMIT 50")
def events_after(spark, sf_dir):
    return jobs.after(job_rows(spark, sf_dir), 100, 50).select("id", "kind", "value")


PATCH_SQL = "p AS (SELECT l_orderkey AS id, string_agg('@@ -' || (l_linenumber * 20) || ',2 +' || (l_linenumber * 20 + 1) || ',3 @@' || chr(10) || ' a' || chr(10) || '-b' || chr(10) || '+c' || chr(10) || '+d', chr(10) ORDER BY l_linenumber) AS patch FROM lineitem GROUP BY 1)"


def _patches(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("k"))
    hunk = F.format_string("@@ -%d,2 +%d,3 @@\n a\n-b\n+c\n+d", F.col("k") * 20, F.col("k") * 20 + 1)
    rows = i.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("k", hunk.alias("h")))).alias("h"))
    return rows.select("id", F.array_join(F.transform("h", lambda x: x["h"]), "\n").alias("patch"))


@query("""SELECT l_orderkey AS id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::INTEGER AS hunk, l_linenumber * 20 AS old_start, l_linenumber * 20 + 1 AS new_start,
  (l_linenumber * 20 + 2) || ',' || (l_linenumber * 20 + 3) AS added, (l_linenumber * 20 + 1)::VARCHAR AS removed FROM lineitem""")
def hunks(spark, sf_dir):
    h = change.hunks(_patches(spark, sf_dir))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return h.select("id", "hunk", "old_start", "new_start", join("added").alias("added"), join("removed").alias("removed"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS id, (l_suppkey % 120)::INTEGER AS line FROM lineitem)
SELECT id, line, EXISTS (SELECT 1 FROM lineitem h WHERE h.l_orderkey = id AND line BETWEEN h.l_linenumber * 20 + 1 - 3 AND h.l_linenumber * 20 + 3 + 3) AS hit FROM l""")
def in_hunks(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 120).cast("int").alias("line")).distinct()
    return change.in_hunks(lines, change.hunks(_patches(spark, sf_dir)), 3)


SYMBOLS_SQL = """symbols AS (SELECT l_orderkey AS path, l_linenumber AS symbol, CASE WHEN l_linenumber > 1 THEN 1 END AS parent, CASE WHEN l_linenumber = 1 THEN 1 ELSE l_linenumber * 10 END AS low, CASE WHEN l_linenumber = 1 THEN 100 ELSE l_linenumber * 10 + 8 END AS high FROM lineitem),
lines AS (SELECT DISTINCT l_orderkey AS path, (l_partkey % 100)::INTEGER AS line FROM lineitem)"""


@query(f"WITH {SYMBOLS_SQL}, t AS (SELECT path, symbol, parent, count(DISTINCT line) AS lines FROM symbols JOIN lines USING (path) WHERE line BETWEEN low AND high GROUP BY 1, 2, 3) SELECT path, symbol, lines FROM t WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.path = t.path AND c.parent = t.symbol)")
def changed_symbols(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    symbols = i.select(F.col("l_orderkey").alias("path"), n.alias("symbol"), F.when(n > 1, 1).alias("parent"), F.when(n == 1, 1).otherwise(n * 10).alias("low"), F.when(n == 1, 100).otherwise(n * 10 + 8).alias("high"))
    lines = i.select(F.col("l_orderkey").alias("path"), (F.col("l_partkey") % 100).cast("int").alias("line")).distinct()
    return change.changed_symbols(symbols, lines, "path")


@query("""WITH RECURSIVE d AS (SELECT doc_id // 40 AS change, doc_id AS id, coalesce(n_chars, 0) AS size,
  row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id % 5 = 0, coalesce(n_chars, 0) DESC, doc_id) AS k FROM documents),
r AS (SELECT change, 0::BIGINT AS k, NULL::BIGINT AS id, 0::BIGINT AS files, 0::BIGINT AS lines, false AS admitted FROM d GROUP BY change
  UNION ALL
  SELECT d.change, d.k, d.id, r.files + (r.files < 20 AND r.lines + d.size <= 30000)::INT, r.lines + CASE WHEN r.files < 20 AND r.lines + d.size <= 30000 THEN d.size ELSE 0 END, r.files < 20 AND r.lines + d.size <= 30000
  FROM r JOIN d ON d.change = r.change AND d.k = r.k + 1)
SELECT change::VARCHAR AS "group", id, admitted FROM r WHERE k > 0""")
def admit_budget(spark, sf_dir):
    """Forty documents are a change."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 40).cast("string").alias("group"), F.col("doc_id").alias("id"), (F.col("doc_id") % 5 == 0).alias("is_test"), F.coalesce("n_chars", F.lit(0)).alias("size"))
    return change.admit(d, 20, 30_000).select("group", "id", "admitted")


FINDINGS_SQL = """f AS (SELECT l_orderkey AS review, (l_orderkey * 10 + l_linenumber)::BIGINT AS id, min(l_returnflag) AS path, min(l_linestatus) AS category, (min(l_suppkey) * 3 % 97)::BIGINT AS low, (min(l_suppkey) * 3 % 97 + floor(min(l_quantity)))::BIGINT AS high FROM lineitem GROUP BY l_orderkey, l_linenumber),
o AS (SELECT *, row_number() OVER (PARTITION BY review ORDER BY id) AS k FROM f)"""


def _greedy_sql(clash: str) -> str:
    return f"""WITH RECURSIVE {FINDINGS_SQL},
r AS (SELECT review, 0::BIGINT AS k, NULL::BIGINT AS id, []::STRUCT(path VARCHAR, category VARCHAR, low BIGINT, high BIGINT)[] AS seen, false AS kept FROM o GROUP BY review
  UNION ALL
  SELECT o.review, o.k, o.id, CASE WHEN ok THEN list_append(seen, {{'path': o.path, 'category': o.category, 'low': o.low, 'high': o.high}}) ELSE seen END, ok
  FROM (SELECT o.*, r.seen, len(list_filter(r.seen, lambda s: {clash})) = 0 AS ok FROM r JOIN o ON o.review = r.review AND o.k = r.k + 1) o)
SELECT review, id, kept FROM r WHERE k > 0"""


def _findings(spark, sf_dir):
    named = [F.min(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_suppkey", "l_quantity")]
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*named)
    low = (F.col("l_suppkey") * 3 % 97).cast("long")
    i = i.where("l_orderkey is not null")
    return i.select(F.col("l_orderkey").alias("review"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), F.col("l_returnflag").alias("path"), F.col("l_linestatus").alias("category"), low.alias("low"), (low + F.floor("l_quantity")).alias("high"))


@query(_greedy_sql("s.path = o.path AND s.category = o.category AND o.low <= s.high AND s.low <= o.high"))
def dedupe_findings(spark, sf_dir):
    return change.collapse_findings(_findings(spark, sf_dir)).select("review", "id", "kept")


@query(_greedy_sql("s.path = o.path AND s.low <= o.low AND o.high <= s.high"))
def span_dedupe(spark, sf_dir):
    return change.collapse_spans(_findings(spark, sf_dir)).select("review", "id", "kept")


@query("""WITH f AS (SELECT doc_id AS id, 's' || (doc_id % 23) AS path, doc_id % 40 AS line, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1 END AS cite FROM labels),
s AS (SELECT 's' || i AS path, 10 + i AS n_lines FROM range(0, 20) r(i))
SELECT id, f.path, line, array_to_string(list_filter([CASE WHEN n_lines IS NULL THEN 'unknown path' END, CASE WHEN line > n_lines THEN 'line out of range' END,
  CASE WHEN cite IS NOT NULL AND cite NOT IN (SELECT doc_id FROM labels) THEN 'unknown evidence' END,
  CASE WHEN NOT (line BETWEEN 0 AND 20) AND (cite IS NULL OR cite NOT IN (SELECT doc_id FROM labels)) OR n_lines IS NULL AND (cite IS NULL OR cite NOT IN (SELECT doc_id FROM labels)) THEN 'not in change and no evidence' END], lambda x: x IS NOT NULL), '; ') AS problems
FROM f LEFT JOIN s USING (path)""")
def ground_findings(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    f = labels.select("id", F.concat(F.lit("s"), (F.col("id") % 23).cast("string")).alias("path"), (F.col("id") % 40).alias("line"), F.when(F.col("id") % 3 == 0, F.array(F.col("id") + 1)).alias("cites"))
    s = spark.range(20).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("path"), (F.col("id") + 10).alias("n_lines"))
    ranges = s.select("path", F.lit(10).alias("low"), F.lit(10).alias("high"))
    out = change.ground(f, s, ranges, labels, slack=10)
    return out.withColumn("problems", F.array_join("problems", "; "))


@query("""WITH f AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'low' ELSE 'high' END AS severity FROM labels), v AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'confirmed' ELSE 'rejected' END AS verdict, CASE WHEN toxic = 1 THEN 'critical' END AS severity FROM labels WHERE quality = 1)
SELECT id, coalesce(v.severity, f.severity) AS severity, coalesce(verdict, 'uncertain') AS verdict, coalesce(verdict, 'uncertain') = 'confirmed' AS shown FROM f LEFT JOIN v USING (id)""")
def verify_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    f = labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "low").otherwise("high").alias("severity"))
    v = labels.where("quality = 1").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "confirmed").otherwise("rejected").alias("verdict"), F.when(F.col("toxic") == 1, "critical").alias("severity"))
    return change.verified(f, v).drop("order")


@query("""WITH w AS (SELECT conv_id, turn, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS used FROM conversations) SELECT conv_id, turn, used::BIGINT AS used FROM w WHERE used <= 2000""")
def context_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("size", F.char_length(F.coalesce("text", F.lit(""))))
    return change.within_budget(c, "conv_id", ["turn", "role", "text"], "size", 2000).select("conv_id", "turn", "used")


@query("""SELECT conv_id, count(*) AS n, CASE WHEN length(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text)) > 2400 THEN substr(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text), 1, 2400) || chr(10) || '... [clipped]' ELSE string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) END AS prompt FROM conversations GROUP BY 1""")
def prompt_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return rows.select("conv_id", "n", text.clipped(joined).alias("prompt"))


@query("SELECT o_orderkey, o_totalprice - (SELECT avg(o_totalprice) FROM orders) > 0 AS above FROM orders")
def scalar_subquery(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.crossJoin(F.broadcast(o.agg(F.avg("o_totalprice").alias("m")))).select("o_orderkey", (F.col("o_totalprice") - F.col("m") > 0).alias("above"))  # one row


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def in_subquery_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(gone, "o_custkey", "left_anti")


@query("""WITH old AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0), new AS (SELECT c_custkey AS k, c_name AS name, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 3 = 0)
SELECT k, coalesce(old.name, new.name) AS name, round(coalesce(new.v, old.v), 4) AS v FROM old FULL JOIN new USING (k)""")
def upsert_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"))
    old = c.where("k % 2 = 0")
    new = c.where("k % 3 = 0").select("k", F.col("name").alias("name2"), (F.col("v") + 1).alias("v2"))
    return old.join(new, "k", "full").select("k", F.coalesce("name", "name2").alias("name"), F.round(F.coalesce("v2", "v"), 4).alias("v"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k > 4")
def offset_tail(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k > 4").select("o_orderkey", "o_custkey")


@query("SELECT conv_id, turn, substr(sha1(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))), 1, 16) AS key FROM conversations WHERE role = 'user'")
def question_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", text.question_key(F.coalesce("text", F.lit(""))).alias("key"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(text.json_object(F.col("props")), "$.k").cast("long").alias("k"))


def _streamed(spark, sf_dir, make, mode="append", by_day=False):
    """Runs a stream over the events to its end and returns what it wrote. With ``by_day`` the events
    come in files of a few days, in order, each a batch."""
    store = Written(spark, "stream")
    events = table(spark, sf_dir, "events")
    if by_day:
        days = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (5 * 86400))
        folder = f"{store.root}/days"
        events.withColumn("day", days).repartition("day").sortWithinPartitions("ts").write.partitionBy("day").parquet(folder)
        for n, (part,) in enumerate(spark.read.parquet(folder).select("day").distinct().orderBy("day").collect()):  # a few days each
            spark.read.schema(events.schema).parquet(f"{folder}/day={part}").coalesce(1).write.mode("append").parquet(f"{store.root}/ordered")
        source = stream.event_stream(spark, f"{store.root}/ordered", events.schema)
    else:
        source = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parque[t]")
    out = f"{store.root}/out"
    result = make(source.withColumn("ts", F.col("ts").cast("timestamp")))
    # in complete mode each batch has all rows: the last one stays
    name = (lambda n: out) if mode == "complete" else (lambda n: f"{out}/batch={n}")
    stream.drain(result, f"{store.root}/checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(name(n)), mode)
    if mode == "complete":
        return spark.read.schema(result.schema).parquet(out)
    return spark.read.schema(result.schema).option("basePath", out).parquet(f"{out}/batch=*")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_counts(spark, sf_dir):
    """All windows, those that the watermark has not passed too."""
    counts = _streamed(spark, sf_dir, lambda e: stream.windowed_counts(e, "1 day", "1 hour"), "complete")
    return counts.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


TTL_SQL = """WITH RECURSIVE kept AS (
  SELECT event_type, user_id, min(ts) AS ts FROM events GROUP BY 1, 2
  UNION ALL
  SELECT e.event_type, e.user_id, min(e.ts) FROM kept k JOIN events e ON e.event_type = k.event_type AND e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 14 DAY GROUP BY 1, 2)"""


@query(f"{TTL_SQL} SELECT event_type, user_id, epoch_us(ts) AS ts FROM kept")
def stream_dedupe(spark, sf_dir):
    """A job of the same kind and client is not run again within 14 days."""
    rows = _streamed(spark, sf_dir, lambda e: stream.without_duplicates(e, ["event_type", "user_id"]), by_day=True)
    return rows.select("event_type", "user_id", F.unix_micros("ts").alias("ts"))


@query(f"{TTL_SQL} SELECT event_type AS kind, user_id AS client, epoch_us(ts) AS ts FROM kept")
def ttl_dedupe(spark, sf_dir):
    return jobs.first_in_ttl(job_rows(spark, sf_dir), ["kind", "client"]).select("kind", "client", F.unix_micros("ts").alias("ts"))


STATUS_SQL = "(CASE id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'done' END)"


def _states(spark, sf_dir):
    status = F.when(F.col("id") % 4 == 0, "queued").when(F.col("id") % 4 == 1, "running").otherwise("done")
    return job_rows(spark, sf_dir).withColumn("status", status)


@query(f"WITH {JOBS_SQL} SELECT kind, arg_min(id, (ts, id)) AS id FROM jobs WHERE {STATUS_SQL} = 'queued' GROUP BY kind")
def claim_oldest(spark, sf_dir):
    return jobs.claimed(_states(spark, sf_dir))


@query(f"WITH {JOBS_SQL} SELECT id, CASE WHEN {STATUS_SQL} = 'running' AND ts < {NOW} - INTERVAL 1800 SECOND THEN 'failed' ELSE {STATUS_SQL} END AS status FROM jobs")
def stale_jobs(spark, sf_dir):
    return jobs.stale(_now(_states(spark, sf_dir)), F.col("now")).select("id", "status")
