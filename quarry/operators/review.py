"""Review of changes: which files count, findings as they come from a model, reports, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.paths import any_of, file_name, language
from quarry.functions.text import json_object

#: Lock files and generated or binary formats, which nobody reviews.
SKIPPED_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Cargo.lock", "go.sum", "composer.lock", "Gemfile.lock", "uv.lock"]
SKIPPED_ENDS = [".lock", "-lock.json", ".min.js", ".min.css", ".map", ".snap", ".svg", ".png", ".jpg", ".gif", ".ico", ".pdf", ".woff", ".woff2", ".ttf"]
#: Relations of a symbol and how many of each go into its context.
CONTEXT = {"caller": 3, "test": 2, "subclass": 2, "callee": 3}
FINDING = "struct<title:string,severity:string,category:string,path:string,line_start:int,line_end:int,side:string,explanation:string,evidence:array<string>,suggestion:string,confidence:string>"
LEAST_WORDS = 8


def reviewable(path: Column, patch: Column) -> Column:
    """No lock or generated file, a known language, and a patch."""
    skipped = file_name(path).isin(*SKIPPED_NAMES) | any_of([path.endswith(e) for e in SKIPPED_ENDS])
    return ~skipped & language(path).isNotNull() & (F.coalesce(patch, F.lit("")) != "")


def findings(replies: DataFrame) -> DataFrame:
    """id, nth, valid and a finding's fields from replies (id, reply): the JSON object in the text.

    Fields that may lack get their defaults; a finding is valid when title, path, line_start and
    explanation are there. A reply without an object, or without summary and findings, gives no rows.
    """
    parsed = F.from_json(json_object(F.col("reply")), f"summary string, findings array<{FINDING}>")
    rows = replies.select("id", parsed.alias("r")).where("r.summary is not null and r.findings is not null")
    rows = rows.select("id", F.posexplode("r.findings").alias("nth", "f")).select("id", "nth", "f.*")
    valid = F.col("title").isNotNull() & F.col("path").isNotNull() & F.col("line_start").isNotNull() & F.col("explanation").isNotNull()
    last = F.when(F.col("line_end") > 0, F.col("line_end")).otherwise(F.col("line_start"))
    empty = F.array().cast("array<string>")
    defaults = {"side": F.lit("new"), "evidence": empty, "severity": F.lit("minor"), "category": F.lit("bug"), "confidence": F.lit("medium")}
    return rows.withColumns({"valid": valid, "line_end": last, **{c: F.coalesce(F.col(c), d) for c, d in defaults.items()}})


def answered(answer: Column, least: int = LEAST_WORDS) -> Column:
    """Whether an answer has ``least`` words or more."""
    return F.size(F.array_remove(F.split(F.trim(F.coalesce(answer, F.lit(""))), r"\s+"), "")) >= least


def on_changed_lines(reports: DataFrame, lines: DataFrame, limit: int = 40) -> DataFrame:
    """The first ``limit`` reports (path, line, code) of an analyzer on changed lines (path, line)."""
    return reports.join(lines.select("path", "line"), ["path", "line"], "left_semi").orderBy("path", "line", "code").limit(limit)


def markdown(reviews: DataFrame, rows: DataFrame) -> DataFrame:
    """id, text: a report of reviews (id, title, summary, risk) and findings (id, nth, path, line_start,
    severity, title, explanation, suggestion). A suggestion with a line that begins with + or - is a diff."""
    body = F.trim("suggestion")
    fence = F.when(body.rlike(r"(?m)^[+-]"), F.lit("```diff")).otherwise(F.lit("```"))
    place = F.concat(F.lit("**"), F.upper("severity"), F.lit("** `"), F.col("path"), F.lit(":"), F.col("line_start").cast("string"), F.lit("` "), F.col("title"))
    text = F.concat_ws("\n", F.lit(""), place, F.lit(""), F.col("explanation"), F.when(F.coalesce(body, F.lit("")) != "", F.concat_ws("\n", F.lit(""), fence, body, F.lit("```"))))
    own = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("nth", text.alias("t")))).alias("t"))
    joined = reviews.join(own, "id", "left")
    listed = F.when(F.col("t").isNull(), F.lit("No blocking issues found.")).otherwise(F.concat(F.lit("### Findings\n"), F.array_join(F.transform("t", lambda x: x["t"]), "\n")))
    head = F.concat_ws("\n", F.concat(F.lit("## "), F.col("title")), F.lit(""), F.col("summary"), F.lit(""), F.concat(F.lit("**Risk:** "), F.coalesce("risk", F.lit("unknown"))), F.lit(""))
    return joined.select("id", F.concat_ws("\n", head, listed).alias("text"))


def symbol_status(head: DataFrame, base: DataFrame) -> DataFrame:
    """path, symbol, status, lines of touched symbols (path, symbol, lines) of both sides of a change:
    added, modified or removed; the lines of the head, or of the base for removed ones."""
    h = head.select("path", "symbol", F.col("lines").alias("h"))
    b = base.select("path", "symbol", F.col("lines").alias("b"))
    status = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").otherwise("modified")
    return h.join(b, ["path", "symbol"], "full").select("path", "symbol", status.alias("status"), F.coalesce("h", "b").alias("lines"))


def context_pack(changed: DataFrame, relations: DataFrame, budget: int = 70_000, most_symbols: int = 10) -> DataFrame:
    """review, symbol, kind, item, size, used: evidence for the most changed symbols of each review.

    ``changed`` has review, symbol, lines, is_test; ``relations`` symbol, kind (see CONTEXT), item,
    weight, size. Of each kind a symbol gets its heaviest; items are taken once a review, in order of
    the symbol's place, kind and weight, until the budget of characters is used.
    """
    first = F.row_number().over(Window.partitionBy("review").orderBy("is_test", F.desc("lines"), "symbol"))
    top = changed.withColumn("place", first).where(F.col("place") <= most_symbols)
    quota = F.create_map(*[F.lit(x) for item in CONTEXT.items() for x in item])
    nth = F.row_number().over(Window.partitionBy("symbol", "kind").orderBy(F.desc("weight"), "item"))
    kept = relations.withColumn("nth", nth).where(F.col("nth") <= F.coalesce(F.try_element_at(quota, F.col("kind")), F.lit(0)))
    turn = F.array_position(F.array(*[F.lit(k) for k in CONTEXT]), F.col("kind"))
    rows = top.join(kept, "symbol").select("review", "symbol", "kind", "item", "size", F.struct("place", turn.alias("turn"), "nth", "item").alias("at"))
    once = F.row_number().over(Window.partitionBy("review", "item").orderBy("at"))
    running = Window.partitionBy("review").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("once", once).where("once = 1").withColumn("used", F.sum("size").over(running))
    return rows.where(F.col("used") <= budget).drop("at", "once")


def blended_report(scored: DataFrame, digits: int = 3) -> DataFrame:
    """review, shown, hidden of findings (review, verdict): how many are confirmed and how many not."""
    shown = F.count_if(F.col("verdict") == "confirmed")
    return scored.groupBy("review").agg(shown.alias("shown"), (F.count("*") - shown).alias("hidden"), F.round(shown / F.count("*"), digits).alias("share"))
