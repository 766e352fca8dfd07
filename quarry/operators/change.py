"""Changes: patches, hunks, admission under budgets, grounding and de-duplication of findings."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The line that opens a hunk of a unified diff.
HUNK = r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"
HUNK_HEAD = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"
HUNK_SIDES = r"^@@ -(\d+(?:,\d+)?) \+(\d+(?:,\d+)?) @@(.*)$"
SEVERITIES = ["critical", "high", "medium", "low", "info"]


def hunks(patches: DataFrame) -> DataFrame:
    """One row per hunk of (id, patch): ranges, header, lines, new-side numbers of added and old-side
    ones of removed lines. Lines that begin with a backslash are notes. Null patches have none.

    Expressions only: a patch is cut before its @@ lines, a hunk's lines are counted by an aggregate.
    """
    parts = F.posexplode(F.filter(F.split("patch", r"(?:^|\n)(?=@@ -\d)"), lambda h: h.rlike(HUNK))).alias("hunk", "h")
    rows = patches.select("id", parts).withColumn("lines", F.split("h", "\n"))
    head = F.get("lines", F.lit(0))
    number = lambda g: F.regexp_extract(head, HUNK_HEAD, g)
    count = lambda g: F.when(number(g) == "", 1).otherwise(number(g).try_cast("int"))
    rows = rows.select(
        "id", "hunk", number(1).cast("int").alias("old_start"), count(2).alias("old_len"), number(3).cast("int").alias("new_start"), count(4).alias("new_len"),
        F.trim(number(5)).alias("header"), F.slice("lines", F.lit(2), F.size("lines")).alias("lines"),
    )
    none = F.array().cast("array<int>")
    start = F.struct(F.col("old_start").alias("old"), F.col("new_start").alias("new"), none.alias("added"), none.alias("removed"))

    def step(at: Column, line: Column) -> Column:
        plus, minus, note = line.startswith("+"), line.startswith("-"), line.startswith("\\")
        return F.struct(
            (at["old"] + F.when(plus | note, 0).otherwise(1)).alias("old"),
            (at["new"] + F.when(minus | note, 0).otherwise(1)).alias("new"),
            F.when(plus, F.array_append(at["added"], at["new"])).otherwise(at["added"]).alias("added"),
            F.when(minus, F.array_append(at["removed"], at["old"])).otherwise(at["removed"]).alias("removed"),
        )

    return rows.withColumn("n", F.aggregate("lines", start, step)).select("id", "hunk", "old_start", "old_len", "new_start", "new_len", "header", "lines", F.col("n.added").alias("added"), F.col("n.removed").alias("removed"))


def annotated(hunk_rows: DataFrame) -> DataFrame:
    """id, text: a patch's hunks with new-side line numbers in front of the lines that have one."""
    before = F.col("new_start")
    lines = F.filter("lines", lambda x: ~x.startswith("\\"))
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("x"), (before + F.size(F.filter(F.slice(lines, F.lit(1), i), lambda y: ~y.startswith("-")))).alias("n")))
    body = F.transform(
        numbered,
        lambda r: F.when(r["x"].startswith("-"), F.concat(F.lit("      - "), F.substr(r["x"], F.lit(2)))).otherwise(
            F.concat(F.lpad(r["n"].cast("string"), 5, " "), F.when(r["x"].startswith("+"), F.lit(" + ")).otherwise(F.lit("   ")), F.substr(r["x"], F.lit(2)))
        ),
    )
    head = F.format_string("@@ old %d,%d new %d,%d @@ %s", "old_start", "old_len", "new_start", "new_len", "header")
    text = F.concat_ws("\n", head, F.array_join(body, "\n"))
    rows = hunk_rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("hunk", text.alias("t")))).alias("t"))
    return rows.select("id", F.array_join(F.transform("t", lambda x: x["t"]), "\n").alias("text"))


def reversed_patch(patch: Column) -> Column:
    """A patch of one file with its sides swapped; file headers go."""
    def line(x: Column) -> Column:
        head = F.concat(
            F.lit("@@ -"), F.regexp_extract(x, HUNK_SIDES, 2), F.lit(" +"), F.regexp_extract(x, HUNK_SIDES, 1), F.lit(" @@"), F.regexp_extract(x, HUNK_SIDES, 3)
        )
        swapped = F.when(x.startswith("+"), F.concat(F.lit("-"), F.substr(x, F.lit(2)))).when(x.startswith("-"), F.concat(F.lit("+"), F.substr(x, F.lit(2))))
        return F.when(x.rlike(HUNK_SIDES), head).otherwise(F.coalesce(swapped, x))

    header = lambda x: x.startswith("diff --git") | x.startswith("index ") | x.startswith("---") | x.startswith("+++")
    lines = F.split(F.regexp_replace(patch, r"\n$", ""), "\n")
    return F.concat(F.array_join(F.transform(F.filter(lines, lambda x: ~header(x)), line), "\n"), F.lit("\n"))


def gold_ranges(hunk_rows: DataFrame, context: int = 3) -> DataFrame:
    """id, hunk, low, high: the old-side lines that a hunk changes, inside its context lines."""
    low = F.col("old_start") + context
    return hunk_rows.select("id", "hunk", low.alias("low"), F.greatest(low, F.col("old_start") + F.col("old_len") - context - 1).alias("high"))


def gold_regions(hunk_rows: DataFrame, context: int = 3) -> DataFrame:
    """id, hunk, low, high: the new-side lines from the first added to the last, or around the place
    where a hunk only removes."""
    at = F.col("new_start") + context
    some = F.size("added") > 0
    return hunk_rows.select("id", "hunk", F.when(some, F.array_min("added")).otherwise(at - 1).alias("low"), F.when(some, F.array_max("added")).otherwise(at + 1).alias("high"))


def in_hunks(lines: DataFrame, ranges: DataFrame, slack: int = 3) -> DataFrame:
    """lines (id, line) with hit: within ``slack`` of a hunk's new side."""
    near = lines.join(ranges.select("id", "new_start", "new_len"), "id").where(F.col("line").between(F.col("new_start") - slack, F.col("new_start") + F.greatest(F.col("new_len"), F.lit(1)) - 1 + slack))
    return lines.join(near.select("id", "line").distinct().withColumn("hit", F.lit(True)), ["id", "line"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def changed_symbols(symbols: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Symbols (key, symbol, parent, low, high) touched by changed lines (key, line): the innermost,
    that is without those that have a touched child."""
    touched = symbols.join(lines, key).where(F.col("line").between(F.col("low"), F.col("high"))).groupBy(key, "symbol", "parent").agg(F.count_distinct("line").alias("lines"))
    parents = touched.select(key, F.col("parent").alias("symbol")).where("symbol is not null").distinct()
    return touched.join(parents, [key, "symbol"], "left_anti").select(key, "symbol", "lines")


def admit(files: DataFrame, most_files: int = 50, most_lines: int = 3000) -> DataFrame:
    """Files (group, id, is_test, size) taken in order of (is_test, -size, id) while budgets last;
    one that is too large is skipped, later ones may still fit. One group a task: a change."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(_s=-frame["size"]).sort_values(["is_test", "_s", "id"])
        files = lines = 0
        taken = []
        for size in frame["size"]:
            ok = files < most_files and lines + size <= most_lines
            files, lines = files + ok, lines + size * ok
            taken.append(bool(ok))
        return frame.assign(admitted=taken)[["group", "id", "size", "admitted"]]

    return files.select("group", "id", "is_test", "size").groupBy("group").applyInPandas(run, "group string, id long, size long, admitted boolean")


def _kept_first(rows: DataFrame, by: list[str], below: str, least: str) -> DataFrame:
    """``rows`` with kept: false for those that clash with an earlier kept one, in the order of id, of
    the same ``by``: one whose low is at most the row's ``below`` and whose high is at least its
    ``least``. A row with a null among these clashes with nothing.

    Sorted rows come as a stream. Of a group only those kept spans are held that no other one reaches
    beyond on both sides, so low and high ascend together, and a row costs one bisection.
    """
    need = [*by, "low", "high"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, lows, highs = None, [], []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            whole, new = np.ones(n, bool), np.zeros(n, bool)
            for c in need:
                whole &= batch.column(c).is_valid().to_numpy(zero_copy_only=False)
            for c in by:
                x = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= x[1:] != x[:-1]
            new[0] = [batch.column(c)[0].as_py() for c in by] != before
            before = [batch.column(c)[n - 1].as_py() for c in by]
            kept = np.ones(n, bool)
            # the only row of a group stays; what follows the last one is not known yet
            at = np.flatnonzero(~(new & np.append(new[1:], False)))
            columns = [x[at].tolist() for x in (new, whole, *(batch.column(c).fill_null(0).to_numpy() for c in ("low", "high", below, least)))]
            for i, first, ok, low, high, x, y in zip(at.tolist(), *columns, strict=True):
                if first:
                    lows, highs = [], []
                if not ok:
                    continue
                k = bisect_right(lows, x)
                if k and highs[k - 1] >= y:
                    kept[i] = False
                    continue
                k = bisect_right(lows, low)
                if not k or highs[k - 1] < high:
                    own = slice(bisect_left(lows, low), bisect_right(highs, high))
                    own = slice(own.start, max(own.start, own.stop))
                    lows[own], highs[own] = [low], [high]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept)], names=[*batch.schema.names, "kept"])

    order = [*by, F.asc_nulls_last("id")]
    return rows.repartition(*by).sortWithinPartitions(*order).mapInArrow(run, schema)


def collapse_findings(findings: DataFrame) -> DataFrame:
    """findings (review, id, path, category, low, high) with kept: false for those that overlap an
    earlier kept one of the same review, path and category."""
    f = findings.select("review", "id", "path", "category", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
    return _kept_first(f, ["review", "path", "category"], "high", "low")


def collapse_spans(spans: DataFrame) -> DataFrame:
    """spans (review, id, path, low, high) with kept: false for those inside an earlier kept one of the
    same review and path."""
    s = spans.select("review", "id", "path", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
    return _kept_first(s, ["review", "path"], "low", "high")


def ground(findings: DataFrame, files: DataFrame, ranges: DataFrame, evidence: DataFrame, slack: int = 10) -> DataFrame:
    """findings (id, path, line, cites) with the array of problems that drop them: unknown path, line
    beyond the file (path, n_lines), unknown evidence (id), neither in the change nor with evidence."""
    f = findings.join(files, "path", "left")
    known = findings.select("id", F.explode_outer("cites").alias("cite")).join(evidence.select(F.col("id").alias("cite"), F.lit(True).alias("ok")), "cite", "left")
    cited = known.groupBy("id").agg(F.count_if(F.col("cite").isNotNull() & F.col("ok").isNull()).alias("missing"), F.count_if("ok").alias("found"))
    near = findings.join(ranges, "path").where(F.col("line").between(F.col("low") - slack, F.col("high") + slack)).select("id").distinct().withColumn("near", F.lit(True))
    f = f.join(cited, "id", "left").join(near, "id", "left")
    problems = F.array_compact(F.array(
        F.when(F.col("n_lines").isNull(), F.lit("unknown path")),
        F.when(F.col("line") > F.col("n_lines"), F.lit("line out of range")),
        F.when(F.col("missing") > 0, F.lit("unknown evidence")),
        F.when(F.col("near").isNull() & (F.coalesce("found", F.lit(0)) == 0), F.lit("not in change and no evidence")),
    ))
    return f.select("id", "path", "line", problems.alias("problems"))


def verified(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """findings (id, severity) with the verdict (id, verdict, severity) given, uncertain without;
    confirmed ones are shown, by severity."""
    v = verdicts.select("id", "verdict", F.col("severity").alias("override"))
    rows = findings.join(v, "id", "left").withColumns({"verdict": F.coalesce("verdict", F.lit("uncertain")), "severity": F.coalesce("override", "severity")}).drop("override")
    order = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return rows.withColumns({"shown": F.col("verdict") == "confirmed", "order": order})


def within_budget(items: DataFrame, by: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Items whose running size within ``by`` stays in the budget; the first that does not ends it."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)
