"""Chat formatting with Spark expressions only.

Template of a conversation: for each run of adjacent turns of one role a block

    ### <role>: <text></turn>+<text> ... </turn>\\n

Inside roles and texts the control strings are escaped, so they never occur there: ``\\`` is
written ``\\s``, ``###`` is ``\\h``, ``</turn>`` is ``\\t``, and in roles ``:`` is ``\\c``. Every
backslash of an escaped text starts such a pair, so unescaping is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, JOIN, END = "### ", "</turn>", "+", "\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\s"), ("###", "\\h"), (CLOSE, "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in ((CLOSE, "\\t"), ("###", "\\h"), ("\\", "\\s")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (start and end of each assistant text).

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn,
    then role, then text (null first); equal rows each stay a turn. Null role or text: empty. A null
    conv_id is a conversation of its own. No rows: no conversations. Offsets count code points of
    ``formatted``, from 0, end exclusive.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
        .withColumn("body", escape(F.col("text")))
        .withColumn("before", F.lag("role").over(order))
        .withColumn("opens", F.col("before").isNull() | (F.col("before") != F.col("role")))
        .withColumn("head", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(": ")))
    )
    lead = F.when(F.col("before").isNull(), F.char_length("head")).when(F.col("opens"), len(CLOSE + END) + F.char_length("head")).otherwise(len(CLOSE + JOIN))
    rows = rows.withColumn("end", F.sum(lead.cast("long") + F.char_length("body")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sorted_turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "end", "body", "head", "opens")))
    grouped = rows.groupBy("conv_id").agg(sorted_turns.alias("t"))
    heads = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.get("t", i)["opens"])
    grouped = grouped.withColumn("heads", heads)
    after = lambda j: F.coalesce(F.get("heads", j + 1), F.size("t"))
    merged = F.transform(
        "heads",
        lambda at, j: F.concat(
            F.get("t", at)["head"],
            F.array_join(F.transform(F.slice("t", at + 1, after(j) - at), lambda x: x["body"]), CLOSE + JOIN),
            F.lit(CLOSE + END),
        ),
    )
    spans = F.transform(
        F.filter("t", lambda x: x["role"] == LOSS_ROLE),
        lambda x: F.struct((x["end"] - F.char_length(x["body"])).alias("start"), x["end"].alias("end")),
    )
    return grouped.select("conv_id", F.array_join(merged, "").alias("formatted"), spans.alias("spans"))


def parse_formatted(formatted: Column) -> Column:
    """Array of (role, text) turns read back from a formatted conversation."""
    blocks = F.split(formatted, f"{CLOSE}{END}")
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, ":", 1)
        role = unescape_role(F.substring(head, len(OPEN) + 1, 1 << 30))
        texts = F.split(F.substr(block, F.char_length(head) + 3), f"{CLOSE}\\{JOIN}")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
