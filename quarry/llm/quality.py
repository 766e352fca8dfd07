"""Quality rules combined by weak supervision, with Spark expressions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of
vote patterns estimates, without labels, how each rule votes on good and on bad documents, and the
share of good ones; a document is kept when its posterior probability of being good is 0.5 or more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quarry.llm.common import SEPARATOR_RUN, WORD_SEPARATORS, Scratch, words_column

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages of the corpus.
FUNCTION_WORDS = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "de", "la", "que", "el", "los", "der", "die", "das", "und", "zu", "von", "le", "les", "et", "des", "en", "un", "une"]
ROUNDS = 25
#: Starting shares of the votes (bad, none, good) on bad and on good documents.
BAD_START = {-1: 0.25, 0: 0.2, 1: 0.55}
GOOD_START = {-1: 0.002, 0: 0.25, 1: 0.748}
START_GOOD = 0.85
STRENGTH = 0.02
VOTES = (-1, 0, 1)


def let(value: Column, body) -> Column:
    """``body`` of a bound variable, so that ``value`` is evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_hashes(words: Column) -> Column:
    """A 64-bit hash for each window of 5 words, compared within one text only; n windows collide
    with probability below n * n / 2**65."""
    starts = F.when(F.size(words) >= 5, F.sequence(F.lit(0), F.size(words) - 5)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))


def repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, the first included.

    Sorting (hash, place) brings equal windows together; their places, sorted, each add as many
    words as the next one leaves uncovered.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))

    def covered(places: Column) -> Column:
        news = F.transform(places, lambda p, j: F.least(F.lit(5), F.coalesce(F.get(places, j + 1), p + 5) - p).cast("long"))
        return F.aggregate(news, F.lit(0).cast("long"), lambda x, y: x + y)

    def twice(found: Column) -> Column:
        same = F.filter(found, lambda x, j: yes(F.get(found, j - 1)["h"] == x["h"]) | yes(F.get(found, j + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def count(hashes: Column) -> Column:
        found = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(found, twice)).otherwise(F.lit(0).cast("long"))

    return let(window_hashes(words), count)


def removed(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, "[" + "".join(f"\\{c}" for c in chars) + "]+", ""))


def metrics(docs: DataFrame) -> DataFrame:
    """Counts of each document, in one pass over its text; see ``weak_supervision`` for odd inputs."""

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).alias("n_distinct"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(FUNCTION_WORDS))).alias("n_function"),
            F.coalesce(F.array_max(F.transform(w, F.char_length)), F.lit(0)).alias("longest_word"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    def of_letters(x: Column) -> Column:
        return F.struct(F.char_length(x).alias("n_letters"), F.char_length(F.regexp_replace(x, r"[^\p{Lu}]+", "")).alias("n_upper"))

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.char_length(F.btrim(x, F.lit(WORD_SEPARATORS))) > 0)
        return F.struct(
            let(words_column(t), of_words).alias("w"),
            let(lines, of_lines).alias("l"),
            let(F.regexp_replace(t, r"[^\p{L}]+", ""), of_letters).alias("c"),
            F.char_length(F.regexp_replace(t, SEPARATOR_RUN, "")).cast("long").alias("word_chars"),
            removed(t, SYMBOLS).cast("long").alias("n_symbols"),
            removed(t, "!").alias("n_bangs"),
            removed(t, ".?").alias("n_stops"),
        )

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.inline(F.transform(F.array(text), of_text))).select("doc_id", "w.*", "l.*", "c.*", "word_chars", "n_symbols", "n_bangs", "n_stops")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def rules() -> dict[str, Column]:
    """A column of votes (-1, 0, 1) for each rule, over the columns of ``metrics``."""
    n = F.col("n_words")
    share = lambda name, of="n_words": F.col(name) / F.greatest(F.col(of), F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    mean_length = share("word_chars")
    return {
        "symbols": vote(share("n_symbols") > 0.25, share("n_symbols") < 0.05),
        "repeats": vote(share("n_repeat_words") > 0.12, share("n_repeat_words") < 0.03),
        "dup_lines": vote(share("n_dup_lines", "n_lines") > 0.3, (F.col("n_lines") >= 3) & (F.col("n_dup_lines") == 0)),
        "word_length": vote((mean_length < 2) | (mean_length > 14), (mean_length > 3) & (mean_length < 10)),
        "capitals": vote(share("n_upper", "n_letters") > 0.5, share("n_upper", "n_letters") < 0.2),
        "bangs": vote(share("n_bangs") > 0.3, share("n_bangs") < 0.05),
        "variety": vote((n >= 30) & (n <= 2000) & (share("n_distinct") < 0.2), (n >= 10) & (share("n_distinct") > 0.35)),
        "stops": vote((n >= 40) & (F.col("n_stops") == 0), share("n_stops") > 0.02),
        "function_words": vote((n >= 30) & (share("n_function") < 0.01), share("n_function") > 0.06),
        "long_words": vote(F.col("longest_word") > 200, F.col("longest_word") < 40),
    }


def log_odds(names: list[str], model: Row) -> Column:
    """Natural log of P(good | votes) / P(bad | votes)."""
    out = F.lit(model["prior"])
    for j, name in enumerate(names):
        bad, none, good = model["weights"][3 * j : 3 * j + 3]
        out = out + F.when(F.col(name) == 1, good).when(F.col(name) == -1, bad).otherwise(none)
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(700.0)), F.lit(-700.0))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def fit(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> Row:
    """Expectation-maximisation over counts of vote patterns (columns of votes and ``n``).

    There are at most 3 ** len(names) patterns whatever the number of documents, so they fit in one
    array; the rounds are one ``aggregate`` over it. Returns ``prior`` (log odds of good) and
    ``weights`` (log ratios for votes bad, none, good of each rule). STRENGTH times the number of
    documents counts as if seen with the starting shares, which keeps the two classes good and bad
    from turning into another split of the corpus. No patterns: the starting values come back.
    """
    k = 3 * len(names)
    start_good = F.array(*[F.lit(GOOD_START[v]) for _ in names for v in VOTES])
    start_bad = F.array(*[F.lit(BAD_START[v]) for _ in names for v in VOTES])
    weights = F.zip_with(start_good, start_bad, lambda g, b: F.log(g / b))
    code = lambda name: F.col(name) + 1
    rows = patterns.agg(F.collect_list(F.struct(F.array(*[code(x) for x in names]).alias("v"), F.col("n").cast("double").alias("n"))).alias("x"))

    def believed(state: Column, x: Column) -> Column:
        votes = F.transform(x["v"], lambda v, j: F.get(state["weights"], 3 * j + v))
        return sigmoid(state["prior"] + total(votes))

    def step(rows_: Column, all_: Column, state: Column, _) -> Column:
        seen = F.transform(rows_, lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), (x["n"] * believed(state, x)).alias("g")))

        def maximise(seen: Column) -> Column:
            good = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x["g"])

            def weight(at: Column) -> Column:
                rule, vote = F.floor(at / 3).cast("int"), at % 3
                here = F.filter(seen, lambda x: F.get(x["v"], rule) == vote)
                g = F.aggregate(here, F.lit(0.0), lambda a, x: a + x["g"])
                n = F.aggregate(here, F.lit(0.0), lambda a, x: a + x["n"])
                pseudo = STRENGTH * all_ + 1
                share_g = (g + pseudo * F.get(start_good, at)) / (good + pseudo)
                share_b = (n - g + pseudo * F.get(start_bad, at)) / (all_ - good + pseudo)
                return F.log(share_g / share_b)

            return F.struct(
                F.log((good + 1) / (all_ - good + 1)).alias("prior"),
                F.transform(F.sequence(F.lit(0), F.lit(k - 1)), weight).alias("weights"),
            )

        return let(seen, maximise)

    first = F.struct(F.lit(math.log(START_GOOD / (1 - START_GOOD))).alias("prior"), weights.alias("weights"))
    all_ = F.aggregate("x", F.lit(0.0), lambda a, x: a + x["n"])
    model = let(all_, lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda state, r: step(F.col("x"), n, state, r)))
    out = rows.select(F.when(F.size("x") == 0, first).otherwise(model).alias("m")).first()
    return out["m"]


def weak_supervision(docs: DataFrame) -> DataFrame:
    """Metrics, votes, posterior and verdict (``kept``) of each row of ``docs`` (doc_id, text).

    Null or empty text: no words, so it fails the base rule. Repeated rows are judged each. A null
    doc_id stays null. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    names = list(rules())
    counted = scratch.write(metrics(docs), "metrics")
    voted = counted.withColumns({k: v.cast("int") for k, v in rules().items()})
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    patterns = scratch.write(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    model = fit(patterns, names)
    out = voted.withColumn("p_good", sigmoid(log_odds(names, model))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
