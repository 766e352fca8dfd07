"""Inverted index and BM25."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import Written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(docs: DataFrame, id_column: str, fields: dict[str, tuple[Column, float]], positions: bool = False) -> DataFrame:
    """doc, term, tf, hits of the fields' tokens; tf is the sum of the fields' weights.

    ``fields``: name -> (column of an array of tokens, weight). With ``positions``, the sorted places
    in the last field too.
    """
    parts = []
    for name, (tokens, weight) in fields.items():
        t = docs.select(F.col(id_column).alias("doc"), F.posexplode(tokens).alias("at", "term"))
        parts.append(t.withColumn("w", F.lit(float(weight))).withColumn("field", F.lit(name)))
    rows = reduce(DataFrame.unionByName, parts)
    last = list(fields)[-1]
    places = [F.sort_array(F.collect_list(F.when(F.col("field") == last, F.col("at")))).alias("positions")] if positions else []
    return rows.groupBy("doc", "term").agg(F.sum("w").alias("tf"), F.count("*").alias("hits"), *places)


def corpus_statistics(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their length, and terms with their document frequency."""
    return index.groupBy("doc").agg(F.sum("hits").alias("len")), index.groupBy("term").agg(F.count("*").alias("df"))


def bm25(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query, doc, score for the documents that hold a term of a query (query, term).

    Only postings of query terms are joined; N and the mean length come from one row.
    """
    lengths, frequency = corpus_statistics(index)
    totals = lengths.agg(F.count("*").alias("N"), F.avg("len").alias("avglen"))
    terms = queries.select("query", "term").distinct().join(frequency, "term")
    hits = terms.join(index.select("doc", "term", "tf"), "term").join(lengths, "doc").crossJoin(F.broadcast(totals))  # one row
    idf = F.greatest(F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avglen")))
    return hits.groupBy("query", "doc").agg(F.sum(idf * gain).alias("score"))


def search(docs: DataFrame, id_column: str, fields: dict[str, tuple[Column, float]], queries: DataFrame) -> DataFrame:
    """query, doc, score: BM25 of queries (query, term) over fields of ``docs`` without an index.

    ``fields``: name -> (array of tokens, weight); tf is the weighted count, the length that of all
    fields. Tokens that no query has go before anything is counted, and a document's length goes with
    its tokens, so only occurrences of search terms are shuffled, and one null term a document for N
    and the mean length. The counts are written, so texts are cut into tokens once. A query's terms are
    few; they are written too, so that Spark knows their size: it broadcasts the set of all to the
    tokens when it is small, and no token is shuffled before the join.
    """
    arrays = docs.select(F.col(id_column).alias("doc"), *[c.alias(f"f_{name}") for name, (c, _) in fields.items()])
    length = reduce(Column.__add__, [F.size(f"f_{name}") for name in fields])
    text_mark = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1.0).alias("w")))

    def weighted(tokens: Column, weight: float) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("w")))

    weighed = F.concat(text_mark, *[weighted(F.col(f"f_{name}"), w) for name, (_, w) in fields.items()])
    tokens = arrays.select("doc", length.alias("len"), F.inline(weighed))
    store = Written(docs.sparkSession, "search")
    terms = store.write(queries.select("query", "term").where("term is not null").distinct())
    none = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("asked"))
    asked = store.write(terms.select(F.col("term").alias("asked")).distinct().unionByName(none))
    tf = tokens.join(asked, F.col("term").eqNullSafe(F.col("asked"))).groupBy("doc", "len", "term").agg(F.sum("w").alias("tf"))
    tf = store.write(tf)
    rows = F.col("tf").cast("long")
    totals = tf.where("term is null and len > 0").agg(F.sum(rows).alias("N"), F.sum(F.col("len") * rows).alias("sum"))
    tf = tf.where("term is not null")
    frequency = tf.groupBy("term").agg(F.count("*").alias("df"))
    hits = terms.join(frequency, "term").join(tf, "term").crossJoin(F.broadcast(totals))  # one row
    idf = F.greatest(F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (F.col("sum") / F.col("N"))))
    return hits.groupBy("query", "doc").agg(F.sum(idf * gain).alias("score"))


def top(scored: DataFrame, k: int, by: str = "query", digits: int = 6) -> DataFrame:
    """The k best documents of each query, with rank; ties to the smaller id."""
    scored = scored.withColumn("score", F.round("score", digits))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def phrase_hits(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """query, doc, n: places where the terms of a phrase (query, at, term) follow one another."""
    rows = phrases.join(index.select("doc", "term", F.explode("positions").alias("place")), "term")
    need = phrases.groupBy("query").agg(F.count("*").alias("need"))
    starts = rows.groupBy("query", "doc", (F.col("place") - F.col("at")).alias("start")).agg(F.countDistinct("at").alias("found"))
    return starts.join(need, "query").where("found = need").groupBy("query", "doc").agg(F.count("*").alias("n"))
