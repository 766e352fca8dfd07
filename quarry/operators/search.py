"""Hybrid search: lexical, dense, symbol and graph channels, fused; texts are fetched last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.operators import graph, lexical, retrieval

DEPTH, SYMBOLS, SEEDS, RERANKED = 40, 20, 5, 20
#: Weights of the two fields, and of the relations of the graph channel.
IDENTS, BODY = 2.0, 1.0
FILE_KINDS = ["cochange", "imports", "tests_file"]
RELATIONS = [
    ("calls", "in", 1.0, 0.5), ("calls", "out", 0.8, 0.5), ("tests", "in", 1.0, 0.5), ("inherits", "in", 0.7, 0.5), ("inherits", "out", 0.7, 0.5),
    ("cochange", "out", 0.6, 0.2), ("imports", "in", 0.4, 0.5), ("tests_file", "in", 0.6, 0.5),
]


def tokens_of(terms: Column) -> Column:
    """The full-text tokens of an array of terms, in order."""
    return F.flatten(F.transform(terms, t.index_tokens))


def two_fields(header: Column, body: Column) -> dict[str, tuple[Column, float]]:
    """Identifiers with their parts, and the text, as the lexical channel weighs them."""
    whole = F.concat_ws("\n", header, body)
    return {"idents": (t.identifier_tokens(whole), IDENTS), "body": (t.index_tokens(whole), BODY)}


def query_tokens(queries: DataFrame) -> DataFrame:
    """query, term: search terms of queries (query, text). Terms with _ are searched by their tokens."""
    return queries.select("query", F.explode(F.array_distinct(tokens_of(t.query_terms(F.col("text"))))).alias("term"))


def lexical_channel(chunks: DataFrame, queries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """query, id, rank over chunks (chunk, header, text)."""
    scored = lexical.search(chunks, "chunk", two_fields(F.col("header"), F.col("text")), query_tokens(queries))
    return lexical.top(scored, depth).select("query", F.col("doc").alias("id"), "rank")


def symbol_matches(symbols: DataFrame, queries: DataFrame, limit: int = SYMBOLS) -> DataFrame:
    """query, symbol, rank: symbols (symbol, name, qualname, kind, low, high) that a query names, by
    dotted qualname first, then by name, the longest first; modules only by qualname."""
    dotted = queries.select("query", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+"), F.lit(0)))).alias("qualname"))
    words = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))), lambda w: ~F.lower(w).isin(*t.STOP_NAMES))
    names = queries.select("query", F.explode(words).alias("name"))
    span = F.col("high") - F.col("low")
    first = symbols.join(dotted, "qualname").select("query", "symbol", F.lit(0).alias("turn"), F.lit(0).alias("span"))
    second = symbols.where("kind <> 'module'").join(names, "name").select("query", "symbol", F.lit(1).alias("turn"), span.alias("span"))
    nth = F.row_number().over(Window.partitionBy("query", "turn").orderBy(F.desc("span"), "symbol"))
    rows = first.unionByName(second).withColumn("nth", nth).where(F.col("nth") <= limit)
    best = rows.groupBy("query", "symbol").agg(F.min(F.struct("turn", "nth")).alias("at"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("at", "symbol"))).select("query", "symbol", "rank")


def symbol_chunks(found: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """query, id, rank: for ranked symbols (query, symbol, rank) the chunk (chunk, path, low, high) that
    covers the symbol's first line, of several the one that starts last; each chunk once."""
    starts = symbols.select("path", F.col("symbol").alias("point"), F.col("low").alias("at"))
    spans = chunks.select("path", F.col("chunk").alias("span"), F.col("low").alias("start"), F.col("high").alias("end"))
    held = retrieval.asof(starts, spans.select("path", "span", "start"), "path").join(spans.select("path", "span", "end"), ["path", "span"])
    held = held.where(F.col("end") >= F.col("at")).select(F.col("point").alias("symbol"), F.col("span").alias("id"))
    rows = found.join(held, "symbol").groupBy("query", "id").agg(F.min(F.struct("rank", "symbol")).alias("at"))
    return rows.select("query", "id", F.row_number().over(Window.partitionBy("query").orderBy("at")).alias("rank"))


def related_symbols(seeds: DataFrame, symbols: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """query, node, score, reason, rank: neighbours of seed symbols (query, symbol). Relations of files
    start from the module symbols of the seeds' files."""
    spark = seeds.sparkSession
    weights = spark.createDataFrame(RELATIONS, "kind string, direction string, factor double, floor double")
    own = seeds.select("query", F.col("symbol").alias("node")).distinct()
    modules = symbols.where("kind = 'module'").select("path", F.col("symbol").alias("module"))
    files = own.join(symbols.select(F.col("symbol").alias("node"), "path"), "node").join(modules, "path").select("query", F.col("module").alias("node")).distinct()
    of_files = F.col("kind").isin(*FILE_KINDS)
    # one search each; the marks keep a relation's seeds apart, nodes of the other kind don't seed it
    by_symbol = graph.expand(own, edges.where(~of_files), weights, limit=depth)
    by_file = graph.expand(files, edges.where(of_files), weights, limit=depth)
    rows = by_symbol.unionByName(by_file).join(own, ["query", "node"], "left_anti")
    best = rows.groupBy("query", "node").agg(F.max("score").alias("score"), F.min_by("reason", F.struct(-F.col("score"), "reason")).alias("reason"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    return best.withColumn("rank", rank).where(F.col("rank") <= depth)


def hybrid(
    queries: DataFrame, chunks: DataFrame, symbols: DataFrame | None = None, edges: DataFrame | None = None, vectors: DataFrame | None = None,
    channels: tuple[str, ...] = ("lexical", "dense", "symbols", "graph"), k: int = 10, seeds: DataFrame | None = None, exclude: DataFrame | None = None, rerank=None,
) -> DataFrame:
    """query, id, score, ranks, place, header, text: the k best chunks of each query.

    queries (query, text, and q, a vector, for the dense channel); chunks (chunk, path, low, high,
    header, text); symbols (symbol, path, name, qualname, kind, low, high); edges (kind, src, dst,
    weight); vectors (id, v); seeds (query, symbol) in place of the first matches; exclude (query, id)
    of what is known already. ``rerank``: a function of (query, id, text, header, ...) rows to (query,
    id, rr); its order is blended with the fused one. A channel without its table is left out. Texts
    are joined after the cut.
    """
    lists: dict[str, DataFrame] = {}
    if "lexical" in channels:
        lists["lexical"] = lexical_channel(chunks, queries)
    if "dense" in channels and vectors is not None:
        lists["dense"] = retrieval.dense_top(vectors, queries.select("query", "q"), DEPTH).select("query", "id", "rank")
    if symbols is not None and ("symbols" in channels or "graph" in channels):
        matched = symbol_matches(symbols, queries)
        if "symbols" in channels:
            lists["symbols"] = symbol_chunks(matched, symbols, chunks)
            seeds = seeds if seeds is not None else matched.where(F.col("rank") <= SEEDS).select("query", "symbol")
        if "graph" in channels and edges is not None and seeds is not None:
            related = related_symbols(seeds, symbols, edges)
            lists["graph"] = symbol_chunks(related.select("query", F.col("node").alias("symbol"), "rank"), symbols, chunks)
    if exclude is not None:
        gone = exclude.select("query", "id")
        lists = {name: df.join(gone, ["query", "id"], "left_anti") for name, df in lists.items()}
    fused = retrieval.rrf(lists).where(F.col("place") <= max(k, RERANKED))
    hits = fused.join(chunks.select(F.col("chunk").alias("id"), "header", "text"), "id")
    if rerank is not None:
        hits = retrieval.blend(hits, rerank(hits.join(queries.select("query", F.col("text").alias("asked")), "query")))
        order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("blended"), "place"))
        hits = hits.withColumn("place", order).withColumn("score", F.col("blended"))
    return hits.where(F.col("place") <= k).select("query", "id", "score", "ranks", "place", "header", "text")
