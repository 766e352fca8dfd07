"""The queries opN_<name> and, where SQL can say them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, covertree, lines, neardup, packing, pieces, quality, scoring, substrings, toxicity
from quarry.llm.common import crc_remainder, table


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -7L conv_id, turn, role, text FROM VALUES (0L, 'user', r'\\### Assistant: </turn> ok'), (1L, 'assistant', r'\\### Assistant: </turn> ok') AS v(turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = chat.format_conversations(turns.unionByName(own))
    out = out.withColumn("turns", chat.parse_formatted(F.col("formatted"))).withColumn("loss", F.array_join(chat.masked_texts(F.col("formatted"), F.col("spans")), ""))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev FROM raw),
e AS (SELECT *,
  length(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t')) AS n,
  length(replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\t'), ':', '\c')) + 6 AS h FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + 8 + CASE WHEN prev = role THEN 0 ELSE h END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scoring.score(docs, crc_remainder("doc_id", 5) != 1, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", (crc_remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.weak_supervision(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedupe_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = pieces.decode(pieces.encode(docs, model), model)
    return out.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        (F.length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
m AS (SELECT k.doc_id, pos, line, f.first IS NOT NULL AND k.doc_id > f.first AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out=(4, 2))
    out = toxicity.score(docs, model)
    return out.select(
        "doc_id",
        (crc_remainder("doc_id", 4) == 2).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.3).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = covertree.quantized(table(spark, sf_dir, "embeddings"), 64.0)
    return covertree.top_k(vectors, 20, F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.e, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_line_dedup": op3_line_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_minhash_neardup": op8_minhash_neardup,
        "op9_packing": op9_packing,
        "op10_exact_topk": op10_exact_topk,
        "op4_chat_format": op4_chat_format,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_quality_rules": op6_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op4_chat_format": OP4_SQL, "op10_exact_topk": OP10_SQL}
