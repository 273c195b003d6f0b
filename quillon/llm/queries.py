"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, chat, langid, lines, mixing, quality, secrets, simhash, suffix, topk
from quillon.llm.common import table

#: The tokenizer file; a parameter, as the files are not part of this repository.
TOKENIZER: str | None = None


def tokenizer_path() -> str:
    if TOKENIZER is not None:
        return TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def automaton() -> bpe.MergeAutomaton:
    return bpe.load(tokenizer_path())


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.cut_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode_decode(docs, automaton())
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    done = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", n_lines.alias("n_lines")), short_copies=True)
    return done.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return done.select("conv_id", "perspective", "piece", "n_turns", "n_trained", "text", F.concat_ws(",", spans).alias("mask"))


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS content, turn
  FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, content) - 1 AS pos FROM turns),
seen AS (
  SELECT t.conv_id, w.speaker AS perspective, t.pos // 256 AS piece, t.pos, t.speaker = w.speaker AS own,
         CASE WHEN t.speaker = w.speaker THEN '<|assistant|>' || chr(10)
              WHEN t.speaker = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || regexp_replace(t.speaker, '[\s<>|]+', '_', 'g') || '|>' || chr(10) END AS head,
         t.content || '<|end|>' || chr(10) AS body
  FROM placed t JOIN (SELECT DISTINCT conv_id, speaker FROM turns WHERE speaker <> 'system') w USING (conv_id)),
ends AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, piece ORDER BY pos) AS stop FROM seen)
SELECT conv_id, perspective, CAST(piece AS BIGINT) AS piece, count(*) AS n_turns, CAST(count(*) FILTER (WHERE own) AS BIGINT) AS n_trained,
       string_agg(head || body, '' ORDER BY pos) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(stop - length(body) AS VARCHAR) || ':' || CAST(stop AS VARCHAR) END, ',' ORDER BY pos), '') AS mask
FROM ends GROUP BY ALL
"""

OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, a.q AS asked, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.KINDS[:3]), F.sha2(F.concat_ws(",", F.transform(base, named)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("secrets", named)).alias("spans"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, mixing.label_domains(table(spark, sf_dir, "labels")), mixing.WEIGHTS).select("doc_id", "n_tokens", "domain", "rate")


def queries() -> dict:
    made = (op1_simhash, op2_suffix_dedup, op3_topk, op4_bpe, op5_line_dedup, op6_langid, op7_quality, op8_chat, op9_secrets, op10_mixing)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op8_chat": OP8_SQL}
