"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from interlace.llm import audit, chat, embeddings, fingerprints, language, lines, minhash, packing, privacy, quality, runs, sentencepieces, suffixes
from interlace.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), 50)


def op2_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat.digests(chat.format_chats(chat.text_parts(turns)))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(table(spark, sf_dir, "documents"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_minhash_near_dup": op2_minhash_near_dup,
    "op3_quality": op3_quality,
    "op4_embedding_near_dup": op4_embedding_near_dup,
    "op5_line_dedup": op5_line_dedup,
    "op6_language": op6_language,
    "op7_fingerprints": op7_fingerprints,
    "op8_packing": op8_packing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_chat_format": op10_chat_format,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_pii": op13_pii,
}

ORACLES = {
    "op10_chat_format": """
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(role) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 17) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
""",
    "op11_filter_audit": r"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), rows AS (
    SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
        regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e,
        EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND l.quality = 1) AS good,
        EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND l.toxic = 1) AS toxic
    FROM texts t
), counted AS (
    SELECT part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, count(*) AS n,
        count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
    FROM rows GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
    SELECT v.f || w.f || x.f || y.f || z.f AS filter_order
    FROM letters v JOIN letters w ON w.f <> v.f JOIN letters x ON x.f NOT IN (v.f, w.f)
        JOIN letters y ON y.f NOT IN (v.f, w.f, x.f) JOIN letters z ON z.f NOT IN (v.f, w.f, x.f, y.f)
), steps AS (
    SELECT filter_order, step, filter_order[step] AS f, string_split(filter_order[1:step - 1], '') AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), failing AS (
    SELECT part, n, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'],
        lambda x: CASE x WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END) AS failed
    FROM counted
), tallied AS (
    SELECT part, filter_order, step, f,
        coalesce(sum(n) FILTER (WHERE NOT list_has_any(failed, before) AND NOT list_contains(failed, f)), 0) AS kept,
        coalesce(sum(n) FILTER (WHERE NOT list_has_any(failed, before) AND list_contains(failed, f)), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE list_has_any(failed, before) AND list_contains(failed, f)), 0) AS redundant,
        coalesce(sum(n) FILTER (WHERE failed = [f]), 0) AS unique_fails,
        coalesce(sum(good) FILTER (WHERE NOT list_has_any(failed, before) AND list_contains(failed, f)), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (WHERE NOT list_has_any(failed, before) AND list_contains(failed, f)), 0) AS toxic_lost
    FROM failing CROSS JOIN steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM tallied
""",
}
