"""The queries of this package, each over its whole table, and SQL where SQL states the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm import ann, bpe, chat, embedding_dedup, lexical, licenses, mixing, pii, quality_classifier, quality_rules, simhash, toxicity, variants
from alphaloom.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the machine's public vocabulary files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


MIX_SQL = r"""
WITH sized AS MATERIALIZED (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 3 * source_size AS cap,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight FROM sources),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS BIGINT) AS rest,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS shares
  FROM ranked WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest, shares FROM levels WHERE rest * weight <= cap * shares ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST LIMIT 1),
shared AS (SELECT source, source_size, least(CAST(level.rest AS DOUBLE) * weight / level.shares, CAST(cap AS DOUBLE)) AS target FROM ranked, level),
queued AS (
  SELECT sized.*, source_size, target,
         CAST(coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized JOIN shared ON sized.source IS NOT DISTINCT FROM shared.source),
turns AS (
  SELECT doc_id, place, size, turn, CAST(source_size * turn + before + size AS DOUBLE) / target AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0 AND target > 0),
cut AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, place, turn ROWS UNBOUNDED PRECEDING) AS upto FROM turns),
used AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM cut WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM queued LEFT JOIN used USING (doc_id)
"""


@query("op1_mixing", MIX_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.queue(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)),
        F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


CHAT_SQL = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT *, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens,
         length(regexp_replace(text, '([<\[\\])', '\1-', 'g')) + 4
         + CASE role WHEN 'user' THEN 10 WHEN 'assistant' THEN 11 WHEN 'system' THEN 11
           ELSE 17 + length(regexp_replace(role, '([<\[\\])', '\1-', 'g')) END AS chars FROM every),
placed AS (
  SELECT *, row_number() OVER w - 1 AS place, CAST(sum(tokens) OVER w AS BIGINT) AS upto FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
spans AS (SELECT *, (greatest(upto, 1) - 1) // 384 AS span FROM placed),
ends AS (SELECT *, max(upto) OVER (PARTITION BY conv_id, span) AS span_end, max(span) OVER (PARTITION BY conv_id) AS last_span FROM spans),
counts AS (SELECT conv_id, count(DISTINCT span) AS n_windows FROM spans GROUP BY conv_id),
used AS (
  SELECT e.*, 1 + CASE WHEN place = 0 AND role = 'system' THEN n_windows - 1
                       WHEN span < last_span AND span_end - upto + tokens <= 128 THEN 1 ELSE 0 END AS uses
  FROM ends e JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '')) AS loss_sha256,
       CAST(sum(chars * uses) AS BIGINT) AS formatted_chars
FROM used GROUP BY conv_id
"""


@query("op8_chat", CHAT_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.windows(rows)
    turns = chat.read_turns(F.col("formatted"))
    fresh = F.filter(F.transform(turns, lambda t, k: F.when(k >= F.col("repeated"), F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), lambda t: t.isNotNull())
    back = made.select("conv_id", "window", "formatted", fresh.alias("turns"), F.array_join(chat.read_targets(F.col("formatted"), F.col("mask")), "").alias("loss"))
    back = back.select("conv_id", F.struct("window", F.size("turns").alias("n"), F.array_join("turns", "").alias("turns"), "loss", F.length("formatted").alias("chars")).alias("w"))
    whole = back.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    total = lambda part: F.aggregate(F.transform("w", part), F.lit(0).cast("long"), lambda a, n: a + n)
    joined = lambda field: F.array_join(F.col("w")[field], "")
    return whole.select(
        "conv_id",
        total(lambda w: w["n"]).alias("n_turns"),
        F.sha2(joined("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss").cast("binary"), 256).alias("loss_sha256"),
        total(lambda w: w["chars"]).alias("formatted_chars"),
    )


@query("op7_licenses", licenses.oracle_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


@query("op3_ann")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, rows.where("vec_id % 20 = 0"), top=20)


@query("op11_embedding_dedup", embedding_dedup.ORACLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.classes(read(spark, sf_dir, "embeddings"))


@query("op12_lexical", lexical.ORACLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op13_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(read(spark, sf_dir, "documents"))
