"""The thin queries over the operators, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contextual_pii, host_reputation, interleave, line_crf, mixing, progressive_jpeg, simhash_pivot, simhash_sql, site_quality, substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), digest=True)


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.quality_rules(docs, line_crf.trained_field(docs, table(spark, sf_dir, "labels")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), byte_vocabulary())


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = site_quality.fit_text_model(docs, site_quality.bad_labels(table(spark, sf_dir, "labels")))
    out = site_quality.rated(docs, model, site_quality.page_sites(table(spark, sf_dir, "pages")))
    rounded = [F.round(c, 6).alias(name) for c, name in (("p", "p_bad"), ("site", "site_rate"), ("posterior", "posterior"))]
    return out.select("doc_id", "host", *rounded, F.col("keep").alias("kept"))


def op5_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.media_digests(table(spark, sf_dir, "documents"))


def op6_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_keys(table(spark, sf_dir, "documents")).withColumn("taken", F.explode("copies"))
    return out.select("doc_id", "size", F.col("total").alias("source_size"), "target", (F.col("taken") * F.col("size")).alias("taken"))


def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextual_pii.find_personal_data(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivot.near_duplicates(table(spark, sf_dir, "documents"))


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = host_reputation.page_outcomes(pages, site_quality.bad_labels(table(spark, sf_dir, "labels")))
    out = host_reputation.judge_urls(pages, outcomes, suffixes=host_reputation.SUFFIXES + ("example.com", "example.net", "example.org"))
    return out.select("page_id", "host", "path", "rule", "verdict", "n", "bad", F.round("mean", 6).alias("mean"), F.round("lower", 6).alias("lower"))


def op10_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave.interleave(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_line_crf, op3_bpe, op4_site_quality, op5_progressive_jpeg, op6_systematic_mix, op7_contextual_pii, op8_simhash, op9_host_reputation, op10_interleave)}


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS tie, md5('mix-1|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))) AS h FROM documents),
r AS (SELECT *, floor(4 * log2(size + 1.0))::INT AS class, (('0x' || substr(h, 1, 8))::BIGINT) % greatest(128, (count(*) OVER () + 399999) // 400000) AS salt FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, doc_id, tie) AS place FROM r),
s0 AS (SELECT source, sum(size)::BIGINT AS total, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM r GROUP BY source),
s1 AS (SELECT *, 1.5 * (sum(total) OVER ())::DOUBLE AS want, (2 * total)::DOUBLE AS cap,
  coalesce(sum(2 * total) OVER (ORDER BY (2 * total)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
  (sum(w) OVER (ORDER BY (2 * total)::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS left_w FROM s0),
s2 AS (SELECT *, (want - before) / left_w AS level FROM s1),
s3 AS (SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS fin FROM s2),
s AS (SELECT source, total, CASE WHEN level * w <= cap THEN fin * w ELSE cap END AS target,
  (('0x' || substr(md5('mix-1|' || coalesce(source, '')), 1, 8))::BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u FROM s3),
j AS (SELECT k.*, total, target, u, CASE WHEN total > 0 THEN target / total::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM k JOIN s ON k.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, total AS source_size, target, (floor(u + rate * place::DOUBLE) - floor(u + rate * (place::DOUBLE - 1)))::BIGINT * size AS taken FROM j
"""


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM w),
k AS (SELECT *, CASE WHEN count(*) OVER nxt = 20 THEN string_agg(word, ' ') OVER nxt END AS key FROM u WINDOW nxt AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT *, (key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1)::INT AS later FROM k),
m AS (SELECT *, max(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN a USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op6_systematic_mix": OP6_SQL, "op8_simhash": simhash_sql.oracle(), "op9_host_reputation": host_reputation.ORACLE, "op10_interleave": interleave.ORACLE}
