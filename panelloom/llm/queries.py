"""The registered queries of the text operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import decontaminate, exact, langid, licenses, packing, pii, quality, repair, repeats, sharding, simhash, simplex, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.withColumn("held_out", langid.held_out(F.col("doc_id"))), langid.fit(docs), ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "position_share")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.fit(docs))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex.cluster(_table(spark, sf_dir, "embeddings"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.with_digests(*repair.repair(repair.damaged(_table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_langid": op2_langid,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_pii": op8_pii,
    "op9_licenses": op9_licenses,
    "op10_repeats": op10_repeats,
    "op11_exact": op11_exact,
    "op12_clustering": op12_clustering,
    "op13_repair": op13_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op9_licenses": licenses.oracle_sql(),
    "op11_exact": exact.ORACLE_SQL,
    "op12_clustering": simplex.oracle_sql(),
    "op13_repair": repair.oracle_sql(),
    "op3_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
        d AS (SELECT page_id, octet_length(raw)::BIGINT AS payload_bytes, sha256(raw) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
        SELECT page_id, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, payload_bytes,
               payload_digest, CASE WHEN page_id > first THEN first END AS refers_to
        FROM f""",
}
