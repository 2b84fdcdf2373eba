"""The corpus pipeline: language, near duplicates, benchmark leaks, personal data, packing; each stage reads what the last wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import decontaminate, langid, packing, pii, simhash
from panelloom.sources.storage import materialize

#: A text whose best language has less than this mean probability is rejected, as are texts without a letter.
LEAST_SCORE = 0.35


def _carried(docs: DataFrame, *names: str) -> DataFrame:
    """`names`, text and all other columns as one struct `row`, which no name of a stage's own can clash with."""
    return docs.select(*names, "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _restored(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `docs` in their order: text and `changed` from the stage, all others as they were."""
    return found.select(*[changed.get(c, F.col("text") if c == "text" else F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c)
                          for c in docs.columns])


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a recognised language; a missing lang is filled with it. Null texts and those without a letter go; an empty table gives no rows."""
    found = langid.identify(_carried(docs), langid.fit(docs), ["row", "text"])
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _restored(kept, docs, lang=F.coalesce("row.lang", "lang_pred"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of SimHash near duplicates: four-word shingles, at most four differing bits.

    The least doc_id stays, null ids after all others, one row of those repeated; null and empty texts are a group.
    """
    return simhash.one_of_each(docs, simhash.SHINGLE, simhash.DISTANCE)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null and empty texts hold none and stay; repeated rows stay or go together."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind, n_chars where it was given. A null text stays null."""
    found = pii.scan(_carried(docs), pii.fit(docs), ["row"], redact=True)
    if "n_chars" not in docs.columns:
        return _restored(found, docs)
    return _restored(found, docs, n_chars=F.when(F.col("row.n_chars").isNotNull(), F.length("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences: a row for each piece. A null or empty text is the end token alone."""
    return packing.pack(docs)


STAGES = [("language_id", identified), ("simhash_near_dedup", deduplicated), ("benchmark_decontamination", decontaminated),
          ("pii_redaction", redacted), ("packing", packed)]

#: Trained networks, fingerprints and token ids have no SQL form; tests/llm/test_pipeline.py checks every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
