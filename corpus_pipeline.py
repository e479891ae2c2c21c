"""The corpus pipeline: five stages, each on all that its predecessor kept, begun with what earlier ones held given back.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flatewise.llm import decontaminate, langid, near_dup, packing, pii
from flatewise.llm.common import HASHED_ROW, broadcast_if_small, give_back, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: no letter, or far from every language learned."""
    give_back(spark)
    return langid.predicted(docs, COLUMNS).where(~F.col("rejected")).select(*COLUMNS)


def keyed(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs joined with the documents of keys (doc_id, text_key): equal keys mean equal text and equal, or equally no, doc_id."""
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_key") == F.col("k.text_key"))
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key")).alias("d")
    return rows.join(broadcast_if_small(keys, HASHED_ROW).alias("k"), same, how).select("d.*")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the documents of gone (doc_id, text_key)."""
    return keyed(docs, gone, "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest doc_id; of its repeated rows, one."""
    give_back(spark)
    gone, repeated = near_dup.surplus(docs)
    if repeated.isEmpty():
        return without(docs, gone)
    once = keyed(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text_key"]).select(*COLUMNS)
    return without(docs, gone.unionByName(repeated)).unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    give_back(spark)
    hits = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, stored(hits.where("n_hit > 0").select("doc_id", "text_key").distinct()))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by the names of their kinds; n_chars follows."""
    give_back(spark)
    return redacted(docs)


def redacted(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    found = F.when(F.size("found_") > 0, pii.scored(text, F.col("found_"))).otherwise(pii.scored(F.lit(""), F.array().cast(pii.S.SPAN)))
    rows = docs.select(*COLUMNS).withColumn("found_", pii.find_all(text)).withColumn("pii_", found).withColumn("text", pii.redact(text, F.col("pii_")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of the remaining texts: one row per piece."""
    give_back(spark)
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_dup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", redact_personal_data),
    ("pack", pack),
]

#: SQL can't express training, minhashing and tokenising; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
