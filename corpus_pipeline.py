"""The corpus pipeline: classify, filter by rules, drop near duplicates, remove repeated passages, pack.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it again as the next stage's input.

Edge cases: null and empty texts have weight 0 in the classifier, whose noise alone decides on them; the rules reject
them. All texts without words are near copies of each other. Repeated and null ids are rows of their own throughout.
Stages but the last pass other columns through, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colfold.llm import best_fit_packing, quality_classifier, quality_rules, simhash_near_dedup, suffix_dedup
from colfold.llm.common import numbered_columns, stored, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against the labelled good documents; what is not sampled goes."""
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Risk-controlled rules; what they reject goes."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their five-word shingles the row with the smallest doc_id stays, null ids last.

    Repeated or null ids do not make rows alike: rows then get numbers of their own, which are grouped."""
    own, name = numbered_columns(docs)
    ids = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    if ids["n"] == ids["ids"] and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        stay = simhash_near_dedup.similar_groups(docs.select("doc_id", "text")).where("doc_id = component_id").select(F.col("doc_id").alias("stay"))
        return own.join(stay, F.col(name["doc_id"]) == F.col("stay"), "left_semi").toDF(*docs.columns)
    rows = stored(own.select(F.monotonically_increasing_id().alias("row"), F.col(name["doc_id"]).cast("long").alias("id"), F.col(name["text"]).alias("words"), *own.columns), "rows")
    groups = simhash_near_dedup.similar_groups(rows.select(F.col("row").alias("doc_id"), F.col("words").alias("text"))).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    stay = groups.join(rows.select("row", "id"), "row").groupBy("component_id").agg(first).select(F.col("first.row").alias("row"))
    return rows.join(stay, "row", "left_semi").select(*own.columns).toDF(*docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated long passages go; n_chars follows."""
    return suffix_dedup.strip(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return best_fit_packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", remove_repeats),
    ("packing", pack),
]

#: Tokenisation and suffix sorting are not SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
