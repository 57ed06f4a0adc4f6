"""Corpus pipeline: quality rules, near-duplicate join, decontamination, packing.

Each stage is (name, function(spark, docs, sf_dir) -> DataFrame); the driver writes
each stage's rows as Parquet and gives them to the next one. All stages but the
last return the columns that documents has. Rows are judged, not ids: the
operators get a hash of the whole row in place of its doc_id, so rows of null or
repeated ids stand each for itself, and rows that are equal in all columns get the
same decision; of those the near-duplicate stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, table
from tessera.llm.decontamination import decontaminate
from tessera.llm.jaccard_join import jaccard_join
from tessera.llm.packing import pack
from tessera.llm.quality_rules import quality_rules
from tessera.llm.registry import tokenizer_file


#: Ids that a broadcast may hold.
NAMED = 500_000


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key, a hash of all columns (nulls of different columns differ)."""
    parts = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]
    return docs.withColumn("row_key", F.xxhash64(*parts))


def by_row(docs: DataFrame) -> DataFrame:
    """docs with each row's key as its doc_id, for the operators."""
    return keyed(docs).withColumn("doc_id", F.col("row_key")).drop("row_key")


def names(docs: DataFrame) -> DataFrame:
    """row_key and doc_id of the different rows."""
    return keyed(docs).select("row_key", F.col("doc_id").cast("long").alias("doc_id")).distinct()


def only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose key is among keys (doc_id), which are broadcast if they are few; with row_key."""
    named = cut(keys.select(F.col("doc_id").alias("keep_key")).distinct())
    few = named.count() <= NAMED
    return keyed(docs).join(F.broadcast(named) if few else named, F.col("row_key") == F.col("keep_key"), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor a risk-controlled cutoff rejects."""
    labels = table(spark, sf_dir, "labels").withColumn("doc_id", F.col("doc_id").cast("long"))
    labels = labels.join(names(docs), "doc_id").withColumn("doc_id", F.col("row_key")).drop("row_key")
    return only(docs, quality_rules(by_row(docs), labels).filter("kept")).drop("row_key")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row (of the smallest doc_id, a null one last) of each group linked at five words and a similarity of 0.8."""
    joined = jaccard_join(by_row(docs), width=5, num=80, den=100, links=False).select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    kept = joined.join(names(docs), "row_key").groupBy("component_id").agg(first["row_key"].alias("doc_id"))
    rows = only(docs, kept)
    repeated = cut(keyed(docs).groupBy("row_key").agg(F.count("*").alias("n")).filter("n > 1").select("row_key"))
    if not repeated.isEmpty():
        rows = rows.join(repeated, "row_key", "left_anti").unionByName(rows.join(repeated, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return rows.select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return only(docs, decontaminate(by_row(docs), table(spark, sf_dir, "benchmark"), span=10).filter(~F.col("contaminated"))).drop("row_key")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces with their sequence and place."""
    return pack(docs, tokenizer_file("word_bpe_49k.json").read_text())


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", benchmark_free), ("packing", packed)]

#: Tokens of a public tokenizer are beyond SQL; a brute-force version tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows kept in the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
