"""The corpus pipeline: documents through toxicity filter, near-dedup, decontamination, secret redaction and packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  `run` writes each stage's result
as Parquet to shared storage and reads it again for the next, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repoquarry.llm import decontamination, minhash, packing, secret_scan, toxicity
from repoquarry.llm.common import table
from repoquarry.llm.queries import tokenizer_path
from repoquarry.plans.storage import settle

TOXIC = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the factorization machine, trained on all labels, scores as toxic."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, machine, keep=tuple(docs.columns), out="__toxicity")
    return scored.where(F.col("__toxicity") < TOXIC).drop("__toxicity")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies (5-word shingles, similarity 0.8).

    Of rows that repeat an id the one with the smallest text stays; rows without an id have no group and stay.
    """
    found = minhash.near_duplicates(docs)
    kept = found.where("kept AND id IS NOT NULL").select(F.col("id").alias("doc_id")).distinct()
    first = Window.partitionBy("doc_id").orderBy("text", *[name for name in docs.columns if name not in ("doc_id", "text")])
    chosen = docs.join(kept, "doc_id", "left_semi").withColumn("__row", F.row_number().over(first)).where("__row = 1").drop("__row")
    return chosen.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage that repeats the question and the answer of a benchmark item."""
    shards = decontamination.build_shards(table(spark, sf_dir, "benchmark"))
    return decontamination.find_leaks(docs, shards, out="__hits").where(F.size("__hits") == 0).drop("__hits")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays."""
    forest = secret_scan.train(secret_scan.labelled_examples(spark))
    path = "source" if "source" in docs.columns else None
    return secret_scan.redact(secret_scan.scan_secrets(docs, forest, path=path, out="__findings"), findings="__findings")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the documents into sequences of power-of-two length: one row per piece, with its token ids."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The stages are a learnt filter, hashing, retrieval and a tokenizer, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the `documents` of `sf_dir`; the result is the last one's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
