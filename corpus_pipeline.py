"""The corpus pipeline: toxicity, near copies, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerflow.llm.common import held_out, share_path, table, without
from ledgerflow.llm.nearcopies import near_copies
from ledgerflow.llm.packing import pack_documents
from ledgerflow.llm.pii import mask_pii
from ledgerflow.llm.templates import template_matches
from ledgerflow.llm.toxicity import score_toxicity
from ledgerflow.session import durable

# No stage but the last can be told in SQL (learned scores, hashes of word windows), so tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject."""
    # The operator's columns go under their own names, so that like-named ones of the documents stay.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0), *others).alias("row"))
    kept = score_toxicity(rows, table(spark, sf_dir, "labels"), ~held_out()).where("predicted = 0")
    return kept.select(*[kept["row"][c].alias(c) if c in others else kept[c] for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    groups = near_copies(docs, width=5, percent=80)
    gone = durable(groups.where("NOT kept").select(F.col("doc_id").alias("doc")), "copies")
    return without(docs, gone)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = template_matches(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, durable(found.select("doc", "part"), "leaks"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by their kind."""
    masked = mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the permitted lengths: a row for each piece of a document."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pii", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    share_path(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
