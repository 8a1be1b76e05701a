"""From documents to packed token sequences, a stage at a time.

Every stage works on all that the stage before it has kept, and its result is
written before the next one reads it. Documents judged toxic go; of documents
that n-gram similarity links one stays; documents that hold a benchmark passage
go; personal data gives way to its kind in brackets; what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrain.llm import decontaminate, jaccard, packing, pii, scratch, sketches, toxicity
from kinegrain.llm.queries_tokens import vocabulary
from kinegrain.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold. A null or empty text stays."""
    model = toxicity.train(*toxicity.training_sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every component.

    Documents link at a similarity of 0.8 of their 5-word shingles. A row
    without a doc_id goes when its component has a document with one; among
    themselves such rows stay. Rows that share a doc_id stay or go together;
    where the whole row is repeated, one stays.
    """
    scratch.bound_batches(docs)
    found = scratch.keep(jaccard.components(docs, k=5, percent=80, with_hash=True), "found")
    unnamed = found.where("doc_id IS NULL AND component_id IS NOT NULL").select("text_hash").distinct()
    found = found.where("doc_id IS NOT NULL")
    bits = sketches.bits_for(scratch.size_in_bytes(docs), 256, least=18)
    kept = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    gone = found.select("doc_id").distinct().join(kept, "doc_id", "left_anti")
    left = sketches.without(docs, "doc_id", gone, bits)
    if not unnamed.isEmpty():
        key = jaccard.text_hash(F.col("text"))
        left = left.where("doc_id IS NOT NULL").unionByName(left.where("doc_id IS NULL").join(unnamed, key == F.col("text_hash"), "left_anti"))
    twice = kept.where("n > 1").select("doc_id")
    if twice.isEmpty():
        return left
    left = scratch.keep(left, "left")
    once = left.join(twice, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(left.join(twice, "doc_id", "left_semi").select(*docs.columns).distinct())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word in a benchmark window.

    That follows from the text alone, so the decision goes back by a 64-bit
    hash of the text: it reaches rows without a doc_id, and of rows that share
    one only those with the passage.
    """
    scratch.bound_batches(docs)
    keyed = docs.withColumn("__text", F.when(F.col("text").isNotNull(), jaccard.text_hash(F.col("text"))))
    found = decontaminate.find_overlaps(keyed.select(F.col("__text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = scratch.keep(found.where("contaminated").select(F.col("doc_id").alias("bad")).distinct(), "bad")
    left = sketches.without(keyed, "__text", bad, sketches.bits_for(scratch.size_in_bytes(docs), 256, least=18))
    return left.select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in their texts."""
    return pii.redact(docs, pii.train(pii.training_sample(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, one row per sequence."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack),
]

#: The stages train models and read tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
