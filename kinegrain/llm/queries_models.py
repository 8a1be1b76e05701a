"""The queries of the two operators that train a random field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrain.llm import pii, toxicity
from kinegrain.session import table


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(*toxicity.training_sample(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted", "spans")


def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the four kinds of the base patterns; codes that the field labels as secrets are a column of their own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.train(pii.training_sample(docs)))
    base = F.filter("pii", lambda x: x["base"])
    personal = F.filter("pii", lambda x: x["kind"] != pii.SECRET)
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(personal).alias("spans"),
        F.size(F.filter("pii", lambda x: ~x["base"])).cast("bigint").alias("n_added"), F.size("pii").cast("bigint").alias("n_spans"),
        line(F.filter("pii", lambda x: x["kind"] == pii.SECRET)).alias("secrets"))
