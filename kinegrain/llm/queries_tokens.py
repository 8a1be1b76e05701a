"""The queries of the two operators that write token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrain.llm import packing, scratch, tokenbin
from kinegrain.session import table


def vocabulary(name: str) -> str:
    """Where the installed public vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "tokens")
    manifest = tokenbin.write_token_shards(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"), 2)
    back = tokenbin.read_token_shards(spark, folder, manifest)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "batch_id")
