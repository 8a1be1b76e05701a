"""Every query of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from kinegrain.llm import queries_models as models
from kinegrain.llm import queries_native as native
from kinegrain.llm import queries_near as near
from kinegrain.llm import queries_tokens as tokens


def queries() -> dict:
    return {
        "op1_token_shards": tokens.op1_token_shards,
        "op2_skip_chain_pii": models.op2_skip_chain_pii,
        "op3_packing": tokens.op3_packing,
        "op4_decontamination": near.op4_decontamination,
        "op5_ngram_jaccard": near.op5_ngram_jaccard,
        "op6_toxicity": models.op6_toxicity,
        "op7_fingerprints": near.op7_fingerprints,
        "op8_chat_formatting": native.op8_chat_formatting,
        "op9_url_filters": native.op9_url_filters,
        "op10_sharding": native.op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": near.OP4_SQL,
        "op5_ngram_jaccard": near.OP5_SQL,
        "op8_chat_formatting": native.OP8_SQL,
        "op9_url_filters": native.OP9_SQL,
        "op10_sharding": native.op10_sql(),
    }
