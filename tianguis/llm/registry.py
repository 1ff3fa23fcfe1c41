"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tianguis.llm import bpe, chat, embedding_dedup, exact_dedup, langid, line_dedup, minhash, mixing, pii, toxicity


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_pii": pii.op1_pii,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_bpe": bpe.op3_bpe,
        "op4_minhash_near_dedup": minhash.op4_minhash_near_dedup,
        "op5_embedding_near_dedup": embedding_dedup.op5_embedding_near_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_language_id": langid.op7_language_id,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_chat_format": chat.op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": exact_dedup.ORACLE, "op10_chat_format": chat.ORACLE}
