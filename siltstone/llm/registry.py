"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from siltstone.llm import chat, contamination, embeddings, lm, mixing, neighbours, pii, quality, resampling, simhash, substrings, tokens, vectorcodes


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_tokens": tokens.op1_tokens,
        "op2_decontamination": contamination.op2_decontamination,
        "op3_simhash": simhash.op3_simhash,
        "op4_quality": quality.op4_quality,
        "op5_pii": pii.op5_pii,
        "op6_lm": lm.op6_lm,
        "op7_chat": chat.op7_chat,
        "op8_embeddings": embeddings.op8_embeddings,
        "op9_substrings": substrings.op9_substrings,
        "op10_mixing": mixing.op10_mixing,
        "op11_vector_codes": vectorcodes.op11_vector_codes,
        "op12_resampling": resampling.op12_resampling,
        "op13_neighbours": neighbours.op13_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": contamination.SQL,
        "op7_chat": chat.SQL,
        "op8_embeddings": embeddings.SQL,
        "op9_substrings": substrings.SQL,
        "op10_mixing": mixing.SQL,
        "op11_vector_codes": vectorcodes.SQL,
        "op12_resampling": resampling.SQL,
        "op13_neighbours": neighbours.SQL,
    }
