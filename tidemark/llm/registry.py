"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm import decontaminate, embedding_dedup, jaccard_join, langid, quality, secrets, sentencepiece, sharding, suffix_dedup, warc


def queries() -> dict:
    return {
        "op5_warc": warc.op5_warc,
        "op7_sharding": sharding.op7_sharding,
        "op1_secrets": secrets.op1_secrets,
        "op2_quality": quality.op2_quality,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
        "op6_langid": langid.op6_langid,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op8_sentencepiece": sentencepiece.op8_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_embedding_dedup": embedding_dedup.ORACLE, "op5_warc": warc.ORACLE, "op9_decontaminate": decontaminate.ORACLE, "op10_jaccard_join": jaccard_join.ORACLE}
