"""The registered queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, embedding_dedup, language_id, packing, quality, sentencepiece_sampling, set_join, topk_search, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_language_id": language_id.op2_language_id,
        "op3_chat_format": chat.op3_chat_format,
        "op4_topk_search": topk_search.op4_topk_search,
        "op5_jaccard_join": set_join.op5_jaccard_join,
        "op6_packing": packing.op6_packing,
        "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
        "op8_sentencepiece_sampling": sentencepiece_sampling.op8_sentencepiece_sampling,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.ORACLE, "op3_chat_format": chat.ORACLE, "op4_topk_search": topk_search.ORACLE, "op5_jaccard_join": set_join.ORACLE, "op7_embedding_dedup": embedding_dedup.ORACLE}
