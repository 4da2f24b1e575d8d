"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airsense.llm import centroids, chat, lexical_search, mixing, warc
from airsense.llm.brown_lm import op6_brown_lm
from airsense.llm.decontamination import op4_decontamination
from airsense.llm.fingerprints import op8_fingerprints
from airsense.llm.language_id import op11_language_id
from airsense.llm.licenses import op9_license_scan
from airsense.llm.ngram_jaccard import op7_ngram_jaccard
from airsense.llm.suffix_dedup import op5_suffix_dedup
from airsense.llm.toxicity import op3_toxicity

Query = Callable[[SparkSession, str], DataFrame]

LLM_QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        mixing.op1_mixing, warc.op2_warc, op3_toxicity, op4_decontamination, op5_suffix_dedup, op6_brown_lm, op7_ngram_jaccard,
        op8_fingerprints, op9_license_scan, chat.op10_chat_rotation,
        op11_language_id, lexical_search.op12_ranked_search, centroids.op13_centroid_clustering,
    )
}
LLM_ORACLES: dict[str, str] = {
    "op1_mixing": mixing.oracle(), "op2_warc": warc.ORACLE, "op10_chat_rotation": chat.ORACLE,
    "op12_ranked_search": lexical_search.ORACLE, "op13_centroid_clustering": centroids.oracle(),
}
