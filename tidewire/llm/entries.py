"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, lexical, linededup, neardup, packing, pii, pivots, quality, rules, toxicity, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_minhash_near_dedup": neardup.op3_minhash_near_dedup,
    "op4_benchmark_decontamination": decontam.op4_benchmark_decontamination,
    "op5_pii": pii.op5_pii,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_warc": warc.op8_warc,
    "op9_language_id": langid.op9_language_id,
    "op10_quality_rules": rules.op10_quality_rules,
    "op11_embedding_near_dedup": pivots.op11_embedding_near_dedup,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_ranked_lexical_search": lexical.op13_ranked_lexical_search,
}

SQL: dict[str, str] = {
    "op3_minhash_near_dedup": neardup.OP3_SQL,
    "op7_line_dedup": linededup.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op13_ranked_lexical_search": lexical.OP13_SQL,
}
