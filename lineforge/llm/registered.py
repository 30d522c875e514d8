"""Queries of this subpackage and the SQL that must give their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lineforge.llm import (
    bpe,
    chat,
    decontaminate,
    importance,
    pseudo_likelihood,
    quality_model,
    quality_rules,
    secrets,
    simhash,
    source_mix,
    token_counts,
    url_filter,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_quality_classifier": quality_model.op3_quality_classifier,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_bpe": bpe.op5_bpe,
    "op6_chat_format": chat.op6_chat_format,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_pseudo_likelihood": pseudo_likelihood.op9_pseudo_likelihood,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "quality_ablations": quality_rules.quality_ablations,
    "op11_importance_resample": importance.op11_importance_resample,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_source_mix": source_mix.op13_source_mix,
}
ORACLES: dict[str, str] = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "quality_ablations": quality_rules.ABLATIONS_SQL,
}
