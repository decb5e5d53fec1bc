"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadlake.llm import audio, bpe, chunk_dedup, decontaminate, hmm, jaccard_join, line_dedup, quality, secrets, shards


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": jaccard_join.op1,
    "op2_line_dedup": line_dedup.op2,
    "op3_audio_fingerprints": audio.op3,
    "op4_byte_bpe": bpe.op4,
    "op5_balanced_shards": shards.op5,
    "op6_secret_scan": secrets.op6,
    "op7_quality_rules": quality.op7,
    "op8_winnowing_decontamination": decontaminate.op8,
    "op9_hidden_markov_scores": hmm.op9,
    "op10_chunk_dedup": chunk_dedup.op10,
    "pipeline": _pipeline,
}

ORACLES = {
    "op1_ngram_jaccard_join": jaccard_join.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op8_winnowing_decontamination": decontaminate.ORACLE,
}
