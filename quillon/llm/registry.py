"""The corpus operators' queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, decontaminate, jaccard_join, line_dedup, pii, qalsh, quality, sharding, sql, substring_dedup, toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_sharding": sharding.op2_sharding,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_byte_bpe": bpe.op4_byte_bpe,
        "op5_quality": quality.op5_quality,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_nearest": qalsh.op8_nearest,
        "op9_pii": pii.op9_pii,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.TWINS)
