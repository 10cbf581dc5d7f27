"""Named queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    from quillon.plans import catalog, extras, fluxes, matching, ranking, records, sequences, vectors

    return {k: v for module in (vectors, catalog, ranking, matching, fluxes, sequences, records, extras) for k, v in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    from quillon.plans import catalog, extras, fluxes, matching, ranking, records, sequences, vectors

    return {k: v for module in (vectors, catalog, ranking, matching, fluxes, sequences, records, extras) for k, v in module.ORACLES.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
