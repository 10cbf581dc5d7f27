"""Typed numeric vectors in long form: (vector_id, entity_id, column, value), and their metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import chemistry

#: Reductions of a vector's columns and of several vectors to one value per entity.
REDUCTIONS = {
    "mean": F.avg,
    "median": F.median,
    "max": F.max,
    "min": F.min,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
}


def from_wide(df: DataFrame, vector_id: str, entity: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Long form of a wide frame; `entity` becomes entity_id, only `columns` (all others if None) are kept."""
    kept = [c for c in (columns or df.columns) if c != entity]
    cast = df.select(F.col(entity).cast("string").alias("entity_id"), *[F.col(c).cast("double").alias(c) for c in kept])
    return cast.unpivot(["entity_id"], kept, "column", "value").select(F.lit(vector_id).alias("vector_id"), "entity_id", "column", "value")


def aggregate(values: DataFrame, op: str, vector_id: str, parents: Sequence[str] | None = None) -> DataFrame:
    """One value per entity over all columns of all parents; nulls are skipped, and a sum over nulls alone is 0."""
    if op not in REDUCTIONS:
        raise ValueError(f"unknown reduction {op!r}")
    table = values.where(F.col("vector_id").isin(list(parents))) if parents is not None else values
    return table.groupBy("entity_id").agg(REDUCTIONS[op](F.col("value")).alias("value")).select(F.lit(vector_id).alias("vector_id"), "entity_id", F.lit(op).alias("column"), "value")


def fold_change(values: DataFrame, numerator: str, denominator: str, vector_id: str, base: float | None = 2, reduce: str | None = None) -> DataFrame:
    """Ratio of two vectors (its logarithm if base is set) for entities that both have.

    With `reduce` both sides are aggregated first; without it each must have one value per entity."""
    if reduce == "sum":
        raise ValueError("sum isn't a reduction for fold changes")
    side = {"n": numerator, "d": denominator}
    one = {}
    for name, vector in side.items():
        own = values.where(F.col("vector_id") == vector)
        value = REDUCTIONS[reduce](F.col("value")) if reduce else F.when(F.count("*") == 1, F.first("value")).otherwise(F.raise_error(F.lit("a vector of several columns needs a reduction")).cast("double"))
        one[name] = own.groupBy("entity_id").agg(value.alias(name))
    column = f"log{base:g}_fold_change" if base else "fold_change"
    joined = one["n"].join(one["d"], "entity_id")
    return joined.select(F.lit(vector_id).alias("vector_id"), "entity_id", F.lit(column).alias("column"), chemistry.log_ratio(F.col("n"), F.col("d"), base).alias("value"))


def many(values: DataFrame, vectors: Sequence[tuple[str, str]]) -> DataFrame:
    """Wide form of (vector, column) pairs, all entities of any; one aggregation instead of a chain of joins."""
    if not vectors:
        return values.sparkSession.createDataFrame([], "entity_id string")
    wanted = values.where(F.concat_ws(":", "vector_id", "column").isin([f"{v}:{c}" for v, c in vectors]))
    cells = [F.max(F.when((F.col("vector_id") == v) & (F.col("column") == c), F.col("value"))).alias(f"{v}:{c}") for v, c in vectors]
    return wanted.groupBy("entity_id").agg(*cells)


def listed(metadata: DataFrame, experiment: str | None = None, domain: str | None = None, scale: str | None = None, entity_kind: str | None = None) -> DataFrame:
    """Metadata that fits all given conditions, oldest first."""
    wanted = {"experiment_id": experiment, "type_domain": domain, "type_scale": scale, "entity_kind": entity_kind}
    out = metadata
    for column, value in wanted.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy("created_at", "id")


def projected(values: DataFrame, gene_reaction: DataFrame, op: str) -> DataFrame:
    """Gene values as reaction values by gene_reaction(gene, reaction): max, min or mean over a reaction's genes."""
    own: dict[str, Column] = {"max": F.max("value"), "min": F.min("value"), "mean": F.avg("value")}
    joined = values.join(gene_reaction.select(F.col("gene").alias("entity_id"), "reaction").distinct(), "entity_id")
    return joined.groupBy("vector_id", "column", "reaction").agg(own[op].alias("value")).select("vector_id", F.col("reaction").alias("entity_id"), "column", "value")


def content_hash(values: DataFrame) -> DataFrame:
    """Per vector a hash of its rows that doesn't depend on their order, and their number. No vector is gathered in one place."""
    row = F.sha2(F.concat_ws("\x1f", "entity_id", "column", F.coalesce(F.col("value").cast("string"), F.lit(""))), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return values.groupBy("vector_id").agg(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts], F.count("*").cast("string")), 256).alias("content_hash"), F.count("*").alias("n_values"))
