"""Windows over event time; each function takes a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _counted(df: DataFrame, window, by: tuple[str, ...]) -> DataFrame:
    return df.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def tumbling(df: DataFrame, time: str, width: str, *by: str, late: str | None = None) -> DataFrame:
    """Counts per window; on a stream `late` is how long late rows are waited for."""
    source = df.withWatermark(time, late) if late and df.isStreaming else df
    return _counted(source, F.window(time, width), by)


def sliding(df: DataFrame, time: str, width: str, slide: str, *by: str, late: str | None = None) -> DataFrame:
    source = df.withWatermark(time, late) if late and df.isStreaming else df
    return _counted(source, F.window(time, width, slide), by)


def sessions(df: DataFrame, key: str, time: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions per key: start, end (the last row's time and the gap) and rows."""
    source = df.withWatermark(time, late) if late and df.isStreaming else df
    out = source.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row of its key that isn't later; one sort of both, no range join."""
    rest = [c for c in left.columns if c not in (key, time)]
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(key, time, value).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    seen = F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(time, "_side", value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("_seen", seen).where("_side = 1").select(key, time, *rest, F.col("_seen").alias(value))
