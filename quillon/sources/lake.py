"""SQL over lake tables: result envelopes, pages and browsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.sinks import stored

DEFAULT_LIMIT, PAGE = 100, 1_000


def rows(spark: SparkSession, sql: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A query's rows from offset on, DEFAULT_LIMIT of them unless told otherwise."""
    return spark.sql(sql).offset(offset).limit(DEFAULT_LIMIT if limit is None else limit)


def query(spark: SparkSession, sql: str, limit: int | None = None, offset: int = 0) -> dict:
    """{success, data, columns, row_count, query[, error]}; what goes wrong is told, never raised."""
    try:
        df = rows(spark, sql, limit, offset)
        data = [r.asDict(recursive=True) for r in df.collect()]  # at most `limit` rows
    except Exception as e:  # the envelope is the contract
        return {"success": False, "data": [], "columns": [], "row_count": 0, "query": sql, "error": str(e).splitlines()[0]}
    return {"success": True, "data": data, "columns": df.columns, "row_count": len(data), "query": sql}


def paged(df: DataFrame, order: Sequence[str], size: int = PAGE, pages: int | None = None, buckets: int = 64) -> DataFrame:
    """df with its page number in a total order. Rows are numbered within ranges of the order, and ranges get offsets, so no task sorts everything.

    The ranges are drawn from a sample, so rows are stored with theirs once, and both counts and numbers read that table."""
    ranged = stored(df.repartitionByRange(buckets, *order).withColumn("_range", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over `buckets` rows
    offsets = ranged.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    numbered = ranged.withColumn("_n", own).join(F.broadcast(offsets), "_range")
    out = numbered.withColumn("page", F.floor((F.col("_n") + F.col("_offset") - 1) / size)).drop("_n", "_offset", "_range")
    return out.where(F.col("page") < pages) if pages is not None else out


def paginate(spark: SparkSession, sql: str, size: int = PAGE, pages: int | None = None) -> dict:
    """All pages of an ordered query in one envelope, streamed instead of asked for again and again."""
    data, fetched, columns = [], 0, []
    try:
        df = spark.sql(sql)
        columns = df.columns
        for r in (df.limit(size * pages) if pages is not None else df).toLocalIterator():
            data.append(r.asDict(recursive=True))
        fetched = -(-len(data) // size)
    except Exception as e:
        return {"success": False, "data": data, "columns": columns, "row_count": len(data), "query": sql, "pages_fetched": fetched, "error": str(e).splitlines()[0]}
    return {"success": True, "data": data, "columns": columns, "row_count": len(data), "query": sql, "pages_fetched": fetched}


def databases(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES").toDF("database")


def tables(spark: SparkSession, database: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN `{database}`").select(F.col("tableName").alias("table"), F.col("isTemporary").alias("temporary"))


def columns(spark: SparkSession, database: str, table: str) -> DataFrame:
    """(name, type) of a table's columns; a missing type is unknown."""
    found = spark.sql(f"DESCRIBE TABLE `{database}`.`{table}`").where("col_name <> '' and not startswith(col_name, '#')")
    return found.select(F.col("col_name").alias("name"), F.coalesce("data_type", F.lit("unknown")).alias("type"))


def schema(spark: SparkSession, database: str | None = None, with_columns: bool = False) -> dict:
    """The tree of databases, tables and, if wanted, columns; metadata only."""
    names = [database] if database else [r[0] for r in databases(spark).collect()]
    tree: dict = {}
    for d in names:
        found = [r["table"] for r in tables(spark, d).where("not temporary").collect()]
        tree[d] = {t: [r.asDict() for r in columns(spark, d, t).collect()] for t in found} if with_columns else found
    return tree


def alive(spark: SparkSession) -> bool:
    return query(spark, "SELECT 1 AS test")["success"]


def count(df: DataFrame) -> int:
    return df.count()


def sample(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)
