"""Vectors: prices of parts by return flag as vectors over part keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import vectors
from quillon.plans import table


def values(spark, sf_dir):
    """Four vectors in long form: mean price per part and flag (n, r, a: one column), and price, quantity, tax means (m: three)."""
    line = table(spark, sf_dir, "lineitem")
    flags = line.groupBy(F.concat(F.lit("flag_"), F.col("l_returnflag")).alias("vector_id"), F.col("l_partkey").cast("string").alias("entity_id")).agg(F.avg("l_extendedprice").alias("value"))
    one = flags.select("vector_id", "entity_id", F.lit("price").alias("column"), "value")
    wide = line.groupBy("l_partkey").agg(*[F.avg(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    return one.unionByName(vectors.from_wide(wide, "means", "l_partkey"))


_FLAGS = """SELECT 'flag_' || l_returnflag AS vector_id, CAST(l_partkey AS VARCHAR) AS entity_id, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2"""
_LONG = f"""WITH f AS ({_FLAGS}), w AS (SELECT CAST(l_partkey AS VARCHAR) AS entity_id, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY 1),
v AS (SELECT vector_id, entity_id, 'price' AS "column", value FROM f
UNION ALL SELECT 'means', entity_id, 'l_quantity', q FROM w UNION ALL SELECT 'means', entity_id, 'l_discount', d FROM w UNION ALL SELECT 'means', entity_id, 'l_tax', t FROM w) """


def _fold(base):
    def run(spark, sf_dir):
        out = vectors.fold_change(values(spark, sf_dir), "flag_R", "flag_A", "fc", base)
        return out.select("entity_id", F.round("value", 6).alias("value"))

    return run


def _aggregate(op):
    def run(spark, sf_dir):
        return vectors.aggregate(values(spark, sf_dir), op, "agg").select("entity_id", F.round("value", 7).alias("value"))

    return run


def _projected(op):
    def run(spark, sf_dir):
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("gene"), F.col("p_brand").alias("reaction"))
        own = values(spark, sf_dir).where("vector_id = 'flag_R'")
        return vectors.projected(own, part, op).select("entity_id", F.round("value", 7).alias("value"))

    return run


def many(spark, sf_dir):
    out = vectors.many(values(spark, sf_dir), [("flag_R", "price"), ("flag_A", "price"), ("means", "l_tax")])
    return out.select("entity_id", *[F.round(F.col(f"`{c}`"), 6).alias(n) for c, n in (("flag_R:price", "r"), ("flag_A:price", "a"), ("means:l_tax", "tax"))])


def reduced_fold(spark, sf_dir):
    out = vectors.fold_change(values(spark, sf_dir), "flag_R", "means", "fc", 2, reduce="median")
    return out.select("entity_id", F.round("value", 6).alias("value"))


def listed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    meta = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("experiment_id"), F.col("o_orderstatus").alias("type_domain"), F.col("o_orderpriority").alias("type_scale"), F.lit("order").alias("entity_kind"), F.col("o_orderdate").alias("created_at"))
    return vectors.listed(meta, domain="F", scale="1-URGENT", entity_kind="order").select("id", "experiment_id", "created_at")


def ingest(spark, sf_dir):
    return vectors.from_wide(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), "suppliers", "s_suppkey")


QUERIES = {
    "vector_ingest_wide": ingest,
    "vector_fold_change": _fold(2),
    "vector_fold_change_raw": _fold(None),
    "vector_fold_change_reduced": reduced_fold,
    **{f"vector_aggregate_{op}": _aggregate(op) for op in vectors.REDUCTIONS},
    "vector_get_many": many,
    "vector_list_filter": listed,
    **{f"gpr_projection_{op}": _projected(op) for op in ("max", "min", "mean")},
}

_JOINED = f"WITH f AS ({_FLAGS}) SELECT r.entity_id, {{}} AS value FROM f r JOIN f a USING (entity_id) WHERE r.vector_id = 'flag_R' AND a.vector_id = 'flag_A'"
_REDUCE = {"mean": "avg(value)", "median": "median(value)", "max": "max(value)", "min": "min(value)", "sum": "coalesce(sum(value), 0)"}

ORACLES = {
    "vector_ingest_wide": "SELECT 'suppliers' AS vector_id, CAST(s_suppkey AS VARCHAR) AS entity_id, c AS \"column\", v AS value FROM (SELECT s_suppkey, 's_acctbal' AS c, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS DOUBLE) FROM supplier)",
    "vector_fold_change": _JOINED.format("round(ln(r.value / a.value) / ln(2.0), 6)"),
    "vector_fold_change_raw": _JOINED.format("round(r.value / a.value, 6)"),
    "vector_fold_change_reduced": f"{_LONG}, m AS (SELECT entity_id, median(value) AS d FROM v WHERE vector_id = 'means' GROUP BY 1) SELECT r.entity_id, CASE WHEN d <= 0 THEN CAST('inf' AS DOUBLE) ELSE round(ln(value / d) / ln(2.0), 6) END AS value FROM v r JOIN m USING (entity_id) WHERE vector_id = 'flag_R'",
    **{f"vector_aggregate_{op}": f"{_LONG} SELECT entity_id, round({e}, 7) AS value FROM v GROUP BY 1" for op, e in _REDUCE.items()},
    "vector_get_many": f"{_LONG} SELECT entity_id, round(max(CASE WHEN vector_id = 'flag_R' THEN value END), 6) AS r, round(max(CASE WHEN vector_id = 'flag_A' THEN value END), 6) AS a, round(max(CASE WHEN \"column\" = 'l_tax' THEN value END), 6) AS tax FROM v WHERE vector_id IN ('flag_R', 'flag_A') OR \"column\" = 'l_tax' GROUP BY 1",
    "vector_list_filter": "SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS experiment_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    **{f"gpr_projection_{op}": f"WITH f AS ({_FLAGS}) SELECT p_brand AS entity_id, round({_REDUCE[op]}, 7) AS value FROM f JOIN part ON entity_id = CAST(p_partkey AS VARCHAR) WHERE vector_id = 'flag_R' GROUP BY 1" for op in ("max", "min", "mean")},
}
