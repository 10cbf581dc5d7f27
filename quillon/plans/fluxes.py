"""Flux classes, growth calls and set differences, over supplier balances and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import fluxes
from quillon.plans import table


def ranges(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    zeroed = lambda c, cut: F.when(F.abs(c) < cut, 0.0).otherwise(c)
    out = line.groupBy(F.col("l_partkey").alias("reaction_id")).agg(F.min("l_discount").alias("a"), F.max("l_tax").alias("b"))
    low = zeroed(F.col("a") - 0.01 * (F.col("reaction_id") % 4), 0.005)
    return out.select("reaction_id", low.alias("minimum"), F.greatest(low, zeroed(F.col("b") - 0.02 * (F.col("reaction_id") % 5), 0.005)).alias("maximum"))


_RANGES = """r AS (SELECT l_partkey AS reaction_id, min(l_discount) - 0.01::DOUBLE * (l_partkey % 4) AS a, max(l_tax) - 0.02::DOUBLE * (l_partkey % 5) AS b FROM lineitem GROUP BY l_partkey),
z AS (SELECT reaction_id, CASE WHEN abs(a) < 0.005 THEN 0 ELSE a END AS minimum, CASE WHEN abs(b) < 0.005 THEN 0 ELSE b END AS b FROM r), g AS (SELECT reaction_id, minimum, greatest(minimum, b) AS maximum FROM z)"""


def growth(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("media_id"), F.when(F.col("s_suppkey") % 10 == 0, float("nan")).otherwise(F.col("s_acctbal") - 4000).alias("simulated_flux"))
    o = table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("media_id"), (F.col("s_suppkey") % 3).cast("double").alias("observed_value"))
    return fluxes.growth(s, o)


_GROWTH = """w AS (SELECT s_suppkey AS media_id, s_suppkey % 10 <> 0 AND s_acctbal - 4000 > 0.01 AS grows, s_suppkey % 4 <> 0 AS seen_, s_suppkey % 3 > 0 AS seen FROM supplier),
k AS (SELECT media_id, CASE WHEN NOT seen_ THEN CASE WHEN grows THEN 'P' ELSE 'N' END WHEN grows AND seen THEN 'CP' WHEN NOT grows AND NOT seen THEN 'CN' WHEN grows THEN 'FP' ELSE 'FN' END AS class FROM w)"""


def reports(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    year = lambda y: line.where(F.year("l_shipdate") == y).select(F.col("l_returnflag").alias("category"), (F.col("l_partkey") % 97).cast("string").alias("member"))
    return year(1996).where("member % 5 <> 0"), year(1997).where("member % 4 <> 0")


def members(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey").distinct()


def knockouts(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(400_000.0).alias("objective_value"), F.col("o_totalprice").alias("ko_objective_value"), F.when(F.col("o_orderstatus") == "P", "infeasible").otherwise("optimal").alias("status"))
    return fluxes.knockouts(t).select("o_orderkey", "impact")


def signed(spark, sf_dir):
    return fluxes.signed_ids(table(spark, sf_dir, "customer").select(F.col("c_name").alias("reaction_id"), F.col("c_acctbal").alias("flux")))


def loops(spark, sf_dir):
    return fluxes.loops(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("loop_id"), F.concat(F.lit("r"), F.col("l_partkey") % 4).alias("reaction_id"), F.when(F.col("l_quantity") > 25, ">").otherwise("<").alias("direction")))


QUERIES = {
    "fva_significant": lambda s, d: fluxes.differing(ranges(s, d), 0.05).select("reaction_id"),
    "fva_classify": lambda s, d: fluxes.classified(ranges(s, d)).select("reaction_id", "class"),
    "fva_partition": lambda s, d: fluxes.partitioned(ranges(s, d)).select("reaction_id", "partition", "essential"),
    "closed_mode": lambda s, d: fluxes.closed_mode(ranges(s, d)).select("reaction_id"),
    "growth_classes": lambda s, d: growth(s, d).select("media_id", "class"),
    "confusion_counts": lambda s, d: fluxes.confusion(growth(s, d)),
    "knockout_impact": knockouts,
    "flux_top_n": lambda s, d: fluxes.largest(table(s, d, "customer").select(F.col("c_name").alias("reaction_id"), F.col("c_acctbal").alias("flux")), 25),
    "flux_resigned": signed,
    "flux_loops": loops,
    "media_union": lambda s, d: fluxes.media_union(table(s, d, "supplier").select((F.col("s_acctbal") > 5000).alias("grows"), F.col("s_nationkey").alias("element"), F.col("s_name").alias("media_id"))),
    "report_diff": lambda s, d: fluxes.report_diff(*reports(s, d)),
    "report_counts": lambda s, d: fluxes.evaluation(reports(s, d)[0]),
    "nway_intersection": lambda s, d: fluxes.shared(members(s, d), "l_returnflag", "l_partkey", 3),
    "nway_distinctive": lambda s, d: fluxes.distinctive(members(s, d).where("l_returnflag <> 'N' or l_partkey % 3 <> 0"), "l_returnflag", "l_partkey", fluxes.shared(members(s, d).where("l_returnflag <> 'N' or l_partkey % 3 <> 0"), "l_returnflag", "l_partkey", 3)),
    "map_overlap": lambda s, d: fluxes.overlap(table(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id")), table(s, d, "orders").select(F.col("o_custkey").alias("id"))),
    "cumulative_diff": lambda s, d: fluxes.cumulative(table(s, d, "lineitem").select(F.year("l_shipdate").alias("step"), F.col("l_returnflag").alias("category"), F.col("l_partkey").alias("member")).distinct(), "step"),
}

ORACLES = {
    "fva_significant": f"WITH {_RANGES} SELECT reaction_id FROM g WHERE abs(maximum - minimum) > 0.05",
    "fva_classify": f"WITH {_RANGES} SELECT reaction_id, CASE WHEN abs(minimum) <= 1e-6 AND abs(maximum) <= 1e-6 THEN 'blocked' WHEN abs(maximum - minimum) <= 1e-6 THEN 'fixed_nonzero' ELSE 'variable' END AS class FROM g",
    "fva_partition": f"WITH {_RANGES} SELECT reaction_id, CASE WHEN maximum > 1e-9 AND minimum < -1e-9 THEN 'reversible' WHEN maximum > 1e-9 THEN 'forward_only' WHEN minimum < -1e-9 THEN 'reverse_only' ELSE 'dead' END AS partition, minimum > 1e-9 OR maximum < -1e-9 AS essential FROM g",
    "closed_mode": f"WITH {_RANGES} SELECT reaction_id FROM g WHERE abs(minimum) > 1e-7 OR abs(maximum) > 1e-7",
    "growth_classes": f"WITH {_GROWTH} SELECT media_id, class FROM k",
    "confusion_counts": f"WITH {_GROWTH} SELECT count(*) FILTER (class = 'CP') AS \"CP\", count(*) FILTER (class = 'CN') AS \"CN\", count(*) FILTER (class = 'FP') AS \"FP\", count(*) FILTER (class = 'FN') AS \"FN\", count(*) FILTER (class = 'P') AS \"P\", count(*) FILTER (class = 'N') AS \"N\", count(*) FILTER (class IN ('CP', 'CN')) / CAST(nullif(count(*) FILTER (length(class) = 2), 0) AS DOUBLE) AS accuracy FROM k",
    "knockout_impact": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_totalprice / 400000 < 0.01 THEN 'essential' WHEN o_totalprice / 400000 < 0.95 THEN 'reduced' ELSE 'dispensable' END AS impact FROM orders",
    "flux_top_n": "SELECT c_name AS reaction_id, c_acctbal AS flux FROM customer ORDER BY abs(c_acctbal) DESC, c_name LIMIT 25",
    "flux_resigned": "SELECT CASE WHEN c_acctbal < 0 THEN c_name || '-rev' ELSE c_name END AS reaction_id, abs(c_acctbal) AS flux FROM customer",
    "flux_loops": "WITH m AS (SELECT DISTINCT l_orderkey AS k, 'r' || (l_partkey % 4) || CASE WHEN l_quantity > 25 THEN '>' ELSE '<' END AS x FROM lineitem), s AS (SELECT k, string_agg(x, ',' ORDER BY x) AS members FROM m GROUP BY 1) SELECT min(k) AS loop_id, members FROM s GROUP BY members",
    "media_union": "SELECT s_nationkey AS element, string_agg(s_name, ',' ORDER BY s_name) AS media FROM supplier WHERE s_acctbal > 5000 GROUP BY 1",
    "report_diff": "WITH b AS (SELECT DISTINCT l_returnflag AS category, CAST(l_partkey % 97 AS VARCHAR) AS m FROM lineitem WHERE year(l_shipdate) = 1996 AND l_partkey % 97 % 5 <> 0), a AS (SELECT DISTINCT l_returnflag AS category, CAST(l_partkey % 97 AS VARCHAR) AS m FROM lineitem WHERE year(l_shipdate) = 1997 AND l_partkey % 97 % 4 <> 0), x AS (SELECT category, 'added' AS change, m FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT category, 'removed', m FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT category, change, string_agg(m, ',' ORDER BY m) AS members, count(*) AS n FROM x GROUP BY 1, 2",
    "report_counts": "WITH b AS (SELECT DISTINCT l_returnflag AS category, CAST(l_partkey % 97 AS VARCHAR) AS m FROM lineitem WHERE year(l_shipdate) = 1996 AND l_partkey % 97 % 5 <> 0) SELECT category, count(*) AS n, string_agg(m, ',' ORDER BY m) AS members FROM b GROUP BY 1",
    "nway_intersection": "SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3",
    "nway_distinctive": "WITH m AS (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem WHERE (l_returnflag <> 'N' OR l_partkey % 3 <> 0)) SELECT l_returnflag, min(l_partkey) AS l_partkey FROM m WHERE l_partkey NOT IN (SELECT l_partkey FROM m GROUP BY 1 HAVING count(*) = 3) GROUP BY 1",
    "map_overlap": "WITH a AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0), b AS (SELECT DISTINCT o_custkey AS id FROM orders), n AS (SELECT (SELECT count(*) FROM a) AS x, (SELECT count(*) FROM b) AS y, (SELECT count(*) FROM a JOIN b USING (id)) AS z) SELECT x AS n_map, y AS n_model, z AS n_shared, CAST(z AS DOUBLE) / x AS map_share, CAST(z AS DOUBLE) / y AS model_share FROM n",
    "cumulative_diff": "WITH r AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS step, l_returnflag AS category, l_partkey AS member FROM lineitem), st AS (SELECT step, lead(step) OVER (ORDER BY step) AS nx FROM (SELECT DISTINCT step FROM r)), bef AS (SELECT nx AS step, category, member FROM r JOIN st USING (step) WHERE nx IS NOT NULL), aft AS (SELECT * FROM r WHERE step > (SELECT min(step) FROM r)) SELECT *, 'added' AS change FROM (SELECT * FROM aft EXCEPT SELECT * FROM bef) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM bef EXCEPT SELECT * FROM aft)",
}
