"""Catalog, lake and ledger queries: events as an access log, orders as stored objects and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import catalog, ledger
from quillon.plans import table
from quillon.sources import lake

_NOW = "1998-09-01 00:00:00"


def log(spark, sf_dir):
    op = F.when(F.col("event_type").isin("purchase", "signup"), "write").when(F.col("event_type").isin("view", "click"), "read").otherwise("delete")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("nb"), F.col("user_id") % 20).alias("notebook"), F.concat(F.lit("obj"), F.col("user_id")).alias("object_id"), F.when(F.col("user_id") % 2 == 0, "cache").otherwise("vector").alias("object_kind"), op.alias("op"), F.col("ts").alias("timestamp"))


_LOG = """WITH log AS (SELECT event_id AS id, 'nb' || (user_id % 20) AS notebook, 'obj' || user_id AS object_id, CASE WHEN user_id % 2 = 0 THEN 'cache' ELSE 'vector' END AS object_kind,
CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' WHEN event_type IN ('view', 'click') THEN 'read' ELSE 'delete' END AS op, ts AS timestamp FROM events)"""


def objects(spark, sf_dir):
    """Orders as stored objects; each names its customer's nation-mates' two neighbours by key as inputs."""
    o = table(spark, sf_dir, "orders")
    inputs = F.concat(F.lit('{"inputs": ["'), F.col("o_orderkey") - 1, F.lit('", "'), F.col("o_orderkey") + 1, F.lit('"]}'))
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("type"), F.md5(F.col("o_orderpriority")).alias("content_hash"), inputs.alias("metadata_json"), F.col("o_orderdate").alias("created_at"))


_OBJECTS = "objects AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, o_orderpriority AS type, md5(o_orderpriority) AS content_hash, o_orderdate AS created_at FROM orders)"
_STALE = "inp AS (SELECT k, id, k - 1 AS i FROM objects UNION ALL SELECT k, id, k + 1 FROM objects), newest AS (SELECT inp.id, max(o.created_at) AS newest FROM inp JOIN objects o ON o.k = inp.i GROUP BY 1), stale AS (SELECT o.id, coalesce(n.newest > o.created_at, false) AS stale FROM objects o LEFT JOIN newest n USING (id))"


def rolled(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.concat(F.lit("obj"), F.col("c_custkey")).alias("id"), F.lit(None).cast("string").alias("metadata_json"), F.lit("2024-01-01").cast("timestamp").alias("created_at")).where("id like '%0' or id like '%2'")
    vectors = table(spark, sf_dir, "supplier").select(F.concat(F.lit("obj"), F.col("s_suppkey")).alias("id"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    parents = table(spark, sf_dir, "supplier").select(F.concat(F.lit("obj"), F.col("s_suppkey")).alias("child_id"), F.concat(F.lit("obj"), F.col("s_nationkey")).alias("parent_id"))
    out = catalog.rollup(own, vectors, parents, log(spark, sf_dir))
    return out.select("id", "kind", F.array_join("parents", ",").alias("parents"), "stale", "last_write", "last_read", "n_writes", "n_reads")


def jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "error").otherwise("queued")
    return o.select(F.col("o_orderkey").alias("job_id"), state.alias("state"), F.col("o_custkey").alias("workspace_id"), F.col("o_orderdate").alias("created_at"), F.date_add("o_orderdate", 3).cast("timestamp").alias("updated_at"), F.date_add("o_orderdate", 5).cast("timestamp").alias("end_ts"), F.col("o_orderdate").alias("submit_ts"))


_JOBS = """WITH jobs AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'error' ELSE 'queued' END AS state, o_custkey AS workspace_id, o_orderdate AS created_at,
CAST(CAST(o_orderdate AS DATE) + 3 AS TIMESTAMP) AS updated_at, CAST(CAST(o_orderdate AS DATE) + 5 AS TIMESTAMP) AS end_ts, o_orderdate AS submit_ts FROM orders)"""


def pipelines(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = o.select(F.col("o_orderkey").alias("pipeline_id"), (F.col("o_orderkey") % 4).cast("int").alias("current_step"), F.lit(4).alias("total_steps"), F.lit("running").alias("status"))
    j = o.select(F.col("o_orderkey").alias("pipeline_id"), (F.col("o_orderkey") % 4).cast("int").alias("step"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "error").otherwise("running").alias("state"))
    return ledger.advanced(p, j)


def upserted(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    base = catalog.latest(e.where("event_id % 2 = 0").select("user_id", "event_type", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), "event_id"), ["user_id"], ["updated_at", "event_id"]).drop("event_id")
    new = catalog.latest(e.where("event_id % 2 = 1").select("user_id", "event_type", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), "event_id"), ["user_id"], ["updated_at", "event_id"]).drop("event_id")
    return catalog.upsert(base, new, ["user_id"], keep=["created_at"])


def latest(spark, sf_dir):
    return catalog.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "ts", "value")


def integrity(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    few = t("customer").where("c_custkey % 7 <> 0")
    some = t("part").where("p_partkey % 11 <> 0")
    rules = [("order without customer", t("orders"), "o_custkey", few, "c_custkey"), ("line without part", t("lineitem"), "l_partkey", some, "p_partkey"), ("supplier without nation", t("supplier"), "s_nationkey", t("nation"), "n_nationkey")]
    return catalog.integrity(rules).groupBy("rule", "key").agg(F.count("*").alias("n"))


def deleted(spark, sf_dir):
    own = objects(spark, sf_dir)
    left, orphans = catalog.deleted(own, own.where("type in ('1-URGENT', '2-HIGH') or created_at < '1995-01-01'").select("id"))
    return left.groupBy("content_hash").agg(F.count("*").alias("n")).withColumn("orphan", F.lit(False)).unionByName(orphans.select("content_hash", F.lit(0).cast("long").alias("n"), F.lit(True).alias("orphan")))


def lineage(spark, sf_dir):
    edges = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("child_id"), F.floor(F.col("p_partkey") / 3).alias("parent_id"))
    return catalog.lineage(edges)


def dot(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    nodes = n.select(F.col("n_name").alias("id"), (F.col("n_nationkey") % 5 == 0).alias("stale"))
    return catalog.dot(nodes, n.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child_id"), F.col("r_name").alias("parent_id")))


QUERIES = {
    "manifest_notebooks": lambda s, d: catalog.notebooks(log(s, d)),
    "manifest_access_stats": lambda s, d: catalog.access_stats(log(s, d)),
    "manifest_objects": rolled,
    "manifest_dot": dot,
    "cache_first_writer": lambda s, d: catalog.first_writers(log(s, d)),
    "cache_list_filter": lambda s, d: catalog.cached(table(s, d, "customer").select(F.concat(F.lit("obj"), F.col("c_custkey")).alias("id"), F.col("c_mktsegment").alias("type"), F.lit("2024-01-01").cast("timestamp").alias("created_at")), log(s, d), "BUILDING", "nb3").select("id", "type"),
    "cache_references": lambda s, d: catalog.references(objects(s, d)),
    "cache_delete_orphans": deleted,
    "stale_objects": lambda s, d: catalog.stale(objects(s, d)),
    "json_inputs": lambda s, d: catalog.inputs(objects(s, d)),
    "lineage_closure": lineage,
    "integrity_report": integrity,
    "upsert_latest": latest,
    "upsert_keep_created": upserted,
    "vector_parents": lambda s, d: table(s, d, "nation").groupBy(F.col("n_regionkey").alias("child_id")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("parents")),
    "lake_limit_offset": lambda s, d: (table(s, d, "orders").createOrReplaceTempView("lake_orders"), lake.rows(s, "SELECT o_orderkey, o_totalprice FROM lake_orders ORDER BY o_orderkey", 50, 25))[1],
    "lake_default_limit": lambda s, d: (table(s, d, "part").createOrReplaceTempView("lake_part"), lake.rows(s, "SELECT p_partkey, p_brand FROM lake_part ORDER BY p_partkey"))[1],
    "lake_paginate": lambda s, d: lake.paged(table(s, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 1000),
    "lake_like_filter": lambda s, d: (table(s, d, "part").createOrReplaceTempView("lake_part"), s.sql("SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM lake_part WHERE p_brand LIKE 'Brand#1%' AND p_size > 10 ORDER BY p_retailprice DESC, p_partkey"))[1],
    "jobs_active": lambda s, d: ledger.active(jobs(s, d)).select("job_id", "state", "created_at"),
    "jobs_by_state": lambda s, d: ledger.by_state(jobs(s, d), "error").select("job_id", "state"),
    "jobs_by_workspace": lambda s, d: ledger.by_workspace(jobs(s, d), 7).select("job_id", "workspace_id"),
    "jobs_summary": lambda s, d: ledger.summary(jobs(s, d)),
    "jobs_recent": lambda s, d: ledger.recent(jobs(s, d), 20).select("job_id", "updated_at"),
    "jobs_ttl": lambda s, d: ledger.expired(jobs(s, d), _NOW, 86_400 * 400),
    "jobs_swept": lambda s, d: ledger.swept(jobs(s, d), _NOW, 86_400 * 400).select("job_id"),
    "jobs_cleanup": lambda s, d: ledger.older(jobs(s, d), _NOW, 300).select("job_id", "state"),
    "jobs_claim": lambda s, d: ledger.claim(jobs(s, d)).select("job_id", "state"),
    "pipelines_list": lambda s, d: ledger.pipelines(table(s, d, "orders").select(F.col("o_orderkey").alias("pipeline_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("project"), F.col("o_orderdate").alias("created_at")), "O", "3-MEDIUM", "1996-06-01", 40),
    "pipeline_advance": pipelines,
    "batch_accounting": lambda s, d: ledger.accounting(table(s, d, "events").select((F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", F.concat(F.lit("user "), F.col("user_id") % 5)).alias("error"))).select("n_ok", "n_failed", F.array_join("errors", ",").alias("errors")),
}

ORACLES = {
    "manifest_notebooks": f"{_LOG} SELECT notebook, max(timestamp) AS last_seen, count(*) FILTER (op = 'write') AS writes, count(*) FILTER (op = 'read') AS reads FROM log GROUP BY 1",
    "manifest_access_stats": f"{_LOG} SELECT object_kind, object_id, max(timestamp) FILTER (op = 'write') AS last_write, max(timestamp) FILTER (op = 'read') AS last_read, count(*) FILTER (op = 'write') AS n_writes, count(*) FILTER (op = 'read') AS n_reads FROM log GROUP BY 1, 2",
    "manifest_objects": f"""{_LOG}, st AS (SELECT object_kind, object_id, max(timestamp) FILTER (op = 'write') AS last_write, max(timestamp) FILTER (op = 'read') AS last_read, count(*) FILTER (op = 'write') AS n_writes, count(*) FILTER (op = 'read') AS n_reads FROM log GROUP BY 1, 2),
        both_ AS (SELECT 'obj' || c_custkey AS id, 'cache' AS kind, '' AS parents FROM customer WHERE c_custkey % 10 IN (0, 2) UNION ALL SELECT 'obj' || s_suppkey, 'vector', 'obj' || s_nationkey FROM supplier)
        SELECT id, kind, parents, false AS stale, last_write, last_read, coalesce(n_writes, 0) AS n_writes, coalesce(n_reads, 0) AS n_reads FROM both_ LEFT JOIN st ON id = object_id AND kind = object_kind""",
    "manifest_dot": """SELECT '"' || n_name || '"' || CASE WHEN n_nationkey % 5 = 0 THEN ' [color=red]' ELSE '' END || ';' AS line FROM nation UNION ALL SELECT '"' || r_name || '" -> "' || n_name || '";' FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "cache_first_writer": f"{_LOG} SELECT object_id, arg_min(notebook, (timestamp, id)) AS notebook, min(timestamp) AS first_write FROM log WHERE op = 'write' GROUP BY 1",
    "cache_list_filter": f"{_LOG}, fw AS (SELECT object_id, arg_min(notebook, (timestamp, id)) AS notebook FROM log WHERE op = 'write' GROUP BY 1) SELECT 'obj' || c_custkey AS id, c_mktsegment AS type FROM customer WHERE c_mktsegment = 'BUILDING' AND 'obj' || c_custkey IN (SELECT object_id FROM fw WHERE notebook = 'nb3')",
    "cache_references": "SELECT md5(o_orderpriority) AS content_hash, count(*) AS n_refs FROM orders GROUP BY 1",
    "cache_delete_orphans": f"WITH {_OBJECTS}, gone AS (SELECT id FROM objects WHERE type IN ('1-URGENT', '2-HIGH') OR created_at < '1995-01-01'), lft AS (SELECT * FROM objects WHERE id NOT IN (SELECT id FROM gone)) SELECT content_hash, count(*) AS n, false AS orphan FROM lft GROUP BY 1 UNION ALL SELECT DISTINCT content_hash, 0, true FROM objects WHERE id IN (SELECT id FROM gone) AND content_hash NOT IN (SELECT content_hash FROM lft)",
    "stale_objects": f"WITH {_OBJECTS}, {_STALE} SELECT id, stale FROM stale",
    "json_inputs": "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey - 1 AS VARCHAR) AS input FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), CAST(o_orderkey + 1 AS VARCHAR) FROM orders",
    "lineage_closure": "WITH RECURSIVE e AS (SELECT p_partkey AS c, p_partkey // 3 AS p FROM part), up AS (SELECT c AS descendant, p AS ancestor FROM e UNION SELECT u.descendant, e.p FROM up u JOIN e ON u.ancestor = e.c) SELECT DISTINCT ancestor, descendant FROM up",
    "integrity_report": "SELECT rule, CAST(k AS VARCHAR) AS key, count(*) AS n FROM (SELECT 'order without customer' AS rule, o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) UNION ALL SELECT 'line without part', l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 11 <> 0) UNION ALL SELECT 'supplier without nation', s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)) GROUP BY 1, 2",
    "upsert_latest": "SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "upsert_keep_created": "WITH r AS (SELECT *, event_id % 2 AS side, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts DESC, event_id DESC) AS n FROM events), a AS (SELECT * FROM r WHERE n = 1 AND side = 0), b AS (SELECT * FROM r WHERE n = 1 AND side = 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.event_type, a.event_type) AS event_type, coalesce(a.ts, b.ts) AS created_at, coalesce(b.ts, a.ts) AS updated_at FROM a FULL JOIN b ON a.user_id = b.user_id",
    "vector_parents": "SELECT n_regionkey AS child_id, string_agg(n_name, ',' ORDER BY n_name) AS parents FROM nation GROUP BY 1",
    "lake_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 25",
    "lake_default_limit": "SELECT p_partkey, p_brand FROM part ORDER BY p_partkey LIMIT 100",
    "lake_paginate": "SELECT o_orderkey, o_custkey, page FROM (SELECT o_orderkey, o_custkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS page FROM orders)",
    "lake_like_filter": "SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part WHERE p_brand LIKE 'Brand#1%' AND p_size > 10",
    "jobs_active": f"{_JOBS} SELECT job_id, state, created_at FROM jobs WHERE state NOT IN ('completed', 'error', 'terminated')",
    "jobs_by_state": f"{_JOBS} SELECT job_id, state FROM jobs WHERE state = 'error'",
    "jobs_by_workspace": f"{_JOBS} SELECT job_id, workspace_id FROM jobs WHERE workspace_id = 7",
    "jobs_summary": f"{_JOBS} SELECT state, count(*) AS n FROM jobs GROUP BY ROLLUP (state)",
    "jobs_recent": f"{_JOBS} SELECT job_id, updated_at FROM jobs ORDER BY updated_at DESC, job_id LIMIT 20",
    "jobs_ttl": f"{_JOBS} SELECT job_id FROM jobs WHERE state IN ('completed', 'error') AND end_ts < TIMESTAMP '{_NOW}' - INTERVAL 400 DAY",
    "jobs_swept": f"{_JOBS} SELECT job_id FROM jobs WHERE NOT (state IN ('completed', 'error') AND end_ts < TIMESTAMP '{_NOW}' - INTERVAL 400 DAY)",
    "jobs_cleanup": f"{_JOBS} SELECT job_id, state FROM jobs WHERE state IN ('completed', 'error') AND updated_at < TIMESTAMP '{_NOW}' - INTERVAL 300 DAY",
    "jobs_claim": f"{_JOBS} SELECT job_id, state FROM jobs WHERE state = 'queued' ORDER BY submit_ts, job_id LIMIT 1",
    "pipelines_list": "SELECT o_orderkey AS pipeline_id, o_orderstatus AS status, o_orderpriority AS project, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM' AND o_orderdate >= '1996-06-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 40",
    "pipeline_advance": "SELECT o_orderkey AS pipeline_id, CAST(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 < 3 THEN o_orderkey % 4 + 1 ELSE o_orderkey % 4 END AS INTEGER) AS current_step, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 3 THEN 'completed' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'running' END AS status, o_orderstatus = 'F' AND o_orderkey % 4 < 3 AS submit_next FROM orders",
    "batch_accounting": "SELECT count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (event_type = 'error') AS n_failed, (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT DISTINCT 'user ' || (user_id % 5) AS e FROM events WHERE event_type = 'error')) AS errors FROM events",
}
