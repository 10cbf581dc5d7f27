"""Queries on small tables of their own, where the driver's smallest ones lack a case."""

import duckdb

from quillon import plans


def compared(name, spark, folder, **tables):
    """Rows of a query and of its SQL twin over tables of (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = plans.queries()[name](spark, str(folder))
    cur = con.execute(plans.oracles()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(found.columns) == sorted(columns)
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
    return order(tuple(r) for r in found.select(*columns).collect()), order(cur.fetchall())


def test_annotation_columns_without_terms(spark, tmp_path):
    """A gene may lack an ontology, all of them, or have null terms only."""
    line = [(1, 7, "A"), (1, 8, "A"), (2, 9, "R"), (2, 9, "N"), (4, None, "A")]
    mine, theirs = compared("annotation_columns", spark, tmp_path, part=([(k, 5) for k in (1, 2, 3, 4)], "p_partkey long, p_size int"), lineitem=(line, "l_partkey long, l_suppkey long, l_returnflag string"))
    assert mine == theirs
    assert mine[0] == (1, 15, "T:7;T:8", None, None) and mine[2] == (3, 15, None, None, None)


def test_alias_match_score_lists_hits_without_shuffling_them(spark, tmp_path):
    """Scores are summed up for classes of parts, so no aggregate is left over the hits themselves."""
    part = [(k, f"n{k % 3}", f"b{k % 2}", "t", k % 5, 1.0) for k in range(200)]
    mine, theirs = compared("alias_match_score", spark, tmp_path, part=(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"))
    assert mine and mine == theirs
    plan = plans.queries()["alias_match_score"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
