"""A catalog of stored objects: upserts, access log, first writers, roll-ups, freshness and integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _largest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of each key: the largest by all columns in order (maps as text)."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    order = F.struct(*[F.to_json(F.col(c)).alias(c) if "map<" in rows.schema[c].dataType.simpleString() else F.col(c) for c in rest])
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns])


def upsert(current: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """current with the rows of new put in by key; of columns in `keep` a present value stays. Of new rows of one key the largest counts."""
    old, fresh = current.alias("old"), _largest(new, keys).alias("new")
    joined = old.join(fresh, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys], "full")
    here = F.coalesce(*[F.col(f"new.{k}").isNotNull() for k in keys][:1])
    cells = []
    for c in current.columns:
        mine, theirs = F.col(f"old.{c}"), F.col(f"new.{c}")
        cells.append((F.coalesce(mine, theirs) if c in keep or c in keys else F.when(here, theirs).otherwise(mine)).alias(c))
    return joined.select(*cells)


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; the form of an upsert where rows are only ever appended."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return log.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def appended(log: DataFrame, row: DataFrame) -> DataFrame:
    return log.unionByName(row, allowMissingColumns=True)


def notebooks(log: DataFrame) -> DataFrame:
    """Activity per notebook: last time, writes, reads; the latest first."""
    table = log.where(F.col("notebook").isNotNull()).groupBy("notebook")
    return table.agg(F.max("timestamp").alias("last_seen"), F.count_if(F.col("op") == "write").alias("writes"), F.count_if(F.col("op") == "read").alias("reads")).orderBy(F.desc("last_seen"), "notebook")


def access_stats(log: DataFrame) -> DataFrame:
    """Per object: last write, last read and their numbers."""
    wrote, read = F.col("op") == "write", F.col("op") == "read"
    return log.groupBy("object_kind", "object_id").agg(
        F.max(F.when(wrote, F.col("timestamp"))).alias("last_write"), F.max(F.when(read, F.col("timestamp"))).alias("last_read"), F.count_if(wrote).alias("n_writes"), F.count_if(read).alias("n_reads")
    )


def first_writers(log: DataFrame) -> DataFrame:
    """The notebook that wrote each object first; equal times go to the smaller log id."""
    return log.where((F.col("op") == "write") & F.col("notebook").isNotNull()).groupBy("object_id").agg(F.min_by("notebook", F.struct("timestamp", "id")).alias("notebook"), F.min("timestamp").alias("first_write"))


def cached(objects: DataFrame, log: DataFrame, kind: str | None = None, notebook: str | None = None) -> DataFrame:
    """Stored objects, of one type and by one first writer if these are given."""
    out = objects.where(F.col("type") == kind) if kind is not None else objects
    if notebook is None:
        return out.orderBy("created_at", "id")
    mine = first_writers(log).where(F.col("notebook") == notebook).select(F.col("object_id").alias("id"))
    return out.join(mine, "id", "left_semi").orderBy("created_at", "id")


def inputs(objects: DataFrame) -> DataFrame:
    """(id, input) of the inputs that objects declare in their metadata."""
    return objects.select("id", F.explode(F.from_json("metadata_json", "struct<inputs:array<string>>")["inputs"]).alias("input"))


def stale(objects: DataFrame) -> DataFrame:
    """Per object whether a declared input is newer than it."""
    made = objects.select(F.col("id").alias("input"), F.col("created_at").alias("made"))
    newest = inputs(objects).join(made, "input").groupBy("id").agg(F.max("made").alias("newest"))
    return objects.join(newest, "id", "left").select("id", F.coalesce(F.col("newest") > F.col("created_at"), F.lit(False)).alias("stale"))


def rollup(objects: DataFrame, vectors: DataFrame, parents: DataFrame, log: DataFrame) -> DataFrame:
    """Objects and vectors with access statistics, parents and freshness."""
    stats = access_stats(log)
    own = objects.select("id", F.lit("cache").alias("kind"), "created_at").join(inputs(objects).groupBy("id").agg(F.array_sort(F.collect_list("input")).alias("parents")), "id", "left").join(stale(objects), "id")
    above = parents.groupBy(F.col("child_id").alias("id")).agg(F.array_sort(F.collect_list("parent_id")).alias("parents"))
    more = vectors.select("id", F.lit("vector").alias("kind"), "created_at").join(above, "id", "left").withColumn("stale", F.lit(False))
    both = own.unionByName(more)
    joined = both.join(stats, (both.id == stats.object_id) & (both.kind == stats.object_kind), "left")
    none = F.array().cast("array<string>")
    return joined.select("id", "kind", "created_at", F.coalesce("parents", none).alias("parents"), "stale", "last_write", "last_read", F.coalesce("n_writes", F.lit(0)).alias("n_writes"), F.coalesce("n_reads", F.lit(0)).alias("n_reads"))


def references(objects: DataFrame) -> DataFrame:
    """How many objects share each blob."""
    return objects.groupBy("content_hash").agg(F.count("*").alias("n_refs"))


def deleted(objects: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects without those of gone(id), hashes of blobs that nothing refers to any more)."""
    left = objects.join(gone.select("id"), "id", "left_anti")
    orphans = objects.join(gone.select("id"), "id", "left_semi").select("content_hash").distinct().join(left.select("content_hash"), "content_hash", "left_anti")
    return left, orphans


def registered(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """current and those of new whose key isn't taken; of new rows of one key the largest."""
    return current.unionByName(_largest(new, [key]).join(current.select(key), key, "left_anti"))


def changed_blobs(objects: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new(id, content_hash) whose content isn't stored yet; only these need a blob."""
    return new.join(objects.select("content_hash").distinct(), "content_hash", "left_anti")


def lineage(edges: DataFrame) -> DataFrame:
    """All (ancestor, descendant) pairs over edges(child_id, parent_id): only new pairs are extended, until there are none, so cycles end too."""
    from quillon.sources.sinks import stored

    step = edges.select(F.col("child_id").alias("via"), F.col("parent_id").alias("above")).distinct()
    known = fresh = stored(step.select(F.col("above").alias("ancestor"), F.col("via").alias("descendant")))
    while not fresh.isEmpty():
        longer = fresh.join(step, fresh.ancestor == step.via).select(F.col("above").alias("ancestor"), "descendant").distinct()
        fresh = stored(longer.join(known, ["ancestor", "descendant"], "left_anti"))
        known = known.union(fresh)
    return known


def dot(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a graph description: (line), nodes first; stale ones red, quotes escaped."""
    from quillon.functions.names import dot_escape

    quoted = lambda c: F.concat(F.lit('"'), dot_escape(F.col(c)), F.lit('"'))
    nodes = objects.select(F.lit(0).alias("part"), F.concat(quoted("id"), F.when(F.col("stale"), " [color=red]").otherwise(""), F.lit(";")).alias("line"))
    arrows = edges.select(F.lit(1).alias("part"), F.concat(quoted("parent_id"), F.lit(" -> "), quoted("child_id"), F.lit(";")).alias("line"))
    return nodes.union(arrows).orderBy("part", "line").select("line")


def missing(child: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """(rule, key) of children whose key isn't a parent's."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def integrity(rules: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """All violations of (rule, child, key, parent, parent key) rules."""
    out = None
    for rule, child, key, parent, parent_key in rules:
        one = missing(child, key, parent, parent_key, rule)
        out = one if out is None else out.unionByName(one)
    return out
