"""Classification of flux results, growth calls, and report differences; solver output comes in as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import chemistry


def differing(ranges: DataFrame, threshold: float = 1e-6) -> DataFrame:
    """Reactions whose largest and least flux differ by more than the threshold."""
    return ranges.where(F.abs(F.col("maximum") - F.col("minimum")) > threshold)


def classified(ranges: DataFrame, tol: float = 1e-6) -> DataFrame:
    return ranges.withColumn("class", chemistry.flux_class(F.col("minimum"), F.col("maximum"), tol))


def partitioned(ranges: DataFrame, low: float = -1e-9, high: float = 1e-9) -> DataFrame:
    """dead, forward_only, reverse_only or reversible; essential if 0 isn't possible."""
    up, down = F.col("maximum") > high, F.col("minimum") < low
    kind = F.when(up & down, "reversible").when(up, "forward_only").when(down, "reverse_only").otherwise("dead")
    return ranges.withColumn("partition", kind).withColumn("essential", (F.col("minimum") > high) | (F.col("maximum") < low))


def growth(simulated: DataFrame, observed: DataFrame, growth_at: float = 0.01, observed_at: float = 1e-6) -> DataFrame:
    """CP, CN, FP, FN per medium, or P, N where nothing was observed; no flux is no growth."""
    joined = simulated.join(observed, "media_id", "left")
    grows = F.coalesce(~F.isnan("simulated_flux") & (F.col("simulated_flux") > growth_at), F.lit(False))
    seen = F.col("observed_value") > observed_at
    kind = F.when(F.col("observed_value").isNull(), F.when(grows, "P").otherwise("N")).when(grows & seen, "CP").when(~grows & ~seen, "CN").when(grows, "FP").otherwise("FN")
    return joined.withColumn("class", kind)


def confusion(classes: DataFrame) -> DataFrame:
    """Counts per class, and the share of right calls among the observed ones."""
    counts = [F.count_if(F.col("class") == c).alias(c) for c in ("CP", "CN", "FP", "FN", "P", "N")]
    right, scored = F.count_if(F.col("class").isin("CP", "CN")), F.count_if(F.col("class").isin("CP", "CN", "FP", "FN"))
    return classes.agg(*counts, F.when(scored > 0, right / F.nullif(scored, F.lit(0))).alias("accuracy"))


def knockouts(table: DataFrame) -> DataFrame:
    """Impact of knock-outs by objective ratio: essential below 0.01, reduced below 0.95; a failed solve counts as 0."""
    ratio = F.when(F.col("status") == "optimal", F.col("ko_objective_value") / F.nullif(F.col("objective_value"), F.lit(0.0))).otherwise(0.0)
    return table.withColumn("objective_ratio", ratio).withColumn("impact", F.when(ratio < 0.01, "essential").when(ratio < 0.95, "reduced").otherwise("dispensable"))


def closed_mode(ranges: DataFrame, tol: float = 1e-7) -> DataFrame:
    """Reactions that carry flux though all exchanges are closed."""
    return ranges.where((F.abs("minimum") > tol) | (F.abs("maximum") > tol))


def largest(fluxes: DataFrame, n: int) -> DataFrame:
    return fluxes.orderBy(F.desc(F.abs("flux")), "reaction_id").limit(n)


def signed_ids(fluxes: DataFrame) -> DataFrame:
    """Negative fluxes as positive ones of <id>-rev."""
    back = F.col("flux") < 0
    return fluxes.select(F.when(back, F.concat("reaction_id", F.lit("-rev"))).otherwise(F.col("reaction_id")).alias("reaction_id"), F.abs("flux").alias("flux"))


def loops(members: DataFrame) -> DataFrame:
    """Distinct loops of members(loop_id, reaction_id, direction), whatever their order."""
    keyed = members.groupBy("loop_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("reaction_id", "direction"))), ",").alias("members"))
    return keyed.groupBy("members").agg(F.min("loop_id").alias("loop_id")).select("loop_id", "members")


def media_union(growing: DataFrame) -> DataFrame:
    """Per element all media on which something grows."""
    return growing.where("grows").groupBy("element").agg(F.array_join(F.array_sort(F.collect_set("media_id")), ",").alias("media"))


def report_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(category, change, members): what each category has gained and lost, sorted."""
    keys = ["category", "member"]
    side = lambda x, y, name: x.select(*keys).distinct().join(y.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit(name))
    both = side(after, before, "added").unionByName(side(before, after, "removed"))
    return both.groupBy("category", "change").agg(F.array_join(F.array_sort(F.collect_list("member")), ",").alias("members"), F.count("*").alias("n"))


def shared(members: DataFrame, group: str, member: str, of: int) -> DataFrame:
    """Members that all `of` groups have."""
    return members.groupBy(member).agg(F.countDistinct(group).alias("n")).where(F.col("n") == of).select(member)


def distinctive(members: DataFrame, group: str, member: str, common: DataFrame) -> DataFrame:
    """Each group's smallest member that isn't common to all."""
    return members.join(common, member, "left_anti").groupBy(group).agg(F.min(member).alias(member))


def evaluation(rows: DataFrame) -> DataFrame:
    """Number and sorted list of members per category."""
    return rows.groupBy("category").agg(F.countDistinct("member").alias("n"), F.array_join(F.array_sort(F.collect_set("member")), ",").alias("members"))


def overlap(map_ids: DataFrame, model_ids: DataFrame) -> DataFrame:
    """Shared ids of a map and a model and the share of each that they cover, 0 for an empty side."""
    joined = map_ids.select("id").distinct().withColumn("a", F.lit(1)).join(model_ids.select("id").distinct().withColumn("b", F.lit(1)), "id", "full")
    n_a, n_b, both = F.count("a"), F.count("b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    share = lambda n: F.coalesce(both / F.nullif(n, F.lit(0)), F.lit(0.0))
    return joined.agg(n_a.alias("n_map"), n_b.alias("n_model"), both.alias("n_shared"), share(n_a).alias("map_share"), share(n_b).alias("model_share"))


def cumulative(reports: DataFrame, order: str) -> DataFrame:
    """Differences between each report and the one before it: reports(order, category, member)."""
    steps = reports.select(order).distinct().withColumn("_next", F.lead(order).over(Window.orderBy(order)))  # one row per perturbation
    after = reports.join(steps.select(F.col("_next").alias(order), F.col(order).alias("_from")), order)
    before = reports.join(steps, order).where("_next is not null").select(F.col("_next").alias(order), "category", "member")
    keys = [order, "category", "member"]
    gained = after.select(*keys).join(before, keys, "left_anti").withColumn("change", F.lit("added"))
    lost = before.join(after.select(*keys), keys, "left_anti").withColumn("change", F.lit("removed"))
    return gained.unionByName(lost)


def accreted(frames: Sequence[DataFrame]) -> DataFrame:
    """One-row reports put together; columns that some lack are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
