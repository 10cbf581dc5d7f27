"""Expressions over formulas, charges and directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammar of element counts in search, and in statistics.
SEARCH_GRAMMAR = "([A-Z][a-z]*)([0-9]*)"
STATS_GRAMMAR = "([A-Z][a-z]?)([0-9]*)"


def elements(formula: Column, grammar: str = SEARCH_GRAMMAR) -> Column:
    """Array of (element, count), one for each occurrence."""
    names, counts = F.regexp_extract_all(formula, F.lit(grammar), 1), F.regexp_extract_all(formula, F.lit(grammar), 2)
    return F.zip_with(names, counts, lambda e, n: F.struct(e.alias("element"), F.coalesce(n.try_cast("int"), F.lit(1)).alias("count")))


def element_map(formula: Column, grammar: str = SEARCH_GRAMMAR) -> Column:
    """Map of element to its total count; repeated elements add."""
    found = elements(formula, grammar)
    names = F.array_distinct(F.transform(found, lambda x: x["element"]))
    total = lambda e: F.aggregate(found, F.lit(0), lambda acc, x: acc + F.when(x["element"] == e, x["count"]).otherwise(0))
    return F.map_from_arrays(names, F.transform(names, total))


def direction(lower: Column, upper: Column, tol: float = 1e-9) -> Column:
    """reversible, forward, reverse or blocked; bounds within tol of 0 count as 0."""
    low, high = F.when(F.abs(lower) < tol, 0.0).otherwise(lower), F.when(F.abs(upper) < tol, 0.0).otherwise(upper)
    return F.when((low < 0) & (high > 0), "reversible").when(high > 0, "forward").when(low < 0, "reverse").otherwise("blocked")


def combined_directions(*signals: Column) -> Column:
    """Direction signals as symbols joined by a bar, ? for unknown ones."""
    #: The symbols.
    symbols = F.create_map(*map(F.lit, ("reversible", "=", "forward", ">", "reverse", "<", "blocked", "0")))
    return F.concat_ws("|", *[F.coalesce(F.try_element_at(symbols, s), F.lit("?")) for s in signals])


def proton_repair(charge: Column, hydrogen: Column, others: Column) -> Column:
    """(fixable, protons): whether adding protons balances a reaction of which charge and hydrogen are off alike and nothing else."""
    fixable = (others == 0) & (charge == hydrogen) & (charge != 0)
    return F.struct(fixable.alias("fixable"), F.when(fixable, -hydrogen).otherwise(0.0).alias("protons"))


def known_energy(value: Column) -> Column:
    """A formation energy as a number, the marker for unknown ones (10,000,000 of either sign, and beyond) as null."""
    number = value.try_cast("double")
    return F.when(F.abs(number) < 10_000_000, number)


def log_ratio(numerator: Column, denominator: Column, base: float | None = 2) -> Column:
    """Ratio, or its logarithm; NaN where it is undefined, infinite over 0."""
    nan, ratio = F.lit(float("nan")), numerator / F.when(denominator != 0, denominator)
    raw = F.when(numerator.isNull() | denominator.isNull(), None).when(denominator != 0, ratio).when(numerator > 0, float("inf")).when(numerator < 0, float("-inf")).otherwise(nan)
    if not base:
        return raw
    return F.when(raw.isNull(), None).when(F.isnan(raw) | (raw <= 0), nan).when(raw == float("inf"), raw).otherwise(F.log(raw) / F.log(F.lit(float(base))))


def flux_class(low: Column, high: Column, tol: float = 1e-6) -> Column:
    """blocked, fixed_nonzero or variable, by the least and the largest flux."""
    return F.when((F.abs(low) <= tol) & (F.abs(high) <= tol), "blocked").when(F.abs(high - low) <= tol, "fixed_nonzero").otherwise("variable")


def fold_colour(value: Column, scale: float = 4.0) -> Column:
    """Hex colour from blue over white to red, by the logarithm of a fold change clamped to 1/scale..scale."""
    import math

    x = F.log(F.greatest(F.least(value, F.lit(scale)), F.lit(1 / scale))) / math.log(scale)
    fade = F.lpad(F.hex(F.round(255 * (1 - F.abs(x))).cast("long")), 2, "0")
    return F.when(value.isNull() | (value <= 0), "#CCCCCC").when(x >= 0, F.concat(F.lit("#FF"), fade, fade)).otherwise(F.concat(F.lit("#"), fade, fade, F.lit("FF")))


def band(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.7, "medium").otherwise("low")


def is_water(base: Column, formula: Column, charge: Column) -> Column:
    return F.coalesce(base.isin("h2o", "cpd00001"), F.lit(False)) | F.coalesce((formula == "H2O") & (charge == 0), F.lit(False))


def is_proton(base: Column, formula: Column, charge: Column) -> Column:
    return F.coalesce(base.isin("h", "cpd00067"), F.lit(False)) | F.coalesce((formula == "H") & (charge == 1), F.lit(False))
