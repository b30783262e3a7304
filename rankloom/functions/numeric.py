"""Arithmetic helpers. All return Catalyst columns, so they stay inside codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rnd(value: Column, digits: int) -> Column:
    """Half-even rounding of a double, done on the scaled binary value."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def stable_sum(value: Column, digits: int) -> Column:
    """Sum of values of ``digits`` decimals, added as whole numbers.

    Whole doubles add exactly, so the result does not depend on the order in
    which partial sums of different tasks are merged.
    """
    scale = F.lit(float(10**digits))
    return F.sum(F.rint(value * scale)) / scale


def stable_mean(value: Column, digits: int) -> Column:
    scale = F.lit(float(10**digits))
    return F.sum(F.rint(value * scale)) / (F.count(value) * scale)


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; null stays null."""
    return F.when(value < low, F.lit(float(low))).when(value > high, F.lit(float(high))).otherwise(value)


def num(name: str, default: float = 0.0) -> Column:
    """A feature as double where an absent value counts as ``default``."""
    return F.coalesce(F.col(name).cast("double"), F.lit(float(default)))


def weighted(weights: Mapping[str, float]) -> Column:
    """Sum of feature * weight in the given order; absent features count as 0."""
    return reduce(lambda a, b: a + b, (num(name) * F.lit(float(w)) for name, w in weights.items()))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def ratio(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """Division that yields ``default`` where the denominator is 0 or null."""
    quotient = F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))
    return quotient if default is None else F.coalesce(quotient, F.lit(float(default)))


def present_mean(names: Sequence[str]) -> Column:
    """Mean over the columns that are present (non-null); null when none is."""
    total = reduce(lambda a, b: a + b, (num(name) for name in names))
    count = reduce(lambda a, b: a + b, (F.col(name).isNotNull().cast("int") for name in names))
    return F.when(count > 0, total / count.cast("double"))


def tie_percentile(below: Column, equal: Column, total: Column) -> Column:
    """(below + half of the equal ones) / total, 0 without any."""
    return ratio(below.cast("double") + F.lit(0.5) * equal.cast("double"), total)


def value_histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with their counts, running counts and group size.

    Counting happens before the shuffle, so a hot group costs one row per
    distinct value and map task. The window then sees only distinct values;
    callers pass values rounded to a fixed number of digits, which bounds them
    (4 digits in 0..100 or 6 digits in 0..1 are at most about a million).
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_equal"))
    ordered = Window.partitionBy(*keys).orderBy(value)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    return counts.select(
        *keys,
        value,
        "n_equal",
        (F.sum("n_equal").over(running) - F.col("n_equal")).alias("n_below"),
        F.sum("n_equal").over(whole).alias("n_total"),
    )


def index_percentile(hist: DataFrame, keys: Sequence[str], value: str, position: Column) -> Column:
    """Value at a 0-based sorted position, as an aggregate over a value histogram."""
    return F.min(F.when(F.col("n_below") + F.col("n_equal") > position, F.col(value)))


def nearest_position(total: Column, quantile: float) -> Column:
    """Index of the nearest-rank percentile with half-even rounding."""
    return F.rint((total - 1).cast("double") * F.lit(float(quantile))).cast("bigint")


def floor_position(total: Column, quantile: float) -> Column:
    """Index of the floor-rank percentile, kept inside the list."""
    return F.least(total - 1, F.floor(total.cast("double") * F.lit(float(quantile))))


def first_by_hash(df: DataFrame, groups: Sequence[str], hash_col: str, wanted: Column) -> DataFrame:
    """Mark the ``wanted`` rows with the smallest hash in each group, exactly.

    A plain row_number would sort a whole group in one task. Here the groups
    are cut by the first four hex digits of the hash: a histogram of at most
    65,536 buckets per group finds the bucket the cut falls in, and only that
    bucket is ranked. ``wanted`` may use the group columns and ``n_total``.
    """
    bucketed = df.withColumn("_bucket", F.substring(hash_col, 1, 4))
    counts = bucketed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(ordered), F.lit(0)))
        .withColumn("n_total", F.sum("_n").over(Window.partitionBy(*groups)))
        .withColumn("_wanted", wanted.cast("bigint"))
        .select(*groups, "_bucket", "_n", "_before", "_wanted", "n_total")
    )
    joined = bucketed.join(bounds, [*groups, "_bucket"])
    inside = joined.filter((F.col("_before") < F.col("_wanted")) & (F.col("_before") + F.col("_n") > F.col("_wanted")))
    rest = joined.filter(~((F.col("_before") < F.col("_wanted")) & (F.col("_before") + F.col("_n") > F.col("_wanted"))))
    position = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(hash_col))
    chosen_inside = inside.withColumn("chosen", position + F.col("_before") <= F.col("_wanted"))
    chosen_rest = rest.withColumn("chosen", F.col("_before") < F.col("_wanted"))
    return chosen_inside.unionByName(chosen_rest).drop("_bucket", "_n", "_before", "_wanted")


def numbered_by_hash(df: DataFrame, groups: Sequence[str], hash_col: str, name: str) -> DataFrame:
    """0-based position by hash order inside each group, without sorting a whole group in one task.

    Bucket counts (at most 65,536 per group) give each bucket its offset;
    rows are then numbered inside (group, bucket).
    """
    bucketed = df.withColumn("_bucket", F.substring(hash_col, 1, 4))
    counts = bucketed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(hash_col))
    return (
        bucketed.join(offsets, [*groups, "_bucket"])
        .withColumn(name, inside + F.col("_before") - 1)
        .drop("_bucket", "_before")
    )
