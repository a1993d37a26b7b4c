"""Summaries: accuracies, counts, quantiles, weighted means, groups of rollouts, objectives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(df: DataFrame, outcome: str, by: Sequence[str]) -> DataFrame:
    """Examples and accuracy of every group of `by` and overall (nulls in `by`, level 0). Null outcomes count as 0."""
    ok = F.coalesce(outcome, F.lit(0))
    sets = [list(by), []]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(F.count(F.lit(1)).alias("examples"), (F.sum(ok) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("accuracy"), F.grouping_id(*by).alias("level"))


def slices(df: DataFrame, outcome: str, by: Sequence[str]) -> DataFrame:
    """Examples and accuracy of every combination of the slices (cube)."""
    return df.cube(*by).agg(F.count(F.lit(1)).alias("examples"), F.avg(F.coalesce(outcome, F.lit(0)).cast("double")).alias("accuracy"), F.grouping_id(*by).alias("level"))


def counts(df: DataFrame, key: str, missing: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(key, F.lit(missing)).alias(key)).agg(F.count(F.lit(1)).alias("n"))


def nested_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """outer, and the counts of inner as a sorted list of (value, n)."""
    n = df.groupBy(outer, F.coalesce(inner, F.lit("unknown")).alias(inner)).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(outer).agg(F.array_sort(F.collect_list(F.struct(inner, "n"))).alias("counts"))


def floor_quantiles(df: DataFrame, value: str, group: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """count, sum, max and the values of rank floor(n * p) + 1 (at most n) per group.

    Equal values are counted before they are ranked, so the window holds distinct values only.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    t = c.withColumns({"_upto": F.sum("_n").over(w), "_all": F.sum("_n").over(Window.partitionBy(*(group or [F.lit(0)])))})
    at = lambda p: F.min(F.when(F.col("_upto") >= F.least(F.col("_all"), F.floor(F.col("_all") * p) + 1), F.col(value)))
    return t.groupBy(*group).agg(F.sum("_n").alias("n"), F.sum(F.col(value) * F.col("_n")).alias("total"), F.max(value).alias("largest"), *[at(p).alias(f"p{round(p * 100)}") for p in shares])


def most_common(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Counts, most frequent first; ties by first appearance."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_pos")).orderBy(F.desc("n"), "first_pos")


def weighted_mean(value: Column, weight: Column, floor: float = 1.0) -> Column:
    """Sum of value x weight over the sum of weights, which counts as `floor` at least; NaN and null values carry no weight."""
    ok = value.isNotNull() & ~F.isnan(value) & weight.isNotNull()
    return F.coalesce(F.sum(F.when(ok, value * weight)), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(F.when(ok, weight)), F.lit(0.0)), F.lit(floor))


def row_loss(losses: Column, weights: Column) -> Column:
    """A row's weighted mean of token losses, weights summing to 1 at least."""
    dot = F.aggregate(F.zip_with(losses, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return dot / F.greatest(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x), F.lit(1.0))


def advantages(df: DataFrame, group: Sequence[str], reward: str, least_std: float = 1e-6) -> DataFrame:
    """(reward - mean) / population deviation within each group; 0 where the deviation is below `least_std`.

    Group statistics are pre-aggregated and joined, not windowed, so a large group is no single task.
    """
    s = df.groupBy(*group).agg(F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_s"))
    return df.join(s, list(group)).withColumn("advantage", F.when(F.col("_s") < least_std, 0.0).otherwise((F.col(reward) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def rollout_stats(df: DataFrame, group: Sequence[str], reward: str, exact: str) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("rollouts"), F.avg(reward).alias("mean_reward"), F.max(reward).alias("best_reward"), F.sum(exact).cast("bigint").alias("exact"))


def softplus(x: Column) -> Column:
    """-log(sigmoid(-x)), stable for large |x|."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def margin_loss(chosen: Column, rejected: Column, beta: float, gamma: float) -> Column:
    """Reference-free preference loss: -log sigmoid(beta (chosen - rejected) - gamma)."""
    return softplus(-(beta * (chosen - rejected) - gamma))


def reference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float) -> Column:
    """Preference loss of the margin over a reference model's margin."""
    return softplus(-beta * ((chosen - rejected) - (ref_chosen - ref_rejected)))


def linear_decay(rate: float, step: Column, steps: int) -> Column:
    return rate * (1 - step / F.lit(float(steps)))


def product(shape: Column) -> Column:
    """Number of parameters of a shape; 1 for a scalar."""
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda s, x: s * x)


def adapter_rank(rank: Column, pattern: Column) -> Column:
    """The largest of the rank and its per-module overrides, 0 if there is none."""
    return F.coalesce(F.array_max(F.concat(F.array(rank), F.coalesce(F.map_values(pattern), F.array().cast("array<int>")))), F.lit(0))
