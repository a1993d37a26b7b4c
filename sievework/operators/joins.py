"""Lookups, memberships and pairings. Join strategies are left to the optimizer unless a side has a known bound."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def looked_up(df: DataFrame, table: DataFrame, key: str, values: Sequence[str], default: str = "") -> DataFrame:
    """Left join on key; missing string values become `default`. `table` has one row a key."""
    return df.join(table.select(key, *values), key, "left").na.fill(default, list(values))


def by_priority(df: DataFrame, key: str, tables: Sequence[DataFrame], value: str) -> DataFrame:
    """The value of the first table that has the key; rows unknown to all are dropped."""
    out, cols = df, []
    for i, t in enumerate(tables):
        out = out.join(t.select(key, F.col(value).alias(f"_v{i}")), key, "left")
        cols.append(F.col(f"_v{i}"))
    return out.withColumn(value, F.coalesce(*cols)).where(F.col(value).isNotNull()).drop(*[f"_v{i}" for i in range(len(tables))])


def flagged(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """Adds whether the key is among ids(key)."""
    return df.join(ids.select(key).distinct().withColumn(flag, F.lit(True)), key, "left").na.fill(False, [flag])


def unused(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return df.join(used.select(key).distinct(), key, "left_anti")


def forced(df: DataFrame, ids: DataFrame, key: str, times: int) -> DataFrame:
    """The rows of the given ids, each `times` times with repeat_index."""
    from sievework.operators.order import repeated

    return repeated(df.join(ids.select(key).distinct(), key, "left_semi"), times, 1)


def zipped(a: DataFrame, b: DataFrame, idx: str = "idx") -> DataFrame:
    """Rows paired by their explicit position."""
    return a.join(b, idx)


def tensor_pairs(tensors: DataFrame, name: str = "name") -> DataFrame:
    """(prefix, a, b) of the low-rank factor tensors `<prefix>.lora_A.weight` and `<prefix>.lora_B.weight`; an orphan has a null partner."""
    t = tensors.where(F.col(name).rlike(r"[.]lora_[AB][.]weight$"))
    part = lambda x: t.where(F.col(name).contains(f".lora_{x}.")).select(F.regexp_replace(name, r"[.]lora_[AB][.]weight$", "").alias("prefix"), F.col(name).alias(x.lower()))
    return part("A").join(part("B"), "prefix", "full_outer")


def scale_of(keys: DataFrame, scales: Sequence[tuple[str, float]], default: float, key: str = "name") -> DataFrame:
    """The scale of the longest listed name that the key contains (the first listed of equal length), else the default.

    The list is a caller's setting of a few names, folded into the expression: no join, no shuffle.
    """
    scale, matched = F.lit(float(default)), F.lit("__default__")
    for n, v in sorted(enumerate(scales), key=lambda x: (len(x[1][0]), -x[0])):
        del n
        hit = F.col(key).contains(v[0])
        scale, matched = F.when(hit, float(v[1])).otherwise(scale), F.when(hit, v[0]).otherwise(matched)
    return keys.withColumns({"scale": scale, "matched": matched})


def renamed_match(keys: DataFrame, model: DataFrame, rewrites: Sequence[tuple[str, str]], key: str = "name") -> DataFrame:
    """(key, target, priority): each key matched to the model's names, as it is or by the first rewrite that hits; target null if none does."""
    tries = F.array(F.struct(F.lit(0).alias("priority"), F.col(key).alias("target")), *[F.struct(F.lit(i + 1).alias("priority"), F.replace(F.col(key), F.lit(a), F.lit(b)).alias("target")) for i, (a, b) in enumerate(rewrites)])
    c = keys.select(key, F.explode(tries).alias("t")).select(key, "t.*")
    hit = c.join(model.select(F.col(key).alias("target")).distinct(), "target").groupBy(key).agg(F.min_by(F.struct("target", "priority"), "priority").alias("h"))
    return keys.select(key).join(hit, key, "left").select(key, "h.target", "h.priority")


def two_runs(before: DataFrame, after: DataFrame, key: str, outcome: str, output: str) -> DataFrame:
    """One row: fixed, regressed, changed output, only in one run."""
    a = before.select(key, F.col(outcome).alias("o1"), F.col(output).alias("p1"))
    b = after.select(key, F.col(outcome).alias("o2"), F.col(output).alias("p2"))
    j = a.join(b, key, "full_outer")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return j.agg(
        n((F.col("o1") == 0) & (F.col("o2") == 1)).alias("fixed"),
        n((F.col("o1") == 1) & (F.col("o2") == 0)).alias("regressed"),
        n(F.col("p1").isNotNull() & F.col("p2").isNotNull() & (F.col("p1") != F.col("p2"))).alias("changed"),
        n(F.col("p1").isNull() | F.col("p2").isNull()).alias("one_sided"),
    )


def prompt_overlap(train: DataFrame, held: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Rows of train whose prompt, with white space folded, is a held-out prompt."""
    h = lambda: F.sha2(F.regexp_replace(F.lower(F.trim(prompt)), r"\s+", " "), 256)
    return train.withColumn("_h", h()).join(held.select(h().alias("_h")).distinct(), "_h", "left_semi").drop("_h")


def grid(df: DataFrame, values: Sequence[float], name: str) -> DataFrame:
    """Every row with every value of a short list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def task_of(field: Column, mapped: Column, default: str | None, row: Column) -> Column:
    """The non-empty field, else the mapped task, else the default, else an error naming the row."""
    return F.coalesce(F.nullif(field, F.lit("")), mapped, F.nullif(F.lit(default), F.lit("")), F.raise_error(F.concat(F.lit("no task for "), row)))


def indexed_first(index: DataFrame, files: DataFrame, key: str, pos: Sequence[str]) -> DataFrame:
    """Files in the order of the index, then the others by name; `place` orders them."""
    from sievework.operators.order import numbered

    order = index.groupBy(key).agg(F.min(F.struct(*pos)).alias("_p"))
    j = files.join(order, key, "left")
    return numbered(j, [F.col("_p").isNull(), "_p", key], "place").drop("_p")


def mapping(m: Mapping[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
