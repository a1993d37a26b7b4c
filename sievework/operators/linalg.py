"""Relational linear algebra over tensors: projections, penalties, norms, low-rank sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Cosine with squared norms clamped at eps."""
    return dot(a, b) / F.sqrt(F.greatest(dot(a, a), F.lit(eps)) * F.greatest(dot(b, b), F.lit(eps)))


def project_conflicts(grads: DataFrame, order: Sequence[str], eps: float = 1e-12) -> DataFrame:
    """(name, task, g, pairs, conflicts, cosine_sum) for grads(name, task, g array<double>).

    Within a tensor the tasks are taken in `order`; each is freed, one after the other, from its part against every other
    task's current gradient. The sequence is what defines the result, hence one group a tensor,
    whose size is the number of tasks.
    """
    rank = {t: i for i, t in enumerate(order)}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("task", key=lambda s: s.map(lambda t: (rank.get(t, len(rank)))), kind="stable")
        v = [np.asarray(x, dtype=np.float64) for x in g["g"]]
        pairs = conflicts = 0
        total = 0.0
        for i in range(len(v)):
            for j in range(len(v)):
                if i != j:
                    d = float(v[i] @ v[j])
                    ni, nj = max(float(v[i] @ v[i]), eps), max(float(v[j] @ v[j]), eps)
                    pairs, total = pairs + 1, total + d / np.sqrt(ni * nj)
                    if d < 0:
                        conflicts += 1
                        v[i] = v[i] - d / nj * v[j]
        return pd.DataFrame({"name": g["name"], "task": g["task"], "g": [x.tolist() for x in v], "pairs": pairs, "conflicts": conflicts, "cosine_sum": total})

    return grads.groupBy("name").applyInPandas(run, "name string, task string, g array<double>, pairs long, conflicts long, cosine_sum double")


def conflict_stats(projected: DataFrame) -> DataFrame:
    """One row: pairs, conflicts, conflict_rate, mean_cosine over all tensors (0 without pairs)."""
    one = projected.groupBy("name").agg(F.first("pairs").alias("p"), F.first("conflicts").alias("c"), F.first("cosine_sum").alias("s"))
    t = one.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("c"), F.lit(0)).alias("conflicts"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    div = lambda a: F.when(F.col("pairs") > 0, a / F.col("pairs")).otherwise(0.0)
    return t.select("pairs", "conflicts", div(F.col("conflicts")).alias("conflict_rate"), div(F.col("s")).alias("mean_cosine"))


def combined(projected: DataFrame, tasks: int, average: bool = True) -> DataFrame:
    """(name, g): element-wise sum of the tasks' gradients, over the number of all tasks if `average`."""
    e = projected.select("name", F.posexplode("g").alias("pos", "x")).groupBy("name", "pos").agg((F.sum("x") / (tasks if average else 1)).alias("x"))
    return e.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda z: z.x).alias("g"))


def squared_pull(now: DataFrame, then: DataFrame, weight: DataFrame) -> DataFrame:
    """One row: the mean over all elements of weight (now - then)^2; tensors that lack a side are left out."""
    j = now.select("name", F.col("g").alias("p")).join(then.select("name", F.col("g").alias("p0")), "name").join(weight.select("name", F.col("g").alias("w")), "name")
    d = F.zip_with("p", "p0", lambda a, b: (a - b) * (a - b))
    return j.agg((F.coalesce(F.sum(dot(d, F.col("w"))), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(F.size("p")), F.lit(0)), F.lit(1))).alias("penalty"))


def squared_mean(grads: DataFrame, scale: bool = False) -> DataFrame:
    """(name, pos, fisher): the mean square of every element over batches, over the global mean if `scale`."""
    f = grads.select("name", F.posexplode("g").alias("pos", "x")).groupBy("name", "pos").agg(F.avg(F.col("x").cast("double") * F.col("x")).alias("fisher"))
    if not scale:
        return f
    mean = f.agg(F.avg("fisher")).first()[0]
    return f.withColumn("fisher", F.col("fisher") / F.lit(max(mean or 0.0, 1e-12)))


def tied(slices: DataFrame, how: str = "mean") -> DataFrame:
    """(name, slice, g): every slice of a tensor replaced by the element-wise mean or sum over its slices."""
    agg = F.avg if how == "mean" else F.sum
    e = slices.select("name", F.posexplode("g").alias("pos", "x")).groupBy("name", "pos").agg(agg(F.col("x").cast("double")).alias("x"))
    t = e.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda z: z.x).alias("g"))
    return slices.select("name", "slice").join(t, "name")


def clipped(grads: DataFrame, most: float) -> DataFrame:
    """(name, g) scaled so that the norm over all tensors is at most `most`."""
    norm = (grads.agg(F.sum(dot(F.col("g"), F.col("g")))).first()[0] or 0.0) ** 0.5
    factor = min(1.0, most / (norm + 1e-6))
    return grads.withColumn("g", F.transform("g", lambda x: x.cast("double") * factor))


def low_rank_sum(a1: np.ndarray, b1: np.ndarray, s1: float, a2: np.ndarray, b2: np.ndarray, s2: float, rank: int, balanced: bool = True, pad: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Factors (A, B) of the best rank-`rank` approximation of s1 B1 A1 + s2 B2 A2, without forming the products.

    balanced: the singular values go to both factors by their square roots, else all to B. pad:
    zeros fill up to `rank`. With balanced factors negative scales count as 0.
    """
    if balanced:
        f1, f2 = np.sqrt(max(s1, 0.0)), np.sqrt(max(s2, 0.0))
        left, right = np.hstack([b1 * f1, b2 * f2]), np.vstack([a1 * f1, a2 * f2])
    else:
        left, right = np.hstack([b1 * s1, b2 * s2]), np.vstack([a1, a2])
    ql, rl = np.linalg.qr(left)
    qr, rr = np.linalg.qr(right.T)
    u, s, vt = np.linalg.svd(rl @ rr.T, full_matrices=False)
    k = min(rank, len(s))
    root = np.sqrt(s[:k]) if balanced else np.ones(k)
    b = ql @ (u[:, :k] * (root if balanced else s[:k]))
    a = (root[:, None] * vt[:k]) @ qr.T
    if pad and k < rank:
        a, b = np.vstack([a, np.zeros((rank - k, a.shape[1]))]), np.hstack([b, np.zeros((b.shape[0], rank - k))])
    return a, b


def merged(pairs: DataFrame, rank: int, balanced: bool = True) -> DataFrame:
    """(prefix, a, b) of low_rank_sum for pairs(prefix, a1, b1, s1, a2, b2, s2), matrices as array<array<double>>; one row a module in and out."""

    def run(batches):
        for p in batches:
            out = []
            for r in p.itertuples():
                m = lambda x: np.asarray([np.asarray(row, dtype=np.float64) for row in x])
                a, b = low_rank_sum(m(r.a1), m(r.b1), r.s1, m(r.a2), m(r.b2), r.s2, rank, balanced, balanced)
                out.append((r.prefix, a.tolist(), b.tolist()))
            yield pd.DataFrame(out, columns=["prefix", "a", "b"])

    return pairs.mapInPandas(run, "prefix string, a array<array<double>>, b array<array<double>>")
