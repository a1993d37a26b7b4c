"""Order, ranks, samples, batches and repeats. Seeded draws order by a hash, so they need no global shuffle state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.runtime import settle


def draw_key(seed: int, *cols: str) -> Column:
    """The order key of a seeded draw: an md5 of seed and key columns, the same on any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def last_wins(df: DataFrame, key: str, pos: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """One row a key, the last by `pos`, with `first_pos` of its first row; null and blank keys are dropped."""
    keep = list(keep or df.columns)
    order = F.struct(*pos)
    some = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    got = some.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*keep), order).alias("_r"), F.min(order).alias("first_pos"))
    return got.select("_r.*", "first_pos")


def first_wins(df: DataFrame, key: str, pos: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """One row a key, the first by `pos`; null and blank keys are dropped."""
    keep = list(keep or df.columns)
    some = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return some.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*keep), F.struct(*pos)).alias("_r")).select("_r.*")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int, spread: int = 32) -> DataFrame:
    """The first n rows of each group.

    Ranks are taken twice: within `spread` parts of a group, which leaves at most n x spread rows
    of it, then over those. So a group of any size is ranked by many tasks.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if dict(df.dtypes)[c] in ("string", "bigint", "int", "double", "timestamp_ntz", "timestamp")]), F.lit(spread))
    part = Window.partitionBy(*group, "_salt").orderBy(*order)
    few = df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n)
    return few.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= n).withColumnRenamed("_rn", "rn").drop("_salt")


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """At most n rows of each group, those of lowest seeded hash."""
    return top_per_group(df.withColumn("_draw", draw_key(seed, key)), [group], ["_draw", key], n).drop("_draw", "rn")


def draw(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """min(n, rows) rows without replacement; n <= 0 gives none. Sort and limit run as a distributed top-n."""
    return df.withColumn("_draw", draw_key(seed, key)).orderBy("_draw", key).limit(max(0, n)).drop("_draw")


def draw_or_all(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A limit option: n rows by seeded draw, or all of them where n is 0 or less or not below the number of rows."""
    return draw(df, key, n, seed) if n > 0 else df


def numbered(df: DataFrame, order: Sequence[Column | str], out: str = "rn") -> DataFrame:
    """Row numbers from 1 over the whole table without a one-task window: rows are range-partitioned and
    written once, the partitions' sizes (one row a partition) are summed up, and each partition is numbered from there."""
    return running(df, order, F.lit(1), out)


def running(df: DataFrame, order: Sequence[Column | str], amount: Column, out: str) -> DataFrame:
    """Inclusive running sum of `amount` over the whole table in `order` (which must be total). Null amounts count as 0."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = settle(df.withColumn("_amt", F.coalesce(amount, F.lit(0))).repartitionByRange(n, *cols).withColumn("_pid", F.spark_partition_id()), "range")
    sums = parts.groupBy("_pid").agg(F.sum("_amt").alias("_sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_pid", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_pid").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(F.broadcast(base), "_pid").withColumn(out, F.col("_base") + F.sum("_amt").over(w)).drop("_pid", "_amt", "_base")


def draw_with_overflow(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows: without replacement while there are enough, else all and the rest drawn again; `draw_no` numbers them.
    No input rows or n <= 0 give none."""
    size = df.count()
    if not size or n <= 0:
        return df.withColumn("draw_no", F.lit(0).cast("bigint")).limit(0)
    ranked = numbered(df.withColumn("_draw", draw_key(seed, key)), ["_draw", key], "draw_no").drop("_draw")
    first = ranked.where(F.col("draw_no") <= n)
    if n <= size:
        return first
    again = df.sparkSession.range(size + 1, n + 1).select(F.col("id").alias("_no"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(size)) + 1).alias("_at"))
    return first.unionByName(ranked.join(again, F.col("draw_no") == F.col("_at")).withColumn("draw_no", F.col("_no")).drop("_no", "_at"))


def stratified(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows in equal parts per group, the remainder to the first groups in sorted order. A group smaller than its part gives all it has."""
    groups = df.select(F.coalesce(group, F.lit("unknown")).alias(group)).distinct()
    k = groups.count()
    if not k or n <= 0:
        return df.limit(0)
    quota = groups.withColumn("_q", F.floor(F.lit(n / k)) + (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(group)) <= n % k).cast("int"))
    ranked = top_per_group(df.withColumn(group, F.coalesce(group, F.lit("unknown"))).withColumn("_draw", draw_key(seed, key)), [group], ["_draw", key], -(-n // k))
    return ranked.join(quota, group).where(F.col("rn") <= F.col("_q")).drop("_draw", "_q", "rn")


def draw_forced(df: DataFrame, key: str, n: int, seed: int, forced: DataFrame) -> DataFrame:
    """n rows, the ids of forced(id, pos) first in their order, the rest by seeded hash."""
    f = forced.select(F.col("id").alias("_id"), F.col("pos").alias("_pos"))
    marked = df.join(f, df[key] == F.col("_id"), "left").withColumn("_draw", draw_key(seed, key))
    return marked.orderBy(F.col("_pos").isNull(), "_pos", "_draw", key).limit(max(0, n)).drop("_id", "_pos", "_draw")


def repeated(df: DataFrame, times: int | Column, least: int = 0) -> DataFrame:
    """Each row `times` times with repeat_index from 0; fewer than one repeat drops the row (or keeps `least`)."""
    k = F.greatest(F.lit(least), F.lit(times) if isinstance(times, int) else times)
    return df.withColumn("repeat_index", F.explode(F.filter(F.sequence(F.lit(-1), k - 1), lambda i: i >= 0)))


def batched(df: DataFrame, order: Sequence[str], size: int, drop_last: bool = False) -> DataFrame:
    """Adds batch_id and batch_pos of consecutive batches; a last partial batch is kept or dropped
    (never if it is the only one)."""
    out = numbered(df, order).withColumns({"batch_id": F.floor((F.col("rn") - 1) / size), "batch_pos": (F.col("rn") - 1) % size})
    if drop_last:
        full = max(1, df.count() // size)
        out = out.where(F.col("batch_id") < full)
    return out.drop("rn")


def cyclic(df: DataFrame, group: str, order: Sequence[str], size: int, batches: int) -> DataFrame:
    """For each group `batches` batches of `size` rows, taken round and round in order (no reshuffle)."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = df.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
    slots = n.select(group, "_n", F.explode(F.sequence(F.lit(0), F.lit(size * batches - 1))).alias("slot")).withColumn("_at", F.pmod("slot", "_n").cast("int"))
    return slots.join(ranked, [group, "_at"]).withColumn("batch_id", F.floor(F.col("slot") / size)).drop("_n", "_at")


def active_groups(groups: Sequence[str], k: int, steps: DataFrame) -> DataFrame:
    """steps(step) with the k groups that are active at each: a window over the sorted names that moves on by one."""
    names = sorted(groups)
    take = len(names) if k <= 0 or k >= len(names) else k
    at = F.transform(F.sequence(F.lit(0), F.lit(take - 1)), lambda i: F.get(F.array(*map(F.lit, names)), F.pmod(F.col("step") + i, F.lit(len(names))).cast("int")))
    return steps.withColumn("active", F.array(*map(F.lit, names)) if take == len(names) else at)


def padded_batches(df: DataFrame, batch: str, arrays: Mapping[str, int | float], multiple: int = 1) -> DataFrame:
    """Every array filled up to its batch's longest, rounded up to a multiple."""
    from sievework.functions.tokens import padded

    longest = F.max(F.size(next(iter(arrays)))).over(Window.partitionBy(batch))
    return df.withColumn("_len", longest).withColumns({c: padded(F.col(c), F.col("_len"), v, multiple) for c, v in arrays.items()}).drop("_len")


def within_budget(df: DataFrame, order: Sequence[str], amount: str, budget: int) -> DataFrame:
    """Rows in order as long as the amounts before them sum to less than the budget."""
    return running(df, order, F.col(amount), "_upto").where(F.col("_upto") - F.coalesce(amount, F.lit(0)) < budget).drop("_upto")


def interleaved(base: DataFrame, aux: DataFrame, order: Sequence[str]) -> DataFrame:
    """aux rows set into base at fixed intervals: the j-th after every floor(base / aux) base rows; `place` orders the result."""
    n, m = base.count(), aux.count()
    step = n // m if m else 0
    a = numbered(base, order, "_rn").select(*base.columns, F.col("_rn").cast("bigint").alias("_k"), F.lit(0).alias("_s"))
    b = numbered(aux, order, "_rn").select(*aux.columns, (F.col("_rn") * step).cast("bigint").alias("_k"), F.lit(1).alias("_s"))
    return a.unionByName(b).withColumnRenamed("_k", "place").withColumnRenamed("_s", "is_aux")
