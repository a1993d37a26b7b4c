"""Session helpers: reading tables, cutting lineage, ranking without one-task windows."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where their files are fewer than these, for work that is heavy per row.

    A file may be one row group, which a scan cannot share out. A table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(2 * cores)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once a session; a new executor fetches it from the driver."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        base = os.path.join(tempfile.mkdtemp(prefix="sievework-code-"), "sievework")
        here = Path(__file__).resolve().parent
        with zipfile.ZipFile(base + ".zip", "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        spark.sparkContext.addPyFile(base + ".zip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` (one file or a folder) under `sf_dir`."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir` of the session.

    Only where the session has none (a local run, tests) a temporary folder is used; on a
    cluster master that would be machine-local, so there it is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and (set_ := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        given = set_.get()
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sievework-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _sweep() -> None:
    for spark, path in _made:
        try:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


atexit.register(_sweep)


def settle(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut, executors may be lost.

    The files are compressed parquet, which also gives later stages column pruning; they are
    removed when the driver ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def unit_hash(*cols: Column) -> Column:
    """A non-negative 63-bit hash of the columns, the order key of every seeded draw."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def running_total(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    ties: Sequence[str],
    amount: Column | None = None,
    out: str = "upto",
    bits: int = 12,
) -> DataFrame:
    """Inclusive running sum of `amount` (1 per row by default) per group in order of `key`.

    `key` is a non-negative 63-bit order key (see `unit_hash`). Rows are bucketed by the top
    `bits` bits of the key, so a group of any size is spread over 2**bits window partitions;
    the offsets of the buckets come from a pre-aggregated table of at most 2**bits rows a
    group. Ties in the key are broken by `ties`. A null amount counts as 0. An empty input
    gives an empty result.
    """
    amount = F.lit(1) if amount is None else F.coalesce(amount, F.lit(0))
    df = df.withColumns({"_slot": F.shiftright(F.col(key), 63 - bits), "_amt": amount})
    keys = [*group, "_slot"]
    sums = df.groupBy(*keys).agg(F.sum("_amt").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    same = None
    a, b = df.alias("a"), offsets.alias("b")
    for k in keys:
        c = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = c if same is None else same & c
    joined = a.join(b, same).select("a.*", "b._base")
    w = Window.partitionBy(*keys).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("_base") + F.sum("_amt").over(w)).drop("_slot", "_amt", "_base")
