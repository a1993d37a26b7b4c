"""Results written while they come: running accuracy over a stream of predictions, appended step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.functions.answers import clean, final_answer, verified
from sievework.operators import order as O


def scored(df: DataFrame) -> DataFrame:
    """Adds prediction and exact_match to rows with raw_output and answer."""
    pred = clean(final_answer(F.col("raw_output")))
    return df.withColumns({"prediction": pred, "exact_match": verified(F.col("answer"), pred).cast("int")})


def live(stream: DataFrame, out: str, checkpoint: str, order: str = "idx") -> StreamingQuery:
    """Scores each micro-batch, appends it as JSON lines and CSV, and keeps the running accuracy.

    `running` has one row a batch with the totals so far, read from the row before it; a batch that is
    run again after a failure replaces its own files, so nothing is counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = scored(batch).persist()
        try:
            past = (0, 0)
            if number > 0:
                r = spark.read.parquet(f"{out}/running/batch={number - 1}").first()
                past = (r.seen, r.correct)
            # a backlog may be one batch, so the totals run over range partitions
            upto = O.running(O.numbered(rows, [order], "_seen"), [order], F.col("exact_match"), "_correct")
            each = upto.withColumn("running_accuracy", (F.lit(past[1]) + F.col("_correct")) / (F.lit(past[0]) + F.col("_seen"))).drop("_seen", "_correct")
            each.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{out}/rows/batch={number}")
            flat = [F.col(c) if not t.startswith(("array", "struct", "map")) else F.to_json(c).alias(c) for c, t in each.dtypes]
            each.select(*flat).write.mode("overwrite").option("header", True).csv(f"{out}/csv/batch={number}")
            total = rows.agg((F.lit(past[0]) + F.count(F.lit(1))).alias("seen"), (F.lit(past[1]) + F.coalesce(F.sum("exact_match"), F.lit(0))).alias("correct"))
            total.withColumn("accuracy", F.col("correct") / F.greatest("seen", F.lit(1))).write.mode("overwrite").parquet(f"{out}/running/batch={number}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
