"""Streaming evaluation (extension, SURVEY 7.6).

The reference evaluates prediction shards written by several workers and merges
them before computing HR/NDCG (G11).  Here the shards are a file stream: each
prediction file that lands in a folder is parsed, normalised (B9), ranked (G1)
and folded into running hit/gain sums per K (G2) by a streaming aggregation whose
state is one row per (run, K).  The metric rows can be appended to a metric log
(A20) through ``foreachBatch``.  Offsets and state live in the checkpoint
location, so a restarted query resumes without double counting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..operators import ranking as R

PREDICTION_SCHEMA = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("row_id", T.LongType()),
    T.StructField("output", T.StringType()),
    T.StructField("predict", T.ArrayType(T.StringType())),
])


def prediction_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 16) -> DataFrame:
    """JSON-lines prediction records arriving in ``folder`` (declared schema, no inference)."""
    return (spark.readStream.schema(PREDICTION_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .json(folder))


def running_rank_sums(preds: DataFrame, ks=R.DEFAULT_KS) -> DataFrame:
    """Streaming aggregate: per (run, K) the number of rows, hits and NDCG gain so far."""
    norm = preds.select("run", F.transform("predict", lambda p: TX.norm_pred(p)).alias("_p"),
                        TX.norm_target("output").alias("_t"))
    ranked = norm.select("run", R.hit_rank("_p", "_t").alias("rank"))
    kk = F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks])).alias("k")
    r = F.col("rank")
    rows = ranked.select("run", "rank", kk)
    inside = (r >= 1) & (r <= F.col("k"))
    return rows.groupBy("run", "k").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(inside, 1).otherwise(0)).alias("hits"),
        F.sum(F.when(inside, F.lit(1.0) / F.log2(r.cast("double") + 1.0)).otherwise(0.0)).alias("gain"),
    )


def metrics_from_sums(sums: DataFrame) -> DataFrame:
    """HR@K / NDCG@K rows from the running sums (rounded to 6 digits)."""
    return sums.select("run", "k", F.round(F.col("hits") / F.col("n"), 6).alias("hr"),
                       F.round(F.col("gain") / F.col("n"), 6).alias("ndcg"), "n")


def start_evaluation(spark: SparkSession, folder: str, checkpoint: str, sink_table: str | None = None,
                     metric_log_path: str | None = None, ks=R.DEFAULT_KS, trigger_once: bool = False):
    """Start the streaming evaluation.

    ``sink_table``: in-memory table with the current metrics (complete mode, for
    tests and notebooks).  ``metric_log_path``: each micro-batch appends the current
    metric rows as ``(stage, tag, step, value)`` parquet partitioned by stage, with
    ``step`` = the batch id.
    """
    sums = running_rank_sums(prediction_stream(spark, folder), ks)
    w = sums.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    if metric_log_path:
        def append(batch: DataFrame, batch_id: int):
            m = metrics_from_sums(batch)
            rows = m.select(F.lit("stream_eval").alias("stage"), F.concat(F.lit("hr@"), F.col("k").cast("string")).alias("tag"),
                            F.lit(batch_id).cast("bigint").alias("step"), F.col("hr").alias("value")).unionByName(
                m.select(F.lit("stream_eval").alias("stage"), F.concat(F.lit("ndcg@"), F.col("k").cast("string")).alias("tag"),
                         F.lit(batch_id).cast("bigint").alias("step"), F.col("ndcg").alias("value")))
            rows.write.mode("append").partitionBy("stage").parquet(metric_log_path)

        return w.foreachBatch(append).start()
    return w.format("memory").queryName(sink_table or "stream_eval").start()
