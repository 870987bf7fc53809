"""Metric reports and run bookkeeping.

Metric tables are small (runs x metrics x K), but every operator is still a
plain aggregate/join so it scales with the number of runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X


def best_run(metrics: DataFrame, by: str = "ndcg", k: int = 10) -> DataFrame:
    """Best run by ``by@k`` (ties: higher step, then run name); ``by='step'``
    picks the highest step (T30)."""
    if by == "step":
        return metrics.agg(F.max(F.struct("step", "run")).alias("_b")).select(
            F.col("_b.run").alias("run"), F.col("_b.step").alias("step"))
    m = metrics.filter((F.col("metric") == by) & (F.col("k") == k))
    return m.agg(F.max(F.struct("value", "step", "run")).alias("_b")).select(
        F.col("_b.run").alias("run"), F.col("_b.step").alias("step"), F.col("_b.value").alias("value"))


def compare(metrics: DataFrame, base_run: str, new_run: str) -> DataFrame:
    """Per (metric, k) base, new, delta and percent change (0 when base is 0)."""
    a = metrics.filter(F.col("run") == base_run).select("metric", "k", F.col("value").alias("base"))
    b = metrics.filter(F.col("run") == new_run).select("metric", "k", F.col("value").alias("new"))
    j = a.join(b, ["metric", "k"])
    return j.select("metric", "k", "base", "new", X.r6(F.col("new") - F.col("base")).alias("delta"),
                    X.r6(F.when(F.col("base") == 0, 0.0).otherwise((F.col("new") - F.col("base")) / F.col("base") * 100.0)).alias("pct"))


def pivot_metrics(metrics: DataFrame, ks) -> DataFrame:
    """One row per run, columns ``hr_k`` / ``ndcg_k`` (explicit pivot values)."""
    m = metrics.withColumn("col", F.concat(F.col("metric"), F.lit("_"), F.col("k").cast("string")))
    values = [f"{m_}_{k}" for m_ in ("hr", "ndcg") for k in ks]
    return m.groupBy("run", "step").pivot("col", values).agg(F.first("value"))


def curve(metrics: DataFrame, metric: str = "ndcg", k: int = 10) -> DataFrame:
    """G9 curve rows: value per step next to the step-0 baseline."""
    m = metrics.filter((F.col("metric") == metric) & (F.col("k") == k))
    # one row: the step-0 value, of the first run by name when several runs have one
    base = m.filter(F.col("step") == 0).agg(F.min_by("value", "run").alias("baseline")).filter("baseline is not null")
    return m.crossJoin(F.broadcast(base)).select("run", "step", "value", "baseline",
                                                          X.r6(F.col("value") - F.col("baseline")).alias("gain"))


def early_stop(log: DataFrame, patience: int, key=("run",), step: str = "step", value: str = "value") -> DataFrame:
    """First step where the evaluations since the best exceed ``patience``.

    A non-improvement is ``value <= running best`` (T35); the best starts at 0.  Per key: running max,
    islands of non-improvement, first row whose run length > patience.  One key is
    one training run (a handful of evaluations): the window is bounded by it.
    """
    key = list(key)
    w = Window.partitionBy(*key).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    d = log.withColumn("_best", F.max(value).over(w))
    d = d.withColumn("_improve", F.col(value) > F.greatest(F.coalesce(F.col("_best"), F.lit(0.0)), F.lit(0.0)))
    w2 = Window.partitionBy(*key).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_island", F.sum(F.col("_improve").cast("int")).over(w2))
    w3 = Window.partitionBy(*key, "_island").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_bad", F.sum((~F.col("_improve")).cast("int")).over(w3))
    stops = d.filter(F.col("_bad") > patience).groupBy(*key).agg(F.min(step).alias("stop_step"))
    return log.select(*key).distinct().join(stops, key, "left")


def discover_runs(paths: DataFrame, path: str = "path") -> DataFrame:
    """A10: runs/checkpoints from ``.../<run>/checkpoint-N`` names; unparsable names are
    ignored; each run gets a baseline row at step 0 (order by ``run, step`` to walk them)."""
    step = F.expr(f"try_cast(regexp_extract({path}, 'checkpoint-([^/]*)$', 1) AS BIGINT)")
    run = F.regexp_extract(path, r"([^/]+)/checkpoint-[^/]*$", 1)
    d = paths.select(run.alias("run"), step.alias("step"), F.col(path).alias("path")).filter(F.col("step").isNotNull())
    base = d.select("run").distinct().select("run", F.lit(0).cast("bigint").alias("step"), F.lit(None).cast("string").alias("path"))
    return d.unionByName(base)


def append_metrics(new: DataFrame, existing: DataFrame, run: str = "run") -> DataFrame:
    """Keep existing rows, add only runs not already present (resume)."""
    fresh = new.join(existing.select(run).distinct(), run, "left_anti")
    return existing.unionByName(fresh)


def metric_log_rows(metrics: DataFrame, stage: str) -> DataFrame:
    """Scalar metric log rows ``(stage, tag, step, value)``; non-numeric dropped."""
    tag = F.concat(F.col("metric"), F.lit("@"), F.col("k").cast("string"))
    v = F.col("value").cast("double")
    return metrics.select(F.lit(stage).alias("stage"), tag.alias("tag"), F.col("step").cast("bigint").alias("step"),
                          v.alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def metric_map_rows(metrics: DataFrame, stage: str, column: str = "metrics", step: str = "step") -> DataFrame:
    """The rows of :func:`metric_log_rows` from a map column ``name -> value`` or ``name -> map`` (any depth).

    Tags are ``stage/name[/name...]`` as the loggers write them (``sft/train/loss``); the RL
    logger writes ``/`` in outer names as ``_``.  Values that are no number are dropped.
    """
    name = F.regexp_replace("_name", "/", "_") if stage == "rl" else F.col("_name")
    d = metrics.select(F.col(step).cast("bigint").alias("step"), F.explode(column).alias("_name", "_value"))
    d = d.select("step", F.concat(F.lit(f"{stage}/"), name).alias("tag"), "_value")
    while isinstance(d.schema["_value"].dataType, T.MapType):
        d = d.select("step", "tag", F.explode("_value").alias("_name", "_value"))
        d = d.select("step", F.concat("tag", F.lit("/"), "_name").alias("tag"), "_value")
    d = d.select(F.lit(stage).alias("stage"), "tag", "step", F.expr("try_cast(_value AS DOUBLE)").alias("value"))
    return d.filter(F.col("value").isNotNull() & ~F.isnan("value"))
