"""Metric and report queries (G-family, A10, A19, A20) over the candidate fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import text as TX
from ..operators import ranking as R
from ..operators import reports as RP
from ..operators import sid as D
from ..sources import ordinal as O
from . import fixtures as FX
from .registry import register

PRED_NORM_SQL = X.strip_ws_sql(X.strip_chars_sql("pred", '"\n'))
TARGET_NORM_SQL = X.strip_chars_sql("output", ' \n"')


def _metric_sql(src: str, ks, group: str = "") -> str:
    kv = ", ".join(f"({k})" for k in ks)
    g = f"{group}, " if group else ""
    return f"""SELECT {g}CAST(v.k AS BIGINT) AS k,
       round(sum(CASE WHEN rk >= 1 AND rk <= v.k THEN 1 ELSE 0 END) / count(*), 6) AS hr,
       round(sum(CASE WHEN rk >= 1 AND rk <= v.k THEN 1.0 / log2(rk + 1) ELSE 0 END) / count(*), 6) AS ndcg,
       count(*) AS n
FROM {src}, (VALUES {kv}) v(k) GROUP BY {g}v.k"""


def _norm_preds(spark, d, n=FX.PRED_LEN, runs=1, idx=None):
    c = FX.candidates(spark, d, n, runs, idx=idx)
    return c.withColumn("npred", TX.norm_pred("pred")).withColumn("ntarget", TX.norm_target("output"))


def _pred_lists(spark, d, runs=1):
    c = _norm_preds(spark, d, runs=runs)
    # one list per (user, run): bounded by the beam width
    g = c.groupBy("run", "user_id", "ntarget").agg(F.array_sort(F.collect_list(F.struct("pos", "npred"))).alias("_l"))
    return g.select("run", "user_id", "ntarget", F.transform("_l", lambda s: s["npred"]).alias("predict"))


_RANK_CTES = {**FX.sql_candidate_ctes(),
              "np": f"SELECT run, user_id, pos, {PRED_NORM_SQL} AS npred, {TARGET_NORM_SQL} AS ntarget FROM preds",
              "rk": "SELECT user_id, coalesce(min(pos + 1) FILTER (WHERE npred = ntarget), 0) AS rk FROM np GROUP BY user_id"}


@register("prediction_hit_rank", FX.with_ctes(_RANK_CTES, "SELECT user_id, CAST(rk AS BIGINT) AS rank FROM rk"))
def prediction_hit_rank(spark, d):
    """G1 + B9: first hit position of the normalised target in the normalised list (0 = miss)."""
    p = _pred_lists(spark, d)
    return p.select("user_id", R.hit_rank("predict", "ntarget").alias("rank"))


@register("prediction_rank_metrics", FX.with_ctes(_RANK_CTES, _metric_sql("rk", R.DEFAULT_KS)))
def prediction_rank_metrics(spark, d):
    """G2 + G12: HR@K / NDCG@K for K in 1,3,5,10,20,50 (K <= list length)."""
    p = _pred_lists(spark, d).withColumn("rank", R.hit_rank("predict", "ntarget")).withColumn("_len", F.size("predict"))
    return R.rank_metrics(p, "rank", R.DEFAULT_KS, list_len_col="_len")


@register("invalid_predictions", FX.with_ctes({**_RANK_CTES,
    "kn": f"SELECT np.*, (sm.item_id IS NOT NULL) AS known FROM np LEFT JOIN (SELECT DISTINCT sid_full, 1 AS item_id FROM sid_map) sm ON sm.sid_full = np.npred"},
    """SELECT kn.user_id,
       CAST(sum(CASE WHEN NOT known AND (rk.rk = 0 OR kn.pos + 1 <= rk.rk) THEN 1 ELSE 0 END) AS BIGINT) AS invalid_until_hit,
       CAST(sum(CASE WHEN NOT known THEN 1 ELSE 0 END) AS BIGINT) AS invalid_total
FROM kn JOIN rk ON rk.user_id = kn.user_id GROUP BY kn.user_id"""))
def invalid_predictions(spark, d):
    """Predictions not in the SID catalogue, up to the hit (parity) and in total."""
    idx = FX.sid_index(spark, d)
    c = _norm_preds(spark, d, idx=idx)
    # Membership of each normalised prediction in the SID catalogue
    k = D.is_known(c, "npred", FX.sid_map(spark, d, idx), "sid", name="known")
    g = k.groupBy("user_id", "ntarget").agg(F.array_sort(F.collect_list(F.struct("pos", "npred", "known"))).alias("_l"))
    g = g.select("user_id", "ntarget", F.transform("_l", lambda s: s["npred"]).alias("predict"),
                 F.transform("_l", lambda s: s["known"]).alias("known"))
    return g.select("user_id", R.invalid_until_hit("predict", "ntarget", "known").alias("invalid_until_hit"),
                    F.size(F.filter("known", lambda x: ~x)).cast("bigint").alias("invalid_total"))


def _scores(spark, d, c=None):
    c = FX.candidates(spark, d) if c is None else c
    pairs = c.select("user_id", "cand").unionByName(c.select("user_id", F.col("target").alias("cand"))).distinct()
    return pairs.select(F.col("user_id").alias("query_id"), F.col("cand").alias("item_id"),
                        FX.score_of(F.col("user_id"), F.col("cand")).alias("score"))


_SCORE_CTES = {**FX.sql_candidate_ctes(),
               "pairs": "SELECT DISTINCT user_id, cand FROM (SELECT user_id, cand FROM preds UNION ALL SELECT user_id, target AS cand FROM et)",
               "sc": f"SELECT user_id, cand, {FX.SCORE_SQL} AS score FROM pairs",
               "ts": "SELECT sc.user_id, sc.cand AS t, sc.score AS tscore FROM sc JOIN et ON et.user_id = sc.user_id AND et.target = sc.cand",
               "r0": """SELECT sc.user_id, sum(CASE WHEN sc.score > ts.tscore OR (sc.score = ts.tscore AND sc.cand < ts.t) THEN 1 ELSE 0 END) AS rank0
FROM sc JOIN ts ON ts.user_id = sc.user_id GROUP BY sc.user_id""",
               "rk": "SELECT user_id, rank0 + 1 AS rk FROM r0"}


@register("score_rank_metrics", FX.with_ctes(_SCORE_CTES, _metric_sql("rk", R.SCORE_KS)))
def score_rank_metrics(spark, d):
    """Rank of the target inside a score table (count above, ties by item id), HR/NDCG at 1..20."""
    c = FX.candidates(spark, d)
    # the targets ride along in the candidate table (one per user)
    t = c.filter(F.col("pos") == 0).select(F.col("user_id").alias("query_id"), F.col("target").alias("item_id"))
    r = R.rank_from_scores(_scores(spark, d, c), t)
    return R.rank_metrics(r.withColumn("rank", F.col("rank0") + 1), "rank", R.SCORE_KS)


def _behaviors(spark, d):
    ev = FX.table(spark, d, "events").filter(F.col("event_type").isin("click", "purchase"))
    b = ev.select(F.col("event_id").alias("query_id"),
                  ((F.col("user_id") * 13 + F.col("event_id")) % 100).alias("target"),
                  F.when(F.col("event_type") == "click", 0.2).otherwise(1.0).alias("reward"))
    b = b.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("pos", F.col("pos").cast("bigint"))
    return b.withColumn("item", (F.col("query_id") * 7 + F.col("pos") * 11) % 100)


_BEH_CTES = {"b": """SELECT event_id AS query_id, (user_id * 13 + event_id) % 100 AS target,
       CASE WHEN event_type = 'click' THEN CAST(0.2 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS reward FROM events WHERE event_type IN ('click', 'purchase')""",
             "bl": "SELECT b.*, p.pos, (query_id * 7 + p.pos * 11) % 100 AS item FROM b, range(20) p(pos)",
             "br": "SELECT query_id, reward, coalesce(min(pos + 1) FILTER (WHERE item = target), 0) AS rk FROM bl GROUP BY query_id, reward"}


@register("behavior_metrics", FX.with_ctes(_BEH_CTES, """SELECT CAST(v.k AS BIGINT) AS k,
       CAST(sum(CASE WHEN rk BETWEEN 1 AND v.k AND reward = 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS click_hits,
       CAST(sum(CASE WHEN rk BETWEEN 1 AND v.k AND reward = 1.0 THEN 1 ELSE 0 END) AS BIGINT) AS purchase_hits,
       round(sum(CASE WHEN rk BETWEEN 1 AND v.k AND reward = 0.2 THEN 1.0 / log2(rk + 1) ELSE 0 END), 6) AS click_ndcg,
       round(sum(CASE WHEN rk BETWEEN 1 AND v.k AND reward = 1.0 THEN 1.0 / log2(rk + 1) ELSE 0 END), 6) AS purchase_ndcg,
       round(sum(CASE WHEN rk BETWEEN 1 AND v.k THEN reward ELSE 0 END), 6) AS total_reward
FROM br, (VALUES (5), (10), (20)) v(k) GROUP BY v.k"""))
def behavior_metrics(spark, d):
    """click/purchase split hits, NDCG and total reward per K from the events table."""
    b = _behaviors(spark, d)
    r = b.groupBy("query_id", "reward").agg(F.coalesce(F.min(F.when(F.col("item") == F.col("target"), F.col("pos") + 1)), F.lit(0)).alias("rk"))
    return R.hit_by_behavior(r, "rk", ks=(5, 10, 20))


_GROUP_CTES = {**FX.sql_candidate_ctes(n=FX.COMPLETION_G),
               "np": "SELECT user_id, pos, trim(pred, '\"' || chr(10)) AS npred, trim(output, '\"' || chr(10)) AS ntarget FROM preds",
               "rk": "SELECT user_id, coalesce(min(pos + 1) FILTER (WHERE npred = ntarget), 0) AS rk FROM np GROUP BY user_id"}


@register("group_rank_metrics", FX.with_ctes(_GROUP_CTES, _metric_sql("rk", R.TRAINING_KS)))
def group_rank_metrics(spark, d):
    """In-training HR/NDCG at 3,5,10,20 over groups of 16 completions (one row per group)."""
    c = FX.candidates(spark, d, n=FX.COMPLETION_G).withColumn("npred", X.strip_chars("pred", '"\n')).withColumn(
        "ntarget", X.strip_chars("output", '"\n'))
    g = c.groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("npred") == F.col("ntarget"), F.col("pos") + 1)), F.lit(0)).alias("rank"))
    return R.rank_metrics(g, "rank", R.TRAINING_KS)


RUNS = 5
_RUNS_CTES = {**FX.sql_candidate_ctes(runs=RUNS),
              "np": f"SELECT run, user_id, pos, {PRED_NORM_SQL} AS npred, {TARGET_NORM_SQL} AS ntarget FROM preds",
              "rk": "SELECT run, user_id, coalesce(min(pos + 1) FILTER (WHERE npred = ntarget), 0) AS rk FROM np GROUP BY run, user_id",
              "m0": _metric_sql("rk", R.DEFAULT_KS, "run"),
              "metrics": """SELECT 'run_' || CAST(run AS VARCHAR) AS run, CAST(run * 100 AS BIGINT) AS step, 'hr' AS metric, k, hr AS value FROM m0
UNION ALL SELECT 'run_' || CAST(run AS VARCHAR) AS run, CAST(run * 100 AS BIGINT) AS step, 'ndcg' AS metric, k, ndcg AS value FROM m0"""}


def run_metrics_df(spark, d):
    """Metric rows ``(run, step, metric, k, value)`` of five evaluation runs."""
    p = _pred_lists(spark, d, runs=RUNS).withColumn("rank", R.hit_rank("predict", "ntarget"))
    m = R.rank_metrics(p, "rank", R.DEFAULT_KS, group_cols=("run",))
    base = m.select(F.concat(F.lit("run_"), F.col("run").cast("string")).alias("run"), (F.col("run") * 100).cast("bigint").alias("step"),
                    "k", "hr", "ndcg")
    return base.select("run", "step", F.lit("hr").alias("metric"), "k", F.col("hr").alias("value")).unionByName(
        base.select("run", "step", F.lit("ndcg").alias("metric"), "k", F.col("ndcg").alias("value")))


@register("run_metrics", FX.with_ctes(_RUNS_CTES, "SELECT * FROM metrics"))
def run_metrics(spark, d):
    """G2/G12 per run: the long metric table of five evaluation runs."""
    return run_metrics_df(spark, d)


@register("best_run", FX.with_ctes(_RUNS_CTES, """SELECT run, step, value FROM metrics WHERE metric = 'ndcg' AND k = 10
ORDER BY value DESC, step DESC, run DESC LIMIT 1"""))
def best_run(spark, d):
    """Best run by NDCG@10."""
    return RP.best_run(run_metrics_df(spark, d), "ndcg", 10)


@register("latest_run", FX.with_ctes(_RUNS_CTES, "SELECT DISTINCT run, step FROM metrics ORDER BY step DESC, run DESC LIMIT 1"))
def latest_run(spark, d):
    """G7 by step: the run with the highest step."""
    return RP.best_run(run_metrics_df(spark, d), "step")


@register("compare_runs", FX.with_ctes(_RUNS_CTES, """SELECT a.metric, a.k, a.value AS base, b.value AS new, round(b.value - a.value, 6) AS delta,
       round(CASE WHEN a.value = 0 THEN 0.0 ELSE (b.value - a.value) / a.value * 100.0 END, 6) AS pct
FROM metrics a JOIN metrics b ON a.metric = b.metric AND a.k = b.k WHERE a.run = 'run_0' AND b.run = 'run_1'"""))
def compare_runs(spark, d):
    """run_1 against run_0 per metric and K."""
    return RP.compare(run_metrics_df(spark, d), "run_0", "run_1")


def _pivot_sql():
    cols = ", ".join(f"max(CASE WHEN metric = '{m}' AND k = {k} THEN value END) AS {m}_{k}" for m in ("hr", "ndcg") for k in R.DEFAULT_KS)
    return f"SELECT run, step, {cols} FROM metrics GROUP BY run, step"


@register("pivot_metrics", FX.with_ctes(_RUNS_CTES, _pivot_sql()))
def pivot_metrics(spark, d):
    """Wide table, one row per run."""
    return RP.pivot_metrics(run_metrics_df(spark, d), R.DEFAULT_KS)


@register("metric_curve", FX.with_ctes(_RUNS_CTES, """SELECT m.run, m.step, m.value, b.value AS baseline, round(m.value - b.value, 6) AS gain
FROM metrics m, (SELECT arg_min(value, run) AS value FROM metrics WHERE metric = 'ndcg' AND k = 10 AND step = 0) b WHERE m.metric = 'ndcg' AND m.k = 10"""))
def metric_curve(spark, d):
    """NDCG@10 per step against the step-0 baseline."""
    return RP.curve(run_metrics_df(spark, d), "ndcg", 10)


@register("early_stop", FX.with_ctes({**_RUNS_CTES,
    "lg": "SELECT 'all' AS series, step, value FROM metrics WHERE metric = 'hr' AND k = 50",
    "b1": "SELECT *, max(value) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM lg",
    "b2": "SELECT *, value > greatest(coalesce(best, 0), 0) AS imp FROM b1",
    "b3": "SELECT *, sum(CASE WHEN imp THEN 1 ELSE 0 END) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING) AS island FROM b2",
    "b4": "SELECT *, sum(CASE WHEN imp THEN 0 ELSE 1 END) OVER (PARTITION BY island ORDER BY step ROWS UNBOUNDED PRECEDING) AS bad FROM b3"},
    "SELECT 'all' AS series, (SELECT min(step) FROM b4 WHERE bad > 1) AS stop_step"))
def early_stop(spark, d):
    """First evaluation step where non-improvements of HR@50 since the best exceed patience 1."""
    m = run_metrics_df(spark, d).filter((F.col("metric") == "hr") & (F.col("k") == 50)).select(
        F.lit("all").alias("series"), "step", "value")
    return RP.early_stop(m, 1, key=("series",))


@register("shard_eval_metrics", FX.with_ctes(_RANK_CTES, _metric_sql("rk", R.DEFAULT_KS)))
def shard_eval_metrics(spark, d):
    """Evaluate four contiguous user shards separately, merge, then compute metrics."""
    p = _pred_lists(spark, d).withColumn("rank", R.hit_rank("predict", "ntarget"))
    o = O.with_ordinal(p, ["user_id"], "ord")
    n = o.agg(F.count(F.lit(1)).alias("n_rows"))
    s = O.shard(o.crossJoin(F.broadcast(n)), "ord", "n_rows", 4)
    merged = O.merge_shards([s.filter(F.col("shard") == i).select("user_id", "rank", "ord") for i in range(4)])
    return R.rank_metrics(merged, "rank", R.DEFAULT_KS)


@register("append_metrics", FX.with_ctes(_RUNS_CTES, """SELECT * FROM metrics WHERE run IN ('run_0', 'run_1', 'run_2')
UNION ALL SELECT * FROM metrics WHERE run IN ('run_1', 'run_2', 'run_3', 'run_4') AND run NOT IN ('run_0', 'run_1', 'run_2')"""))
def append_metrics(spark, d):
    """Existing rows for runs 0-2, new results for runs 1-4; only unseen runs are added."""
    m = run_metrics_df(spark, d)
    existing = m.filter(F.col("run").isin("run_0", "run_1", "run_2"))
    new = m.filter(F.col("run").isin("run_1", "run_2", "run_3", "run_4"))
    return RP.append_metrics(new, existing)


@register("metric_log", FX.with_ctes(_RUNS_CTES, "SELECT 'eval' AS stage, metric || '@' || CAST(k AS VARCHAR) AS tag, step, value FROM metrics WHERE NOT isnan(value)"))
def metric_log(spark, d):
    """Scalar metric log rows for the eval stage."""
    return RP.metric_log_rows(run_metrics_df(spark, d), "eval")


@register("discover_runs", """WITH p AS (SELECT 'out/' || o_orderpriority || '/checkpoint-' ||
       CASE WHEN o_orderstatus = 'P' THEN 'final' ELSE CAST(o_orderkey % 1000 AS VARCHAR) END AS path FROM orders),
d AS (SELECT regexp_extract(path, '([^/]+)/checkpoint-[^/]*$', 1) AS run, TRY_CAST(regexp_extract(path, 'checkpoint-([^/]*)$', 1) AS BIGINT) AS step, path FROM p)
SELECT run, step, path FROM d WHERE step IS NOT NULL
UNION ALL SELECT DISTINCT run, CAST(0 AS BIGINT) AS step, CAST(NULL AS VARCHAR) AS path FROM d WHERE step IS NOT NULL""")
def discover_runs(spark, d):
    """A10: runs and checkpoints from ``<run>/checkpoint-N`` paths (one per order); unparsable ignored, baseline step 0."""
    o = FX.table(spark, d, "orders")
    path = F.concat(F.lit("out/"), F.col("o_orderpriority"), F.lit("/checkpoint-"),
                    F.when(F.col("o_orderstatus") == "P", F.lit("final")).otherwise((F.col("o_orderkey") % 1000).cast("string")))
    return RP.discover_runs(o.select(path.alias("path")))
