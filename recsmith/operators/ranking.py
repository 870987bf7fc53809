"""Ranking metrics and the popularity ranking baseline.

All metrics divide by the number of evaluated rows: a miss has rank NULL/0 and
counts in the denominator (``avg`` over a NULL rank would silently drop it).
NDCG has one positive, so ideal DCG = 1 and ``ln2/ln(r+2) = 1/log2(r+2)`` for a
0-based rank r.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X

DEFAULT_KS = (1, 3, 5, 10, 20, 50)
SCORE_KS = (1, 3, 5, 10, 20)
TRAINING_KS = (3, 5, 10, 20)


def top_popular(history: DataFrame, k: int, item: str = "item_id", counts: DataFrame | None = None) -> DataFrame:
    """Top-k items by interaction count, ties by item id.  ``rank`` is 1-based.

    Counting is a partial aggregate (a popular item is combined map-side) and the
    top-k is a per-partition take-ordered, so only k rows per partition move.
    ``counts`` (item, cnt) may be passed instead of the rows.
    """
    if counts is None:
        counts = history.groupBy(item).agg(F.count(F.lit(1)).alias("cnt"))
    top = counts.orderBy(F.desc("cnt"), F.asc(item)).limit(k)
    # k rows: a global window over them is bounded by k
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cnt"), F.asc(item))).cast("bigint"))


def hit_rank(pred_col, target_col) -> Column:
    """G1: 1-based position of the first occurrence of the target in the list; 0 = miss."""
    p = F.col(pred_col) if isinstance(pred_col, str) else pred_col
    t = F.col(target_col) if isinstance(target_col, str) else target_col
    return F.coalesce(F.array_position(p, t), F.lit(0)).cast("bigint")


def rank_metrics(df: DataFrame, rank_col: str = "rank", ks=DEFAULT_KS, group_cols=(), list_len_col: str | None = None) -> DataFrame:
    """HR@K and NDCG@K from a 1-based rank column (0/NULL = miss).

    One partial aggregate computes every K at once; the K rows are produced after
    the aggregation.  With ``list_len_col`` only K <= the shortest list is kept
    (the reference keeps K <= beam width).
    """
    r = F.col(rank_col)
    hit = lambda k: F.when((r >= 1) & (r <= k), 1).otherwise(0)
    gain = lambda k: F.when((r >= 1) & (r <= k), F.lit(1.0) / F.log2(r.cast("double") + 1.0)).otherwise(0.0)
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in ks:
        aggs.append(F.sum(hit(k)).alias(f"_h{k}"))
        aggs.append(F.sum(gain(k)).alias(f"_g{k}"))
    if list_len_col:
        aggs.append(F.min(list_len_col).alias("_minlen"))
    g = list(group_cols)
    a = df.groupBy(*g).agg(*aggs) if g else df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"_h{k}").alias("_h"), F.col(f"_g{k}").alias("_g")) for k in ks
    ])).alias("_m")
    out = a.select(*g, "n", *(["_minlen"] if list_len_col else []), rows)
    out = out.select(
        *g,
        F.col("_m.k").alias("k"),
        X.r6(F.col("_m._h") / F.col("n")).alias("hr"),
        X.r6(F.col("_m._g") / F.col("n")).alias("ndcg"),
        F.col("n").cast("bigint").alias("n"),
        *(["_minlen"] if list_len_col else []),
    )
    if list_len_col:
        out = out.filter(F.col("k") <= F.col("_minlen")).drop("_minlen")
    return out


def popularity_rank_metrics(history: DataFrame | None, targets: DataFrame, ks=(10, 20, 50), item: str = "item_id",
                            target: str = "target", counts: DataFrame | None = None) -> DataFrame:
    """Flagship: HR@K/NDCG@K of a top-max(K) popularity list against each user's held-out item.

    The top list has max(K) rows (a proven bound), so it is broadcast to the
    targets; no row-scale data is shuffled by item.
    """
    top = top_popular(history, max(ks), item, counts).select(F.col(item).alias("_item"), "rank")
    hits = targets.join(F.broadcast(top), targets[target] == top["_item"], "left").select(F.coalesce("rank", F.lit(0)).alias("rank"))
    return rank_metrics(hits, "rank", ks)


def invalid_until_hit(pred_col: str, target_col: str, known_col: str) -> Column:
    """G3 parity form: number of unknown predictions up to and including the hit
    position (whole list on a miss).  ``known_col`` is an array<boolean> aligned
    with the predictions."""
    rank = hit_rank(pred_col, target_col)
    upto = F.when(rank > 0, rank).otherwise(F.size(pred_col))
    return F.size(F.filter(F.slice(F.col(known_col), 1, upto), lambda k: ~k)).cast("bigint")


def rank_from_scores(scores: DataFrame, targets: DataFrame, query: str = "query_id", item: str = "item_id",
                     score: str = "score") -> DataFrame:
    """0-based rank of the target from a score table: the number of items that
    score strictly higher, plus equal scores with a smaller item id (tie rule T17).
    A count per query, not a sort: a query with many candidates is combined map-side."""
    t = targets.select(F.col(query).alias("_q"), F.col(item).alias("_t"))
    ts = scores.join(t, (scores[query] == t["_q"]) & (scores[item] == t["_t"])).select(
        F.col("_q"), F.col("_t"), F.col(score).alias("_ts"))
    # one row per query: join back on the query key
    j = scores.join(ts, scores[query] == ts["_q"])
    above = (F.col(score) > F.col("_ts")) | ((F.col(score) == F.col("_ts")) & (F.col(item) < F.col("_t")))
    return j.groupBy(F.col("_q").alias(query)).agg(F.sum(F.when(above, 1).otherwise(0)).cast("bigint").alias("rank0"))


def hit_by_behavior(df: DataFrame, rank_col: str = "rk", reward_col: str = "reward", ks=(5, 10, 20),
                    click: float = 0.2, purchase: float = 1.0) -> DataFrame:
    """Per K, click/purchase hits and NDCG sums plus the total reward of hits."""
    r = F.col(rank_col)
    inside = lambda k: (r >= 1) & (r <= k)
    gain = F.lit(1.0) / F.log2(r.cast("double") + 1.0)
    rows = []
    for k in ks:
        rows.append(F.struct(
            F.lit(k).cast("bigint").alias("k"),
            F.sum(F.when(inside(k) & (F.col(reward_col) == click), 1).otherwise(0)).cast("bigint").alias("click_hits"),
            F.sum(F.when(inside(k) & (F.col(reward_col) == purchase), 1).otherwise(0)).cast("bigint").alias("purchase_hits"),
            X.r6(F.sum(F.when(inside(k) & (F.col(reward_col) == click), gain).otherwise(0.0))).alias("click_ndcg"),
            X.r6(F.sum(F.when(inside(k) & (F.col(reward_col) == purchase), gain).otherwise(0.0))).alias("purchase_ndcg"),
            X.r6(F.sum(F.when(inside(k), F.col(reward_col)).otherwise(0.0))).alias("total_reward"),
        ))
    return df.agg(F.array(*rows).alias("_r")).select(F.explode("_r").alias("_m")).select("_m.*")
