"""Ranking queries (G-family) over the event fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators import sequences as S
from . import fixtures as FX
from .registry import register


def _metric_sql(rank_source: str, ks) -> str:
    kv = ", ".join(f"({k})" for k in ks)
    return f"""SELECT CAST(v.k AS BIGINT) AS k,
       round(sum(CASE WHEN rk >= 1 AND rk <= v.k THEN 1 ELSE 0 END) / count(*), 6) AS hr,
       round(sum(CASE WHEN rk >= 1 AND rk <= v.k THEN 1.0 / log2(rk + 1) ELSE 0 END) / count(*), 6) AS ndcg,
       count(*) AS n
FROM {rank_source}, (VALUES {kv}) v(k) GROUP BY v.k"""


POPULARITY_SQL = FX.with_ctes(
    {
        **FX.event_ctes(),
        "cnt": "SELECT item_id, count(*) AS c FROM hist GROUP BY item_id",
        "top": "SELECT item_id, row_number() OVER (ORDER BY c DESC, item_id) AS rk FROM cnt QUALIFY rk <= 50",
        "hits": "SELECT t.user_id, coalesce(top.rk, 0) AS rk FROM targets t LEFT JOIN top ON t.target = top.item_id",
    },
    _metric_sql("hits", (10, 20, 50)),
)


@register("popularity_rank_metrics", POPULARITY_SQL)
def popularity_rank_metrics(spark, d):
    """What HR@K / NDCG@K does a popularity top-50 reach on each customer's last order line?"""
    ev = FX.events(spark, d)
    last = S.last_event(ev, "user_id", FX.EVENT_KEY)
    targets = last.select("user_id", F.col("item_id").alias("target"))
    counts = S.history_item_counts(ev, "user_id", FX.EVENT_KEY)
    return R.popularity_rank_metrics(None, targets, ks=(10, 20, 50), counts=counts)
