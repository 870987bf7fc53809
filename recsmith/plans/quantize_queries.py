"""Quantizer-fitting queries (C9-C11, C18, C20-C22).  Iterative fits have no SQL
twin; their invariants are checked in tests/test_quantize.py."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import quantize as Q
from ..operators import vectors as V
from . import fixtures as FX
from .registry import register

K = FX.CODEBOOK_K


@register("kmeans_codes")
def kmeans_codes(spark, d):
    """Plain k-means (K=16) over the item vectors with pyspark.ml."""
    _, a = Q.kmeans(FX.vectors(spark, d).select("item_id", "embedding"), K, seed=1)
    return a.select("item_id", "code")


@register("residual_kmeans_codes")
def residual_kmeans_codes(spark, d):
    """C11: three-level residual k-means (16 codes per level)."""
    _, codes = Q.residual_kmeans(FX.vectors(spark, d).select("item_id", "embedding"), [K, K, K], seed=1)
    return codes.select("item_id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("path"))


@register("balanced_kmeans_sizes")
def balanced_kmeans_sizes(spark, d):
    """Size-bounded k-means (min-cost assignment, three starts, tol 1e-4); cluster sizes (all within [n//K-1, n//K+1])."""
    _, a = Q.balanced_kmeans(FX.vectors(spark, d).select("item_id", "embedding"), K, max_iter=100, seed=1, tol=1e-4, n_init=3)
    return a.groupBy("code").agg(F.count(F.lit(1)).alias("size"))


@register("sinkhorn_codes")
def sinkhorn_codes(spark, d):
    """Sinkhorn balanced assignment to the level-0 fixture codebook (eps 0.003, 50 iterations)."""
    s = Q.sinkhorn_assign(FX.vectors(spark, d).select("item_id", "embedding"), FX.codebook(spark, d), eps=0.003, iters=50)
    return s


@register("kmeanspp_centers")
def kmeanspp_centers(spark, d):
    """C20: k-means++ seeding (D^2 weights, seeded exponential race)."""
    cb = Q.kmeanspp_seed(FX.vectors(spark, d).select("item_id", "embedding"), K, seed=3)
    return cb.select("code", X.r6(F.sqrt(V.sq_norm("vector"))).alias("norm"))


@register("kmeans_parallel_centers")
def kmeans_parallel_centers(spark, d):
    """C20 by k-means|| (five passes whatever K, then a weighted reclustering of the drawn rows)."""
    cb = Q.kmeans_parallel_seed(FX.vectors(spark, d).select("item_id", "embedding"), K, seed=3)
    return cb.select("code", X.r6(F.sqrt(V.sq_norm("vector"))).alias("norm"))


@register("pca_codebook_init")
def pca_codebook_init(spark, d):
    """The fixture codebook re-initialised at 8 dimensions (centred, then PCA)."""
    cb = Q.init_codebook(FX.codebook(spark, d), 8)
    return cb.select("level", "code", F.size("vector").cast("bigint").alias("dim"))


def _pair_sum_weights(d_in: int):
    w = np.zeros((d_in // 2, d_in))
    for i in range(d_in // 2):
        w[i, 2 * i] = 1.0
        w[i, 2 * i + 1] = 1.0
    b = np.asarray([0.01 * i for i in range(d_in // 2)])
    return w, b


@register("projected_vectors", FX.with_ctes({"emb_long": FX.sql_emb_long()},
    "SELECT item_id, CAST(dim // 2 AS BIGINT) AS dim, round(sum(v) + 0.01 * (dim // 2), 6) AS value FROM emb_long GROUP BY item_id, dim // 2"))
def projected_vectors(spark, d):
    """``x W^T + b`` with a fixed pair-sum matrix (64 -> 32) and bias 0.01*i."""
    v = FX.vectors(spark, d).select("item_id", "embedding")
    w, b = _pair_sum_weights(64)
    p = V.project(v, w, b, "embedding", name="proj")
    return p.select("item_id", F.posexplode("proj").alias("dim", "_v")).select(
        "item_id", F.col("dim").cast("bigint").alias("dim"), X.r6("_v").alias("value"))


@register("collision_repair_paths")
def collision_repair_paths(spark, d):
    """Repair shared code paths of the fixture codes by Sinkhorn on the last level."""
    c = FX.codes(spark, d)
    r = Q.repair_collisions(c.select("item_id", "embedding"), c.select("item_id", "codes"), FX.codebook(spark, d), rounds=20)
    return r.select("item_id", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("path"))


@register("best_codebook_run")
def best_codebook_run(spark, d):
    """Quantizer runs with K in 4, 8, 16 (fixture codebooks); best by collision rate,
    lowest-loss run tracked separately."""
    from ..operators import sid as D

    rows = None
    for k in (4, 8, 16):
        c = FX.codes(spark, d, k=k)
        coll = D.collision_rate(c.select("item_id", "codes")).select("collision_rate")
        loss = V.level_errors(c).agg(F.avg("mse").alias("loss"))
        r = coll.crossJoin(loss).select(F.lit(f"k{k}").alias("run"), "collision_rate", X.r6("loss").alias("loss"))
        rows = r if rows is None else rows.unionByName(r)
    return D.best_codebook(rows)


def _sinkhorn_sql(rounds: int, eps: float = 0.003) -> str:
    ctes = {**FX.sql_codebook_ctes(levels=1),
            "sd": "SELECT x.item_id, c.code, sum((x.v - c.v) * (x.v - c.v)) AS d FROM emb_long x JOIN cb0 c ON c.dim = x.dim GROUP BY x.item_id, c.code",
            "sm": "SELECT (max(d) + min(d)) / 2 AS mid, max(d) AS hi FROM sd",
            "q0": f"SELECT item_id, code, exp(-((d - mid) / (hi - mid + 1e-5)) / {eps}) AS q FROM sd, sm"}
    for i in range(rounds):
        ctes[f"r{i}"] = f"SELECT item_id, code, q / sum(q) OVER (PARTITION BY item_id) AS q FROM q{i}"
        ctes[f"q{i + 1}"] = f"SELECT item_id, code, q / sum(q) OVER (PARTITION BY code) AS q FROM r{i}"
    return FX.with_ctes(ctes, f"SELECT item_id, CAST(arg_min(code, (-q, code)) AS INTEGER) AS code FROM q{rounds} GROUP BY item_id")


@register("sinkhorn_two_rounds", _sinkhorn_sql(2))
def sinkhorn_two_rounds(spark, d):
    """C18 after two rounds (what SQL can follow step by step)."""
    return Q.sinkhorn_assign(FX.vectors(spark, d).select("item_id", "embedding"), FX.codebook(spark, d, levels=1), eps=0.003, iters=2)
