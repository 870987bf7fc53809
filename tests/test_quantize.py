"""Invariants of the iterative quantizer operators (no SQL twin)."""

import numpy as np
from pyspark.sql import functions as F

from recsmith.operators import quantize as Q
from recsmith.operators import vectors as V
from recsmith.plans import fixtures as FX

from .conftest import SF01


def test_balanced_kmeans_bounds(spark):
    emb = FX.vectors(spark, SF01).select("item_id", "embedding")
    n, k = emb.count(), 16
    _, a = Q.balanced_kmeans(emb, k, max_iter=2, seed=1, n_init=1)
    sizes = {r["code"]: r["count"] for r in a.groupBy("code").count().collect()}
    assert sum(sizes.values()) == n
    assert a.select("item_id").distinct().count() == n
    assert max(sizes.values()) <= n // k + 1
    assert min(sizes.values()) >= max(1, n // k - 1)


def _sizes(assigned):
    return sorted(r["count"] for r in assigned.groupBy("code").count().collect())


def test_balanced_kmeans_far_centre_and_few_distinct_vectors(spark):
    rng = np.random.default_rng(1)
    near = [(i, (rng.normal(size=4) * 0.1 + np.eye(4)[i % 3] * 2).tolist()) for i in range(31)]
    emb = spark.createDataFrame([*near, (31, [50.0, 50.0, 50.0, 50.0])], "item_id bigint, embedding array<double>")
    _, a = Q.balanced_kmeans(emb, 4, max_iter=4, seed=1, n_init=1)
    assert sum(_sizes(a)) == 32 and all(7 <= s <= 9 for s in _sizes(a)) and len(_sizes(a)) == 4
    two = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(32)], "item_id bigint, embedding array<double>")
    cb, a = Q.balanced_kmeans(two, 4, max_iter=3, seed=1, n_init=1)
    assert cb.count() == 4 and sum(_sizes(a)) == 32 and all(7 <= s <= 9 for s in _sizes(a))
    assert a.select("item_id").distinct().count() == 32


def _plain_sinkhorn(d, eps, iters):
    mid = (d.max() + d.min()) / 2
    q = np.exp(-((d - mid) / (d.max() - mid + 1e-5)) / eps)
    q /= q.sum()
    for _ in range(iters):
        q /= q.sum(axis=1, keepdims=True) * len(q)
        q /= q.sum(axis=0, keepdims=True) * q.shape[1]
    return q.argmax(axis=1)


def test_sinkhorn_order_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(60, 6)), rng.normal(size=(5, 6))
    emb = spark.createDataFrame([(i, int(i % 3 == 0), v.tolist()) for i, v in enumerate(x)], "item_id bigint, part int, embedding array<double>")
    cb = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(c)], "level int, code int, vector array<double>")
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    got = {r.item_id: r.code for r in Q.sinkhorn_assign(emb, cb, eps=0.05, iters=4).collect()}
    assert [got[i] for i in range(60)] == _plain_sinkhorn(d, 0.05, 4).tolist()
    want = {int(i): int(v) for part in (0, 1) for sel in [np.nonzero((np.arange(60) % 3 == 0) == part)[0]] for i, v in zip(sel, _plain_sinkhorn(d[sel], 0.05, 4))}
    assert {r.item_id: r.code for r in Q.sinkhorn_assign(emb, cb, eps=0.05, iters=4, batch="part").collect()} == want
    monkeypatch.setattr(Q, "SINKHORN_TASK_ITEMS", 30)  # the larger batch in distributed rounds
    assert {r.item_id: r.code for r in Q.sinkhorn_assign(emb, cb, eps=0.05, iters=4, batch="part").collect()} == want


def test_pca_init_per_level(spark):
    rng = np.random.default_rng(5)
    books = rng.normal(size=(2, 9, 6))
    old = spark.createDataFrame([(lv, i, v.tolist()) for lv in range(2) for i, v in enumerate(books[lv])], "level int, code int, vector array<double>")
    got = {(r.level, r.code): r.vector for r in Q.init_codebook(old, 3).collect()}
    for lv in range(2):
        cen = books[lv] - books[lv].mean(axis=0)
        want = cen @ np.linalg.svd(cen, full_matrices=False)[2][:3].T
        assert np.allclose(np.abs([got[lv, i] for i in range(9)]), np.abs(want), atol=1e-8)


def test_residual_error_non_increasing(spark):
    emb = FX.vectors(spark, SF01).select("item_id", "embedding")
    cb, codes = Q.residual_kmeans(emb, [8, 8, 8], seed=2)
    enc = V.rq_encode(emb, cb)
    errs = [r["mse"] for r in V.level_errors(enc).orderBy("level").collect()]
    assert errs[0] >= errs[1] >= errs[2]
    # the fitted codes equal a re-encode with the fitted codebooks
    j = enc.select("item_id", F.col("codes").alias("re")).join(codes, "item_id")
    assert j.filter(F.col("re") != F.col("codes")).count() == 0


def test_sinkhorn_balances(spark):
    emb = FX.vectors(spark, SF01).select("item_id", "embedding")
    cb = FX.codebook(spark, SF01)
    plain = V.assign(emb, cb, level=0).groupBy("code").count().collect()
    sk = Q.sinkhorn_assign(emb, cb, eps=0.003, iters=3).groupBy("code").count().collect()
    assert sum(r["count"] for r in sk) == emb.count()
    assert max(r["count"] for r in sk) <= max(r["count"] for r in plain)


def test_kmeanspp_distinct_centers(spark):
    emb = FX.vectors(spark, SF01).select("item_id", "embedding")
    cb = Q.kmeanspp_seed(emb, 8, seed=3)
    m = V.codebook_matrices(cb)[0]
    assert m.shape == (8, 64)
    assert len({tuple(np.round(r, 9)) for r in m}) == 8


def test_pca_init_dims(spark):
    cb = Q.init_codebook(FX.codebook(spark, SF01), 8)
    assert {r["d"] for r in cb.select(F.size("vector").alias("d")).collect()} == {8}


def test_collision_repair_reduces_collisions(spark):
    from recsmith.operators import sid as D

    c = FX.codes(spark, SF01)
    before = D.collision_rate(c.select("item_id", "codes")).first()["collision_rate"]
    r = Q.repair_collisions(c.select("item_id", "embedding"), c.select("item_id", "codes"), FX.codebook(spark, SF01), rounds=3)
    after = D.collision_rate(r).first()["collision_rate"]
    assert r.count() == c.count()
    assert after < before
    # earlier levels are untouched
    j = r.withColumnRenamed("codes", "new").join(c.select("item_id", "codes"), "item_id")
    assert j.filter(F.slice("new", 1, 2) != F.slice("codes", 1, 2)).count() == 0


def test_best_codebook(spark):
    from recsmith.operators import sid as D

    log = spark.createDataFrame([("a", 0.2, 1.0), ("b", 0.1, 3.0), ("c", 0.1, 2.0), ("d", 0.5, 0.5)],
                                "run string, collision_rate double, loss double")
    r = D.best_codebook(log).first()
    assert r["best_by_collision"] == "c" and r["best_by_loss"] == "d"


def test_sinkhorn_sums_beyond_one_band(spark):
    """One batch whose sums leave the first band of 256 (more rows or rounds, or a far code) keeps every code."""
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(64, 6)), rng.normal(size=(5, 6)) * 2
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id bigint, embedding array<double>")
    cb = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(c)], "level int, code int, vector array<double>")
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    got = {r.item_id: r.code for r in Q.sinkhorn_assign(emb, cb, eps=0.002, iters=3).collect()}
    assert [got[i] for i in range(64)] == _plain_sinkhorn(d, 0.002, 3).tolist()


def test_log_sum_exp_keys_of_any_name(spark):
    from recsmith.operators.logsum import log_sum_exp

    rows = [(g, h, v) for g in (1, 2) for h in (3, 4) for v in (-700.0, 10.0 * g, 600.0 + h)]
    df = spark.createDataFrame(rows, "_band int, _b int, _v double")
    got = {(r["_band"], r["_b"]): r["lse"] for r in log_sum_exp(df, ["_band", "_b"], "_v").collect()}
    assert got.keys() == {(g, h) for g in (1, 2) for h in (3, 4)}
    assert all(abs(v - (600.0 + h)) < 1e-9 for (_, h), v in got.items())
