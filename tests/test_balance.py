"""Min-cost balanced assignment, k-means|| seeds and mergeable log-sum-exp against plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recsmith.operators import balance as B
from recsmith.operators import quantize as Q
from recsmith.operators import trie as TR
from recsmith.operators import vectors as V
from recsmith.operators.logsum import log_sum_exp
from recsmith.plans import fixtures as FX

from .conftest import SF01


def cheapest_placing(cost: np.ndarray, lo: int, hi: int) -> float:
    """Least total cost with sizes in bounds: items against slots (Hungarian method); the first ``lo`` slots of a code must be taken."""
    n, k = cost.shape
    must = float(np.abs(cost).max()) * n + 1.0
    slots = np.concatenate([np.repeat(cost - must, lo, axis=1), np.repeat(cost, hi - lo, axis=1)], axis=1)
    m = slots.shape[1]
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, np.int64)  # row of a column, 0 free
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            cur = slots[i0 - 1] - u[i0] - v[1:]
            free = ~used[1:]
            closer = free & (cur < low[1:])
            low[1:][closer], way[1:][closer] = cur[closer], j0
            j1 = int(np.where(free, low[1:], np.inf).argmin()) + 1
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[1:][free] -= step
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return sum(slots[match[j] - 1, j - 1] + (must if j <= lo * k else 0.0) for j in range(1, m + 1) if match[j])


def _frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id bigint, embedding array<double>").repartition(3)


def _cost(rows, centers):
    return sum(float(((np.asarray(r["embedding"]) - centers[r["code"]]) ** 2).sum()) for r in rows)


@pytest.mark.parametrize("listed,rounds", [(64, 8), (3, 0)])
def test_assignment_costs_as_little_as_an_exact_solver(spark, monkeypatch, listed, rounds):
    monkeypatch.setattr(B, "LIST_ITEMS", listed)
    rng = np.random.default_rng(listed)
    x = np.concatenate([rng.normal(size=(70, 5)), rng.normal(size=(20, 5)) * 0.2 + 3, np.repeat(rng.normal(size=(1, 5)), 7, axis=0)])
    centers = np.concatenate([rng.normal(size=(5, 5)), rng.normal(size=(1, 5)) * 9])
    coded, _ = B.balanced_assign(_frame(spark, x), centers, len(x), "item_id", "embedding", price_rounds=rounds)
    rows = coded.collect()
    size = np.bincount([r["code"] for r in rows], minlength=6)
    lo, hi = len(x) // 6 - 1, len(x) // 6 + 1
    assert len({r["item_id"] for r in rows}) == len(rows) == len(x) and size.min() >= lo and size.max() <= hi
    assert _cost(rows, centers) == pytest.approx(cheapest_placing(B.costs(x, centers), lo, hi), rel=1e-9)


def test_500_rows_of_the_table_within_bounds_at_the_exact_cost(spark):
    emb = FX.vectors(spark, SF01).select("item_id", "embedding")
    x = B.matrix([r["embedding"] for r in emb.orderBy("item_id").limit(500).collect()])
    centers = x[:16]
    coded, _ = B.balanced_assign(_frame(spark, x), centers, 500, "item_id", "embedding")
    rows = coded.collect()
    size = np.bincount([r["code"] for r in rows], minlength=16)
    assert size.min() >= 500 // 16 - 1 and size.max() <= 500 // 16 + 1
    assert _cost(rows, centers) == pytest.approx(cheapest_placing(B.costs(x, centers), 500 // 16 - 1, 500 // 16 + 1), rel=1e-6)


def test_flow_stops_at_a_short_list_and_goes_on_with_the_next():
    rng = random.Random(2)
    dist = np.array([[rng.random() for _ in range(3)] for _ in range(30)])
    code = np.zeros(30, np.int64)
    for width, done in ((3, False), (30, True)):
        listed = {(0, b): sorted(range(30), key=lambda i: dist[i, b] - dist[i, 0])[:width] for b in (1, 2)}
        full = {(a, b) for a in range(3) for b in range(3) if a != 0 or width == 30}
        flow = B.ResidualFlow([30, 0, 0], 9, 11, listed, code, dist, full)
        assert flow.run() is done and flow.size.sum() == 30
    assert flow.size.min() >= 9 and flow.size.max() <= 11
    assert dist[np.arange(30), flow.code].sum() == pytest.approx(cheapest_placing(dist, 9, 11))


def test_parallel_seeds_are_no_worse_and_their_passes_do_not_follow_k(spark, monkeypatch):
    emb = FX.vectors(spark, SF01).select("item_id", "embedding")
    x = B.matrix([r["embedding"] for r in emb.collect()])
    loss = lambda cb: B.costs(x, V.codebook_matrices(cb)[0]).min(axis=1).sum()
    one_by_one = np.mean([loss(Q.kmeanspp_seed(emb, 8, seed=s)) for s in range(3)])
    assert np.mean([loss(Q.kmeans_parallel_seed(emb, 8, seed=s)) for s in range(3)]) <= one_by_one
    passes = []
    spread = Q._nearest_gap
    monkeypatch.setattr(Q, "_codebook_df", lambda spark, c, level, f=Q._codebook_df: passes.append(len(c)) or f(spark, c, level))
    for k in (4, 32):
        passes.clear()
        assert Q.kmeans_parallel_seed(emb, k, seed=1, rounds=3).count() == k
        assert len(passes) == 2 and passes[0] <= 1 + 3 * 2 * k
    assert spread(x[:3], x).max() == 0


def test_parallel_seeds_of_few_distinct_vectors(spark):
    two = _frame(spark, np.array([[float(i % 2), 1.0] for i in range(40)]))
    assert sorted(r["vector"] for r in Q.kmeans_parallel_seed(two, 5).collect()) == [[0.0, 1.0], [1.0, 1.0]]


def test_log_sum_exp_merges_any_range(spark):
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(size=50), "wide": rng.uniform(-5000, 5000, 200), "high": np.array([1e8, 1e8 + 1, 1e8 - 700]), "low": np.array([-1e6, -1e6 - 2]), "one": np.array([3.25])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("none", None), ("inf", math.inf), ("inf", 1.0), ("neg", -math.inf), ("mix", -math.inf), ("mix", 2.0)]
    got = {r["k"]: r["lse"] for r in log_sum_exp(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v").collect()}
    for k, v in groups.items():
        assert got[k] == pytest.approx(v.max() + math.log(np.exp(v - v.max()).sum()), rel=1e-14, abs=1e-12), k
    assert got["none"] is None and got["inf"] == math.inf and got["neg"] == -math.inf and got["mix"] == pytest.approx(2.0)


def test_vocabulary_beyond_the_broadcast_bound_goes_in_parts(spark):
    vocab = spark.createDataFrame([(f"<t_{i}>",) for i in range(200)], "token string")
    prefixes = spark.createDataFrame([(1, ""), (2, "x")], "query_id bigint, prefix string")
    whole = TR.over_vocabulary(prefixes, vocab)
    parts = TR.over_vocabulary(prefixes, vocab, max_bytes=4_000)
    assert parts.count() == whole.count() == 400 and parts.exceptAll(whole).count() == 0
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("Join Cross") > 2


def test_sinkhorn_fifty_rounds_in_distributed_rounds(spark, monkeypatch):
    monkeypatch.setattr(Q, "SINKHORN_TASK_ITEMS", 10)
    rng = np.random.default_rng(11)
    x, c = rng.normal(size=(90, 6)), rng.normal(size=(7, 6))
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    mid = (d.max() + d.min()) / 2
    lq = -((d - mid) / (d.max() - mid + 1e-5)) / 0.05
    for _ in range(50):  # rows, then columns, in the log domain
        lq = lq - np.log(np.exp(lq - lq.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - lq.max(axis=1, keepdims=True)
        lq = lq - np.log(np.exp(lq - lq.max(axis=0)).sum(axis=0)) - lq.max(axis=0)
    cb = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(c)], "level int, code int, vector array<double>")
    got = {r["item_id"]: r["code"] for r in Q.sinkhorn_assign(_frame(spark, x), cb, eps=0.05, iters=50).collect()}
    assert [got[i] for i in range(90)] == lq.argmax(axis=1).tolist()
    plan = log_sum_exp(spark.range(9).select((F.col("id") % 2).alias("k"), F.col("id").alias("v")), "k", "v")
    assert plan.count() == 2


def test_prices_are_foreseen_for_larger_tables(spark, monkeypatch):
    """However far from balance a large table is, a few counted rounds leave few rows to move, at the same cost."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 4)) * [1, 1, 3, 1]
    centers, n = x[:6] * 0.3, len(x)
    data = _frame(spark, x)
    monkeypatch.setattr(B, "PRICE_ROWS", 600)
    monkeypatch.setattr(B, "LIST_ITEMS", 8)
    assert B.price_sample(data.limit(1200), 1200, "item_id", "embedding") is None
    sample = B.price_sample(data, n, "item_id", "embedding")
    assert sample.shape == (600, 4)
    bc, prices, rounds = spark.sparkContext.broadcast(centers), np.zeros(6), 0
    while True:
        size = B._sizes(data, bc, prices, "embedding")
        assert size.tolist() == np.bincount((B.costs(x, centers) + prices).argmin(axis=1), minlength=6).tolist()
        if np.abs(size - n // 6).sum() <= 6 * 8:
            break
        prices, rounds = B._foreseen(sample, centers, prices, size), rounds + 1
    assert 1 <= rounds <= 4
    plain, _ = B.balanced_assign(data, centers, n, "item_id", "embedding")
    coded, _ = B.balanced_assign(data, centers, n, "item_id", "embedding", sample=sample)
    assert sorted(r["count"] for r in coded.groupBy("code").count().collect())[0] >= n // 6 - 1
    assert abs(_cost(coded.collect(), centers) - _cost(plain.collect(), centers)) < 1e-6
