"""Iterative quantizer fitting.

Each iteration is a distributed pass over the vectors with a small broadcast
model (K centres); the per-iteration statistics are partial aggregates keyed by
code (K rows).  Lineage is cut with reliable checkpoints into the shared
``spark.checkpoint.dir`` between levels.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..session import cut_lineage
from . import vectors as V
from .balance import balanced_assign, costs, matrix, price_sample
from .logsum import log_sum_exp


def _codebook_df(spark, centers: np.ndarray, level: int) -> DataFrame:
    rows = [(level, i, [float(x) for x in c]) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, "level int, code int, vector array<double>")


def kmeans(emb: DataFrame, k: int, seed: int = 0, max_iter: int = 20, vec: str = "embedding", level: int = 0):
    """Plain k-means with ``pyspark.ml`` (k-means|| init); returns (codebook df, assigned df)."""
    data = emb.withColumn("_features", array_to_vector(F.col(vec)))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="_pred").fit(data)
    centers = np.asarray([c for c in model.clusterCenters()], dtype=np.float64)
    cb = _codebook_df(emb.sparkSession, centers, level)
    return cb, V.assign(emb, cb, vec=vec, level=level)


def kmeanspp_seed(emb: DataFrame, k: int, key: str = "item_id", vec: str = "embedding", seed: int = 0, power: int = 2) -> DataFrame:
    """C20: k-means++ seeding.  Each round keeps the running min squared distance to the
    chosen centres and picks the next centre by the exponential-race key
    ``-ln(u) / w`` with ``w = d^(power/2 * 2)`` (power 2: D^2, power 4: the reference's D^4, T23)."""
    spark = emb.sparkSession
    first = emb.withColumn("_h", X.portable_hash(key, seed=seed)).orderBy("_h", key).limit(1).select(vec).collect()
    centers = [np.asarray(first[0][0], dtype=np.float64)]
    cur = emb.select(key, vec).withColumn("_md", F.lit(float("inf")))
    for r in range(1, k):
        c = centers[-1].tolist()
        cur = cur.withColumn("_md", F.least("_md", V.sq_l2_direct(vec, F.array(*[F.lit(x) for x in c]))))
        cur = cut_lineage(cur) if r % 8 == 0 else cur
        u = X.unit_interval(X.portable_hash(key, seed=seed + r))
        w = F.pow(F.col("_md"), F.lit(power / 2.0))
        pick = cur.filter(F.col("_md") > 0).withColumn("_race", -F.log(u) / w).orderBy("_race", key).limit(1).select(vec).collect()
        if not pick:
            break
        centers.append(np.asarray(pick[0][0], dtype=np.float64))
    return _codebook_df(spark, np.stack(centers), 0)


def kmeans_parallel_seed(emb: DataFrame, k: int, key: str = "item_id", vec: str = "embedding", seed: int = 0, power: int = 2, rounds: int = 5,
                         oversample: int | None = None) -> DataFrame:
    """C20 in a number of passes that does not follow ``k``: k-means|| seeding.

    From one row on, each of ``rounds`` passes draws the ``oversample`` (default ``2 k``) rows first in an
    exponential race weighted by their distance to the rows drawn so far (``power`` as in
    ``kmeanspp_seed``); a task passes on no more than that many.  One more pass weighs every drawn row by the rows nearest to it, and
    the driver reclusters these ``1 + rounds * oversample`` weighted rows to ``k`` centres by k-means++ and Lloyd steps.
    Fewer distinct vectors than ``k`` give as many centres.
    """
    spark = emb.sparkSession
    draw = oversample or 2 * k
    rows = emb.select(key, F.col(vec).cast("array<double>").alias(vec))
    first = rows.withColumn("_h", X.portable_hash(key, seed=seed)).orderBy("_h", key).limit(1).select(vec).collect()
    drawn = matrix([first[0][0]])
    schema = T.StructType([rows.schema[key], rows.schema[vec], T.StructField("_race", T.DoubleType())])
    for r in range(rounds):
        bc = spark.sparkContext.broadcast(drawn)

        def race(batches, bc=bc):
            best = None
            for pdf in batches:
                if len(pdf):
                    far = _nearest_gap(matrix(pdf[vec]), bc.value) ** (power / 2.0)
                    with np.errstate(divide="ignore"):
                        part = pdf[[key, vec]].assign(_race=np.where(far > 0, -np.log(pdf["_u"].to_numpy()) / far, np.inf))
                    part = part[np.isfinite(part["_race"])]
                    best = (part if best is None else pd.concat([best, part])).nsmallest(draw, "_race", keep="all")
            if best is not None:
                yield best

        u = X.unit_interval(X.portable_hash(key, seed=seed + r + 1))
        picked = rows.withColumn("_u", u).mapInPandas(race, schema).orderBy("_race", key).limit(draw).select(vec).collect()
        if not picked:
            break
        drawn = np.unique(np.concatenate([drawn, matrix([p[0] for p in picked])]), axis=0)
    near = V.assign(rows, _codebook_df(spark, drawn, 0), vec=vec).groupBy("code").count().collect()  # a row for each drawn vector
    weight = np.zeros(len(drawn))
    weight[[r["code"] for r in near]] = [r["count"] for r in near]
    return _codebook_df(spark, _recluster(drawn, weight, k, seed, power), 0)


def _nearest_gap(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest centre, exactly zero at the centre itself."""
    return ((x - centers[costs(x, centers).argmin(axis=1)]) ** 2).sum(axis=1)


def _recluster(x: np.ndarray, weight: np.ndarray, k: int, seed: int, power: int = 2, starts: int = 8, steps: int = 20) -> np.ndarray:
    """Weighted k-means of a few vectors: k-means++ starts and Lloyd steps, the cheapest of ``starts``."""
    rng = np.random.default_rng(seed)
    best = (np.inf, x)
    for _ in range(starts if len(x) > k else 1):
        at = [int(rng.choice(len(x), p=weight / weight.sum()))]
        while len(at) < min(k, len(x)):
            far = _nearest_gap(x, x[at]) ** (power / 2.0) * np.maximum(weight, 1e-9)
            if not far.sum() > 0:
                break
            at.append(int(rng.choice(len(x), p=far / far.sum())))
        centers = x[at].copy()
        for _ in range(steps):
            code = costs(x, centers).argmin(axis=1)
            total = np.bincount(code, weight, len(centers))
            sums = np.zeros_like(centers)
            np.add.at(sums, code, x * weight[:, None])
            moved = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-300)[:, None], centers)
            if np.array_equal(moved, centers):
                break
            centers = moved
        loss = float((_nearest_gap(x, centers) * weight).sum())
        best = min(best, (loss, centers), key=lambda f: f[0])
    return best[1]


def balanced_kmeans(emb: DataFrame, k: int, key: str = "item_id", vec: str = "embedding", max_iter: int = 100,
                    seed: int = 0, level: int = 0, price_rounds: int = 8, tol: float = 1e-4, n_init: int = 3):
    """Size-bounded k-means; every cluster size within ``[max(1, n//k - 1), n//k + 1]``.

    Lloyd iterations whose assignment is the cheapest inside the bounds (``balanced_assign``: a min-cost
    flow between codes), from k-means|| seeds, until the centres move less than ``tol`` (relative to their spread) or
    ``max_iter``; the best of ``n_init`` starts by the sum of squared distances.  Every item is
    placed: the sizes add up to n.  With fewer distinct vectors than codes the spare centres repeat chosen ones.
    Returns (codebook, assigned).
    """
    n = emb.count()
    if n < k:
        raise ValueError("balanced k-means needs n >= k")
    data = cut_lineage(emb.select(key, vec))
    sample = price_sample(data, n, key, vec)
    # starts do not depend on each other: their small jobs share the cluster
    with ThreadPoolExecutor(n_init) as pool:
        runs = list(pool.map(lambda i: _balanced_run(data, n, k, key, vec, max_iter, seed + 1000 * i, price_rounds, tol, sample), range(n_init)))
    _, centers, assigned = min(runs, key=lambda found: found[0])
    return _codebook_df(emb.sparkSession, centers, level), assigned


def _balanced_run(data, n, k, key, vec, max_iter, seed, price_rounds, tol, sample=None):
    centers = V.codebook_matrices(kmeans_parallel_seed(data, k, key, vec, seed))[0]
    if len(centers) < k:  # fewer distinct vectors than codes
        centers = np.concatenate([centers, centers[np.arange(k - len(centers)) % len(centers)]])
    prices = None
    for _ in range(max(1, max_iter)):
        assigned, prices = balanced_assign(data, centers, n, key, vec, prices, price_rounds, sample)
        means = V.mean_vector(assigned, "code", vec, "vector").select("code", "vector").limit(k).collect()  # K rows
        moved = centers.copy()
        for r in means:
            moved[r["code"]] = r["vector"]
        shift = float(((moved - centers) ** 2).sum()) / max(float(moved.var(axis=0).sum()) * k, 1e-300)
        centers = moved
        if shift <= tol:
            break
    books = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])
    loss = assigned.agg(F.sum(V.sq_l2_direct(vec, F.element_at(books, F.col("code") + 1)))).first()[0]
    return float(loss), centers, assigned


def residual_kmeans(emb: DataFrame, ks, key: str = "item_id", vec: str = "embedding", seed: int = 0,
                    balanced: bool = False, max_iter: int = 20):
    """C11: fit one k-means per level on the residuals of the previous levels.

    Level seeds derive from the base seed; the residual of each level is written to
    the shared checkpoint folder so no level recomputes from raw.  Returns
    (codebook df over all levels, codes df ``key, codes array<int>``).
    """
    spark = emb.sparkSession
    cur = emb.select(key, F.col(vec).cast("array<double>").alias("_res"))
    books = []
    codes = emb.select(key).withColumn("codes", F.array().cast("array<int>"))
    for lvl, k in enumerate(ks):
        if balanced:
            cb, assigned = balanced_kmeans(cur, k, key, "_res", max_iter=max_iter, seed=seed + lvl, level=lvl)
        else:
            cb, assigned = kmeans(cur, k, seed=seed + lvl, max_iter=max_iter, vec="_res", level=lvl)
        books.append(cb)
        cbl = cb.select(F.col("code"), F.col("vector").alias("_cv"))
        nxt = assigned.select(key, "_res", "code").join(F.broadcast(cbl), "code")  # K rows
        nxt = cut_lineage(nxt.select(key, "code", V.sub("_res", "_cv").alias("_res")))
        codes = codes.join(nxt.select(key, "code"), key).select(key, F.concat("codes", F.array(F.col("code").cast("int"))).alias("codes"))
        codes = cut_lineage(codes)
        cur = nxt.select(key, "_res")
    allbooks = books[0]
    for b in books[1:]:
        allbooks = allbooks.unionByName(b)
    return allbooks, codes


#: Batches of at most so many items are assigned inside one task; larger ones in distributed rounds.
SINKHORN_TASK_ITEMS = 8192


def _row_normal(lq: np.ndarray, u: np.ndarray) -> np.ndarray:
    s = lq - u
    top = s.max(axis=1, keepdims=True)
    return s - top - np.log(np.exp(s - top).sum(axis=1, keepdims=True))


def _log_sum(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column maxima and the sums of exponentials above them."""
    top = s.max(axis=0)
    return top, np.exp(s - top).sum(axis=0)


def sinkhorn_assign(emb: DataFrame, codebook: DataFrame, key: str = "item_id", vec: str = "embedding", level: int = 0,
                    eps: float = 0.003, iters: int = 50, batch: str | None = None) -> DataFrame:
    """Sinkhorn balanced assignment in the log domain.

    Distances are centred to [-1, 1] per batch (C17) and ``log Q = -d / eps``.  Each round
    normalises every item over its codes, then every code over the items of its batch;
    the code is the argmax of the final plan (ties: the lowest code).

    An item is one row with K numbers, and what a round changes is one K-vector per batch:
    what the codes have been divided by.  Tasks add up their items' shares by code, so a
    round moves K sums per task and batch, never the items.  Without ``batch`` all rows are one batch whose
    K-vector the driver passes on.  With ``batch``, batches of up to
    ``SINKHORN_TASK_ITEMS`` are done inside a task; larger ones share the rounds.
    """
    centers = V.codebook_matrices(codebook.filter(F.col("level") == level))[level]
    bc = emb.sparkSession.sparkContext.broadcast(centers)  # size checked by codebook_matrices
    b = batch or "_b"
    rows = emb if batch else emb.withColumn("_b", F.lit(0))
    kind, group = rows.schema[key], rows.schema[b]

    def distances(batches):
        c = bc.value
        for pdf in batches:
            if len(pdf):
                x = matrix(pdf[vec])
                yield pdf[[key, b]].assign(d=list(np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)))

    numbers = T.ArrayType(T.DoubleType())
    items = cut_lineage(rows.select(key, b, vec).mapInPandas(distances, T.StructType([kind, group, T.StructField("d", numbers)])))
    span = items.groupBy(b).agg(F.max(F.array_max("d")).alias("_hi"), F.min(F.array_min("d")).alias("_lo"), F.count(F.lit(1)).alias("_n"))
    mid, half = (F.col("_hi") + F.col("_lo")) / 2, (F.col("_hi") - F.col("_lo")) / 2 + F.lit(1e-5)
    items = items.join(span, b).select(key, b, "_n", F.transform("d", lambda x: -((x - mid) / half) / F.lit(eps)).alias("lq"))
    items = cut_lineage(items)
    out = T.StructType([kind, T.StructField("code", T.IntegerType())])

    def in_task(pdf):
        lq, u = matrix(pdf["lq"]), np.zeros(len(centers))
        for _ in range(iters):
            top, total = _log_sum(_row_normal(lq, u))
            u = u + top + np.log(total)
        return pdf[[key]].assign(code=(lq - u).argmax(axis=1).astype(np.int32))

    large = items
    small = None
    if batch:
        small = items.filter(F.col("_n") <= SINKHORN_TASK_ITEMS).groupBy(b).applyInPandas(in_task, out)
        large = items.filter(F.col("_n") > SINKHORN_TASK_ITEMS)
        if large.isEmpty():
            return small
    done = _distributed_rounds(large, b, len(centers), iters, batch is None).select(key, "code")
    return done if small is None else small.unionByName(done)


def _distributed_rounds(items: DataFrame, b: str, k: int, iters: int, one_batch: bool) -> DataFrame:
    """Sinkhorn rounds over batches of any size; ``u`` is one K-vector per batch."""
    cols = cut_lineage(items.select(b).distinct().withColumn("u", F.array_repeat(F.lit(0.0), k)))
    partial = T.StructType([items.schema[b], T.StructField("code", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def shares(batches):
        for pdf in batches:
            for name, part in pdf.groupby(b, sort=False):
                u = np.asarray(part["u"].iloc[0], dtype=np.float64)
                top, total = _log_sum(_row_normal(matrix(part["lq"]), u))
                with np.errstate(divide="ignore"):
                    yield pd.DataFrame({b: np.repeat(part[b].iloc[:1].to_numpy(), k), "code": np.arange(k, dtype=np.int32), "v": u + top + np.log(total)})

    # with one batch its K-vector goes to every task; batches of their own are joined by their name
    beside = F.broadcast if one_batch else (lambda frame: frame)
    for _ in range(iters):
        parts = items.join(beside(cols), b).select(b, "lq", "u").mapInPandas(shares, partial)
        # K numbers for each Arrow batch, merged by code with partial aggregates (nothing is gathered);
        # what the codes were divided by before is inside the numbers already
        new = log_sum_exp(parts, [b, "code"], "v", "u")
        cols = new.groupBy(b).agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "u"))), lambda x: x["u"]).alias("u"))  # K rows
        cols = cut_lineage(cols)
    best = F.zip_with("lq", "u", lambda x, u: x - u)
    return items.join(beside(cols), b).withColumn("code", (F.array_position(best, F.array_max(best)) - 1).cast("int"))


def init_codebook(old: DataFrame, target_dim: int) -> DataFrame:
    """New codebook from a prior one; when the dimension differs, each level's vectors are
    centred and projected on their own principal axes (one PCA per level)."""
    d = old.select(F.size("vector").alias("d")).first()["d"]
    if d == target_dim:
        return old
    out = None
    for level in sorted(r["level"] for r in old.select("level").distinct().collect()):
        book = old.filter(F.col("level") == level)
        mean = V.mean_vector(book, "level", "vector", "_mu").select("_mu")
        feats = book.crossJoin(F.broadcast(mean)).withColumn("_f", array_to_vector(V.sub("vector", "_mu")))  # one row
        model = PCA(k=target_dim, inputCol="_f", outputCol="_p").fit(feats)
        part = model.transform(feats).select("level", "code", vector_to_array("_p").alias("vector"))
        out = part if out is None else out.unionByName(part)
    return out


def repair_collisions(emb: DataFrame, codes: DataFrame, codebook: DataFrame, key: str = "item_id", vec: str = "embedding",
                      rounds: int = 20, eps: float = 0.003, iters: int = 50) -> DataFrame:
    """Iterative collision repair.

    Each round finds the items whose full code path is shared, re-assigns their last
    level with Sinkhorn balanced assignment batched by colliding group (so members
    of a group are spread over codes), and replaces the last code.  Earlier levels
    keep their plain nearest-codeword codes.  Stops after ``rounds`` or when no path
    is shared.  Returns ``key, codes``.
    """
    mats = V.codebook_matrices(codebook)
    last = max(mats)
    prefix_book = codebook.filter(F.col("level") < last)
    cur = codes.select(key, "codes")
    base = emb.select(key, F.col(vec).cast("array<double>").alias(vec))
    if last > 0:
        res = V.rq_encode(base, prefix_book, vec=vec, keep_residual=True).select(key, F.col("residual").alias("_res"))
    else:
        res = base.select(key, F.col(vec).alias("_res"))
    res = cut_lineage(res)
    for _ in range(rounds):
        path = F.array_join(F.transform("codes", lambda c: c.cast("string")), ",")
        counts = cur.groupBy(path.alias("_path")).agg(F.count(F.lit(1)).alias("_n"))
        coll = cur.withColumn("_path", path).join(counts.filter(F.col("_n") > 1), "_path")
        if coll.limit(1).count() == 0:
            break
        todo = coll.select(key, "_path").join(res, key)
        new = sinkhorn_assign(todo.withColumnRenamed("_res", vec), codebook, key, vec, level=last, eps=eps, iters=iters,
                              batch="_path")
        upd = cur.join(new.withColumnRenamed("code", "_new"), key, "left")
        cur = cut_lineage(upd.select(key, F.when(F.col("_new").isNull(), F.col("codes")).otherwise(
            F.concat(F.slice("codes", 1, last), F.array(F.col("_new").cast("int")))).alias("codes")))
    return cur
