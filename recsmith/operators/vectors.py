"""Vector operators.

Row-scale vectors stay in the executors.  Only model-sized objects (codebooks,
projection weights) are collected, after a size check, and shipped with
``SparkContext.broadcast``.  Distance work on many vectors runs in Arrow batches
(``mapInPandas`` + numpy matmul); small relational forms exist for the oracle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upper bound for anything collected to the driver and broadcast (bytes of float64).
MAX_BROADCAST_BYTES = 512 * 1024 * 1024


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- C1, C2
def sanitize(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Replace NaN and +-Inf by 0; adds ``n_nan``/``n_inf`` per row for reporting."""
    v = F.col(col)
    return (
        df.withColumn("n_nan", F.size(F.filter(v, lambda x: F.isnan(x))).cast("bigint"))
        .withColumn("n_inf", F.size(F.filter(v, lambda x: ~F.isnan(x) & (F.abs(x) == F.lit(float("inf"))))).cast("bigint"))
        .withColumn(
            col,
            F.transform(v, lambda x: F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x.cast("double"))),
        )
    )


def sanitize_report(df: DataFrame, col: str = "embedding") -> DataFrame:
    """C1 counts: rows, NaN and Inf totals (one partial aggregate)."""
    s = sanitize(df, col)
    return s.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("n_nan").cast("bigint").alias("n_nan"),
        F.sum("n_inf").cast("bigint").alias("n_inf"),
    )


def vector_stats(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Matrix shape, min, max, mean over all elements, aggregated per row first."""
    v = F.col(col)
    per_row = df.select(
        F.size(v).alias("_d"),
        F.array_min(v).cast("double").alias("_mn"),
        F.array_max(v).cast("double").alias("_mx"),
        F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")).alias("_s"),
    )
    return per_row.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("_d").cast("bigint").alias("dim"),
        F.min("_mn").alias("min_value"),
        F.max("_mx").alias("max_value"),
        (F.sum("_s") / F.sum("_d")).alias("mean_value"),
    )


# ---------------------------------------------------------------- C3, C4
def mean_pool(token_vecs: DataFrame, key: str = "key", vec: str = "vector", mask: str = "mask", eps: float = 1e-9) -> DataFrame:
    """Masked mean of token vectors per key: ``sum(v*m) / max(sum(m), eps)``.

    Runs as a partial aggregate (``Summarizer``), so a key with many tokens is
    combined map-side; keys whose tokens are all masked get the zero vector.
    """
    keys = token_vecs.select(key, F.size(vec).alias("_d")).groupBy(key).agg(F.max("_d").alias("_d"))
    live = token_vecs.filter(F.col(mask) != 0)
    pooled = (
        live.withColumn("_w", F.col(mask).cast("double"))
        .withColumn("_v", array_to_vector(F.col(vec)))
        .groupBy(key)
        .agg(Summarizer.mean(F.col("_v"), F.col("_w")).alias("_m"))
        .select(key, vector_to_array("_m").alias("pooled"))
    )
    return keys.join(pooled, key, "left").select(
        key, F.coalesce("pooled", F.array_repeat(F.lit(0.0), F.col("_d"))).alias("pooled")
    )


def mean_vector(df: DataFrame, keys, vec: str = "embedding", name: str = "mean") -> DataFrame:
    """C4: group mean vector (partial aggregate via ``Summarizer``)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return (
        df.withColumn("_v", array_to_vector(F.col(vec)))
        .groupBy(*keys)
        .agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n"))
        .select(*keys, vector_to_array("_m").alias(name), "n")
    )


# ---------------------------------------------------------------- C5, C6 (column functions)
def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sq_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine(a, b, eps: float = 1e-8) -> Column:
    """Cosine similarity with each norm clamped at ``eps`` (torch semantics)."""
    na = F.greatest(F.sqrt(sq_norm(a)), F.lit(eps))
    nb = F.greatest(F.sqrt(sq_norm(b)), F.lit(eps))
    return dot(a, b) / (na * nb)


def sq_l2(a, b) -> Column:
    """Squared L2 distance in expanded form ``|a|^2 - 2ab + |b|^2``."""
    return sq_norm(a) - F.lit(2.0) * dot(a, b) + sq_norm(b)


def sq_l2_direct(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") + y.cast("double"))


# ---------------------------------------------------------------- codebooks
def codebook_matrices(codebook: DataFrame, max_levels: int = 16, max_codes: int = 65536) -> dict[int, np.ndarray]:
    """Collect a codebook (level, code, vector) into ``{level: K x d}``.

    A codebook is model-sized (L x K x d); the count and the byte size are checked
    before anything is pulled to the driver.
    """
    n = codebook.count()
    if n > max_levels * max_codes:
        raise ValueError(f"codebook has {n} rows; refusing to collect")
    rows = codebook.select("level", "code", "vector").collect()
    by_level: dict[int, list] = {}
    for r in rows:
        by_level.setdefault(int(r["level"]), []).append((int(r["code"]), r["vector"]))
    out = {}
    total = 0
    for lvl, items in by_level.items():
        items.sort(key=lambda t: t[0])
        codes = [c for c, _ in items]
        if codes != list(range(len(codes))):
            raise ValueError(f"codes of level {lvl} must be 0..K-1")
        m = np.asarray([np.asarray(v, dtype=np.float64) for _, v in items], dtype=np.float64)
        total += m.nbytes
        out[lvl] = m
    if total > MAX_BROADCAST_BYTES:
        raise ValueError(f"codebook of {total} bytes exceeds the broadcast bound")
    return out


def _argmin_rows(x: np.ndarray, c: np.ndarray, c_sq: np.ndarray, tile: int = 16384):
    """Nearest codeword per row (first index on ties) and its exact squared distance."""
    codes = np.empty(x.shape[0], dtype=np.int64)
    for s in range(0, x.shape[0], tile):
        xb = x[s : s + tile]
        d = (xb * xb).sum(1)[:, None] - 2.0 * (xb @ c.T) + c_sq[None, :]
        codes[s : s + tile] = np.argmin(d, axis=1)
    diff = x - c[codes]
    return codes, (diff * diff).sum(1)


def assign(df: DataFrame, codebook: DataFrame, vec: str = "embedding", level: int = 0) -> DataFrame:
    """Nearest codeword of one level, in Arrow batches with a broadcast codebook."""
    mats = codebook_matrices(codebook.filter(F.col("level") == level))
    c = mats[level]
    bc = df.sparkSession.sparkContext.broadcast(c)
    out_schema = T.StructType(df.schema.fields + [T.StructField("code", T.IntegerType()), T.StructField("dist", T.DoubleType())])

    def run(batches):
        cb = bc.value
        c_sq = (cb * cb).sum(1)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[vec].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy())
            codes, dist = _argmin_rows(x, cb, c_sq)
            pdf = pdf.assign(code=codes.astype(np.int32), dist=dist)
            yield pdf

    return df.mapInPandas(run, out_schema)


def assign_relational(df: DataFrame, codebook: DataFrame, key: str, vec: str = "embedding", level: int = 0) -> DataFrame:
    """C7 relational form: broadcast cross join of a bounded codebook, then
    ``min(struct(dist, code))`` per row (first code on ties)."""
    codebook_matrices(codebook.filter(F.col("level") == level))  # size check before broadcasting
    cb = F.broadcast(codebook.filter(F.col("level") == level).select(F.col("code"), F.col("vector").alias("_cv")))
    pairs = df.select(key, vec).crossJoin(cb).withColumn("_dist", sq_l2_direct(vec, "_cv"))
    best = pairs.groupBy(key).agg(F.min(F.struct("_dist", "code")).alias("_b"))
    return best.select(key, F.col("_b.code").alias("code"), F.col("_b._dist").alias("dist"))


def assign_candidates(df: DataFrame, row: str, code: str = "code", vec: str = "embedding", cand_vec: str = "cand_vector") -> DataFrame:
    """Nearest among per-row candidate vectors (rows: row key, candidate code, both vectors)."""
    d = df.withColumn("_dist", sq_l2_direct(vec, cand_vec))
    best = d.groupBy(row).agg(F.min(F.struct("_dist", code)).alias("_b"))
    return best.select(row, F.col(f"_b.{code}").alias(code), F.col("_b._dist").alias("dist"))


def rq_encode(df: DataFrame, codebook: DataFrame, vec: str = "embedding", keep_residual: bool = False,
              residual_col: str = "residual") -> DataFrame:
    """Residual encode over all codebook levels in one Arrow pass.

    Adds ``codes array<int>`` (and optionally the final residual and per-level
    squared error ``level_err array<double>``).
    """
    mats = codebook_matrices(codebook)
    levels = sorted(mats)
    bc = df.sparkSession.sparkContext.broadcast([mats[l] for l in levels])
    fields = df.schema.fields + [T.StructField("codes", T.ArrayType(T.IntegerType())),
                                 T.StructField("level_err", T.ArrayType(T.DoubleType()))]
    if keep_residual:
        fields.append(T.StructField(residual_col, T.ArrayType(T.DoubleType())))
    out_schema = T.StructType(fields)

    def run(batches):
        books = bc.value
        sqs = [(b * b).sum(1) for b in books]
        for pdf in batches:
            if len(pdf) == 0:
                continue
            r = np.stack(pdf[vec].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy())
            all_codes = []
            errs = []
            for b, bsq in zip(books, sqs):
                codes, dist = _argmin_rows(r, b, bsq)
                r = r - b[codes]
                all_codes.append(codes)
                errs.append(dist)
            codes_m = np.stack(all_codes, axis=1).astype(np.int32)
            err_m = np.stack(errs, axis=1)
            pdf = pdf.assign(codes=list(codes_m), level_err=list(err_m))
            if keep_residual:
                pdf[residual_col] = list(r)
            yield pdf

    return df.mapInPandas(run, out_schema)


def rq_decode(codes: DataFrame, codebook: DataFrame, key: str, codes_col: str = "codes") -> DataFrame:
    """reconstruction = sum over levels of the chosen codewords.

    A lookup per row in Arrow batches with the size-checked broadcast codebook; no shuffle.
    """
    mats = codebook_matrices(codebook)
    bc = codes.sparkSession.sparkContext.broadcast([mats[l] for l in sorted(mats)])
    schema = T.StructType([codes.schema[key], T.StructField("recon", T.ArrayType(T.DoubleType()))])

    def run(batches):
        books = bc.value
        for pdf in batches:
            if len(pdf):
                chosen = [np.asarray(c, dtype=np.int64) for c in pdf[codes_col]]
                yield pdf[[key]].assign(recon=[sum(books[l][i] for l, i in enumerate(c[: len(books)])) for c in chosen])

    return codes.select(key, codes_col).mapInPandas(run, schema)


def recon_error(emb: DataFrame, recon: DataFrame, key: str, vec: str = "embedding", recon_col: str = "recon") -> DataFrame:
    """C14: reconstruction MSE and L1 over all elements."""
    j = emb.select(key, vec).join(recon.select(key, recon_col), key)
    per = j.select(
        F.size(vec).alias("_d"),
        sq_l2_direct(vec, recon_col).alias("_se"),
        F.aggregate(F.zip_with(F.col(vec), F.col(recon_col), lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x).alias("_ae"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.sum("_se") / F.sum("_d")).alias("mse"),
        (F.sum("_ae") / F.sum("_d")).alias("l1"),
    )


def level_errors(encoded: DataFrame, err_col: str = "level_err", vec: str = "embedding") -> DataFrame:
    """C14/C15/C16 inputs: per-level residual MSE (mean over elements)."""
    ex = encoded.select(F.size(vec).alias("_d"), F.posexplode(err_col).alias("level", "_se"))
    return ex.groupBy("level").agg((F.sum("_se") / F.sum("_d")).alias("mse"), F.count(F.lit(1)).alias("n_rows"))


def quant_loss(level_mse: DataFrame, beta: float = 0.25) -> DataFrame:
    """Codebook + beta*commitment per level; both equal the residual MSE as values,
    so the loss is (1+beta)*mse, and the total is the mean over levels."""
    per = level_mse.withColumn("loss", (1.0 + beta) * F.col("mse"))
    return per.agg(F.avg("loss").alias("quant_loss"), F.count(F.lit(1)).alias("n_levels"))


def nrl_loss(level_mse: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Normalised residual loss ``sum_l log1p(loss_l / (loss_{l-1} + eps))``;
    the first level is divided by 1 (no previous level).  Levels are few: a
    window over a handful of rows."""
    w = Window.orderBy("level")
    prev = F.lag("mse").over(w)
    t = level_mse.withColumn("_term", F.log1p(F.col("mse") / F.coalesce(prev + F.lit(eps), F.lit(1.0))))
    return t.agg(F.sum("_term").alias("nrl_loss"))


def center_distances(df: DataFrame, dist: str, batch: str) -> DataFrame:
    """C17: scale distances of one batch to [-1, 1]: ``(d - mid) / (max - mid + 1e-5)``."""
    stats = df.groupBy(batch).agg(F.max(dist).alias("_mx"), F.min(dist).alias("_mn"))
    j = df.join(stats, batch)
    mid = (F.col("_mx") + F.col("_mn")) / 2.0
    return j.withColumn("centered", (F.col(dist) - mid) / (F.col("_mx") - mid + F.lit(1e-5))).drop("_mx", "_mn")


def ema_update(codebook: DataFrame, emb: DataFrame, codes: DataFrame, key: str, decay: float = 0.99,
               vec: str = "embedding", level: int = 0) -> DataFrame:
    """``decay*c + (1-decay)*mean(assigned)``; codes with no assignment stay unchanged."""
    assigned = codes.select(key, F.element_at("codes", level + 1).alias("code")).join(emb.select(key, vec), key)
    means = mean_vector(assigned, "code", vec, "_m").select("code", "_m")
    cb = codebook.filter(F.col("level") == level)
    # one row per code: bounded by K, so broadcasting it is safe
    j = cb.join(F.broadcast(means), "code", "left")
    upd = F.when(F.col("_m").isNull(), F.col("vector").cast("array<double>")).otherwise(
        F.zip_with("vector", "_m", lambda c, m: F.lit(decay) * c + F.lit(1.0 - decay) * m)
    )
    return j.select("level", "code", upd.alias("vector"))


def project(df: DataFrame, weight: np.ndarray, bias: np.ndarray | None = None, vec: str = "embedding",
            residual: bool = False, name: str = "projected") -> DataFrame:
    """``x W^T + b`` (and ``x + f(x)`` when ``residual``) with broadcast weights, Arrow matmul."""
    w = np.asarray(weight, dtype=np.float64)
    if w.nbytes > MAX_BROADCAST_BYTES:
        raise ValueError("projection weights exceed the broadcast bound")
    b = np.zeros(w.shape[0]) if bias is None else np.asarray(bias, dtype=np.float64)
    bc = df.sparkSession.sparkContext.broadcast((w, b))
    out_schema = T.StructType(df.schema.fields + [T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches):
        wm, bv = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[vec].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy())
            y = x @ wm.T + bv
            if residual:
                y = x + y
            pdf[name] = list(y)
            yield pdf

    return df.mapInPandas(run, out_schema)


def gather(matrix_col, idx_col) -> Column:
    """Row ``idx`` (0-based) of a per-key matrix column."""
    return F.try_element_at(_c(matrix_col), _c(idx_col).cast("int") + F.lit(1))


def explode_vector(df: DataFrame, keys, vec: str, value: str = "value") -> DataFrame:
    """Long form ``(keys..., dim, value)`` (dims 0-based), rounded for reports."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.select(*keys, F.posexplode(vec).alias("dim", value))
