"""Vector queries (C-family) over the ``embeddings`` table and the codebook fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import vectors as V
from . import fixtures as FX
from .registry import register

K = FX.CODEBOOK_K


def _long(df, keys, vec, value="value"):
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.select(*keys, F.posexplode(vec).alias("dim", "_v")).select(
        *keys, F.col("dim").cast("bigint").alias("dim"), X.r6("_v").alias(value))


@register("vector_sanitize_report", """SELECT count(*) AS n_rows,
       CAST(sum(len(list_filter(embedding, lambda x: isnan(x)))) AS BIGINT) AS n_nan,
       CAST(sum(len(list_filter(embedding, lambda x: isinf(x)))) AS BIGINT) AS n_inf
FROM embeddings""")
def vector_sanitize_report(spark, d):
    """NaN/Inf counts of the embedding matrix."""
    raw = FX.table(spark, d, "embeddings").select("embedding")
    return V.sanitize_report(raw, "embedding")


@register("vector_stats", FX.with_ctes({"emb_long": FX.sql_emb_long()}, """SELECT (SELECT count(*) FROM embeddings) AS n_rows,
       CAST(max(dim) + 1 AS BIGINT) AS dim, round(min(v), 6) AS min_value, round(max(v), 6) AS max_value,
       round(avg(v), 6) AS mean_value FROM emb_long"""))
def vector_stats(spark, d):
    """Shape, min, max, mean."""
    s = V.vector_stats(FX.vectors(spark, d))
    return s.select("n_rows", "dim", X.r6("min_value").alias("min_value"), X.r6("max_value").alias("max_value"),
                    X.r6("mean_value").alias("mean_value"))


def _token_vectors(spark, d):
    # token table derived from the vectors: key = label, position = vec_id, mask off every 4th row
    v = FX.vectors(spark, d)
    return v.select(F.col("label").cast("bigint").alias("key"), F.col("item_id").alias("pos"),
                    F.when(F.col("item_id") % 4 == 0, 0).otherwise(1).alias("mask"), F.col("embedding").alias("vector"))


@register("token_mean_pool", FX.with_ctes({"emb_long": FX.sql_emb_long(),
    "tok": """SELECT CAST(e.label AS BIGINT) AS key, l.dim, l.v, CASE WHEN l.item_id % 4 = 0 THEN 0 ELSE 1 END AS m
FROM emb_long l JOIN embeddings e ON e.vec_id = l.item_id"""},
    "SELECT key, CAST(dim AS BIGINT) AS dim, round(sum(v * m) / greatest(sum(m), 1e-9), 6) AS value FROM tok GROUP BY key, dim"))
def token_mean_pool(spark, d):
    """Masked mean pooling of token vectors per key."""
    return _long(V.mean_pool(_token_vectors(spark, d), "key", "vector", "mask"), "key", "pooled")


@register("vector_mean_by_label", FX.with_ctes({"emb_long": FX.sql_emb_long()},
    """SELECT CAST(e.label AS BIGINT) AS label, CAST(l.dim AS BIGINT) AS dim, round(avg(l.v), 6) AS value
FROM emb_long l JOIN embeddings e ON e.vec_id = l.item_id GROUP BY e.label, l.dim"""))
def vector_mean_by_label(spark, d):
    """C4: group mean vector."""
    v = FX.vectors(spark, d).withColumn("label", F.col("label").cast("bigint"))
    return _long(V.mean_vector(v, "label", "embedding", "mean"), "label", "mean")


_PAIR_SQL = {"emb_long": FX.sql_emb_long(),
             "pr": """SELECT a.item_id, sum(a.v * b.v) AS dp, sum(a.v * a.v) AS na, sum(b.v * b.v) AS nb
FROM emb_long a JOIN emb_long b ON b.item_id = a.item_id + 1 AND a.dim = b.dim GROUP BY a.item_id"""}


def _pairs(spark, d):
    v = FX.vectors(spark, d)
    nxt = v.select((F.col("item_id") - 1).alias("item_id"), F.col("embedding").alias("next_embedding"))
    return v.join(nxt, "item_id")


@register("vector_cosine_pairs", FX.with_ctes(_PAIR_SQL,
    "SELECT item_id, round(dp / (greatest(sqrt(na), 1e-8) * greatest(sqrt(nb), 1e-8)), 6) AS cosine FROM pr"))
def vector_cosine_pairs(spark, d):
    """Cosine similarity of each vector with the next one."""
    return _pairs(spark, d).select("item_id", X.r6(V.cosine("embedding", "next_embedding")).alias("cosine"))


@register("vector_sq_l2_pairs", FX.with_ctes(_PAIR_SQL, "SELECT item_id, round(na - 2 * dp + nb, 6) AS sq_l2 FROM pr"))
def vector_sq_l2_pairs(spark, d):
    """Expanded-form squared L2 distance of each vector to the next one."""
    return _pairs(spark, d).select("item_id", X.r6(V.sq_l2("embedding", "next_embedding")).alias("sq_l2"))


@register("nearest_codeword", FX.with_ctes(FX.sql_codes_ctes(), "SELECT item_id, CAST(code AS INTEGER) AS code, round(dist, 6) AS dist FROM cbr0_c"))
def nearest_codeword(spark, d):
    """Nearest level-0 codeword of every vector (Arrow matmul, broadcast codebook)."""
    a = V.assign(FX.vectors(spark, d).select("item_id", "embedding"), FX.codebook(spark, d), level=0)
    return a.select("item_id", "code", X.r6("dist").alias("dist"))


@register("nearest_codeword_relational", FX.with_ctes(FX.sql_codes_ctes(), "SELECT item_id, CAST(code AS INTEGER) AS code, round(dist, 6) AS dist FROM cbr0_c"))
def nearest_codeword_relational(spark, d):
    """C7 relational form: broadcast cross join with a bounded codebook + min(struct)."""
    a = V.assign_relational(FX.vectors(spark, d), FX.codebook(spark, d), "item_id", level=0)
    return a.select("item_id", "code", X.r6("dist").alias("dist"))


def _cand_sql() -> dict:
    c = FX.sql_codebook_ctes()
    c["cand"] = f"""SELECT l.item_id, cb.code, sum((l.v - cb.v) * (l.v - cb.v)) AS dist
FROM emb_long l JOIN cb0 cb ON cb.dim = l.dim
WHERE cb.code IN (l.item_id % {K}, (l.item_id + 1) % {K}, (l.item_id + 5) % {K})
GROUP BY l.item_id, cb.code"""
    return c


@register("nearest_candidate", FX.with_ctes(_cand_sql(), """SELECT item_id, CAST(arg_min(code, (dist, code)) AS INTEGER) AS code, round(min(dist), 6) AS dist
FROM cand GROUP BY item_id"""))
def nearest_candidate(spark, d):
    """Nearest among three candidate codewords per row."""
    v = FX.vectors(spark, d).select("item_id", "embedding")
    cb = FX.codebook(spark, d).filter(F.col("level") == 0).select("code", F.col("vector").alias("cand_vector"))
    cands = v.withColumn("code", F.explode(F.array(
        (F.col("item_id") % K).cast("int"), ((F.col("item_id") + 1) % K).cast("int"), ((F.col("item_id") + 5) % K).cast("int"))))
    rows = cands.distinct().join(F.broadcast(cb), "code")  # codebook: K rows
    a = V.assign_candidates(rows, "item_id", "code", "embedding", "cand_vector")
    return a.select("item_id", "code", X.r6("dist").alias("dist"))


@register("rq_encode_paths", FX.with_ctes(FX.sql_codes_ctes(),
    "SELECT item_id, array_to_string(list_transform(codes, lambda c: CAST(c AS VARCHAR)), ',') AS path FROM codes"))
def rq_encode_paths(spark, d):
    """Residual codes over all levels in one Arrow pass."""
    c = FX.codes(spark, d)
    return c.select("item_id", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("path"))


def _recon_sql() -> dict:
    c = FX.sql_codes_ctes()
    c["recon"] = """SELECT cl.item_id, cb.dim, sum(cb.v) AS v FROM codes_long cl
JOIN cb_all cb ON cb.level = cl.level AND cb.code = cl.code GROUP BY cl.item_id, cb.dim"""
    return c


@register("rq_recon_error", FX.with_ctes(_recon_sql(), """SELECT count(DISTINCT e.item_id) AS n_rows,
       round(avg((e.v - r.v) * (e.v - r.v)), 6) AS mse, round(avg(abs(e.v - r.v)), 6) AS l1
FROM emb_long e JOIN recon r ON r.item_id = e.item_id AND r.dim = e.dim"""))
def rq_recon_error(spark, d):
    """C13 + C14: decode the codes and report MSE / L1 against the input."""
    c = FX.codes(spark, d)
    rec = V.rq_decode(c.select("item_id", "codes"), FX.codebook(spark, d), "item_id")
    e = V.recon_error(c.select("item_id", "embedding"), rec, "item_id")
    return e.select("n_rows", X.r6("mse").alias("mse"), X.r6("l1").alias("l1"))


def _level_mse_sql() -> dict:
    c = FX.sql_codes_ctes()
    c["lm"] = "SELECT level, sum(dist) / (count(*) * 64.0) AS mse FROM codes_long GROUP BY level"
    return c


@register("rq_level_mse", FX.with_ctes(_level_mse_sql(), "SELECT CAST(level AS BIGINT) AS level, round(mse, 6) AS mse FROM lm"))
def rq_level_mse(spark, d):
    """C14: residual MSE after each level."""
    m = V.level_errors(FX.codes(spark, d))
    return m.select(F.col("level").cast("bigint").alias("level"), X.r6("mse").alias("mse"))


@register("rq_quant_loss", FX.with_ctes(_level_mse_sql(), "SELECT round(avg(1.25 * mse), 6) AS quant_loss, count(*) AS n_levels FROM lm"))
def rq_quant_loss(spark, d):
    """Codebook + 0.25 * commitment loss value, mean over levels."""
    q = V.quant_loss(V.level_errors(FX.codes(spark, d)), beta=0.25)
    return q.select(X.r6("quant_loss").alias("quant_loss"), "n_levels")


@register("rq_nrl_loss", FX.with_ctes(_level_mse_sql(), """SELECT round(sum(ln(1 + mse / coalesce(prev + 1e-6, 1.0))), 6) AS nrl_loss
FROM (SELECT level, mse, lag(mse) OVER (ORDER BY level) AS prev FROM lm)"""))
def rq_nrl_loss(spark, d):
    """Normalised residual loss over levels."""
    return V.nrl_loss(V.level_errors(FX.codes(spark, d))).select(X.r6("nrl_loss").alias("nrl_loss"))


def _dist_sql() -> dict:
    c = FX.sql_codebook_ctes()
    c["dd"] = """SELECT l.item_id, cb.code, sum((l.v - cb.v) * (l.v - cb.v)) AS dist, l.item_id // 50 AS batch
FROM emb_long l JOIN cb0 cb ON cb.dim = l.dim GROUP BY l.item_id, cb.code"""
    return c


def _distances(spark, d):
    v = FX.vectors(spark, d).select("item_id", "embedding")
    cb = FX.codebook(spark, d).filter(F.col("level") == 0).select("code", F.col("vector").alias("cv"))
    # codebook side: K rows
    return v.crossJoin(F.broadcast(cb)).select("item_id", "code", V.sq_l2_direct("embedding", "cv").alias("dist"),
                                               F.floor(F.col("item_id") / 50).cast("bigint").alias("batch"))


@register("center_distances", FX.with_ctes(_dist_sql(), """SELECT item_id, CAST(code AS INTEGER) AS code,
       round((dist - (max(dist) OVER w + min(dist) OVER w) / 2) / (max(dist) OVER w - (max(dist) OVER w + min(dist) OVER w) / 2 + 1e-5), 6) AS centered
FROM dd WINDOW w AS (PARTITION BY batch)"""))
def center_distances(spark, d):
    """C17: distances of each vector to the level-0 codewords scaled to [-1, 1] per batch of 50 rows."""
    c = V.center_distances(_distances(spark, d), "dist", "batch")
    return c.select("item_id", "code", X.r6("centered").alias("centered"))


def _ema_sql() -> dict:
    c = FX.sql_codes_ctes()
    c["mv"] = """SELECT cl.code, l.dim, avg(l.v) AS m FROM codes_long cl JOIN emb_long l ON l.item_id = cl.item_id
WHERE cl.level = 0 GROUP BY cl.code, l.dim"""
    return c


@register("codebook_ema_update", FX.with_ctes(_ema_sql(), """SELECT CAST(cb.code AS INTEGER) AS code, CAST(cb.dim AS BIGINT) AS dim,
       round(CASE WHEN mv.m IS NULL THEN cb.v ELSE 0.99 * cb.v + 0.01 * mv.m END, 6) AS value
FROM cb0 cb LEFT JOIN mv ON mv.code = cb.code AND mv.dim = cb.dim"""))
def codebook_ema_update(spark, d):
    """EMA update of the level-0 codebook with the mean of assigned vectors (decay 0.99)."""
    c = FX.codes(spark, d)
    upd = V.ema_update(FX.codebook(spark, d), c.select("item_id", "embedding"), c.select("item_id", "codes"), "item_id",
                       decay=0.99, level=0)
    return _long(upd, "code", "vector")


@register("codeword_gather", FX.with_ctes(_recon_sql(), """SELECT cl.item_id, CAST(cb.dim AS BIGINT) AS dim, round(cb.v, 6) AS value
FROM codes_long cl JOIN cb_all cb ON cb.level = cl.level AND cb.code = cl.code WHERE cl.level = cl.item_id % 3"""))
def codeword_gather(spark, d):
    """Per item, the matrix of its chosen codewords (L x d); select row ``item_id % L``."""
    c = FX.codes(spark, d).select("item_id", "codes")
    cb = FX.codebook(spark, d)
    # L x K rows: bounded model-sized side
    ex = c.select("item_id", F.posexplode("codes").alias("level", "code")).join(F.broadcast(cb), ["level", "code"])
    mat = ex.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("level", "vector"))).alias("_m"))
    mat = mat.select("item_id", F.transform("_m", lambda s: s["vector"]).alias("matrix"))
    g = mat.select("item_id", V.gather("matrix", F.col("item_id") % 3).alias("row"))
    return _long(g, "item_id", "row")
