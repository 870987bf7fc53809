"""Reward, advantage and loss queries (H-family) over groups of 16 completions per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import rewards as H
from ..operators import sequences as S
from . import fixtures as FX
from .registry import register

G = FX.COMPLETION_G
STRIP3 = '\n" '
STRIP2 = '\n"'


def completions(spark, d):
    """Completion table: group = user, 16 completions, batch = 8 groups."""
    c = FX.candidates(spark, d, n=G)
    return c.select(F.col("user_id").alias("group_id"), "user_id", F.floor(F.col("user_id") / 8).cast("bigint").alias("batch_id"),
                    "pos", "cand", "target", F.col("pred").alias("completion"), F.col("output").alias("target_text"))


_C = {**FX.sql_candidate_ctes(n=G),
      "comp": "SELECT user_id AS group_id, user_id, user_id // 8 AS batch_id, pos, cand, target, pred AS completion, output AS target_text FROM preds"}
RULE_SQL = f"CASE WHEN {X.strip_chars_sql('completion', STRIP3)} = {X.strip_chars_sql('target_text', STRIP3)} THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"
HIT2_SQL = f"({X.strip_chars_sql('completion', STRIP2)} = {X.strip_chars_sql('target_text', STRIP2)})"
_W = {**_C,
      "wsum": f"SELECT sum(1.0 / log2(i + 2)) AS s FROM range({G}) t(i)",
      "h": f"SELECT comp.*, {RULE_SQL} AS rule_reward, CAST({HIT2_SQL} AS INTEGER) AS hit FROM comp",
      "ga": "SELECT group_id, max(hit) AS anyhit FROM h GROUP BY group_id",
      "rw": """SELECT h.*, CASE WHEN ga.anyhit = 0 OR h.hit = 1 THEN CAST(0.0 AS DOUBLE) ELSE -(1.0 / log2(h.pos % 16 + 2)) / wsum.s END AS ndcg_reward
FROM h JOIN ga ON ga.group_id = h.group_id, wsum""",
      "rc": "SELECT *, 1.0 * rule_reward + 1.0 * ndcg_reward AS reward FROM rw"}


def _rewards(spark, d):
    c = completions(spark, d).withColumn("rule_reward", H.rule_reward("completion", "target_text"))
    c = H.ndcg_rule_reward(c, G, completion="completion", target="target_text")
    return H.combine_rewards(c, {"rule_reward": 1.0, "ndcg_reward": 1.0})


@register("rule_reward", FX.with_ctes(_W, "SELECT user_id, pos, rule_reward FROM rw"))
def rule_reward(spark, d):
    """H1: exact-match reward after stripping quotes, newlines and spaces."""
    return _rewards(spark, d).select("user_id", "pos", "rule_reward")


@register("ndcg_rule_reward", FX.with_ctes(_W, "SELECT user_id, pos, round(ndcg_reward, 6) AS ndcg_reward FROM rw"))
def ndcg_rule_reward(spark, d):
    """H2: rank penalty reward (misses weighted by position, zero for a group without a hit)."""
    return _rewards(spark, d).select("user_id", "pos", X.r6("ndcg_reward").alias("ndcg_reward"))


@register("semantic_reward", FX.with_ctes({**_C, "emb_long": FX.sql_emb_long(),
    "pr": """SELECT c.user_id, c.pos, sum(a.v * b.v) AS dp, sum(a.v * a.v) AS na, sum(b.v * b.v) AS nb
FROM comp c JOIN emb_long a ON a.item_id = c.target JOIN emb_long b ON b.item_id = c.cand AND b.dim = a.dim GROUP BY c.user_id, c.pos"""},
    """SELECT c.user_id, c.pos, round(pr.dp / (greatest(sqrt(pr.na), 1e-8) * greatest(sqrt(pr.nb), 1e-8)), 6) AS semantic_reward
FROM comp c LEFT JOIN pr ON pr.user_id = c.user_id AND pr.pos = c.pos"""))
def semantic_reward(spark, d):
    """H3: cosine between target and predicted item vectors (NULL when the item has no vector)."""
    c = completions(spark, d)
    s = H.semantic_reward(c, FX.vectors(spark, d), "cand", "target")
    return s.select("user_id", "pos", X.r6("semantic_reward").alias("semantic_reward"))


@register("cf_reward", FX.with_ctes(_C, f"SELECT user_id, pos, round({FX.SCORE_SQL}, 6) AS cf_reward FROM comp"))
def cf_reward(spark, d):
    """H4: score of the predicted item from a score table keyed by (query, item)."""
    c = completions(spark, d)
    sc = c.select(F.col("user_id").alias("query_id"), F.col("cand").alias("item_id")).distinct().withColumn(
        "score", FX.score_of(F.col("query_id"), F.col("item_id")))
    r = H.cf_reward(c.withColumnRenamed("user_id", "query_id"), sc, "query_id", "cand")
    return r.select(F.col("query_id").alias("user_id"), "pos", X.r6("cf_reward").alias("cf_reward"))


@register("reward_logs", FX.with_ctes({**_W, "gs": "SELECT group_id, stddev_samp(reward) AS s FROM rc GROUP BY group_id"},
    """SELECT round(avg(rule_reward), 6) AS mean_rule_reward, round(avg(ndcg_reward), 6) AS mean_ndcg_reward,
       round(avg(reward), 6) AS mean_reward, (SELECT round(avg(s), 6) FROM gs) AS reward_std FROM rc"""))
def reward_logs(spark, d):
    """H5: weighted reward sum and per-function means."""
    r = _rewards(spark, d)
    a = H.reward_logs(r, ["rule_reward", "ndcg_reward", "reward"])
    return a.select(*[X.r6(c).alias(c) for c in a.columns])


@register("grpo_advantage", FX.with_ctes({**_W, "gs": "SELECT group_id, avg(reward) AS m, stddev_samp(reward) AS s FROM rc GROUP BY group_id"},
    "SELECT user_id, pos, round((reward - m) / (s + 1e-4), 6) AS advantage FROM rc JOIN gs USING (group_id)"))
def grpo_advantage(spark, d):
    """H6: group-normalised advantage."""
    a = H.grpo_advantage(_rewards(spark, d))
    return a.select("user_id", "pos", X.r6("advantage").alias("advantage"))


@register("gdpo_advantage", FX.with_ctes({**_W,
    "gs": """SELECT group_id, avg(rule_reward) AS m1, stddev_samp(rule_reward) AS s1, avg(ndcg_reward) AS m2, stddev_samp(ndcg_reward) AS s2
FROM rc GROUP BY group_id""",
    "pre": """SELECT rc.*, coalesce(1.0 * (rule_reward - m1) / (s1 + 1e-4), 0) + coalesce(1.0 * (ndcg_reward - m2) / (s2 + 1e-4), 0) AS pre
FROM rc JOIN gs USING (group_id)""",
    "bs": "SELECT batch_id, avg(pre) AS bm, stddev_samp(pre) AS bsd FROM pre GROUP BY batch_id"},
    "SELECT user_id, pos, round((pre - bm) / (bsd + 1e-4), 6) + CAST(0 AS DOUBLE) AS advantage FROM pre JOIN bs USING (batch_id)"))
def gdpo_advantage(spark, d):
    """H7: per-reward group normalisation, weighted sum, then batch normalisation."""
    a = H.gdpo_advantage(_rewards(spark, d), {"rule_reward": 1.0, "ndcg_reward": 1.0})
    return a.select("user_id", "pos", X.r6("advantage").alias("advantage"))


def _pool(spark, d):
    idx = FX.sid_index(spark, d)
    t = FX.eval_targets(spark, d, idx)
    n_items = FX.table(spark, d, "part").agg(F.count(F.lit(1)).alias("n_items"))
    p = t.crossJoin(F.broadcast(n_items)).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(int(1.5 * G) - 1))))
    p = p.withColumn("pos", F.col("pos").cast("bigint"))
    cand = F.when(F.col("pos") % 8 == F.col("user_id") % 8, F.col("target")).otherwise(
        (F.col("user_id") * 7 + ((F.col("pos") * F.col("pos")) % 11) * 13) % F.col("n_items"))
    p = p.withColumn("cand", cand)
    sm = FX.sid_map(spark, d, idx).select(F.col("item_id").alias("cand"), F.col("sid").alias("_s"))
    p = p.join(sm, "cand", "left").withColumn("completion", F.coalesce("_s", F.concat(F.lit("item_"), F.col("cand").cast("string"))))
    return p.select(F.col("user_id").alias("group_id"), "user_id", "pos", "completion", F.col("target_sid").alias("target"))


@register("select_completions", FX.with_ctes({**FX.sql_candidate_ctes(n=G),
    "pool0": f"""SELECT et.user_id, et.target_sid, p.pos,
       CASE WHEN p.pos % 8 = et.user_id % 8 THEN et.target ELSE (et.user_id * 7 + ((p.pos * p.pos) % 11) * 13) % ni.n_items END AS cand
FROM et, ni, range({int(1.5 * G)}) p(pos)""",
    "pool": "SELECT p.*, coalesce(sm.sid_full, 'item_' || CAST(p.cand AS VARCHAR)) AS completion FROM pool0 p LEFT JOIN sid_map sm ON sm.item_id = p.cand",
    "st": """SELECT *, row_number() OVER (PARTITION BY user_id, completion ORDER BY pos) - 1 AS cp,
       count(*) OVER (PARTITION BY user_id, completion) AS fr, min(pos) OVER (PARTITION BY user_id, completion) AS fp FROM pool""",
    "rk": """SELECT user_id, completion, row_number() OVER (PARTITION BY user_id
       ORDER BY CASE WHEN completion = target_sid THEN 1 ELSE 0 END DESC, cp, fr DESC, fp) - 1 AS sel_pos FROM st"""},
    f"SELECT user_id, CAST(sel_pos AS INTEGER) AS sel_pos, completion FROM rk WHERE sel_pos < {G}"))
def select_completions(spark, d):
    """H8: dynamic sampling of 16 completions from a pool of 24 (targets first, then round-robin by frequency)."""
    s = H.select_completions(_pool(spark, d), G)
    return s.select("user_id", F.col("sel_pos").cast("int").alias("sel_pos"), "completion")


@register("add_ground_truth", FX.with_ctes(_C, f"SELECT user_id, pos, CASE WHEN (pos + 1) % {G} = 0 THEN target_text ELSE completion END AS completion_gt FROM comp"))
def add_ground_truth(spark, d):
    """H9: the last completion of each repeat block becomes the ground truth."""
    a = H.add_ground_truth(completions(spark, d), G, completion="completion", target="target_text")
    return a.select("user_id", "pos", "completion_gt")


@register("categorical_diversity", FX.with_ctes(_C, """SELECT round(avg(dv), 6) AS categorical_diversity FROM (
  SELECT group_id, count(DISTINCT completion) / count(*) AS dv FROM comp GROUP BY group_id)"""))
def categorical_diversity(spark, d):
    """Mean over groups of distinct completions / G."""
    return H.categorical_diversity(completions(spark, d)).select(X.r6("categorical_diversity").alias("categorical_diversity"))


@register("token_diversity", FX.with_ctes({**_C, "tk": """SELECT unnest(coalesce(s.codes, [0, 0, 0])) AS t
FROM comp c LEFT JOIN codes_dd s ON s.item_id = c.cand"""},
    "SELECT round(count(DISTINCT t) / count(*), 6) AS token_diversity FROM tk WHERE t <> 0"))
def token_diversity(spark, d):
    """Distinct non-pad token ids / all non-pad token ids (tokens = SID codes, pad 0)."""
    c = completions(spark, d)
    idx = FX.sid_index(spark, d).select(F.col("item_id").alias("cand"), "codes")
    j = c.join(idx, "cand", "left").withColumn("tokens", F.coalesce("codes", F.array(F.lit(0), F.lit(0), F.lit(0))))
    return H.token_diversity(j, "tokens", 0).select(X.r6("token_diversity").alias("token_diversity"))


def _logps(spark, d):
    a = H.grpo_advantage(_rewards(spark, d))
    t = a.withColumn("tok_pos", F.explode(F.sequence(F.lit(0), F.lit(3))))
    u, p, k = F.col("user_id"), F.col("pos"), F.col("tok_pos")
    return t.select("batch_id", "group_id", "pos", "tok_pos", "advantage",
                    (-((u + p + k) % 17) / 10.0).alias("logp"),
                    (-((u * 3 + p + 2 * k) % 13) / 10.0).alias("ref_logp"),
                    F.when(k < 3, 1).otherwise(0).alias("mask")).withColumn(
        "logp_old", F.col("logp") - ((F.col("group_id") + F.col("tok_pos")) % 3) / 100.0)


_L = {**_W, "gs": "SELECT group_id, avg(reward) AS m, stddev_samp(reward) AS s FROM rc GROUP BY group_id",
      "adv": "SELECT rc.*, (reward - m) / (s + 1e-4) AS advantage FROM rc JOIN gs USING (group_id)",
      "lp": """SELECT batch_id, group_id, pos, k AS tok_pos, advantage,
       -((user_id + pos + k) % 17) / 10.0 AS logp, -((user_id * 3 + pos + 2 * k) % 13) / 10.0 AS ref_logp,
       CASE WHEN k < 3 THEN 1 ELSE 0 END AS mask,
       -((user_id + pos + k) % 17) / 10.0 - ((group_id + k) % 3) / 100.0 AS logp_old
FROM adv, range(4) t(k)""",
      "kl": "SELECT *, exp(ref_logp - logp) - (ref_logp - logp) - 1 AS kl, logp - logp_old AS lr FROM lp",
      "tl": "SELECT *, -(exp(lr) * advantage - 0.04 * kl) AS tl FROM kl",
      "sq": """SELECT batch_id, group_id, pos, sum(tl * mask) / sum(mask) AS sl, exp(sum(lr * mask) / sum(mask)) AS sr,
       sum(kl * mask) / sum(mask) AS skl, sum(mask) AS len, first(advantage) AS a FROM tl GROUP BY batch_id, group_id, pos"""}


@register("kl_report", FX.with_ctes(_L, "SELECT round(avg(skl), 6) AS mean_kl, round(avg(len), 6) AS completion_length FROM sq"))
def kl_report(spark, d):
    """Masked per-token KL estimate, mean KL and completion length."""
    k = H.kl_report(_logps(spark, d))
    return k.select(X.r6("mean_kl").alias("mean_kl"), X.r6("completion_length").alias("completion_length"))


@register("policy_loss", FX.with_ctes(_L, """SELECT 'default' AS kind, round((SELECT avg(sl) FROM sq), 6) AS loss
UNION ALL SELECT 'dapo' AS kind, round((SELECT sum(tl * mask) / sum(mask) FROM tl), 6) AS loss
UNION ALL SELECT 'gspo' AS kind, round((SELECT -avg(sr * a - 0.04 * skl) FROM sq), 6) AS loss"""))
def policy_loss(spark, d):
    """Loss values of the default, DAPO and GSPO forms (beta 0.04), one pass."""
    l = H.policy_losses(_logps(spark, d), beta=0.04)
    return l.select("kind", X.r6("loss").alias("loss"))


@register("reward_sparsity", FX.with_ctes({**_W, "g": "SELECT group_id, max(rule_reward) AS mx, min(rule_reward) AS mn, avg(rule_reward) AS av FROM rw GROUP BY group_id"},
    "SELECT round(avg(CASE WHEN mx = mn THEN 1.0 ELSE 0.0 END), 6) AS zero_std_share, round(avg(av), 6) AS hit_rate, count(*) AS n_groups FROM g"))
def reward_sparsity(spark, d):
    """Share of zero-signal groups and the hit rate of the rule reward."""
    s = H.reward_sparsity(_rewards(spark, d), "rule_reward")
    return s.select(X.r6("zero_std_share").alias("zero_std_share"), X.r6("hit_rate").alias("hit_rate"), "n_groups")


@register("bce_loss", FX.with_ctes({**FX.sql_candidate_ctes(n=1),
    "ng": f"""SELECT user_id, target, CASE WHEN h % (ni.n_items - 1) >= target THEN h % (ni.n_items - 1) + 1 ELSE h % (ni.n_items - 1) END AS neg
FROM (SELECT user_id, target, {X.portable_hash_sql('user_id', 'target', seed=42)} AS h FROM et), ni""",
    "pr": """SELECT ((user_id * 31 + target * 17) % 1009) / 1009.0 AS score, 1.0 AS label FROM ng
UNION ALL SELECT ((user_id * 31 + neg * 17) % 1009) / 1009.0 AS score, 0.0 AS label FROM ng"""},
    """SELECT round(avg(label * (greatest(-score, 0) + ln(1 + exp(-abs(score)))) + (1 - label) * (greatest(score, 0) + ln(1 + exp(-abs(score))))), 6) AS bce FROM pr"""))
def bce_loss(spark, d):
    """Binary cross-entropy over positive and sampled-negative scores."""
    t = FX.eval_targets(spark, d)
    n_items = FX.table(spark, d, "part").count()  # one scalar
    t = t.withColumn("neg", S.negative_sample("user_id", "target", n_items, seed=42))
    t = t.withColumn("ps", FX.score_of(F.col("user_id"), F.col("target"))).withColumn("ns", FX.score_of(F.col("user_id"), F.col("neg")))
    return H.bce(H.bce_pairs(t, "ps", "ns", "user_id")).select(X.r6("bce").alias("bce"))


@register("dro_loss", FX.with_ctes({**FX.sql_candidate_ctes(), "c": "SELECT target AS item_id, count(*) AS cnt FROM targets GROUP BY target",
    "cat": "SELECT DISTINCT p_partkey AS item_id FROM part",
    "j": "SELECT cat.item_id, coalesce(c.cnt, 0) + 1 AS cnt1 FROM cat LEFT JOIN c ON c.item_id = cat.item_id",
    "prop": "SELECT item_id, pow(cnt1 / (SELECT sum(cnt1) FROM j), 0.05) AS ps FROM j",
    "pairs": "SELECT DISTINCT user_id, cand FROM (SELECT user_id, cand FROM preds UNION ALL SELECT user_id, target AS cand FROM et)",
    "sc": "SELECT p.user_id, p.cand, ((p.user_id * 31 + p.cand * 17) % 1009) / 1009.0 AS s, prop.ps, (p.cand = et.target) AS ist FROM pairs p JOIN prop ON prop.item_id = p.cand JOIN et ON et.user_id = p.user_id",
    "q": """SELECT user_id, sum(exp(s * s * ps)) AS a, sum(CASE WHEN ist THEN exp(s * s * ps) ELSE 0 END) AS b,
       sum(CASE WHEN ist THEN exp((s - 1) * (s - 1) * ps) ELSE 0 END) AS c FROM sc GROUP BY user_id"""},
    "SELECT round(avg(ln(a - b + c + 1e-24)), 6) AS dro_loss FROM q"))
def dro_loss(spark, d):
    """Robust (DRO) loss value with popularity propensity (beta 1)."""
    c = FX.candidates(spark, d)
    pairs = c.select("user_id", "cand").unionByName(c.select("user_id", F.col("target").alias("cand"))).distinct()
    scores = pairs.select(F.col("user_id").alias("query_id"), F.col("cand").alias("item_id"), FX.score_of(F.col("user_id"), F.col("cand")).alias("score"))
    _, last = S.split_last(FX.events(spark, d), "user_id", FX.EVENT_KEY)
    counts = last.groupBy(F.col("target").alias("item_id")).agg(F.count(F.lit(1)).alias("cnt"))
    prop = S.propensity(None, FX.table(spark, d, "part").select(F.col("p_partkey").alias("item_id")), counts=counts)
    t = c.filter(F.col("pos") == 0).select(F.col("user_id").alias("query_id"), F.col("target").alias("item_id"))
    return H.dro_loss(scores, prop, t, beta=1.0).select(X.r6("dro_loss").alias("dro_loss"))


@register("completion_items", FX.with_ctes({**_C,
    "nm": "SELECT sid_full, max(item_id) AS item_id FROM sid_map GROUP BY sid_full",
    "tx": f"SELECT comp.*, {X.strip_chars_sql('completion', STRIP2)} AS t FROM comp"},
    f"""SELECT user_id, pos, nm.item_id, CAST(nm.item_id IS NULL AS BIGINT) AS is_unknown,
       CAST(coalesce(nm.item_id, {X.portable_hash_sql('user_id', 'pos', seed=42)} % ni.n_items) AS BIGINT) AS picked_id
FROM tx LEFT JOIN nm ON nm.sid_full = tx.t, ni"""))
def completion_items(spark, d):
    """H3/H4: items named by completion texts, unknown flag and the pick for unknown ones."""
    n = FX.table(spark, d, "part").count()  # one scalar
    r = H.resolve_completions(completions(spark, d).select("user_id", "pos", "completion"), FX.sid_map(spark, d), n, ["user_id", "pos"], seed=42)
    return r.select("user_id", "pos", "item_id", F.col("is_unknown").cast("bigint").alias("is_unknown"), "picked_id")
