"""Rewards, advantages and off-policy loss values.

Completions are a long table ``(batch_id, group_id, pos, completion, target, ...)``;
the group stride of the reference becomes an explicit key.  Group statistics
are partial aggregates joined back on ``group_id`` (a group is G rows, the
number of generations, so it is bounded by construction).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from . import vectors as V

ADV_EPS = 1e-4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rule_reward(completion, target) -> Column:
    """H1: 1.0 when equal after ``strip("\\n\\" ")``."""
    return F.when(X.strip_chars(completion, '\n" ') == X.strip_chars(target, '\n" '), 1.0).otherwise(0.0)


def ndcg_position_weights(g: int) -> list[float]:
    """H2 weights: ``-(1/log2(i+2)) / sum_j 1/log2(j+2)``; negative, summing to -1."""
    raw = [1.0 / math.log2(i + 2) for i in range(g)]
    s = sum(raw)
    return [-r / s for r in raw]


def ndcg_rule_reward(df: DataFrame, g: int, group: str = "group_id", pos: str = "pos",
                     completion: str = "completion", target: str = "target", name: str = "ndcg_reward") -> DataFrame:
    """H2: a miss at position i gets the i-th weight, a hit 0; a group with no hit gets 0."""
    hit = (X.strip_chars(completion, '\n"') == X.strip_chars(target, '\n"'))
    d = df.withColumn("_hit", hit.cast("int"))
    any_hit = d.groupBy(group).agg(F.max("_hit").alias("_any"))
    w = F.element_at(F.array(*[F.lit(x) for x in ndcg_position_weights(g)]), (F.col(pos) % g).cast("int") + 1)
    return d.join(any_hit, group).withColumn(
        name, F.when(F.col("_any") == 0, 0.0).when(F.col("_hit") == 1, 0.0).otherwise(w)).drop("_hit", "_any")


def resolve_completions(df: DataFrame, items: DataFrame, n_items: int, keys, completion: str = "completion",
                        item_text: str = "sid", seed: int = 0) -> DataFrame:
    """H3/H4: the item a completion names, after ``strip('"\\n')``.

    Adds ``item_id`` (null when the text names none), ``is_unknown`` and ``picked_id``: the item,
    or for an unknown text a seeded uniform pick in ``[0, n_items)`` by ``keys``.  ``items`` has
    ``item_id`` and its text; of items that share a text the last (largest id) counts.
    """
    named = items.groupBy(F.col(item_text).alias("_text")).agg(F.max("item_id").alias("item_id"))
    out = df.withColumn("_text", X.strip_chars(completion, '\n"')).join(named, "_text", "left").drop("_text")
    pick = F.pmod(X.portable_hash(*keys, seed=seed), F.lit(n_items)).cast("bigint")
    return out.withColumn("is_unknown", F.col("item_id").isNull()).withColumn("picked_id", F.coalesce("item_id", pick))


def semantic_reward(df: DataFrame, vectors: DataFrame, pred_item: str, target_item: str, name: str = "semantic_reward") -> DataFrame:
    """H3: cosine of target and predicted item vectors; unknown completion -> NULL."""
    p = vectors.select(F.col("item_id").alias(pred_item), F.col("embedding").alias("_pv"))
    t = vectors.select(F.col("item_id").alias(target_item), F.col("embedding").alias("_tv"))
    j = df.join(p, pred_item, "left").join(t, target_item, "left")
    return j.withColumn(name, F.when(F.col("_pv").isNotNull() & F.col("_tv").isNotNull(), V.cosine("_tv", "_pv"))).drop("_pv", "_tv")


def cf_reward(df: DataFrame, scores: DataFrame, query: str, pred_item: str, name: str = "cf_reward") -> DataFrame:
    """H4: score of the predicted item in a given score table; unknown -> NULL."""
    s = scores.select(F.col("query_id").alias(query), F.col("item_id").alias(pred_item), F.col("score").alias(name))
    return df.join(s, [query, pred_item], "left")


def combine_rewards(df: DataFrame, weights: dict[str, float], name: str = "reward") -> DataFrame:
    """H5: weighted sum of the reward columns."""
    total = None
    for col, w in weights.items():
        term = F.lit(w) * F.col(col)
        total = term if total is None else total + term
    return df.withColumn(name, total)


def reward_logs(df: DataFrame, cols, reward: str = "reward", group: str = "group_id") -> DataFrame:
    """H5 logs: per-function means, the reward mean and the mean of the per-group reward
    std (sample std, as logged by the trainer)."""
    means = df.agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])
    std = df.groupBy(group).agg(F.stddev_samp(reward).alias("_s")).agg(F.avg("_s").alias("reward_std"))
    return means.crossJoin(std)  # two one-row aggregates


def grpo_advantage(df: DataFrame, reward: str = "reward", group: str = "group_id", name: str = "advantage") -> DataFrame:
    """H6: ``(r - mean_g) / (std_g + 1e-4)`` with the sample std."""
    st = df.groupBy(group).agg(F.avg(reward).alias("_m"), F.stddev_samp(reward).alias("_s"))
    j = df.join(st, group)
    return j.withColumn(name, (F.col(reward) - F.col("_m")) / (F.col("_s") + F.lit(ADV_EPS))).drop("_m", "_s")


def gdpo_advantage(df: DataFrame, rewards: dict[str, float], group: str = "group_id", batch: str = "batch_id",
                   name: str = "advantage") -> DataFrame:
    """H7: each reward normalised inside its group, weighted sum ignoring NaN, then
    normalised over the whole batch.  With a single reward it falls back to H6 (T14)."""
    cols = list(rewards)
    if len(cols) == 1:
        return grpo_advantage(combine_rewards(df, rewards, "_r"), "_r", group, name).drop("_r")
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}")]
    st = df.groupBy(group).agg(*aggs)
    j = df.join(st, group)
    pre = None
    for c, w in rewards.items():
        a = (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + F.lit(ADV_EPS))
        term = F.when(F.isnan(a) | a.isNull(), F.lit(0.0)).otherwise(F.lit(w) * a)
        pre = term if pre is None else pre + term
    j = j.withColumn("_pre", pre).drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])
    bst = j.groupBy(batch).agg(F.avg("_pre").alias("_bm"), F.stddev_samp("_pre").alias("_bs"))
    return j.join(bst, batch).withColumn(name, (F.col("_pre") - F.col("_bm")) / (F.col("_bs") + F.lit(ADV_EPS))).drop(
        "_pre", "_bm", "_bs")


def select_completions(df: DataFrame, g: int, group: str = "group_id", pos: str = "pos", completion: str = "completion",
                       target: str = "target") -> DataFrame:
    """H8: dynamic sampling of G completions from a larger pool.

    Order: copies of the target first (up to G), then round-robin over the other
    completions by frequency (desc) and first appearance; keep the first G.
    """
    from pyspark.sql import Window

    occ = Window.partitionBy(group, completion).orderBy(pos)
    d = df.withColumn("_copy", F.row_number().over(occ) - 1)
    stats = d.groupBy(group, completion).agg(F.count(F.lit(1)).alias("_freq"), F.min(pos).alias("_first"))
    d = d.join(stats, [group, completion])
    is_t = (F.col(completion) == F.col(target)).cast("int")
    # the pool per group is 1.5*G rows: a bounded window
    rank = F.row_number().over(Window.partitionBy(group).orderBy(is_t.desc(), F.col("_copy"), F.col("_freq").desc(), F.col("_first")))
    return d.withColumn("sel_pos", rank - 1).filter(F.col("sel_pos") < g).drop("_copy", "_freq", "_first")


def add_ground_truth(df: DataFrame, repeat: int, pos: str = "pos", completion: str = "completion",
                     target: str = "target", name: str = "completion_gt") -> DataFrame:
    """H9: the last row of each repeat block is replaced by the ground truth."""
    return df.withColumn(name, F.when((F.col(pos) + 1) % repeat == 0, F.col(target)).otherwise(F.col(completion)))


def categorical_diversity(df: DataFrame, group: str = "group_id", completion: str = "completion") -> DataFrame:
    """Mean over groups of distinct completions / group size."""
    per = df.groupBy(group).agg((F.countDistinct(completion) / F.count(F.lit(1))).alias("_d"))
    return per.agg(F.avg("_d").alias("categorical_diversity"))


def token_diversity(df: DataFrame, tokens: str, pad: int = 0) -> DataFrame:
    """Distinct non-pad token ids / total non-pad token ids; 0 when all are pads."""
    ex = df.select(F.explode(tokens).alias("_t")).filter(F.col("_t") != pad)
    return ex.agg(F.coalesce(F.try_divide(F.countDistinct("_t"), F.count(F.lit(1))), F.lit(0.0)).alias("token_diversity"))


def per_token_kl(logp: str = "logp", ref: str = "ref_logp") -> Column:
    """``exp(ref - p) - (ref - p) - 1``."""
    diff = F.col(ref) - F.col(logp)
    return F.exp(diff) - diff - F.lit(1.0)


def kl_report(logps: DataFrame, seq_keys=("batch_id", "group_id", "pos"), mask: str = "mask") -> DataFrame:
    """Mean over sequences of the masked mean KL, and mean completion length."""
    d = logps.withColumn("_kl", per_token_kl())
    seq = d.groupBy(*seq_keys).agg(F.try_divide(F.sum(F.col("_kl") * F.col(mask)), F.sum(mask)).alias("_skl"), F.sum(mask).alias("_len"))
    return seq.agg(F.avg("_skl").alias("mean_kl"), F.avg("_len").alias("completion_length"))


def policy_loss(logps: DataFrame, kind: str = "default", beta: float = 0.04, seq_keys=("batch_id", "group_id", "pos"),
                mask: str = "mask", adv: str = "advantage") -> DataFrame:
    """Loss values.  ratio = exp(p - p_old) with ``p_old`` given.

    default: mean over sequences of the masked token mean; dapo: masked token mean
    over the batch; gspo: sequence ratio exp(masked mean log-ratio).
    """
    d = logps.withColumn("_kl", per_token_kl()).withColumn("_lr", F.col("logp") - F.col("logp_old"))
    d = d.withColumn("_tl", -(F.exp("_lr") * F.col(adv) - F.lit(beta) * F.col("_kl")))
    m = F.col(mask)
    if kind == "dapo":
        return d.agg(F.try_divide(F.sum(F.col("_tl") * m), F.sum(m)).alias("loss"))
    seq = d.groupBy(*seq_keys).agg(
        F.try_divide(F.sum(F.col("_tl") * m), F.sum(m)).alias("_sl"),
        F.exp(F.try_divide(F.sum(F.col("_lr") * m), F.sum(m))).alias("_s"),
        F.try_divide(F.sum(F.col("_kl") * m), F.sum(m)).alias("_skl"),
        F.first(adv).alias("_a"),
    )
    if kind == "gspo":
        return seq.agg((-F.avg(F.col("_s") * F.col("_a") - F.lit(beta) * F.col("_skl"))).alias("loss"))
    return seq.agg(F.avg("_sl").alias("loss"))


def policy_losses(logps: DataFrame, beta: float = 0.04, seq_keys=("batch_id", "group_id", "pos"),
                  mask: str = "mask", adv: str = "advantage") -> DataFrame:
    """H13, all three loss forms from one per-sequence aggregate: rows ``(kind, loss)``."""
    d = logps.withColumn("_kl", per_token_kl()).withColumn("_lr", F.col("logp") - F.col("logp_old"))
    d = d.withColumn("_tl", -(F.exp("_lr") * F.col(adv) - F.lit(beta) * F.col("_kl")))
    m = F.col(mask)
    seq = d.groupBy(*seq_keys).agg(
        F.sum(F.col("_tl") * m).alias("_tsum"), F.sum(m).alias("_msum"),
        F.sum(F.col("_lr") * m).alias("_lrsum"), F.sum(F.col("_kl") * m).alias("_klsum"), F.first(adv).alias("_a"))
    tot = seq.agg(
        F.avg(F.try_divide(F.col("_tsum"), F.col("_msum"))).alias("default"),
        F.try_divide(F.sum("_tsum"), F.sum("_msum")).alias("dapo"),
        (-F.avg(F.exp(F.try_divide(F.col("_lrsum"), F.col("_msum"))) * F.col("_a")
                - F.lit(beta) * F.try_divide(F.col("_klsum"), F.col("_msum")))).alias("gspo"),
    )
    return tot.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("loss")) for k in ("default", "dapo", "gspo")])).alias("_r")).select("_r.*")


def reward_sparsity(df: DataFrame, reward: str, group: str = "group_id") -> DataFrame:
    """Share of groups whose rewards have zero spread, and the hit rate."""
    per = df.groupBy(group).agg(F.max(reward).alias("_mx"), F.min(reward).alias("_mn"), F.avg(reward).alias("_avg"))
    return per.agg(
        F.avg(F.when(F.col("_mx") == F.col("_mn"), 1.0).otherwise(0.0)).alias("zero_std_share"),
        F.avg("_avg").alias("hit_rate"),
        F.count(F.lit(1)).alias("n_groups"),
    )


def softplus(x: Column) -> Column:
    """Stable ``log(1 + exp(x))``."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce_pairs(df: DataFrame, pos_score: str, neg_score: str, keys) -> DataFrame:
    """Positive and negative scores stacked with labels 1/0."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.select(*keys, F.explode(F.array(
        F.struct(F.col(pos_score).alias("score"), F.lit(1.0).alias("label")),
        F.struct(F.col(neg_score).alias("score"), F.lit(0.0).alias("label")))).alias("_p")).select(*keys, "_p.score", "_p.label")


def bce(pairs: DataFrame) -> DataFrame:
    """Mean binary cross-entropy with logits."""
    s, y = F.col("score"), F.col("label")
    return pairs.agg(F.avg(y * softplus(-s) + (F.lit(1.0) - y) * softplus(s)).alias("bce"))


def total_loss(base: Column, dro: Column, alpha: float) -> Column:
    """``base + alpha * dro`` (the base loss alone when ``alpha`` is 0)."""
    return base if alpha == 0.0 else base + F.lit(alpha) * dro


def cross_entropy(scores: DataFrame, targets: DataFrame, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """H16 base loss ``ce``: mean over queries of log-sum-exp of all scores minus the target's score."""
    top = scores.groupBy(query).agg(F.max("score").alias("_m"))
    lse = scores.join(top, query).groupBy(query).agg((F.first("_m") + F.log(F.sum(F.exp(F.col("score") - F.col("_m"))))).alias("_lse"))
    hit = scores.join(targets.select(query, item).distinct(), [query, item]).select(query, "score")
    return lse.join(hit, query).agg(F.avg(F.col("_lse") - F.col("score")).alias("ce"))


def dro_loss(scores: DataFrame, prop: DataFrame, targets: DataFrame, beta: float = 1.0, query: str = "query_id",
             item: str = "item_id") -> DataFrame:
    """``mean_q log(sum_j exp(s_j^2 ps_j / b) - exp(s_t^2 ps_t / b) + exp((s_t-1)^2 ps_t / b) + 1e-24)``."""
    j = scores.join(prop.select(item, "propensity"), item)
    t = targets.select(F.col(query).alias("_q"), F.col(item).alias("_t"))
    j = j.join(t, j[query] == t["_q"]).drop("_q")
    s, ps = F.col("score"), F.col("propensity")
    is_t = F.col(item) == F.col("_t")
    per = j.groupBy(query).agg(
        F.sum(F.exp(s * s * ps / beta)).alias("_all"),
        F.sum(F.when(is_t, F.exp(s * s * ps / beta)).otherwise(0.0)).alias("_pos"),
        F.sum(F.when(is_t, F.exp((s - 1) * (s - 1) * ps / beta)).otherwise(0.0)).alias("_posl"),
    )
    return per.agg(F.avg(F.log(F.col("_all") - F.col("_pos") + F.col("_posl") + F.lit(1e-24))).alias("dro_loss"))
