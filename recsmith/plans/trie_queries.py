"""Prefix-table, constrained-scoring and beam queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import trie as TR
from . import fixtures as FX
from .registry import register

BEAMS = 5
SQL_STEPS = 5  # three codes, a collision suffix and EOS


def _trie_sql(src: str) -> dict:
    return {
        "tk": f"SELECT tokens, unnest(range(0, len(tokens) + 1)) AS depth FROM {src}",
        "steps": """SELECT DISTINCT depth, array_to_string(tokens[1:depth], '') AS prefix,
       CASE WHEN depth < len(tokens) THEN tokens[depth + 1] ELSE '</s>' END AS nxt FROM tk""",
        "trie": "SELECT depth, prefix, list_sort(list(nxt)) AS allowed FROM steps GROUP BY depth, prefix",
    }


def _trie_out(t):
    return t.select(F.col("depth").cast("bigint").alias("depth"), "prefix", F.array_join("allowed", ",").alias("allowed"),
                    F.size("allowed").cast("bigint").alias("n_allowed"))


TRIE_OUT_SQL = "SELECT CAST(depth AS BIGINT) AS depth, prefix, array_to_string(allowed, ',') AS allowed, len(allowed) AS n_allowed FROM trie"


@register("sid_trie", FX.with_ctes({**FX.sql_sid_ctes(), **_trie_sql("sid_index")}, TRIE_OUT_SQL))
def sid_trie(spark, d):
    """SID prefix table with EOS after each full SID."""
    return _trie_out(TR.build_trie(FX.sid_index(spark, d), "tokens"))


@register("title_trie", FX.with_ctes({"it": FX.ITEMS_SQL, "tt": "SELECT string_split(title, ' ') AS tokens FROM it",
                                      **_trie_sql("tt")}, TRIE_OUT_SQL))
def title_trie(spark, d):
    """The same prefix table over title words."""
    t = FX.items(spark, d).select(F.split("title", " ").alias("tokens"))
    return _trie_out(TR.build_trie(t, "tokens"))


@register("allowed_next_lookup", FX.with_ctes({**FX.sql_sid_ctes(), **_trie_sql("sid_index"),
    "q": """SELECT p.p_partkey AS item_id, 2 AS depth, coalesce(array_to_string(s.tokens[1:2], ''), '<a_0><b_0>') AS prefix
FROM part p LEFT JOIN sid_index s ON s.item_id = p.p_partkey"""},
    """SELECT q.item_id, array_to_string(coalesce(t.allowed, []), ',') AS allowed, CAST(len(coalesce(t.allowed, [])) AS BIGINT) AS n_allowed
FROM q LEFT JOIN trie t ON t.depth = q.depth AND t.prefix = q.prefix"""))
def allowed_next_lookup(spark, d):
    """Allowed next tokens after each catalogue item's 2-token prefix (unknown -> none)."""
    idx = FX.sid_index(spark, d)
    trie = TR.build_trie(idx, "tokens")
    p = FX.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    q = p.join(idx.select("item_id", "tokens"), "item_id", "left").select(
        "item_id", F.lit(2).alias("depth"),
        F.coalesce(F.array_join(F.slice("tokens", 1, 2), ""), F.lit("<a_0><b_0>")).alias("prefix"))
    a = TR.allowed_next(trie, q)
    return a.select("item_id", F.array_join("allowed", ",").alias("allowed"), F.size("allowed").cast("bigint").alias("n_allowed"))


_VOCAB_SQL = "SELECT DISTINCT token FROM (SELECT unnest(tokens) AS token FROM sid_index UNION ALL SELECT '</s>' AS token)"


@register("constrained_scores", FX.with_ctes({**FX.sql_candidate_ctes(n=1), **_trie_sql("sid_index"), "vocab": _VOCAB_SQL,
    "q": """SELECT et.user_id AS query_id, 2 AS depth,
       CASE WHEN et.user_id % 2 = 1 THEN '<a_0><b_0>' ELSE array_to_string(s.tokens[1:2], '') END AS prefix
FROM et JOIN sid_index s ON s.item_id = et.target""",
    "sc": f"SELECT q.query_id, q.depth, q.prefix, v.token, {TR.token_logit_sql('q.query_id', 'q.prefix', 'v.token')} / 0.7 AS logit FROM q, vocab v",
    "mx": "SELECT *, max(logit) OVER (PARTITION BY query_id, depth, prefix) AS m FROM sc",
    "ls": "SELECT *, logit - (m + ln(sum(exp(logit - m)) OVER (PARTITION BY query_id, depth, prefix))) AS logp FROM mx",
    "al": "SELECT depth, prefix, unnest(allowed) AS token FROM trie"},
    """SELECT ls.query_id, ls.token, round(ls.logp, 6) AS logp FROM ls
WHERE (NOT EXISTS (SELECT 1 FROM trie t WHERE t.depth = ls.depth AND t.prefix = ls.prefix) AND ls.token = '</s>')
   OR EXISTS (SELECT 1 FROM al WHERE al.depth = ls.depth AND al.prefix = ls.prefix AND al.token = ls.token)"""))
def constrained_scores(spark, d):
    """Temperature 0.7, log-softmax over the vocabulary, mask to allowed tokens; dead prefixes keep EOS."""
    idx = FX.sid_index(spark, d)
    trie = TR.build_trie(idx, "tokens")
    t = FX.eval_targets(spark, d, idx).join(idx.select(F.col("item_id").alias("target"), "tokens"), "target")
    q = t.select(F.col("user_id").alias("query_id"), F.lit(2).alias("depth"),
                 F.when(F.col("user_id") % 2 == 1, F.lit("<a_0><b_0>")).otherwise(F.array_join(F.slice("tokens", 1, 2), "")).alias("prefix"))
    # the scores of a step: every query's prefix with every token of the vocabulary table
    sc = TR.over_vocabulary(q, TR.vocabulary(idx)).withColumn("logit", TR.token_logit(F.col("query_id"), F.col("prefix"), F.col("token")))
    c = TR.constrain_scores(sc, trie, temperature=0.7)
    return c.select("query_id", "token", X.r6("logp").alias("logp"))


def _beam_sql() -> str:
    ctes = {**FX.sql_candidate_ctes(n=1), **_trie_sql("sid_index"), "vocab": _VOCAB_SQL,
            "b0": "SELECT user_id AS query_id, '' AS prefix, CAST(0.0 AS DOUBLE) AS score, false AS ended FROM et"}
    for dpt in range(SQL_STEPS):
        ctes[f"c{dpt}"] = f"SELECT b.query_id, b.prefix, unnest(t.allowed) AS token, b.score FROM b{dpt} b JOIN trie t ON t.depth = {dpt} AND t.prefix = b.prefix WHERE NOT b.ended"
        ctes[f"f{dpt}"] = f"SELECT b.query_id, b.prefix, {TR.token_logit_sql('b.query_id', 'b.prefix', 'v.token')} AS lg FROM b{dpt} b, vocab v WHERE NOT b.ended"
        ctes[f"l{dpt}"] = f"""SELECT query_id, prefix, mx + ln(sum(exp(lg - mx))) AS lse FROM (
  SELECT *, max(lg) OVER (PARTITION BY query_id, prefix) AS mx FROM f{dpt}) GROUP BY query_id, prefix, mx"""
        ctes[f"n{dpt}"] = f"""SELECT c.query_id, c.prefix || c.token AS prefix,
       c.score + {TR.token_logit_sql('c.query_id', 'c.prefix', 'c.token')} - l.lse AS score, c.token = '</s>' AS ended
FROM c{dpt} c JOIN l{dpt} l ON l.query_id = c.query_id AND l.prefix = c.prefix
UNION ALL SELECT query_id, prefix, score, ended FROM b{dpt} WHERE ended"""
        ctes[f"b{dpt + 1}"] = f"SELECT * FROM n{dpt} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prefix) <= {BEAMS}"
    return FX.with_ctes(ctes, f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prefix) AS BIGINT) AS beam_rank,
       replace(prefix, '</s>', '') AS sid, round(score, 6) AS score FROM b{SQL_STEPS}""")


@register("beam_top5", _beam_sql())
def beam_top5(spark, d):
    """Constrained beam search (5 beams, to the end of every SID) per evaluation user."""
    idx = FX.sid_index(spark, d)
    trie = TR.build_trie(idx, "tokens")
    q = FX.eval_targets(spark, d, idx).select(F.col("user_id").alias("query_id"))
    b = TR.beam_topk(q, trie, TR.vocabulary(idx), TR.key_logit, BEAMS, text_key=X.string_key)
    return b.select("query_id", "beam_rank", F.col("prefix").alias("sid"), X.r6("score").alias("score"))
