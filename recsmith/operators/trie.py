"""Prefix tables, constrained scoring and constrained beam top-k.

The prefix table is keyed by ``(depth, prefix)`` (T22).  Building it dedupes
``(depth, prefix, next)`` first (a partial aggregate), so the root prefix, which
every SID passes through, is combined map-side and its allowed set is bounded by
the codebook size.  Beam search unrolls into ``depth`` join rounds; each round
keeps ``beams`` rows per query with a window bounded by beams x allowed tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .logsum import log_sum_exp

EOS = "</s>"

#: Vocabulary bytes that are broadcast at a time.
BROADCAST_BYTES = 64 << 20


def build_trie(df: DataFrame, tokens: str = "tokens", eos: str = EOS) -> DataFrame:
    """``(depth, prefix, allowed array<string> sorted)`` from token lists; the
    full list is followed by ``eos``."""
    t = F.col(tokens)
    steps = df.select(tokens).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.size(t)), lambda dpt: F.struct(
            dpt.cast("int").alias("depth"),
            F.array_join(F.slice(t, 1, dpt), "").alias("prefix"),
            F.when(dpt < F.size(t), F.element_at(t, dpt + 1)).otherwise(F.lit(eos)).alias("next"),
        ))).alias("s")
    ).select("s.*")
    distinct = steps.distinct()
    return distinct.groupBy("depth", "prefix").agg(F.array_sort(F.collect_list("next")).alias("allowed"))


def allowed_next(trie: DataFrame, prefixes: DataFrame, depth: str = "depth", prefix: str = "prefix") -> DataFrame:
    """Allowed next tokens of each queried prefix; an unknown prefix gets []."""
    t = trie.select(F.col("depth").alias(depth), F.col("prefix").alias(prefix), "allowed")
    j = prefixes.join(t, [depth, prefix], "left")
    return j.withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))


def log_softmax(df: DataFrame, keys, logit: str = "logit", name: str = "logp") -> DataFrame:
    """Log-softmax of ``logit`` inside ``keys`` (mergeable log-sum-exp, one join)."""
    keys = list(keys)
    return df.join(log_sum_exp(df, keys, logit, "_lse"), keys).withColumn(name, F.col(logit) - F.col("_lse")).drop("_lse")


def over_vocabulary(prefixes: DataFrame, vocab: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every prefix row with every token of the vocabulary (what a model scores at a step).

    The vocabulary stays a table.  Its size is counted first: up to ``max_bytes`` it is
    broadcast, a larger one in as many hash parts as it takes, one after the other, so
    no task ever holds more than that much of it and prefixes are never shuffled.
    """
    held = vocab.agg((F.count(F.lit(1)) * 64 + F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).alias("b")).first()["b"]
    parts = max(1, -(-held // max_bytes))
    out = None
    for i in range(parts):
        part = vocab if parts == 1 else vocab.where(F.pmod(F.xxhash64("token"), F.lit(parts)) == i)
        rows = prefixes.crossJoin(F.broadcast(part))
        out = rows if out is None else out.unionByName(rows)
    return out


def constrain_scores(scores: DataFrame, trie: DataFrame, temperature: float = 1.0, query: str = "query_id",
                     eos: str = EOS) -> DataFrame:
    """Temperature, log-softmax over the full vocabulary per (query, depth, prefix), keep
    allowed tokens only; a dead prefix (no trie entry) keeps only EOS with its own log-prob."""
    s = scores.withColumn("logit", F.col("logit") / F.lit(temperature))
    keys = [query, "depth", "prefix"]
    s = log_softmax(s, keys)
    allowed = trie.select("depth", "prefix", F.explode("allowed").alias("token")).withColumn("_ok", F.lit(True))
    live = trie.select("depth", "prefix").withColumn("_live", F.lit(True))
    j = s.join(live, ["depth", "prefix"], "left").join(allowed, ["depth", "prefix", "token"], "left")
    keep = F.when(F.col("_live").isNull(), F.col("token") == F.lit(eos)).otherwise(F.col("_ok").isNotNull())
    return j.filter(keep).drop("_ok", "_live")


def vocabulary(index: DataFrame, tokens: str = "tokens", eos: str = EOS) -> DataFrame:
    """The SID vocabulary as a table ``token`` (distinct tokens and EOS)."""
    eos_row = index.sparkSession.createDataFrame([(eos,)], "token string")
    return index.select(F.explode(tokens).alias("token")).union(eos_row).distinct()


def beam_topk(queries: DataFrame, trie: DataFrame, vocab: DataFrame, logit_fn, beams: int, depth: int | None = None,
              query: str = "query_id", eos: str = EOS, text_key=None) -> DataFrame:
    """Constrained beam search until every beam has ended.

    ``logit_fn(query_col, prefix_col, token_col) -> Column`` gives the model score of a
    token after a prefix (of their ``text_key`` values if that is given: computed once for
    each prefix and token, not for each pair); each step normalises it by log-softmax over the whole
    vocabulary, keeps allowed tokens only and sums the log-probs (length penalty 0).  EOS
    is a scored step; a beam that has taken it is carried on unchanged.  Ties break by
    the sequence text.  Each step keeps ``beams`` rows per query; the number of steps
    follows from the prefix table (its deepest prefix and the EOS after it).

    The vocabulary is a table: the scores of a step are rows (``over_vocabulary``) that a mergeable
    log-sum-exp adds up to one normaliser for each beam.  The prefixes of a level join by equality; the root row
    goes to every query by a broadcast.
    """
    # the prefix table and the vocabulary are read at every step: materialise them once
    key = text_key or (lambda c: c)
    trie = cut_lineage(trie.select("depth", "prefix", "allowed"))
    vocab = cut_lineage(vocab.select("token", key(F.col("token")).alias("_tk")))
    last = trie.agg(F.max("depth")).first()[0]
    steps = (0 if last is None else last + 1) if depth is None else depth
    cur = queries.select(query).distinct().select(query, F.lit("").alias("prefix"), F.lit(0.0).alias("score"), F.lit(False).alias("ended"))
    cur = cut_lineage(cur.withColumn("_pk", key(F.col("prefix"))))  # kept as a column: not derived again for each token
    for d in range(steps):
        live = cur.filter(~F.col("ended") & F.col(query).isNotNull()).select(query, "prefix", "score", "_pk")
        beam = [query, "prefix", "score", "_pk"]
        scored = over_vocabulary(live, vocab).select(*beam, logit_fn(F.col(query), F.col("_pk"), F.col("_tk")).alias("_lg"))
        # grouped by all columns of a beam: nothing has to be joined back to it
        norm = log_sum_exp(scored, beam, "_lg", "_lse")
        lvl = trie.filter(F.col("depth") == d)
        # depth 0 has the one root prefix: its row goes to every query without an exchange on ""
        at = norm.crossJoin(F.broadcast(lvl.select("allowed"))) if d == 0 else norm.join(lvl.select("prefix", "allowed"), "prefix")
        cand = at.select(*beam, "_lse", F.explode("allowed").alias("token")).withColumn(
            "score", F.col("score") + logit_fn(F.col(query), F.col("_pk"), key(F.col("token"))) - F.col("_lse"))
        cand = cand.select(query, F.concat(F.col("prefix"), F.col("token")).alias("prefix"), "score", (F.col("token") == eos).alias("ended"))
        both = cand.unionByName(cur.filter("ended").drop("_pk"))
        # per query at most beams x allowed rows: a bounded window
        w = Window.partitionBy(query).orderBy(F.desc("score"), F.asc("prefix"))
        best = both.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= beams).drop("_r")
        cur = cut_lineage(best.withColumn("_pk", key(F.col("prefix"))))
    w = Window.partitionBy(query).orderBy(F.desc("score"), F.asc("prefix"))
    ranked = cur.drop("_pk").withColumn("beam_rank", F.row_number().over(w).cast("bigint"))
    return ranked.withColumn("prefix", F.when(F.col("ended"), F.expr(f"left(prefix, length(prefix) - {len(eos)})")).otherwise(F.col("prefix")))


def token_logit(q: Column, prefix: Column, token: Column) -> Column:
    """Deterministic stand-in model score used by the fixtures (string keys via MD5)."""
    from ..functions.expr import string_key

    return key_logit(q, string_key(prefix), string_key(token))


def key_logit(q: Column, prefix_key: Column, token_key: Column) -> Column:
    """``token_logit`` of the string keys."""
    return ((q * 31 + (prefix_key % 1000) * 7 + (token_key % 1000) * 13) % 1000) / F.lit(100.0)


def token_logit_sql(q: str, prefix: str, token: str) -> str:
    from ..functions.expr import string_key_sql

    return f"((({q}) * 31 + ({string_key_sql(prefix)} % 1000) * 7 + ({string_key_sql(token)} % 1000) * 13) % 1000) / 100.0"
