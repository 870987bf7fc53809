"""Semantic-ID operators.

Group statistics are partial aggregates keyed by the code path; ranks inside a
path use the skew-safe ``group_row_number`` (a path shared by a third of the
catalogue is split across range partitions, never one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..sources.ordinal import group_row_number, with_ordinal


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def offset_codes(codes, offset: int = 1) -> Column:
    """The token format adds ``offset`` (1 by default) to every code."""
    return F.transform(_c(codes), lambda c: c + F.lit(offset))


def codes_to_tokens(codes, offset: int = 0) -> Column:
    """``<a_3>``-style tokens, letter = chr(97 + level)."""
    return F.transform(
        _c(codes), lambda c, i: F.format_string("<%s_%d>", F.char(F.lit(97) + i), (c + F.lit(offset)).cast("int"))
    )


def sid_full(tokens) -> Column:
    """D3: all tokens joined."""
    return F.array_join(_c(tokens), "")


def sid3(tokens) -> Column:
    """First three tokens joined, only when there are at least three."""
    t = _c(tokens)
    return F.when(F.size(t) >= 3, F.array_join(F.slice(t, 1, 3), ""))


def path_key(codes) -> Column:
    return F.array_join(F.transform(_c(codes), lambda c: c.cast("string")), ",")


def dedup_suffix(df: DataFrame, codes: str = "codes", order_col: str = "item_id") -> DataFrame:
    """When a code path occurs more than once, append the 1-based rank of the
    row inside its path (by ``order_col``)."""
    ranked = group_row_number(df, [codes], [order_col], name="_dup_rank", with_count="_dup_n")
    return ranked.withColumn(
        codes,
        F.when(F.col("_dup_n") > 1, F.concat(F.col(codes), F.array(F.col("_dup_rank").cast("int")))).otherwise(F.col(codes)),
    ).drop("_dup_rank", "_dup_n")


def path_counts(df: DataFrame, codes: str = "codes") -> DataFrame:
    return df.groupBy(codes).agg(F.count(F.lit(1)).alias("group_size"))


def collision_rate(df: DataFrame, codes: str = "codes") -> DataFrame:
    """``(n - distinct paths) / n`` with exact distinct counts (two-level aggregate)."""
    g = path_counts(df, codes)
    return g.agg(
        F.sum("group_size").cast("bigint").alias("n_items"),
        F.count(F.lit(1)).cast("bigint").alias("distinct_paths"),
    ).withColumn("collision_rate", X.r6((F.col("n_items") - F.col("distinct_paths")) / F.col("n_items")))


def collision_groups(df: DataFrame, codes: str = "codes", member: str = "item_id") -> DataFrame:
    """D6 in long form: one row per member of a colliding path, with the group size
    and the member's rank (a member list per path would be an unbounded collect)."""
    ranked = group_row_number(df.select(codes, member), [codes], [member], name="member_rank", with_count="group_size")
    return ranked.filter(F.col("group_size") > 1).select(
        path_key(codes).alias("path"), member, F.col("group_size").cast("bigint").alias("group_size"),
        F.col("member_rank").cast("bigint").alias("member_rank"),
    )


def duplication_report(df: DataFrame, codes: str = "codes") -> DataFrame:
    """Colliding groups, surplus rows, largest group; ``rows_minus_groups`` is the
    parity figure the reference prints as unique paths (T6)."""
    g = path_counts(df, codes)
    return g.agg(
        F.sum(F.when(F.col("group_size") > 1, 1).otherwise(0)).cast("bigint").alias("n_groups"),
        F.sum(F.when(F.col("group_size") > 1, F.col("group_size") - 1).otherwise(0)).cast("bigint").alias("surplus_rows"),
        F.coalesce(F.max(F.when(F.col("group_size") > 1, F.col("group_size"))), F.lit(0)).cast("bigint").alias("largest_group"),
        F.count(F.lit(1)).cast("bigint").alias("distinct_paths"),
        F.sum("group_size").cast("bigint").alias("n_items"),
    ).withColumn("rows_minus_groups", F.col("n_items") - F.col("n_groups"))


def duplicate_sizes(df: DataFrame, codes: str = "codes") -> DataFrame:
    """D7 table sorted by size: how many paths have each group size (> 1)."""
    g = path_counts(df, codes).filter(F.col("group_size") > 1)
    return g.groupBy("group_size").agg(F.count(F.lit(1)).cast("bigint").alias("n_paths")).select(
        F.col("group_size").cast("bigint").alias("group_size"), "n_paths").orderBy(F.desc("group_size"))


def level_codes(df: DataFrame, codes: str = "codes") -> DataFrame:
    return df.select(F.posexplode(codes).alias("level", "code"))


def level_usage(df: DataFrame, k: int, codes: str = "codes") -> DataFrame:
    """Per level unique codes, utilisation n/K and cluster size min/max/mean."""
    per_code = level_codes(df, codes).groupBy("level", "code").agg(F.count(F.lit(1)).alias("sz"))
    return per_code.groupBy("level").agg(
        F.count(F.lit(1)).cast("bigint").alias("unique_codes"),
        X.r6(F.count(F.lit(1)) / F.lit(float(k))).alias("utilisation"),
        F.min("sz").cast("bigint").alias("min_size"),
        F.max("sz").cast("bigint").alias("max_size"),
        X.r6(F.avg("sz")).alias("mean_size"),
    ).withColumn("level", F.col("level").cast("bigint"))


def level_entropy(df: DataFrame, codes: str = "codes") -> DataFrame:
    """Entropy (bits) of the code distribution per level."""
    per_code = level_codes(df, codes).groupBy("level", "code").agg(F.count(F.lit(1)).alias("sz"))
    tot = per_code.groupBy("level").agg(F.sum("sz").alias("_n"))
    # one row per level: a tiny broadcast
    p = per_code.join(F.broadcast(tot), "level").withColumn("_p", F.col("sz") / F.col("_n"))
    return p.groupBy("level").agg(X.r6(-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy")).withColumn(
        "level", F.col("level").cast("bigint"))


def sid_quality(index: DataFrame, tokens: str = "tokens", threshold: float = 0.10) -> DataFrame:
    """Format errors (< 3 tokens), collision rate of the 3-token SID, PASS/WARN."""
    t = index.select(sid3(tokens).alias("_s3"), F.size(tokens).alias("_n"))
    g = t.groupBy("_s3").agg(F.count(F.lit(1)).alias("_c"), F.sum(F.when(F.col("_n") < 3, 1).otherwise(0)).alias("_bad"))
    a = g.agg(
        F.sum("_c").cast("bigint").alias("n_items"),
        F.sum("_bad").cast("bigint").alias("format_errors"),
        F.sum(F.when(F.col("_s3").isNotNull(), 1).otherwise(0)).cast("bigint").alias("distinct_sid3"),
        F.sum(F.when(F.col("_s3").isNotNull(), F.col("_c")).otherwise(0)).cast("bigint").alias("_valid"),
    )
    rate = (F.col("_valid") - F.col("distinct_sid3")) / F.col("n_items")
    return a.select(
        "n_items", "format_errors", "distinct_sid3", X.r6(rate).alias("collision_rate"),
        F.when((F.col("format_errors") == 0) & (rate < threshold), F.lit("PASS")).otherwise(F.lit("WARN")).alias("status"),
    )


def sid_vocab(index: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Distinct tokens in sorted order with their 0-based position."""
    toks = index.select(F.explode(tokens).alias("token")).distinct()
    return with_ordinal(toks, ["token"], "token_ord")


def last_write_wins(df: DataFrame, key: str, order_col: str, value_cols) -> DataFrame:
    """Dictionary overwrite semantics -- the row with the highest ordinal per key
    wins (partial aggregate of ``max(struct(ord, value))``)."""
    vals = [value_cols] if isinstance(value_cols, str) else list(value_cols)
    best = df.groupBy(key).agg(F.max(F.struct(order_col, *vals)).alias("_w"))
    return best.select(key, *[F.col(f"_w.{v}").alias(v) for v in vals])


def is_known(df: DataFrame, col: str, known: DataFrame, known_col: str, name: str = "is_known") -> DataFrame:
    """Membership flag via a left join on the distinct known values."""
    k = known.select(F.col(known_col).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return df.join(k, df[col] == k["_k"], "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")


def remap_ids(df: DataFrame, col: str, name: str = "idx") -> DataFrame:
    """Dense 0-based index over the sorted distinct values (the written map)."""
    return with_ordinal(df.select(col).distinct(), [col], name)


def best_codebook(metric_log: DataFrame, run: str = "run", collision: str = "collision_rate", loss: str = "loss") -> DataFrame:
    """Best run by lowest collision (then loss, then name) and, separately, the lowest-loss run."""
    return metric_log.agg(
        F.min(F.struct(collision, loss, run))[run].alias("best_by_collision"),
        F.min(F.struct(loss, collision, run))[run].alias("best_by_loss"),
    )
