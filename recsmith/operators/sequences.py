"""Interactions, sequences and sampling.

Two shapes are offered: the long form ``(user, pos, item)`` that stays balanced
under skew, and the per-user array form of the reference data model.  Splitting
off the last event is a partial aggregate (``max(struct)``) plus an anti join on
the full event key, so a user with a huge history is never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..sources.ordinal import group_row_number


def last_event(events: DataFrame, user: str, order_cols, item: str = "item_id") -> DataFrame:
    """Per-user last event in the total order ``order_cols`` (partial aggregate)."""
    cols = list(order_cols) if item in order_cols else list(order_cols) + [item]
    best = events.groupBy(user).agg(F.max(F.struct(*cols)).alias("_last"))
    return best.select(user, *[F.col(f"_last.{c}").alias(c) for c in cols])


def user_targets(events: DataFrame, user: str, order_cols, item: str = "item_id", min_events: int = 2) -> DataFrame:
    """Leave-last-out targets without building any sequence: one partial aggregate per
    user gives the last item and the event count; users below ``min_events`` drop out.
    Returns ``user, target, n_hist``."""
    cols = list(order_cols) if item in order_cols else list(order_cols) + [item]
    a = events.groupBy(user).agg(F.max(F.struct(*cols)).alias("_last"), F.count(F.lit(1)).alias("_n"))
    return a.filter(F.col("_n") >= min_events).select(
        user, F.col(f"_last.{item}").alias("target"), (F.col("_n") - 1).cast("bigint").alias("n_hist"))


def split_last(events: DataFrame, user: str, order_cols, item: str = "item_id"):
    """E5 long form: (history rows, target rows).  Users with one event keep no history."""
    last = last_event(events, user, order_cols, item)
    key = [user] + [c for c in order_cols]
    history = events.join(last.select(*key), key, "left_anti")
    targets = last.select(user, F.col(item).alias("target"))
    return history, targets


def history_item_counts(events: DataFrame, user: str, order_cols, item: str = "item_id") -> DataFrame:
    """Item counts over every user's history (all events but the last) without
    materialising the history: the history is the events minus exactly one target
    row per user, so ``count_history = count_all - count_targets``.  Both sides are
    partial aggregates; no event row is shuffled."""
    all_counts = events.groupBy(item).agg(F.count(F.lit(1)).alias("_all"))
    t = last_event(events, user, order_cols, item)
    t_counts = t.groupBy(item).agg(F.count(F.lit(1)).alias("_t"))
    c = all_counts.join(t_counts, item, "left").select(item, (F.col("_all") - F.coalesce("_t", F.lit(0))).alias("cnt"))
    return c.filter(F.col("cnt") > 0)


def order_events(events: DataFrame, user: str, order_cols, item: str = "item_id", name: str = "items") -> DataFrame:
    """Each user's items ordered by the total order, as an array (stable)."""
    cols = list(order_cols) if item in order_cols else list(order_cols) + [item]
    srt = F.array_sort(F.collect_list(F.struct(*cols)))
    return events.groupBy(user).agg(srt.alias("_s")).select(
        user, F.transform("_s", lambda s: s[item]).alias(name)
    )


def last_items(events: DataFrame, user: str, order_cols, n: int, item: str = "item_id", min_events: int = 2, name: str = "items") -> DataFrame:
    """Each user's last ``n`` items in order, without ever holding more of a user.

    The rank limit is pushed below the exchange (each task keeps the last ``n`` of its rows of a
    user), so a user with a third of all events costs one task ``n`` rows per input task.  Equal
    events are told apart by the order columns only, as everywhere.  Users below ``min_events`` drop out; ``n`` must be at
    least ``min_events`` for that.  Returns ``user, items``.
    """
    if n < min_events:
        raise ValueError("n must be at least min_events")
    cols = list(order_cols) if item in order_cols else [*order_cols, item]
    latest = Window.partitionBy(user).orderBy(*[F.col(c).desc() for c in cols])
    kept = events.withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") <= n)
    kept = kept.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("_s")).filter(F.size("_s") >= min_events)
    return kept.select(user, F.transform("_s", lambda s: s[item]).alias(name))


def positions(events: DataFrame, user: str, order_cols) -> DataFrame:
    """Long form: 0-based position of each event in its user's order plus ``n_events``
    (skew-safe group row number)."""
    out = group_row_number(events, [user], list(order_cols), name="_rn", with_count="n_events")
    return out.withColumn("pos", (F.col("_rn") - 1).cast("bigint")).drop("_rn")


def leave_last_out(df: DataFrame, items: str = "items", min_len: int = 2) -> DataFrame:
    """E5 on arrays: input = all but last, target = last; needs >= ``min_len`` items."""
    return df.filter(F.size(items) >= min_len).withColumn("history", F.slice(items, 1, F.size(items) - 1)).withColumn(
        "target", X.last(items)
    )


def append_target(history, target) -> Column:
    """History + [target], NULL-safe on both sides."""
    h = F.coalesce(F.col(history) if isinstance(history, str) else history, F.array())
    t = F.col(target) if isinstance(target, str) else target
    return F.when(t.isNull(), h).otherwise(F.concat(h, F.array(t)))


def repeat_flag(history, target) -> Column:
    """Target equals the last history item (typed compare, NULL-safe)."""
    h = F.col(history) if isinstance(history, str) else history
    t = F.col(target) if isinstance(target, str) else target
    return F.coalesce(X.last(h) == t, F.lit(False))


def pad_right(col, n: int, pad) -> Column:
    """Right pad to ``n`` with ``pad``; never truncates."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(c, F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(c), F.lit(0))))


def pad_history(col, n: int, pad) -> Column:
    """Keep the last ``n`` then right pad."""
    return pad_right(X.tail(col, n), n, pad)


def negative_sample(user_col, target_col, n_items: int, seed: int = 0) -> Column:
    """One uniform negative in ``[0, n_items)`` never equal to the target:
    draw in ``[0, n_items-1)`` and shift by one when >= target (no rejection loop)."""
    h = X.portable_hash(user_col, target_col, seed=seed)
    r = F.pmod(h, F.lit(n_items - 1))
    t = F.col(target_col) if isinstance(target_col, str) else target_col
    return F.when(r >= t, r + 1).otherwise(r).cast("bigint")


def propensity(history: DataFrame, catalog: DataFrame, item: str = "item_id", power: float = 0.05,
               counts: DataFrame | None = None) -> DataFrame:
    """``((count+1) / sum(count+1)) ** power`` over the whole catalog, zero-count items included.

    ``history`` holds one row per training target (the next items, not the histories);
    ``counts`` (item, cnt) may be given instead.  The total is
    one scalar aggregate joined back as a one-row broadcast.
    """
    if counts is None:
        counts = history.groupBy(item).agg(F.count(F.lit(1)).alias("cnt"))
    c = catalog.select(item).distinct().join(counts, item, "left").withColumn("cnt1", F.coalesce("cnt", F.lit(0)) + 1)
    total = c.agg(F.sum("cnt1").alias("_tot"))
    return c.crossJoin(F.broadcast(total)).select(
        item, F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"),
        F.pow(F.col("cnt1") / F.col("_tot"), F.lit(power)).alias("propensity"),
    )


def repeat_rows(df: DataFrame, g: int, name: str = "rep") -> DataFrame:
    """Each row repeated ``g`` times consecutively (``rep`` = 0..g-1)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(g - 1))))


def ids_to_sids(df: DataFrame, list_col: str, key_cols, sid_map: DataFrame, id_col: str = "item_id",
                sid_col: str = "sid", name: str = "sids") -> DataFrame:
    """Map each id of a list to its SID, falling back to the id's text; order kept.

    Exploded per element and joined by item; the map is catalog-sized, so the join
    runs as a shuffle join unless the map fits the broadcast threshold.
    """
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    ex = df.select(*keys, F.posexplode(list_col).alias("_p", "_id"))
    j = ex.join(sid_map.select(F.col(id_col).alias("_id"), F.col(sid_col).alias("_sid")), "_id", "left")
    back = j.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_p", F.coalesce("_sid", F.col("_id").cast("string")).alias("_v")))).alias("_l")
    )
    return df.join(back.select(*keys, F.transform("_l", lambda s: s["_v"]).alias(name)), keys, "left").withColumn(
        name, F.coalesce(F.col(name), F.array().cast("array<string>"))
    )


def to_sequences(inter: DataFrame, items: DataFrame, sid_map: DataFrame, row_key: str = "line_no",
                 user: str = "user_id", history: str = "history", target: str = "target") -> DataFrame:
    """Interactions -> sequence rows.

    History SIDs skip items without a SID, history titles skip items absent from the
    catalogue (title fallback ``Item_{id}``), ids are kept as is (T8); rows whose
    target has no SID are dropped; user becomes ``A{id}``.  The catalogue and SID
    map are joined per history element; Catalyst broadcasts them when their
    estimated size is under the threshold, else AQE splits hot items.
    """
    ex = inter.select(row_key, F.posexplode(history).alias("_p", "_id"))
    it = items.select(F.col("item_id").alias("_id"), F.coalesce(F.col("title"), F.concat(F.lit("Item_"), F.col("item_id").cast("string"))).alias("_title"))
    sm = sid_map.select(F.col("item_id").alias("_id"), F.col("sid").alias("_sid"))
    j = ex.join(it, "_id", "left").join(sm, "_id", "left")
    back = j.groupBy(row_key).agg(
        F.array_sort(F.collect_list(F.when(F.col("_sid").isNotNull(), F.struct("_p", "_sid")))).alias("_s"),
        F.array_sort(F.collect_list(F.when(F.col("_title").isNotNull(), F.struct("_p", "_title")))).alias("_t"),
        F.array_sort(F.collect_list(F.struct("_p", "_id", "_title", "_sid"))).alias("_a"),
    ).select(row_key, F.transform("_s", lambda s: s["_sid"]).alias("history_item_sid"),
             F.transform("_t", lambda s: s["_title"]).alias("history_item_title"),
             # The parity lists skip missing items independently; this one keeps them paired
             F.transform("_a", lambda s: F.struct(s["_id"].alias("item_id"), s["_title"].alias("title"),
                                                  s["_sid"].alias("sid"))).alias("history_aligned"))
    tgt = inter.join(sm.withColumnRenamed("_id", target), target).join(
        it.withColumnRenamed("_id", target), target, "left")
    out = tgt.join(back, row_key, "left")
    return out.select(
        row_key,
        F.concat(F.lit("A"), F.col(user).cast("string")).alias("user_id"),
        F.coalesce("history_item_title", F.array().cast("array<string>")).alias("history_item_title"),
        F.coalesce(F.col("_title"), F.concat(F.lit("Item_"), F.col(target).cast("string"))).alias("item_title"),
        F.col(history).alias("history_item_id"),
        F.col(target).alias("item_id"),
        F.coalesce("history_item_sid", F.array().cast("array<string>")).alias("history_item_sid"),
        F.col("_sid").alias("item_sid"),
        "history_aligned",
    )


def keep_longest(df: DataFrame, user: str, history: str, line_no: str) -> DataFrame:
    """One row per user, the longest history; first line on ties (strict ``>`` in
    the reference).  A partial aggregate of ``max(struct(size, -line_no))``."""
    best = df.groupBy(user).agg(F.max(F.struct(F.size(history).alias("_n"), (-F.col(line_no)).alias("_neg"))).alias("_b"))
    keys = best.select(user, (-F.col("_b._neg")).alias(line_no))
    return df.join(keys, [user, line_no])


def sample_n(df: DataFrame, n: int, key_cols, seed: int = 42) -> DataFrame:
    """Exact, repeatable n-row sample: the n rows with the smallest portable hash
    (ties by key).  A take-ordered top-n; the limit is the feature."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    h = X.portable_hash(*keys, seed=seed)
    return df.withColumn("_h", h).orderBy("_h", *keys).limit(n).drop("_h")


def pad_left_batch(df: DataFrame, col: str, batch: str, pad, name: str = "padded") -> DataFrame:
    """Left pad each list to the longest list of its batch, with a 0/1 mask.

    The batch maximum is a partial aggregate joined back (no per-batch window)."""
    mx = df.groupBy(batch).agg(F.max(F.size(col)).alias("_mx"))
    j = df.join(mx, batch)
    npad = F.col("_mx") - F.size(col)
    return j.withColumn(name, F.concat(F.array_repeat(F.lit(pad), npad), F.col(col))).withColumn(
        "mask", F.concat(F.array_repeat(F.lit(0), npad), F.array_repeat(F.lit(1), F.size(col)))).drop("_mx")


def mix(dfs, key_cols, seed: int = 42, skip_frac: float = 0.0):
    """Union several example sets, shuffle by a seeded hash, optionally keep the
    tail after the first ``skip_frac`` share.  Returns rows with ``mix_ord``."""
    from ..sources.ordinal import with_ordinal

    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    out = None
    for i, d in enumerate(dfs):
        d = d.withColumn("set_id", F.lit(i).cast("bigint"))
        out = d if out is None else out.unionByName(d)
    out = out.withColumn("_h", X.portable_hash("set_id", *keys, seed=seed))
    o = with_ordinal(out, ["_h", "set_id", *keys], "mix_ord").drop("_h")
    if skip_frac > 0:
        total = o.agg(F.count(F.lit(1)).alias("_n"))
        o = o.crossJoin(F.broadcast(total)).filter(F.col("mix_ord") >= F.floor(F.col("_n") * F.lit(skip_frac))).drop("_n")
    return o


def num_targets(df: DataFrame, batch: str, target: str) -> DataFrame:
    """Distinct targets per batch."""
    return df.groupBy(batch).agg(F.countDistinct(target).alias("num_targets"))


def order_events_chunked(events: DataFrame, user: str, order_cols, item: str = "item_id", chunk_size: int = 64,
                         keep=None) -> DataFrame:
    """E1, skew-safe form: each user's ordered items as rows ``(user, chunk, items, n_events)``
    with at most ``chunk_size`` items per row.

    Positions come from the range-partitioned group ordinal (a user holding a third of
    all events is split across ranges), and items are collected per (user, chunk), so no
    task ever holds more than one chunk of one user.  ``keep(pos, n_events)`` filters
    positions first (e.g. the history of leave-last-out).
    """
    pos = positions(events.select(user, item, *[c for c in order_cols if c != item]), user, list(order_cols))
    if keep is not None:
        pos = pos.filter(keep(F.col("pos"), F.col("n_events")))
    pos = pos.withColumn("chunk", F.floor(F.col("pos") / F.lit(chunk_size)).cast("bigint"))
    g = pos.groupBy(user, "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", item))).alias("_l"),
                                       F.first("n_events").alias("n_events"))
    return g.select(user, "chunk", F.transform("_l", lambda s: s[item]).alias("items"), F.col("n_events").cast("bigint").alias("n_events"))


def leave_last_out_chunked(events: DataFrame, user: str, order_cols, item: str = "item_id", chunk_size: int = 64) -> DataFrame:
    """E5, skew-safe form: history chunks (all events but the last) with the target
    (last item, from a partial aggregate) on every chunk row of the user."""
    hist = order_events_chunked(events, user, order_cols, item, chunk_size, keep=lambda p, n: p < n - 1)
    t = user_targets(events, user, order_cols, item)
    return hist.join(t.select(user, "target"), user)
