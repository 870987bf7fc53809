"""Sequence, sampling and ordinal queries (E-family, A12, A17, A18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import sequences as S
from ..sources import ordinal as O
from . import fixtures as FX
from .registry import register

SEED = 42


def _ids(col):
    return F.array_join(F.transform(F.col(col) if isinstance(col, str) else col, lambda x: x.cast("string")), ",")


def _ids_sql(expr):
    return f"array_to_string(list_transform({expr}, lambda x: CAST(x AS VARCHAR)), ',')"


def user_items(spark, d):
    return S.order_events(FX.events(spark, d), "user_id", FX.EVENT_KEY, "item_id", "items")


def inter(spark, d):
    """Leave-last-out rows per user: ``line_no, user_id, history, target``."""
    s = S.leave_last_out(user_items(spark, d), "items")
    return s.select(F.col("user_id").alias("line_no"), "user_id", "history", "target", "items")


def targets(spark, d):
    """Per user with >= 2 events: last item and history length, from one partial aggregate
    (no per-user array is built)."""
    t = S.user_targets(FX.events(spark, d), "user_id", FX.EVENT_KEY)
    return t.withColumn("line_no", F.col("user_id"))


SEQ_CTES = {
    "ev": FX.EVENTS_SQL,
    "seq": f"SELECT user_id, list(item_id ORDER BY {FX.EVENT_ORDER_SQL}) AS items FROM ev GROUP BY user_id",
    "inter": """SELECT user_id AS line_no, user_id, items[1:len(items) - 1] AS history, items[len(items)] AS target, items
FROM seq WHERE len(items) >= 2""",
}


@register("user_sequences", FX.with_ctes(SEQ_CTES, f"SELECT user_id, {_ids_sql('items')} AS items, len(items) AS n FROM seq"))
def user_sequences(spark, d):
    """E1 + E11: each user's items in time order and the sequence length."""
    u = user_items(spark, d)
    return u.select("user_id", _ids("items").alias("items"), F.size("items").cast("bigint").alias("n"))


@register("leave_last_out", FX.with_ctes(SEQ_CTES, f"SELECT user_id, {_ids_sql('history')} AS history, target, len(history) AS n_hist FROM inter"))
def leave_last_out(spark, d):
    """E5: input = all but last, target = last, at least two items."""
    i = inter(spark, d)
    return i.select("user_id", _ids("history").alias("history"), "target", F.size("history").cast("bigint").alias("n_hist"))


@register("append_target", FX.with_ctes(SEQ_CTES, f"SELECT user_id, {_ids_sql('list_append(history, target)')} AS full_seq FROM inter"))
def append_target(spark, d):
    """History with the target appended."""
    i = inter(spark, d)
    return i.select("user_id", _ids(S.append_target("history", "target")).alias("full_seq"))


@register("repeat_flag", FX.with_ctes(SEQ_CTES, "SELECT user_id, CAST(coalesce(history[len(history)] = target, false) AS BIGINT) AS is_repeat FROM inter"))
def repeat_flag(spark, d):
    """Target equals the last history item; only each user's last two events leave their tasks."""
    i = S.leave_last_out(S.last_items(FX.events(spark, d), "user_id", FX.EVENT_KEY, 2))
    return i.select("user_id", S.repeat_flag("history", "target").cast("bigint").alias("is_repeat"))


@register("pad_right", FX.with_ctes(SEQ_CTES, f"""SELECT user_id,
       {_ids_sql("list_concat(history, list_transform(range(greatest(64 - len(history), 0)), lambda x: -1))")} AS padded FROM inter"""))
def pad_right(spark, d):
    """Right pad histories to 64 with -1, never truncating."""
    i = inter(spark, d)
    return i.select("user_id", _ids(S.pad_right("history", 64, -1)).alias("padded"))


@register("pad_history", FX.with_ctes(SEQ_CTES, f"""SELECT user_id,
       {_ids_sql("list_concat(" + X.tail_sql("history", 10) + ", list_transform(range(greatest(10 - len(history), 0)), lambda x: 0))")} AS padded FROM inter"""))
def pad_history(spark, d):
    """Keep the last 10 history items, then right pad with 0; only each user's last 11 events leave their tasks."""
    i = S.leave_last_out(S.last_items(FX.events(spark, d), "user_id", FX.EVENT_KEY, 11))
    return i.select("user_id", _ids(S.pad_history("history", 10, 0)).alias("padded"))


@register("pad_left_batch", FX.with_ctes({**SEQ_CTES, "b": "SELECT *, user_id // 100 AS batch, max(len(history)) OVER (PARTITION BY user_id // 100) AS mx FROM inter"},
    f"""SELECT user_id, batch, {_ids_sql("list_concat(list_transform(range(mx - len(history)), lambda x: -1), history)")} AS padded,
       CAST(mx - len(history) AS BIGINT) AS n_pad FROM b"""))
def pad_left_batch(spark, d):
    """Left pad to the longest history of each batch of 100 users, with a mask."""
    i = inter(spark, d).withColumn("batch", F.floor(F.col("user_id") / 100).cast("bigint"))
    p = S.pad_left_batch(i, "history", "batch", -1)
    return p.select("user_id", "batch", _ids("padded").alias("padded"),
                    F.size(F.filter("mask", lambda m: m == 0)).cast("bigint").alias("n_pad"))


def _order_rows(spark, d):
    ev = FX.events(spark, d)
    srt = F.array_sort(F.collect_list(F.struct("l_linenumber", "item_id", "l_suppkey", "l_extendedprice")))
    o = ev.groupBy("user_id", F.col("l_orderkey").alias("line_no")).agg(srt.alias("_s"))
    o = o.select("user_id", "line_no", F.transform("_s", lambda s: s["item_id"]).alias("items"))
    return o.withColumn("history", F.slice("items", 1, F.size("items") - 1))


ORDER_ROWS_CTES = {
    "ev": FX.EVENTS_SQL,
    "ord_rows": """SELECT user_id, l_orderkey AS line_no, list(item_id ORDER BY l_linenumber, item_id, l_suppkey, l_extendedprice) AS items
FROM ev GROUP BY user_id, l_orderkey""",
}


@register("keep_longest", FX.with_ctes(ORDER_ROWS_CTES, """SELECT user_id, line_no, len(items) - 1 AS n_hist FROM ord_rows
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY len(items) DESC, line_no) = 1"""))
def keep_longest(spark, d):
    """One row per user (rows = orders), longest history, first order on ties."""
    k = S.keep_longest(_order_rows(spark, d), "user_id", "history", "line_no")
    return k.select("user_id", "line_no", F.size("history").cast("bigint").alias("n_hist"))


@register("sample_users", FX.with_ctes(SEQ_CTES, f"SELECT user_id, target FROM inter ORDER BY {X.portable_hash_sql('user_id', seed=SEED)}, user_id LIMIT 100"))
def sample_users(spark, d):
    """Exact, repeatable 100-row sample of the evaluation rows."""
    return S.sample_n(targets(spark, d).select("user_id", "target"), 100, ["user_id"], seed=SEED)


@register("negative_sample", FX.with_ctes({**SEQ_CTES, "ni": "SELECT count(*) AS n FROM part"},
    f"""SELECT user_id, target, CAST(CASE WHEN h % (ni.n - 1) >= target THEN h % (ni.n - 1) + 1 ELSE h % (ni.n - 1) END AS BIGINT) AS negative
FROM (SELECT user_id, target, {X.portable_hash_sql('user_id', 'target', seed=SEED)} AS h FROM inter), ni"""))
def negative_sample(spark, d):
    """One uniform negative per row that is never the target."""
    n_items = FX.table(spark, d, "part").count()  # one scalar
    i = targets(spark, d)
    return i.select("user_id", "target", S.negative_sample("user_id", "target", n_items, seed=SEED).alias("negative"))


@register("item_propensity", FX.with_ctes({**FX.event_ctes(), "c": "SELECT target AS item_id, count(*) AS cnt FROM targets GROUP BY target",
    "cat": "SELECT DISTINCT p_partkey AS item_id FROM part",
    "j": "SELECT cat.item_id, coalesce(c.cnt, 0) AS cnt, coalesce(c.cnt, 0) + 1 AS cnt1 FROM cat LEFT JOIN c ON c.item_id = cat.item_id"},
    "SELECT item_id, CAST(cnt AS BIGINT) AS cnt, round(pow(cnt1 / (SELECT sum(cnt1) FROM j), 0.05), 6) AS propensity FROM j"))
def item_propensity(spark, d):
    """Popularity propensity over the catalogue (items without events included)."""
    counts = targets(spark, d).groupBy(F.col("target").alias("item_id")).agg(F.count(F.lit(1)).alias("cnt"))
    cat = FX.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    p = S.propensity(None, cat, counts=counts)
    return p.select("item_id", "cnt", X.r6("propensity").alias("propensity"))


_MIX_CTES = {**SEQ_CTES, **ORDER_ROWS_CTES,
             "u": "SELECT 0 AS set_id, user_id, line_no FROM inter UNION ALL SELECT 1 AS set_id, user_id, line_no FROM ord_rows",
             "h": f"SELECT *, {X.portable_hash_sql('set_id', 'user_id', 'line_no', seed=SEED)} AS hh FROM u",
             "o": "SELECT set_id, user_id, line_no, row_number() OVER (ORDER BY hh, set_id, user_id, line_no) - 1 AS mix_ord FROM h"}


@register("mix_example_sets", FX.with_ctes(_MIX_CTES, """SELECT CAST(set_id AS BIGINT) AS set_id, user_id, line_no, CAST(mix_ord AS BIGINT) AS mix_ord
FROM o WHERE mix_ord >= floor((SELECT count(*) FROM o) * 0.2)"""))
def mix_example_sets(spark, d):
    """Shuffle-mix two example sets by a seeded hash and keep the tail after 20%."""
    a = targets(spark, d).select("user_id", "line_no")
    b = FX.events(spark, d).select("user_id", F.col("l_orderkey").alias("line_no")).distinct()
    m = S.mix([a, b], ["user_id", "line_no"], seed=SEED, skip_frac=0.2)
    return m.select("set_id", "user_id", "line_no", "mix_ord")


@register("repeat_rows", FX.with_ctes({**SEQ_CTES, "o": f"SELECT user_id, row_number() OVER (ORDER BY {X.portable_hash_sql('user_id', seed=SEED)}, user_id) - 1 AS shuffle_ord FROM inter"},
    "SELECT user_id, CAST(shuffle_ord AS BIGINT) AS shuffle_ord, CAST(rep AS INTEGER) AS rep, CAST(shuffle_ord * 4 + rep AS BIGINT) AS position FROM o, range(4) r(rep)"))
def repeat_rows(spark, d):
    """Shuffle rows by a seeded hash, then repeat each 4 times consecutively."""
    i = targets(spark, d).select("user_id").withColumn("_h", X.portable_hash("user_id", seed=SEED))
    o = O.with_ordinal(i, ["_h", "user_id"], "shuffle_ord").drop("_h")
    r = S.repeat_rows(o, 4, "rep")
    return r.select("user_id", "shuffle_ord", "rep", (F.col("shuffle_ord") * 4 + F.col("rep")).alias("position"))


@register("batch_ids", FX.with_ctes(SEQ_CTES, "SELECT user_id, CAST((row_number() OVER (ORDER BY user_id) - 1) // 64 AS BIGINT) AS batch FROM inter"))
def batch_ids(spark, d):
    """Contiguous batches of 64 rows in user order."""
    o = O.with_ordinal(targets(spark, d).select("user_id"), ["user_id"], "ord")
    return o.select("user_id", O.batch_id("ord", 64).alias("batch"))


@register("batch_num_targets", FX.with_ctes(SEQ_CTES, """SELECT batch, count(DISTINCT target) AS num_targets FROM (
  SELECT target, CAST((row_number() OVER (ORDER BY user_id) - 1) // 64 AS BIGINT) AS batch FROM inter) GROUP BY batch"""))
def batch_num_targets(spark, d):
    """Distinct targets per batch of 64 rows."""
    o = O.with_ordinal(targets(spark, d).select("user_id", "target"), ["user_id"], "ord")
    return S.num_targets(o.withColumn("batch", O.batch_id("ord", 64)), "batch", "target")


def _sid_map_spark(spark, d):
    from ..operators import sid as D

    return FX.sid_index(spark, d).select("item_id", D.sid_full("tokens").alias("sid"))


@register("history_ids_to_sids", FX.with_ctes({**FX.sql_sid_ctes(), **SEQ_CTES,
    "hx": "SELECT user_id, unnest(history) AS hid, generate_subscripts(history, 1) AS p FROM inter"},
    """SELECT hx.user_id, string_agg(coalesce(sm.sid_full, CAST(hx.hid AS VARCHAR)), ',' ORDER BY hx.p) AS sids
FROM hx LEFT JOIN sid_map sm ON sm.item_id = hx.hid GROUP BY hx.user_id"""))
def history_ids_to_sids(spark, d):
    """History ids -> SIDs, falling back to the id text."""
    s = S.ids_to_sids(inter(spark, d), "history", "user_id", _sid_map_spark(spark, d))
    return s.select("user_id", F.array_join("sids", ",").alias("sids"))


@register("sequence_rows", FX.with_ctes({**FX.sql_sid_ctes(), **SEQ_CTES, "it": FX.ITEMS_SQL,
    "hx": "SELECT line_no, unnest(history) AS hid, generate_subscripts(history, 1) AS p FROM inter",
    "hs": """SELECT hx.line_no,
       coalesce(list(sm.sid_full ORDER BY hx.p) FILTER (WHERE sm.sid_full IS NOT NULL), []) AS hsid,
       coalesce(list(coalesce(it.title, 'Item_' || CAST(hx.hid AS VARCHAR)) ORDER BY hx.p) FILTER (WHERE it.item_id IS NOT NULL), []) AS htitle
FROM hx LEFT JOIN sid_map sm ON sm.item_id = hx.hid LEFT JOIN it ON it.item_id = hx.hid GROUP BY hx.line_no"""},
    f"""SELECT i.line_no, 'A' || CAST(i.user_id AS VARCHAR) AS user_id,
       coalesce(it.title, 'Item_' || CAST(i.target AS VARCHAR)) AS item_title, i.target AS item_id, sm.sid_full AS item_sid,
       array_to_string(coalesce(hs.htitle, []), '::') AS history_item_title,
       array_to_string(coalesce(hs.hsid, []), ',') AS history_item_sid,
       {_ids_sql('i.history')} AS history_item_id
FROM inter i JOIN sid_map sm ON sm.item_id = i.target LEFT JOIN it ON it.item_id = i.target
LEFT JOIN hs ON hs.line_no = i.line_no"""))
def sequence_rows(spark, d):
    """Interactions -> sequence rows with SID and title lists (target without SID dropped)."""
    s = S.to_sequences(inter(spark, d), FX.items(spark, d), _sid_map_spark(spark, d))
    return s.select("line_no", "user_id", "item_title", "item_id", "item_sid",
                    F.array_join("history_item_title", "::").alias("history_item_title"),
                    F.array_join("history_item_sid", ",").alias("history_item_sid"),
                    _ids("history_item_id").alias("history_item_id"))


@register("event_ordinal", FX.with_ctes({"ev": FX.EVENTS_SQL}, f"""SELECT l_orderkey, l_linenumber, item_id, l_suppkey,
       CAST(row_number() OVER (ORDER BY {FX.EVENT_ORDER_SQL}) - 1 AS BIGINT) AS ord FROM ev"""))
def event_ordinal(spark, d):
    """Stable global ordinal of the interaction rows in the total event order."""
    o = O.with_ordinal(FX.events(spark, d), FX.EVENT_KEY, "ord")
    return o.select("l_orderkey", "l_linenumber", "item_id", "l_suppkey", "ord")


_SHARD_CTES = {**SEQ_CTES, "o": "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS ord, count(*) OVER () AS n FROM inter"}


@register("user_shards", FX.with_ctes(_SHARD_CTES, "SELECT user_id, CAST(ord AS BIGINT) AS ord, CAST(((ord + 1) * 4 - 1) // n AS BIGINT) AS shard FROM o"))
def user_shards(spark, d):
    """Four contiguous shards, shard i = rows [i*n//4, (i+1)*n//4)."""
    o = O.with_ordinal(targets(spark, d).select("user_id"), ["user_id"], "ord")
    n = o.agg(F.count(F.lit(1)).alias("n_rows"))
    s = O.shard(o.crossJoin(F.broadcast(n)), "ord", "n_rows", 4)
    return s.select("user_id", "ord", "shard")


@register("merge_user_shards", FX.with_ctes(_SHARD_CTES, """SELECT user_id, CAST(((ord + 1) * 4 - 1) // n AS BIGINT) AS shard,
       CAST(row_number() OVER (ORDER BY ((ord + 1) * 4 - 1) // n, ord) - 1 AS BIGINT) AS merged_ord FROM o"""))
def merge_user_shards(spark, d):
    """Evaluate shards separately, merge them in listed order."""
    o = O.with_ordinal(targets(spark, d).select("user_id"), ["user_id"], "ord")
    n = o.agg(F.count(F.lit(1)).alias("n_rows"))
    s = O.shard(o.crossJoin(F.broadcast(n)), "ord", "n_rows", 4)
    parts = [s.filter(F.col("shard") == i) for i in range(4)]
    m = O.merge_shards(parts)
    mo = O.with_ordinal(m, ["_shard", "ord"], "merged_ord")
    return mo.select("user_id", F.col("_shard").cast("bigint").alias("shard"), "merged_ord")


CHUNK = 64
_CHUNK_CTES = {"ev": FX.EVENTS_SQL,
               "ps": f"""SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {FX.EVENT_ORDER_SQL}) - 1 AS BIGINT) AS pos,
       count(*) OVER (PARTITION BY user_id) AS n_events FROM ev"""}


@register("user_sequence_chunks", FX.with_ctes(_CHUNK_CTES, f"""SELECT user_id, CAST(pos // {CHUNK} AS BIGINT) AS chunk,
       string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY pos) AS items, CAST(any_value(n_events) AS BIGINT) AS n_events
FROM ps GROUP BY user_id, pos // {CHUNK}"""))
def user_sequence_chunks(spark, d):
    """E1 skew-safe form: ordered items in chunks of 64 per user (no task holds a whole user)."""
    c = S.order_events_chunked(FX.events(spark, d), "user_id", FX.EVENT_KEY, chunk_size=CHUNK)
    return c.select("user_id", "chunk", _ids("items").alias("items"), "n_events")


@register("history_chunks", FX.with_ctes({**_CHUNK_CTES,
    "tg": "SELECT user_id, item_id AS target FROM ps WHERE pos = n_events - 1 AND n_events >= 2"},
    f"""SELECT ps.user_id, CAST(pos // {CHUNK} AS BIGINT) AS chunk, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY pos) AS history,
       any_value(tg.target) AS target
FROM ps JOIN tg ON tg.user_id = ps.user_id WHERE pos < n_events - 1 GROUP BY ps.user_id, pos // {CHUNK}"""))
def history_chunks(spark, d):
    """E5 skew-safe form: leave-last-out history in chunks of 64, target on every chunk row."""
    c = S.leave_last_out_chunked(FX.events(spark, d), "user_id", FX.EVENT_KEY, chunk_size=CHUNK)
    return c.select("user_id", "chunk", _ids("items").alias("history"), "target")
