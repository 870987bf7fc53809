"""Semantic-ID queries (D-family, A13) over the residual-codes fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import sid as D
from . import fixtures as FX
from .registry import register

K = FX.CODEBOOK_K
PATH_SQL = "array_to_string(list_transform(codes, lambda c: CAST(c AS VARCHAR)), ',')"


def _raw_codes(spark, d):
    return FX.codes(spark, d).select("item_id", "codes")


@register("sid_tokens", FX.with_ctes(FX.sql_sid_ctes(), """SELECT item_id, sid_full, sid3, CAST(len(sid_full) - len(replace(sid_full, '<', '')) AS BIGINT) AS n_tokens FROM sid_map"""))
def sid_tokens(spark, d):
    """Tokens, full SID and 3-token SID per item."""
    idx = FX.sid_index(spark, d)
    return idx.select("item_id", D.sid_full("tokens").alias("sid_full"), D.sid3("tokens").alias("sid3"),
                      F.size("tokens").cast("bigint").alias("n_tokens"))


@register("sid_collision_rate", FX.with_ctes(FX.sql_codes_ctes(), f"""SELECT count(*) AS n_items, count(DISTINCT {PATH_SQL}) AS distinct_paths,
       round((count(*) - count(DISTINCT {PATH_SQL})) / count(*), 6) AS collision_rate FROM codes"""))
def sid_collision_rate(spark, d):
    """Collision rate of raw code paths."""
    return D.collision_rate(_raw_codes(spark, d))


@register("sid_collision_groups", FX.with_ctes(FX.sql_codes_ctes(), f"""SELECT {PATH_SQL} AS path, item_id,
       count(*) OVER (PARTITION BY codes) AS group_size,
       row_number() OVER (PARTITION BY codes ORDER BY item_id) AS member_rank
FROM codes QUALIFY group_size > 1"""))
def sid_collision_groups(spark, d):
    """Members of each colliding path (long form)."""
    return D.collision_groups(_raw_codes(spark, d))


@register("sid_duplication_report", FX.with_ctes({**FX.sql_codes_ctes(), "g": "SELECT codes, count(*) AS c FROM codes GROUP BY codes"},
    """SELECT CAST(sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_groups,
       CAST(sum(CASE WHEN c > 1 THEN c - 1 ELSE 0 END) AS BIGINT) AS surplus_rows,
       CAST(coalesce(max(CASE WHEN c > 1 THEN c END), 0) AS BIGINT) AS largest_group,
       count(*) AS distinct_paths, CAST(sum(c) AS BIGINT) AS n_items,
       CAST(sum(c) - sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS BIGINT) AS rows_minus_groups FROM g"""))
def sid_duplication_report(spark, d):
    """Duplicate statistics."""
    return D.duplication_report(_raw_codes(spark, d))


@register("sid_duplicate_sizes", FX.with_ctes({**FX.sql_codes_ctes(), "g": "SELECT codes, count(*) AS c FROM codes GROUP BY codes"},
    "SELECT c AS group_size, count(*) AS n_paths FROM g WHERE c > 1 GROUP BY c"))
def sid_duplicate_sizes(spark, d):
    """Number of colliding paths per group size."""
    return D.duplicate_sizes(_raw_codes(spark, d))


_LEVEL_SQL = {**FX.sql_codes_ctes(), "pc": "SELECT level, code, count(*) AS sz FROM codes_long GROUP BY level, code"}


@register("sid_level_usage", FX.with_ctes(_LEVEL_SQL, f"""SELECT CAST(level AS BIGINT) AS level, count(*) AS unique_codes,
       round(count(*) / {float(K)}, 6) AS utilisation, min(sz) AS min_size, max(sz) AS max_size, round(avg(sz), 6) AS mean_size
FROM pc GROUP BY level"""))
def sid_level_usage(spark, d):
    """Per-level code usage."""
    return D.level_usage(_raw_codes(spark, d), K)


@register("sid_level_entropy", FX.with_ctes({**_LEVEL_SQL, "tot": "SELECT level, sum(sz) AS n FROM pc GROUP BY level"},
    """SELECT CAST(pc.level AS BIGINT) AS level, round(-sum((sz / n) * log2(sz / n)), 6) AS entropy
FROM pc JOIN tot ON pc.level = tot.level GROUP BY pc.level"""))
def sid_level_entropy(spark, d):
    """Per-level entropy of the code distribution."""
    return D.level_entropy(_raw_codes(spark, d))


@register("sid_quality_gate", FX.with_ctes(FX.sql_sid_ctes(), """SELECT count(*) AS n_items,
       CAST(sum(CASE WHEN len(tokens) < 3 THEN 1 ELSE 0 END) AS BIGINT) AS format_errors,
       count(DISTINCT sid3) AS distinct_sid3,
       round((count(sid3) - count(DISTINCT sid3)) / count(*), 6) AS collision_rate,
       CASE WHEN sum(CASE WHEN len(tokens) < 3 THEN 1 ELSE 0 END) = 0
             AND (count(sid3) - count(DISTINCT sid3)) / count(*) < 0.1 THEN 'PASS' ELSE 'WARN' END AS status
FROM sid_index JOIN sid_map USING (item_id)"""))
def sid_quality_gate(spark, d):
    """Index quality gate."""
    return D.sid_quality(FX.sid_index(spark, d))


@register("sid_vocab", FX.with_ctes(FX.sql_sid_ctes(), """SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS BIGINT) AS token_ord
FROM (SELECT DISTINCT unnest(tokens) AS token FROM sid_index)"""))
def sid_vocab(spark, d):
    """New-token vocabulary, sorted."""
    return D.sid_vocab(FX.sid_index(spark, d))


def _sid_items(spark, d):
    idx = FX.sid_index(spark, d).select("item_id", D.sid_full("tokens").alias("sid_full"), D.sid3("tokens").alias("sid3"))
    return FX.items(spark, d).join(idx, "item_id")


@register("sid_to_title", FX.with_ctes({**FX.sql_sid_ctes(), "it": FX.ITEMS_SQL},
    """SELECT sid3, arg_max(title, item_ord) AS title FROM it JOIN sid_map USING (item_id) WHERE sid3 IS NOT NULL GROUP BY sid3"""))
def sid_to_title(spark, d):
    """3-token SID -> title, last write wins in item order."""
    j = _sid_items(spark, d).filter(F.col("sid3").isNotNull())
    return D.last_write_wins(j, "sid3", "item_ord", "title")


@register("title_to_sid", FX.with_ctes({**FX.sql_sid_ctes(), "it": FX.ITEMS_SQL},
    """SELECT title, arg_max(sid3, item_ord) AS sid3 FROM it JOIN sid_map USING (item_id) WHERE sid3 IS NOT NULL GROUP BY title"""))
def title_to_sid(spark, d):
    """Title -> 3-token SID; duplicate titles collapse to the last item."""
    j = _sid_items(spark, d).filter(F.col("sid3").isNotNull())
    return D.last_write_wins(j, "title", "item_ord", "sid3")


@register("item_info", FX.with_ctes({**FX.sql_sid_ctes(), "it": FX.ITEMS_SQL},
    """SELECT item_id, sid_full || chr(9) || coalesce(title, 'Item_' || CAST(item_id AS VARCHAR)) || chr(9) || CAST(item_id AS VARCHAR) AS line
FROM it JOIN sid_map USING (item_id)"""))
def item_info(spark, d):
    """Info lines ``sid<TAB>title<TAB>item_id`` for items that have a SID."""
    j = _sid_items(spark, d)
    title = F.coalesce(F.col("title"), F.concat(F.lit("Item_"), F.col("item_id").cast("string")))
    return j.select("item_id", F.concat_ws("\t", "sid_full", title, F.col("item_id").cast("string")).alias("line"))


@register("user_id_remap", FX.with_ctes({"ev": FX.EVENTS_SQL},
    "SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT user_id FROM ev)"))
def user_id_remap(spark, d):
    """Dense indices for the users of the interaction table."""
    return D.remap_ids(FX.events(spark, d), "user_id")
