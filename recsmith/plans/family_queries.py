"""Example-family queries (F1-F3, F6-F17) with DuckDB twins built from the same fixed texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import text as TX
from ..operators import examples as EX
from . import fixtures as FX
from .example_queries import _seq_rows
from .registry import register
from .sequence_queries import SEQ_CTES, inter

CATEGORY = TX.CATEGORY_LABELS["Industrial_and_Scientific"]
SEED = 42


def lit(s: str) -> str:
    """SQL literal of a fixed text (quotes doubled, newlines as chr(10))."""
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


def fill_sql(template: str, **exprs) -> str:
    import re

    out, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            out.append(lit(template[pos:m.start()]))
        out.append(f"({exprs[m.group(1)]})")
        pos = m.end()
    if pos < len(template):
        out.append(lit(template[pos:]))
    return " || ".join(out)


def frame_sql(inp: str) -> str:
    return f"{lit('### User Input: ' + chr(10))} || ({inp}) || {lit(chr(10) + chr(10) + '### Response:' + chr(10))}"


def quoted_sql(col: str, sep: str) -> str:
    return f"array_to_string(list_transform({col}, lambda x: '\"' || x || '\"'), {lit(sep)})"


BASE = {**FX.sql_sid_ctes(), **SEQ_CTES, "it": FX.ITEMS_SQL,
        "hx": "SELECT line_no, unnest(history) AS hid, generate_subscripts(history, 1) AS p FROM inter",
        "hs": """SELECT hx.line_no, coalesce(list(sm.sid_full ORDER BY hx.p) FILTER (WHERE sm.sid_full IS NOT NULL), []) AS hsid,
       coalesce(list(coalesce(it.title, 'Item_' || CAST(hx.hid AS VARCHAR)) ORDER BY hx.p) FILTER (WHERE it.item_id IS NOT NULL), []) AS htitle
FROM hx LEFT JOIN sid_map sm ON sm.item_id = hx.hid LEFT JOIN it ON it.item_id = hx.hid GROUP BY hx.line_no""",
        "sr": """SELECT i.line_no, i.history AS hids, i.target AS item_id, coalesce(it.title, 'Item_' || CAST(i.target AS VARCHAR)) AS item_title,
       sm.sid_full AS item_sid, coalesce(hs.hsid, []) AS hsid, coalesce(hs.htitle, []) AS htitle
FROM inter i JOIN sid_map sm ON sm.item_id = i.target LEFT JOIN it ON it.item_id = i.target LEFT JOIN hs ON hs.line_no = i.line_no"""}

MAPS = {"mp": """SELECT s.item_id, s.item_id AS idx_ord, array_to_string(s.tokens[1:3], '') AS sid3, it.title,
       it.description[1] AS description,
       CASE WHEN length(it.description[2]) > length(it.description[1]) THEN it.description[2] ELSE it.description[1] END AS long_description
FROM sid_index s JOIN it ON it.item_id = s.item_id WHERE len(s.tokens) >= 3""",
        "s2t": "SELECT sid3, arg_max(title, idx_ord) AS title FROM mp GROUP BY sid3",
        "t2s": "SELECT title, arg_max(sid3, idx_ord) AS sid3 FROM mp GROUP BY title",
        "d2s": "SELECT description, arg_max(sid3, idx_ord) AS sid3 FROM mp GROUP BY description",
        "s2d": "SELECT sid3, arg_max(long_description, idx_ord) AS description FROM mp GROUP BY sid3"}

ROW_COLS = "family, example_id, prompt, completion, history_key, is_repeat"


def _rows_sql(family: str, prompt: str, completion: str, key: str, rep: str, src: str = "sr", extra: str = "") -> str:
    return f"""SELECT '{family}' AS family, line_no AS example_id, {prompt} AS prompt, {completion} AS completion,
       {key} AS history_key, CAST(coalesce({rep}, false) AS BIGINT) AS is_repeat{extra} FROM {src}"""


def _out(df):
    return df.withColumn("is_repeat", F.col("is_repeat").cast("bigint"))


def _variant_sql(id_expr: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {lit(v.replace('{category}', CATEGORY))}" for i, v in enumerate(EX.TITLE_INSTRUCTS))
    return f"(CASE ({X.portable_hash_sql(id_expr, seed=SEED)}) % {len(EX.TITLE_INSTRUCTS)} {cases} END)"


def _title_history_sql(family: str, tail: str) -> str:
    inp = fill_sql(EX.TITLE_HISTORY_INPUT, category=lit(CATEGORY), history=quoted_sql("htitle", ",\t"))
    prompt = f"{lit(EX.INSTRUCTION_HEAD)} || {_variant_sql('line_no')} || {lit(tail)} || {frame_sql(inp)}"
    return FX.with_ctes(BASE, _rows_sql(family, prompt, "'\"' || item_title || '\"' || chr(10)", "array_to_string(htitle, '::')",
                                        "hids[len(hids)] = item_id"))


@register("title_history_sft_examples", _title_history_sql("title_history_sft", "\n \n"))
def title_history_sft_examples(spark, d):
    """quoted title history -> quoted title, instruction variant by seeded hash."""
    return _out(EX.title_history_examples(_seq_rows(spark, d), CATEGORY, SEED, "title_history_sft"))


@register("title_history_d3_examples", _title_history_sql("title_history_d3", "\n \n"))
def title_history_d3_examples(spark, d):
    """the prompt/completion form of F1 (lookup maps keyed by the ``::`` title key)."""
    return _out(EX.title_history_examples(_seq_rows(spark, d), CATEGORY, SEED, "title_history_d3"))


@register("title_history_eval_examples", _title_history_sql("title_history_eval", "\n\n"))
def title_history_eval_examples(spark, d):
    """evaluation form (instruction ends without the extra space line)."""
    return _out(EX.title_history_examples(_seq_rows(spark, d), CATEGORY, SEED, "title_history_eval", evaluation=True))


@register("sid_eval_examples", FX.with_ctes(BASE, _rows_sql(
    "sid_eval", f"{lit(EX.INSTRUCTION)} || {frame_sql(fill_sql(EX.SID_EVAL_INPUT, history=chr(39) + chr(39) + ' || array_to_string(hsid, ' + chr(39) + ', ' + chr(39) + ')'))}",
    "item_sid || chr(10)", "array_to_string(hsid, '::')", "hsid[len(hsid)] = item_sid")))
def sid_eval_examples(spark, d):
    """SID history -> SID, evaluation wording."""
    return _out(EX.sid_eval_examples(_seq_rows(spark, d)))


def _user_features(spark, d):
    c = FX.table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("user_id"),
                    F.concat(F.lit("["), F.upper("c_mktsegment"), F.lit("]")).alias("u_token"))


_GPR = {**BASE,
        "uf": "SELECT CAST(c_custkey AS VARCHAR) AS uid, '[' || upper(c_mktsegment) || ']' AS u_token FROM customer",
        "gh": """SELECT hx.line_no, string_agg(CASE WHEN coalesce(it.item_type, 'O') = 'O' THEN '[O_TOKEN]' ELSE '[I_TOKEN]' END || sm.sid_full, ', ' ORDER BY hx.p) AS gh
FROM hx JOIN sid_map sm ON sm.item_id = hx.hid LEFT JOIN it ON it.item_id = hx.hid GROUP BY hx.line_no""",
        "g": """SELECT sr.*, coalesce(gh.gh, '') AS ghist, coalesce(uf.u_token, '[USER_UNKNOWN]') AS ut,
       CASE WHEN coalesce(it.item_type, 'O') = 'O' THEN '[O_TOKEN]' ELSE '[I_TOKEN]' END AS tp, coalesce(it.final_value, 0.0) AS final_value
FROM sr LEFT JOIN gh ON gh.line_no = sr.line_no LEFT JOIN uf ON uf.uid = CAST(sr.line_no AS VARCHAR) LEFT JOIN it ON it.item_id = sr.item_id"""}


@register("sid_gpr_examples", FX.with_ctes(_GPR, _rows_sql(
    "sid_gpr", f"{lit(EX.INSTRUCTION)} || {frame_sql(fill_sql(EX.GPR_INPUT, u_token='ut', e_token=lit(EX.CTX_HOMEPAGE), history='ghist'))}",
    "tp || item_sid || chr(10)", "array_to_string(hsid, ', ')", "hsid[len(hsid)] = item_sid", src="g", extra=", final_value")))
def sid_gpr_examples(spark, d):
    """heterogeneous prompts with user/context tokens, type prefixes and the target's value weight."""
    s = _seq_rows(spark, d).withColumn("user_id_original_str", F.col("line_no").cast("string"))
    e = EX.sid_gpr_examples(s, FX.items(spark, d), _user_features(spark, d), FX.sid_map(spark, d))
    return _out(e)


def _maps(spark, d):
    idx = FX.sid_index(spark, d).withColumn("idx_ord", F.col("item_id"))
    return EX.item_maps(FX.items(spark, d), idx)


_ITEM_FRAME = lambda p: f"{lit(EX.INSTRUCTION_HEAD + EX.ITEM_ID_INSTRUCTION + chr(10) + chr(10))} || {frame_sql(p)}"


@register("sid_title_examples", FX.with_ctes({**BASE, **MAPS}, f"""SELECT 'sid2title' AS task, sid3 AS input, {_ITEM_FRAME(fill_sql(EX.SID2TITLE_PROMPT, sid='sid3'))} AS prompt, title || chr(10) AS completion FROM s2t
UNION ALL SELECT 'title2sid' AS task, title AS input, {_ITEM_FRAME(fill_sql(EX.TITLE2SID_PROMPT, title='title'))} AS prompt, sid3 || chr(10) AS completion FROM t2s"""))
def sid_title_examples(spark, d):
    """F8: sid2title + title2sid item-identification pairs (last write wins, T21)."""
    return EX.sid_title_examples(_maps(spark, d))


@register("title_desc_to_sid_examples", FX.with_ctes({**BASE, **MAPS}, f"""SELECT 'title2sid' AS task, title AS input, {frame_sql(fill_sql(EX.TITLE2SID_PROMPT, title='title'))} AS prompt, sid3 || chr(10) AS completion FROM t2s
UNION ALL SELECT 'description2sid' AS task, description AS input, {frame_sql(fill_sql(EX.DESC2SID_PROMPT, description='description'))} AS prompt, sid3 || chr(10) AS completion FROM d2s"""))
def title_desc_to_sid_examples(spark, d):
    """title2sid + description2sid (first-element description rule)."""
    return EX.title_desc_to_sid_examples(_maps(spark, d))


@register("sid_to_title_examples", FX.with_ctes({**BASE, **MAPS},
    f"SELECT 'sid2title' AS task, sid3 AS input, {frame_sql(fill_sql(EX.SID2TITLE_PROMPT, sid='sid3'))} AS prompt, title || chr(10) AS completion FROM s2t"))
def sid_to_title_examples(spark, d):
    """sid2title pairs."""
    return EX.sid_to_title_examples(_maps(spark, d))


@register("title_seq_to_sid_examples", FX.with_ctes(BASE, _rows_sql(
    "title_seq_to_sid", frame_sql(fill_sql(EX.TITLE_SEQ_PROMPT, titles=quoted_sql("htitle", ", "))), "item_sid || chr(10)",
    "array_to_string(htitle, '::')", "hids[len(hids)] = item_id") + " WHERE NOT coalesce(hids[len(hids)] = item_id, false)"))
def title_seq_to_sid_examples(spark, d):
    """title history -> SID with repeats dropped (``dedup=True``, T7)."""
    return _out(EX.title_seq_to_sid_examples(_seq_rows(spark, d), dedup=True))


@register("sid_history_to_title_examples", FX.with_ctes(BASE, _rows_sql(
    "sid_history_to_title", frame_sql(fill_sql(EX.SID_HISTORY_TITLE_INPUT, history="array_to_string(hsid, ', ')")),
    "coalesce((SELECT title FROM it WHERE it.item_id = sr.item_id), 'Unknown item ' || CAST(item_id AS VARCHAR)) || chr(10)",
    "array_to_string(hsid, '::')", "hsid[len(hsid)] = item_sid")))
def sid_history_to_title_examples(spark, d):
    """SID history -> title of the target."""
    return _out(EX.sid_history_to_title_examples(_seq_rows(spark, d), FX.items(spark, d)))


def _fusion_sql(task: str) -> str:
    if task == "title":
        p = fill_sql(EX.FUSION_TITLE_PROMPT, history="array_to_string(hsid, ', ')")
        tgt = "coalesce(s2t.title, sr.item_sid)"
    else:
        p = fill_sql(EX.FUSION_DESC_PROMPT, history="array_to_string(hsid, ', ')")
        tgt = f"coalesce(s2d.description, {fill_sql(EX.FUSION_DESC_FALLBACK, sid='sr.item_sid')})"
    prompt = f"{lit(EX.INSTRUCTION_HEAD + EX.FUSION_INSTRUCTION + chr(10) + chr(10))} || {frame_sql(p)}"
    body = _rows_sql(f"fusion_{task}", prompt, "_tgt || chr(10)", "array_to_string(hsid, ', ')", "hsid[len(hsid)] = item_sid", src="fu")
    ctes = {**BASE, **MAPS, "fu": f"SELECT sr.*, {tgt} AS _tgt FROM sr LEFT JOIN s2t ON s2t.sid3 = sr.item_sid LEFT JOIN s2d ON s2d.sid3 = sr.item_sid"}
    return FX.with_ctes(ctes, body)


@register("fusion_title_examples", _fusion_sql("title"))
def fusion_title_examples(spark, d):
    """F13 (live branch): SID history -> title; suffixed SIDs miss the 3-token map and fall back to the SID."""
    return _out(EX.fusion_examples(_seq_rows(spark, d), _maps(spark, d), "title"))


@register("fusion_description_examples", _fusion_sql("description"))
def fusion_description_examples(spark, d):
    """F13 (description branch, exposed as well)."""
    return _out(EX.fusion_examples(_seq_rows(spark, d), _maps(spark, d), "description"))


@register("title_history_to_sid_sft_examples", FX.with_ctes({**BASE, **MAPS, "i2s": "SELECT item_id, sid3 FROM mp",
    "tq": "SELECT sr.*, coalesce(i2s.sid3, CAST(sr.item_id AS VARCHAR)) AS _tgt FROM sr LEFT JOIN i2s ON i2s.item_id = sr.item_id"},
    _rows_sql("title_history_to_sid_sft",
              f"{lit(EX.INSTRUCTION_HEAD + EX.TITLE2SID_SFT_INSTRUCTION + chr(10) + chr(10))} || "
              f"{frame_sql(fill_sql(EX.TITLE2SID_SFT_INPUT, category=lit(CATEGORY), titles=quoted_sql('htitle', ', ')))}",
              "_tgt || chr(10)", "array_to_string(htitle, '::')", "hids[len(hids)] = item_id", src="tq")))
def title_history_to_sid_sft_examples(spark, d):
    """quoted title history -> 3-token SID (fallback: the item id), with instruction."""
    m = _maps(spark, d).select("item_id", "sid3")
    return _out(EX.title_history_to_sid_sft(_seq_rows(spark, d), m, CATEGORY))


def _preferences(spark, d):
    """Preference records of every user: history and target with the assistant's texts, in turn order,
    of one conversation; users are dealt over the conversations that have such texts."""
    from ..sources import ordinal as O

    i = inter(spark, d)
    said = FX.table(spark, d, "conversations").filter(F.col("role") == "assistant")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    c = said.groupBy("conv_id").agg(F.array_join(texts, " ").alias("user_preference"))
    ranked = O.with_ordinal(c, ["conv_id"], "_conv")
    n = c.agg(F.count(F.lit(1)).alias("_n"))
    j = i.crossJoin(F.broadcast(n)).withColumn("_conv", F.col("user_id") % F.col("_n")).join(ranked, "_conv")
    return j.select(F.col("user_id").cast("string").alias("user"), "user_preference", F.lit("train").alias("split"),
                    F.struct(F.col("history").alias("history_items"), F.col("target").alias("target_item")).alias("context"),
                    F.col("user_id").alias("example_id"))


_PREF = {**BASE, **MAPS,
         "cv": "SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS pref FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
         "cr": "SELECT pref, row_number() OVER (ORDER BY conv_id) - 1 AS k FROM cv",
         "pf": """SELECT i.user_id, cr.pref, i.history, i.target FROM inter i JOIN cr ON cr.k = i.user_id % (SELECT count(*) FROM cr)""",
         "px": "SELECT user_id, unnest(history) AS hid, generate_subscripts(history, 1) AS p FROM pf",
         "ph": """SELECT px.user_id, string_agg(coalesce(mp.sid3, CAST(px.hid AS VARCHAR)), ', ' ORDER BY px.p) AS hist
FROM px LEFT JOIN mp ON mp.item_id = px.hid GROUP BY px.user_id""",
         "pq": """SELECT pf.user_id, pf.pref, ph.hist, coalesce(mp.sid3, CAST(pf.target AS VARCHAR)) AS ts
FROM pf JOIN ph ON ph.user_id = pf.user_id LEFT JOIN mp ON mp.item_id = pf.target"""}


@register("preference_reasoning_examples", FX.with_ctes(_PREF, f"""SELECT CAST(user_id AS VARCHAR) AS user, user_id AS example_id,
       {lit(EX.INSTRUCTION_HEAD + EX.PREF_SFT_INSTRUCTION + chr(10) + chr(10))} || {frame_sql(fill_sql(EX.PREF_SFT_INPUT, history='hist'))} AS prompt,
       {fill_sql(EX.PREF_SFT_OUTPUT, preference='pref', sid='ts')} AS completion FROM pq"""))
def preference_reasoning_examples(spark, d):
    """history -> reasoning + SID (no trailing newline)."""
    m = _maps(spark, d).select("item_id", "sid3")
    return EX.preference_examples(_preferences(spark, d), m, "reasoning")


@register("preference_to_sid_examples", FX.with_ctes(_PREF, f"""SELECT CAST(user_id AS VARCHAR) AS user, user_id AS example_id,
       {lit(EX.INSTRUCTION_HEAD + EX.PREF2SID_INSTRUCTION + chr(10) + chr(10))} || {frame_sql(fill_sql(EX.PREF2SID_INPUT, history='hist', preference='pref'))} AS prompt,
       ts || chr(10) AS completion FROM pq"""))
def preference_to_sid_examples(spark, d):
    """F16: history + reasoning -> SID (with trailing newline)."""
    m = _maps(spark, d).select("item_id", "sid3")
    return EX.preference_examples(_preferences(spark, d), m, "to_sid")


@register("few_shot_blocks", FX.with_ctes(BASE, f"""SELECT line_no AS example_id,
       {fill_sql(EX.FEW_SHOT_BLOCK, idx="CAST(line_no % 3 + 1 AS VARCHAR)", input=fill_sql(EX.SID_INPUT, history="array_to_string(hsid, ', ')"), output="item_sid || chr(10)")} AS block FROM sr"""))
def few_shot_blocks(spark, d):
    """few-shot example blocks (defined in the reference, not called by it)."""
    s = _seq_rows(spark, d)
    inp = EX.fill(EX.SID_INPUT, history=F.array_join("history_item_sid", ", "))
    return s.select(F.col("line_no").alias("example_id"),
                    EX.few_shot_block(F.col("line_no") % 3 + 1, inp, F.concat("item_sid", F.lit("\n"))).alias("block"))
