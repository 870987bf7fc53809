"""Training-example queries (F4, F5, F19-F23) over the sequence rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import examples as EX
from ..operators import sequences as S
from . import fixtures as FX
from .registry import register
from .sequence_queries import SEQ_CTES, _ids, _ids_sql, _sid_map_spark, inter

BOS, EOS = 100000, 100001


def _seq_rows(spark, d):
    return S.to_sequences(inter(spark, d), FX.items(spark, d), _sid_map_spark(spark, d))


_SEQ_ROWS = {**FX.sql_sid_ctes(), **SEQ_CTES,
             "hx": "SELECT line_no, unnest(history) AS hid, generate_subscripts(history, 1) AS p FROM inter",
             "hs": """SELECT hx.line_no, coalesce(list(sm.sid_full ORDER BY hx.p) FILTER (WHERE sm.sid_full IS NOT NULL), []) AS hsid
FROM hx LEFT JOIN sid_map sm ON sm.item_id = hx.hid GROUP BY hx.line_no""",
             "sr": """SELECT i.line_no, coalesce(hs.hsid, []) AS hsid, sm.sid_full AS item_sid
FROM inter i JOIN sid_map sm ON sm.item_id = i.target LEFT JOIN hs ON hs.line_no = i.line_no"""}

_SID_PROMPT_SQL = ("'### User Input: ' || chr(10) || 'The user has interacted with items ' || array_to_string(hsid, ', ') || "
                   "' in chronological order. Can you predict the next possible item that the user may expect?' || chr(10) || chr(10) || '### Response:' || chr(10)")


def _examples_sql(family: str, instruction: bool) -> str:
    prefix = ""
    if instruction:
        lit = EX.INSTRUCTION.replace("'", "''").replace("\n", "' || chr(10) || '")
        prefix = f"'{lit}' || "
    key_sep = ", " if instruction else "::"
    return f"""SELECT '{family}' AS family, line_no AS example_id, {prefix}{_SID_PROMPT_SQL} AS prompt, item_sid || chr(10) AS completion,
       array_to_string(hsid, '{key_sep}') AS history_key, CAST(coalesce(hsid[len(hsid)] = item_sid, false) AS BIGINT) AS is_repeat FROM sr"""


def _out(e):
    return e.withColumn("is_repeat", F.col("is_repeat").cast("bigint"))


@register("sid_examples", FX.with_ctes(_SEQ_ROWS, _examples_sql("sid_history_to_sid", False)))
def sid_examples(spark, d):
    """SID history -> SID prompt/completion rows with history key and repeat flag."""
    return _out(EX.sid_examples(_seq_rows(spark, d)))


@register("sid_instruction_examples", FX.with_ctes(_SEQ_ROWS, _examples_sql("sid_instruction", True)))
def sid_instruction_examples(spark, d):
    """the same with the instruction frame."""
    return _out(EX.sid_examples(_seq_rows(spark, d), family="sid_instruction", instruction=True))


@register("history_to_target_table", FX.with_ctes({**_SEQ_ROWS,
    "ex": f"""SELECT 0 AS set_order, line_no AS example_id, array_to_string(hsid, '::') AS history_key, item_sid || chr(10) AS completion FROM sr
UNION ALL SELECT 1 AS set_order, line_no AS example_id, array_to_string(hsid, ', ') AS history_key, item_sid || chr(10) AS completion FROM sr"""},
    "SELECT history_key, arg_max(completion, (set_order, example_id)) AS target FROM ex GROUP BY history_key"))
def history_to_target_table(spark, d):
    """history key -> target over two example sets, last write wins in load order."""
    s = _seq_rows(spark, d)
    a = EX.sid_examples(s).withColumn("set_order", F.lit(0))
    b = EX.sid_examples(s, family="sid_instruction", instruction=True).withColumn("set_order", F.lit(1))
    _, h2t = EX.lookup_tables(a.unionByName(b))
    return h2t


@register("prompt_to_history_table", FX.with_ctes(_SEQ_ROWS, f"""SELECT prompt, arg_max(history_key, (set_order, example_id)) AS history_key FROM (
  SELECT 0 AS set_order, example_id, prompt, history_key FROM ({_examples_sql('sid_history_to_sid', False)})
  UNION ALL SELECT 1 AS set_order, example_id, prompt, history_key FROM ({_examples_sql('sid_instruction', True)})) GROUP BY prompt"""))
def prompt_to_history_table(spark, d):
    """prompt -> history key over two example sets, last write wins in load order."""
    s = _seq_rows(spark, d)
    a = EX.sid_examples(s).withColumn("set_order", F.lit(0))
    b = EX.sid_examples(s, family="sid_instruction", instruction=True).withColumn("set_order", F.lit(1))
    return EX.lookup_tables(a.unionByName(b))[0]


def _token_rows(spark, d):
    i = inter(spark, d)
    idx = FX.sid_index(spark, d).select("item_id", "codes")
    ex = i.select("user_id", "target", F.posexplode("history").alias("p", "item_id")).join(idx, "item_id")
    g = ex.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("p", "codes"))).alias("_l"))
    g = g.select("user_id", F.flatten(F.transform("_l", lambda s: s["codes"])).alias("prompt_ids"))
    t = i.select("user_id", "target").join(idx.select(F.col("item_id").alias("target"), F.col("codes").alias("target_ids")), "target")
    return t.join(g, "user_id")


@register("token_examples", FX.with_ctes({**FX.sql_sid_ctes(), **SEQ_CTES,
    "hx": "SELECT user_id, unnest(history) AS hid, generate_subscripts(history, 1) AS p FROM inter",
    "pi": "SELECT hx.user_id, flatten(list(s.codes ORDER BY hx.p)) AS prompt_ids FROM hx JOIN codes_dd s ON s.item_id = hx.hid GROUP BY hx.user_id",
    "tr": """SELECT i.user_id, pi.prompt_ids, s.codes AS target_ids, list_concat(s.codes, [100001]) AS tgt
FROM inter i JOIN codes_dd s ON s.item_id = i.target JOIN pi ON pi.user_id = i.user_id"""},
    f"""SELECT user_id,
       {_ids_sql("list_concat([100000], prompt_ids, [100001])")} AS framed,
       {_ids_sql(X.tail_sql("list_concat(prompt_ids, tgt)", 64))} AS input_ids,
       {_ids_sql(X.tail_sql("list_concat(list_transform(range(len(prompt_ids)), lambda x: -100), tgt)", 64))} AS labels,
       {_ids_sql("list_concat(list_transform(tgt, lambda x: 1), [0, 0])")} AS completion_mask,
       {_ids_sql(X.tail_sql("prompt_ids", 32))} AS prompt_tail
FROM tr"""))
def token_examples(spark, d):
    """Framing (BOS/EOS), labels with -100 on the prompt (last 64), mask after EOS, prompt tail (32)."""
    t = _token_rows(spark, d)
    tgt = F.concat(F.col("target_ids"), F.array(F.lit(EOS)))
    raw = F.concat(F.array(F.lit(BOS), F.lit(BOS)), F.col("prompt_ids"), F.array(F.lit(EOS)))
    ids, labels, _ = EX.build_labels("prompt_ids", tgt, 64)
    gen = F.concat(tgt, F.array(F.lit(0), F.lit(0)))
    return t.select("user_id", _ids(EX.frame_tokens(raw, BOS, EOS)).alias("framed"), _ids(ids).alias("input_ids"),
                    _ids(labels).alias("labels"), _ids(EX.completion_mask(gen, EOS)).alias("completion_mask"),
                    _ids(X.tail("prompt_ids", 32)).alias("prompt_tail"))
