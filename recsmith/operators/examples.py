"""Training-example construction.

Examples are rows ``(family, example_id, prompt, completion, history_key, is_repeat)``
built with string expressions over sequence rows; token operators work on
``array<int>`` columns with higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X

# ---- fixed values (must equal the reference's for equal output) -------------
USER_FRAME = "### User Input: \n{input}\n\n### Response:\n{output}"
SID_INPUT = ("The user has interacted with items {history} in chronological order. "
             "Can you predict the next possible item that the user may expect?")
INSTRUCTION = ("Below is an instruction that describes a task, paired with an input that provides further context. "
               "Write a response that appropriately completes the request. \n\n"
               "### Instruction:\nCan you predict the next possible item that the user may expect?\n\n")
LABEL_PAD = -100
# -----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def user_frame(inp, out) -> Column:
    return F.concat(F.lit("### User Input: \n"), _c(inp), F.lit("\n\n### Response:\n"), _c(out))


def sid_examples(seq: DataFrame, example_id: str = "line_no", family: str = "sid_history_to_sid",
                 instruction: bool = False) -> DataFrame:
    """F4 (and F5 with the instruction frame): SID history -> SID.

    ``history_item_sid`` array<string>, ``item_sid`` string; the history key joins the
    SIDs with ``::`` (F5: with ``, ``); the repeat flag compares the target with the last history SID.
    """
    hist = F.array_join("history_item_sid", ", ")
    inp = fill(SID_INPUT, history=hist)
    prompt = user_frame(inp, F.lit(""))
    if instruction:
        prompt = F.concat(F.lit(INSTRUCTION), prompt)
    return seq.select(
        F.lit(family).alias("family"), F.col(example_id).alias("example_id"), prompt.alias("prompt"),
        F.concat(F.col("item_sid"), F.lit("\n")).alias("completion"),
        (hist if instruction else F.array_join("history_item_sid", "::")).alias("history_key"),
        F.coalesce(X.last("history_item_sid") == F.col("item_sid"), F.lit(False)).alias("is_repeat"),
    )


def lookup_tables(examples: DataFrame, set_order: str = "set_order", ord_col: str = "example_id"):
    """prompt -> history key and history key -> target, last write wins across sets in
    load order (partial aggregates of ``max(struct(set, ord, value))``)."""
    p2h = examples.groupBy("prompt").agg(F.max(F.struct(set_order, ord_col, "history_key")).alias("_w")).select(
        "prompt", F.col("_w.history_key").alias("history_key"))
    h2t = examples.groupBy("history_key").agg(F.max(F.struct(set_order, ord_col, "completion")).alias("_w")).select(
        "history_key", F.col("_w.completion").alias("target"))
    return p2h, h2t


def frame_tokens(col, bos: int, eos: int, add_bos: bool = True, add_eos: bool = True) -> Column:
    """strip repeated leading BOS and trailing EOS, then add them as asked."""
    c = _c(col)
    n = F.size(c)
    # first position that is not BOS (1-based; n+1 when all are BOS)
    first = F.coalesce(F.nullif(F.array_position(F.transform(c, lambda x: x != F.lit(bos)), F.lit(True)), F.lit(0)), n + 1)
    rev = F.reverse(c)
    last_from_end = F.coalesce(F.nullif(F.array_position(F.transform(rev, lambda x: x != F.lit(eos)), F.lit(True)), F.lit(0)), n + 1)
    length = F.greatest(n - (first - 1) - (last_from_end - 1), F.lit(0))
    core = F.when(length > 0, F.slice(c, first, length)).otherwise(F.array().cast("array<int>"))
    if add_bos:
        core = F.concat(F.array(F.lit(bos)), core)
    if add_eos:
        core = F.concat(core, F.array(F.lit(eos)))
    return core


def build_labels(prompt, target, max_len: int):
    """input = prompt + target, labels = -100 on the prompt, mask of ones; the
    last ``max_len`` positions are kept.  Returns (input_ids, labels, attention_mask)."""
    p, t = _c(prompt), _c(target)
    ids = F.concat(p, t)
    labels = F.concat(F.array_repeat(F.lit(LABEL_PAD), F.size(p)), t)
    return X.tail(ids, max_len), X.tail(labels, max_len), X.tail(F.array_repeat(F.lit(1), F.size(ids)), max_len)


def completion_mask(ids, eos: int) -> Column:
    """1 up to and including the first EOS, 0 after; all ones without EOS."""
    c = _c(ids)
    first = F.array_position(c, F.lit(eos))
    return F.transform(c, lambda x, i: F.when((first == 0) | (i + 1 <= first), 1).otherwise(0))


# ---- fixed values (must equal the reference's for equal output) -------------
INSTRUCTION_HEAD = ("Below is an instruction that describes a task, paired with an input that provides further context. "
                    "Write a response that appropriately completes the request. \n\n### Instruction:\n")
TITLE_INSTRUCTS = [
    "Given a list of {category} the user recetenly enjoy, please write a new {category} that the user may bought",
    "Considering the {category} that has recently captured the user's interest, kindly create a compilation of other {category} that the user might have played prior to this.",
    "Based on the user's current gaming preference, please draft a list of potential {category} they may have experienced beforehand.",
    "Reflecting on the {category} the user has taken pleasure in recently, we request that you formulate a list of {category} that may have preceded the user's current enjoyment.",
    "In light of the recent gaming enjoyment expressed by the user, please assemble a list of {category} that could potentially include past titles the user has engaged with.",
    "Taking into account the {category} that has lately provided enjoyment to the user, please put together an inventory of {category} the user might have explored previously.",
    "Given the user's newfound enjoyment of a particular {category}, would you kindly generate a roster of other {category} that might resonate with their past gaming experiences?",
    "In response to the user's recent fondness for a specific {category}, we seek your assistance in listing possible {category} the user may have delighted in earlier.",
    "With respect to the {category} currently enjoyed by the user, please compile a suggestive list of {category} they may have played in the past.",
    "Bearing in mind the {category} that the user has recently been enthralled by, please construct a catalog of other {category} that the user potentially partook in beforehand.",
    "In relation to the user's recent entertainment with a given {category}, it would be appreciated if you could curate a list of {category} that might form part of the user's previous gaming history.",
]
TITLE_HISTORY_INPUT = "The user has palyed the following {category}s before: {history}"
SID_EVAL_INPUT = "Can you predict the next possible item the user may expect, given the following chronological interaction history: {history}"
ITEM_ID_INSTRUCTION = "Answer the question about item identification."
TITLE2SID_PROMPT = "Which item has the title: {title}?"
SID2TITLE_PROMPT = 'What is the title of item "{sid}"?'
DESC2SID_PROMPT = 'An item can be described as follows: "{description}". Which item is it describing?'
TITLE_SEQ_PROMPT = ("Given the title sequence of user historical interactive items: {titles}, "
                    "can you recommend a suitable next item for the user?")
SID_HISTORY_TITLE_INPUT = ("The user has interacted with items {history} in chronological order. Can you predict the title of the next "
                           "item that the user may expect? Analyze user preferences and then predict the title of the next item.")
FUSION_INSTRUCTION = "Can you recommend the next item for the user based on their interaction history?"
FUSION_TITLE_PROMPT = "The user has sequentially interacted with items {history}. Can you recommend the next item for him? Tell me the title of the item"
FUSION_DESC_PROMPT = "Please review the user's historical interactions: {history}, and describe what kind of item he still needs."
FUSION_DESC_FALLBACK = "An item with semantic ID {sid}"
TITLE2SID_SFT_INSTRUCTION = "Based on the user's historical interaction with item titles, predict the semantic ID of the next item they may expect."
TITLE2SID_SFT_INPUT = ("The user has interacted with the following {category} items in chronological order: {titles}. "
                       "Can you predict the next item the user may expect?")
PREF_SFT_INSTRUCTION = "Analyze the user's interaction history, provide insights about their preferences, and predict the next item's semantic ID."
PREF_SFT_INPUT = "The user has interacted with items {history} in chronological order. Can you analyze the user's preferences and predict the next item?"
PREF_SFT_OUTPUT = "### Reasoning:\n{preference}\n### Response:\n{sid}"
PREF2SID_INSTRUCTION = "Based on the user interaction history and preference analysis, predict the next item's semantic ID."
PREF2SID_INPUT = ("The user has interacted with items {history} in chronological order. Can you analyze the user's preferences?\n"
                  "### Reasoning:\n{preference}\nCan you predict the next possible item that the user may expect?")
FEW_SHOT_BLOCK = "### Example {idx}:\n{input} \n\n### Response:\n{output}\n"
GPR_INPUT = ("{u_token} {e_token} The user has interacted with items {history} in chronological order. "
             "Can you predict the next possible item that the user may expect?")
USER_UNKNOWN = "[USER_UNKNOWN]"
CTX_HOMEPAGE = "[CTX_HOMEPAGE]"
O_TOKEN = "[O_TOKEN]"
I_TOKEN = "[I_TOKEN]"
# -----------------------------------------------------------------------------


def fill(template: str, **cols) -> Column:
    """Fill ``{name}`` slots of a fixed template with columns (plain ``concat``)."""
    import re

    parts = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts.append(F.lit(template[pos:m.start()]))
        v = cols[m.group(1)]
        parts.append(F.lit(v) if isinstance(v, str) else v)
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def instruction_frame(text, tail: str = "\n\n") -> Column:
    return F.concat(F.lit(INSTRUCTION_HEAD), F.lit(text) if isinstance(text, str) else text, F.lit(tail))


def title_instruction(example_id, category: str, seed: int) -> Column:
    """The instruction variant is picked by a seeded portable hash of the example id."""
    variants = F.array(*[F.lit(v.replace("{category}", category)) for v in TITLE_INSTRUCTS])
    return F.element_at(variants, (X.portable_hash(example_id, seed=seed) % len(TITLE_INSTRUCTS)).cast("int") + 1)


def _quoted(col, sep: str) -> Column:
    return F.array_join(F.transform(_c(col), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), sep)


def _rows(df, family, example_id, prompt, completion, history_key, is_repeat):
    return df.select(F.lit(family).alias("family"), F.col(example_id).alias("example_id"), prompt.alias("prompt"),
                     completion.alias("completion"), history_key.alias("history_key"),
                     F.coalesce(is_repeat, F.lit(False)).alias("is_repeat"))


def title_history_examples(seq: DataFrame, category: str, seed: int = 42, family: str = "title_history_sft",
                           evaluation: bool = False, example_id: str = "line_no") -> DataFrame:
    """F1/F2 (and F3 with ``evaluation``): quoted title history -> quoted title.

    Instruction variant by seeded hash (T27); history joined by ``",\\t"``; repeat by ids."""
    inp = fill(TITLE_HISTORY_INPUT, category=category, history=_quoted("history_item_title", ",\t"))
    tail = "\n\n" if evaluation else "\n \n"
    prompt = F.concat(instruction_frame(title_instruction(F.col(example_id), category, seed), tail), user_frame(inp, F.lit("")))
    completion = F.concat(F.lit('"'), F.col("item_title"), F.lit('"\n'))
    rep = X.last("history_item_id") == F.col("item_id")
    return _rows(seq, family, example_id, prompt, completion, F.array_join("history_item_title", "::"), rep)


def sid_eval_examples(seq: DataFrame, example_id: str = "line_no") -> DataFrame:
    """SID history -> SID with the evaluation wording and the SID instruction."""
    inp = fill(SID_EVAL_INPUT, history=F.array_join("history_item_sid", ", "))
    prompt = F.concat(F.lit(INSTRUCTION), user_frame(inp, F.lit("")))
    rep = X.last("history_item_sid") == F.col("item_sid")
    return _rows(seq, "sid_eval", example_id, prompt, F.concat(F.col("item_sid"), F.lit("\n")),
                 F.array_join("history_item_sid", "::"), rep)


def sid_gpr_examples(seq: DataFrame, items: DataFrame, user_features: DataFrame, sid_map: DataFrame,
                     example_id: str = "line_no", user_key: str = "user_id_original_str", aligned: bool = True) -> DataFrame:
    """heterogeneous prompt -- user token (default ``[USER_UNKNOWN]``), context token
    ``[CTX_HOMEPAGE]``, ``[O_TOKEN]``/``[I_TOKEN]`` prefix by item type (anything but 'O' is
    ``[I_TOKEN]``), target weight ``final_value`` (default 0.0).  History pairs each item
    with its own SID (the aligned form; items without a SID are skipped, T8)."""
    it = items.select(F.col("item_id").alias("_id"), F.col("item_type").alias("_type"), F.col("final_value").alias("_fv"))
    sm = sid_map.select(F.col("item_id").alias("_id"), F.col("sid").alias("_sid"))
    if aligned:
        ex = seq.select(example_id, F.posexplode("history_item_id").alias("_p", "_id"))
        j = ex.join(sm, "_id").join(it, "_id", "left")
    else:
        # parity (T8): the i-th id is paired with the i-th entry of the SID list, which
        # skipped items without a SID, so pairs can drift; missing entries become ''
        ex = seq.select(example_id, "history_item_sid", F.posexplode("history_item_id").alias("_p", "_id"))
        ex = ex.withColumn("_sid", F.coalesce(F.try_element_at("history_item_sid", F.col("_p") + 1), F.lit(""))).drop("history_item_sid")
        j = ex.join(it, "_id", "left")
    pref = F.when(F.coalesce(F.col("_type"), F.lit("O")) == "O", F.lit(O_TOKEN)).otherwise(F.lit(I_TOKEN))
    back = j.groupBy(example_id).agg(F.array_sort(F.collect_list(F.struct("_p", F.concat(pref, F.col("_sid")).alias("_v")))).alias("_l"))
    back = back.select(example_id, F.array_join(F.transform("_l", lambda s: s["_v"]), ", ").alias("_hist"))
    t = seq.join(back, example_id, "left").join(it.withColumnRenamed("_id", "item_id"), "item_id", "left")
    t = t.join(user_features.select(F.col("user_id").alias(user_key), "u_token"), user_key, "left")
    inp = fill(GPR_INPUT, u_token=F.coalesce("u_token", F.lit(USER_UNKNOWN)), e_token=CTX_HOMEPAGE,
               history=F.coalesce("_hist", F.lit("")))
    prompt = F.concat(F.lit(INSTRUCTION), user_frame(inp, F.lit("")))
    tpref = F.when(F.coalesce(F.col("_type"), F.lit("O")) == "O", F.lit(O_TOKEN)).otherwise(F.lit(I_TOKEN))
    out = _rows(t, "sid_gpr", example_id, prompt, F.concat(tpref, F.col("item_sid"), F.lit("\n")),
                F.array_join("history_item_sid", ", "), X.last("history_item_sid") == F.col("item_sid"))
    return out.join(t.select(F.col(example_id).alias("example_id"), F.coalesce("_fv", F.lit(0.0)).alias("final_value")), "example_id")


def item_maps(items: DataFrame, index: DataFrame) -> DataFrame:
    """Per item with at least three tokens: sid3, title, first-element (B6) and longest
    description and the index ordinal that decides dictionary overwrites (T21)."""
    from ..functions.text import description_first, description_longest

    j = index.filter(F.size("tokens") >= 3).join(items, "item_id")
    return j.select("item_id", "idx_ord", F.array_join(F.slice("tokens", 1, 3), "").alias("sid3"), "title",
                    description_first("description_raw").alias("description"),
                    description_longest("description_raw", "title").alias("long_description"))


def _lww(df, key, value):
    return df.groupBy(key).agg(F.max(F.struct("idx_ord", value)).alias("_w")).select(key, F.col(f"_w.{value}").alias(value))


def sid_title_examples(maps: DataFrame, with_instruction: bool = True, sample: int = -1, seed: int = 0) -> DataFrame:
    """F8: sid2title and title2sid pairs from the last-write-wins maps; with ``sample`` > 0 that
    many pairs of the union, chosen by a seeded hash."""
    s2t = _lww(maps, "sid3", "title")
    t2s = _lww(maps, "title", "sid3")
    frame = (lambda p: F.concat(instruction_frame(ITEM_ID_INSTRUCTION), user_frame(p, F.lit("")))) if with_instruction else (
        lambda p: user_frame(p, F.lit("")))
    a = s2t.select(F.lit("sid2title").alias("task"), F.col("sid3").alias("input"),
                   frame(fill(SID2TITLE_PROMPT, sid=F.col("sid3"))).alias("prompt"), F.concat("title", F.lit("\n")).alias("completion"))
    b = t2s.select(F.lit("title2sid").alias("task"), F.col("title").alias("input"),
                   frame(fill(TITLE2SID_PROMPT, title=F.col("title"))).alias("prompt"), F.concat("sid3", F.lit("\n")).alias("completion"))
    both = a.unionByName(b)
    if sample <= 0:
        return both
    drawn = X.portable_hash(X.string_key("task"), X.string_key("input"), seed=seed)
    return both.withColumn("_h", drawn).orderBy("_h", "task", "input").limit(sample).drop("_h")


def title_desc_to_sid_examples(maps: DataFrame) -> DataFrame:
    """title2sid and description2sid (B6 first-element description)."""
    t2s = _lww(maps, "title", "sid3")
    d2s = _lww(maps, "description", "sid3")
    a = t2s.select(F.lit("title2sid").alias("task"), F.col("title").alias("input"),
                   user_frame(fill(TITLE2SID_PROMPT, title=F.col("title")), F.lit("")).alias("prompt"), F.concat("sid3", F.lit("\n")).alias("completion"))
    b = d2s.select(F.lit("description2sid").alias("task"), F.col("description").alias("input"),
                   user_frame(fill(DESC2SID_PROMPT, description=F.col("description")), F.lit("")).alias("prompt"),
                   F.concat("sid3", F.lit("\n")).alias("completion"))
    return a.unionByName(b)


def sid_to_title_examples(maps: DataFrame) -> DataFrame:
    """sid2title only."""
    s2t = _lww(maps, "sid3", "title")
    return s2t.select(F.lit("sid2title").alias("task"), F.col("sid3").alias("input"),
                      user_frame(fill(SID2TITLE_PROMPT, sid=F.col("sid3")), F.lit("")).alias("prompt"),
                      F.concat("title", F.lit("\n")).alias("completion"))


def title_seq_to_sid_examples(seq: DataFrame, dedup: bool = False, example_id: str = "line_no") -> DataFrame:
    """title history -> SID; with ``dedup`` rows whose target repeats the last id are dropped."""
    p = user_frame(fill(TITLE_SEQ_PROMPT, titles=_quoted("history_item_title", ", ")), F.lit(""))
    rep = X.last("history_item_id") == F.col("item_id")
    out = _rows(seq, "title_seq_to_sid", example_id, p, F.concat("item_sid", F.lit("\n")), F.array_join("history_item_title", "::"), rep)
    return out.filter(~F.col("is_repeat")) if dedup else out


def sid_history_to_title_examples(seq: DataFrame, items: DataFrame, dedup: bool = False, example_id: str = "line_no") -> DataFrame:
    """SID history -> title of the target id (fallback ``Unknown item {id}``)."""
    it = items.select(F.col("item_id").alias("item_id"), F.col("title").alias("_t"))
    s = seq.join(it, "item_id", "left")
    title = F.coalesce("_t", F.concat(F.lit("Unknown item "), F.col("item_id").cast("string")))
    p = user_frame(fill(SID_HISTORY_TITLE_INPUT, history=F.array_join("history_item_sid", ", ")), F.lit(""))
    out = _rows(s, "sid_history_to_title", example_id, p, F.concat(title, F.lit("\n")), F.array_join("history_item_sid", "::"),
                X.last("history_item_sid") == F.col("item_sid"))
    return out.filter(~F.col("is_repeat")) if dedup else out


def fusion_examples(seq: DataFrame, maps: DataFrame, task: str = "title", example_id: str = "line_no", dedup: bool = False) -> DataFrame:
    """SID history -> title (live branch) or longest description (B7); ``dedup`` drops rows
    whose target repeats the last history SID.  The target SID of the
    row is looked up in the 3-token maps as is, so suffixed SIDs miss and fall back
    (title -> the SID itself; description -> ``An item with semantic ID {sid}``), T1."""
    s2t = _lww(maps, "sid3", "title").withColumnRenamed("sid3", "item_sid")
    s2d = _lww(maps, "sid3", "long_description").withColumnRenamed("sid3", "item_sid")
    s = seq.join(s2t, "item_sid", "left").join(s2d, "item_sid", "left")
    hist = F.array_join("history_item_sid", ", ")
    if task == "title":
        p = fill(FUSION_TITLE_PROMPT, history=hist)
        target = F.coalesce("title", "item_sid")
    else:
        p = fill(FUSION_DESC_PROMPT, history=hist)
        target = F.coalesce("long_description", fill(FUSION_DESC_FALLBACK, sid=F.col("item_sid")))
    prompt = F.concat(instruction_frame(FUSION_INSTRUCTION), user_frame(p, F.lit("")))
    out = _rows(s, f"fusion_{task}", example_id, prompt, F.concat(target, F.lit("\n")), hist,
                X.last("history_item_sid") == F.col("item_sid"))
    return out.filter(~F.col("is_repeat")) if dedup else out


def title_history_to_sid_sft(seq: DataFrame, id2sid: DataFrame, category: str, example_id: str = "line_no", dedup: bool = False) -> DataFrame:
    """quoted titles -> 3-token SID of the target (fallback: the id text), with instruction;
    ``dedup`` drops rows whose target repeats the last history id."""
    m = id2sid.select(F.col("item_id"), F.col("sid3").alias("_s3"))
    s = seq.join(m, "item_id", "left")
    target = F.coalesce("_s3", F.col("item_id").cast("string"))
    inp = fill(TITLE2SID_SFT_INPUT, category=category, titles=_quoted("history_item_title", ", "))
    prompt = F.concat(instruction_frame(TITLE2SID_SFT_INSTRUCTION), user_frame(inp, F.lit("")))
    out = _rows(s, "title_history_to_sid_sft", example_id, prompt, F.concat(target, F.lit("\n")),
                F.array_join("history_item_title", "::"), X.last("history_item_id") == F.col("item_id"))
    return out.filter(~F.col("is_repeat")) if dedup else out


def preference_examples(pref: DataFrame, id2sid: DataFrame, kind: str = "reasoning") -> DataFrame:
    """F15 (``reasoning``: history -> reasoning + SID, no trailing newline) and F16
    (``to_sid``: history + reasoning -> SID with newline).  Records are train-split
    preference rows; history = all but the last of history+target, >= 2 items."""
    from .sequences import ids_to_sids

    p = pref.filter(F.col("split") == "train").withColumn(
        "_all", F.concat(F.coalesce("context.history_items", F.array().cast("array<bigint>")),
                         F.when(F.col("context.target_item").isNotNull(), F.array("context.target_item")).otherwise(F.array().cast("array<bigint>"))))
    p = p.filter(F.size("_all") >= 2).withColumn("_hist", F.slice("_all", 1, F.size("_all") - 1)).withColumn("_tgt", X.last("_all"))
    if "example_id" not in p.columns:
        raise ValueError("preference rows need an example_id column (stable row key)")
    p = p.withColumnRenamed("example_id", "_row")
    m = id2sid.select("item_id", F.col("sid3").alias("sid"))
    h = ids_to_sids(p, "_hist", "_row", m, name="_hs")
    h = h.join(m.select(F.col("item_id").alias("_tgt"), F.col("sid").alias("_ts")), "_tgt", "left")
    h = h.withColumn("_ts", F.coalesce("_ts", F.col("_tgt").cast("string")))
    hist = F.array_join("_hs", ", ")
    if kind == "reasoning":
        prompt = F.concat(instruction_frame(PREF_SFT_INSTRUCTION), user_frame(fill(PREF_SFT_INPUT, history=hist), F.lit("")))
        completion = fill(PREF_SFT_OUTPUT, preference=F.col("user_preference"), sid=F.col("_ts"))
    else:
        prompt = F.concat(instruction_frame(PREF2SID_INSTRUCTION),
                          user_frame(fill(PREF2SID_INPUT, history=hist, preference=F.col("user_preference")), F.lit("")))
        completion = F.concat("_ts", F.lit("\n"))
    return h.filter(F.size("_hs") > 0).select(F.col("user").alias("user"), F.col("_row").alias("example_id"),
                                               prompt.alias("prompt"), completion.alias("completion"))


def few_shot_block(idx, inp, out) -> Column:
    """one few-shot example block."""
    return fill(FEW_SHOT_BLOCK, idx=_c(idx).cast("string"), input=_c(inp), output=_c(out))
