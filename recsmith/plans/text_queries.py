"""Text queries (B-family) over pages, documents, conversations and the item catalogue."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import text as TX
from . import fixtures as FX
from .registry import register

TAG_SQL = "'</?[\\p{L}\\p{N}_]+[^>]*>'"


def _clean_sql(e: str) -> str:
    c = X.strip_ws_sql(e)
    c = f"regexp_replace({c}, {TAG_SQL}, '', 'g')"
    c = f"regexp_replace({c}, '[\"\\n\\r]', '', 'g')"
    c = f"(regexp_replace({c}, '^(.)(.*?)\\.*$', '\\1\\2', 's') || '.')"
    return f"(CASE WHEN length({c}) >= 2000 THEN '' ELSE {c} END)"


def _clean_list_sql(e: str) -> str:
    el = "regexp_replace(regexp_replace(x, " + TAG_SQL + ", '', 'g'), '[\"\\n\\r]', '', 'g')"
    parts = f"array_to_string(list_transform({e}, lambda x: {X.strip_ws_sql(el)}), ' ')"
    c = f"(regexp_replace({parts}, '^(.)(.*?)\\.*$', '\\1\\2', 's') || '.')"
    return f"(CASE WHEN length({c}) >= 2000 THEN '' ELSE {c} END)"


@register("clean_page_text", f"SELECT page_id, {_clean_sql('html')} AS text FROM pages")
def clean_page_text(spark, d):
    """B1 (entity decoding off): strip tags and quote/newline characters, dot rule, blank when >= 2000 chars."""
    p = FX.table(spark, d, "pages")
    return p.select("page_id", TX.clean_text("html", unescape=False).alias("text"))


@register("clean_page_text_unescaped")
def clean_page_text_unescaped(spark, d):
    """B1 full form: HTML entities decoded in Arrow batches (no SQL twin for ``html.unescape``)."""
    p = FX.table(spark, d, "pages")
    return p.select("page_id", TX.clean_text("html", unescape=True).alias("text"))


@register("clean_document_text", f"SELECT doc_id, {_clean_sql('text')} AS text FROM documents")
def clean_document_text(spark, d):
    """B1 on whole documents (entity decoding off)."""
    return FX.table(spark, d, "documents").select("doc_id", TX.clean_text("text", unescape=False).alias("text"))


def _item_text_sql(fields, list_fields) -> str:
    parts = []
    for f in fields:
        c = _clean_list_sql(f) if f in list_fields else _clean_sql(f)
        parts.append(f"CASE WHEN {f} IS NOT NULL THEN {X.strip_ws_sql(c)} END")
    arr = f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL AND x <> '')"
    return f"SELECT item_id, CASE WHEN len({arr}) = 0 THEN 'unknown item' ELSE array_to_string({arr}, ' ') END AS text FROM it"


@register("item_text", FX.with_ctes({"it": FX.ITEMS_SQL}, _item_text_sql(["title", "description"], ["description"])))
def item_text(spark, d):
    """B2 with feature set ``title, description``: cleaned fields joined, else ``unknown item``."""
    return TX.item_text(FX.items(spark, d), TX.FEATURE_SETS["amazon_text_feature5"], list_fields=("description",), unescape=False)


@register("item_text_title_only", FX.with_ctes({"it": FX.ITEMS_SQL}, _item_text_sql(["title"], [])))
def item_text_title_only(spark, d):
    """B2 + B3: the ``title`` preset."""
    return TX.item_text(FX.items(spark, d), TX.FEATURE_SETS["amazon_text_feature2"], unescape=False)


#: The presets beside ``title`` and ``title, description``, which have queries of their own.
OTHER_PRESETS = ["amazon_text_feature1", "amazon_text_feature1_ro1", "amazon_text_feature1_re1", "amazon_text_feature3", "amazon_text_feature4"]
CATALOGUE_SQL = """SELECT p_partkey AS item_id, p_name AS title, [p_type, p_brand] AS description,
       [p_type] AS category, p_brand AS brand, p_type AS main_cat FROM part"""
LIST_FIELDS = ("description", "category")


@register("item_text_presets", FX.with_ctes({"it": CATALOGUE_SQL}, " UNION ALL ".join(
    f"SELECT '{p}' AS preset, item_id, text FROM ({_item_text_sql(TX.FEATURE_SETS[p], LIST_FIELDS)})" for p in OTHER_PRESETS)))
def item_text_presets(spark, d):
    """B2 + B3: item text by each of the five other presets, one row per preset and item."""
    items = FX.table(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.array("p_type", "p_brand").alias("description"),
        F.array("p_type").alias("category"), F.col("p_brand").alias("brand"), F.col("p_type").alias("main_cat"))
    texts = [TX.item_text(items, TX.FEATURE_SETS[p], list_fields=LIST_FIELDS, unescape=False).select(F.lit(p).alias("preset"), "item_id", "text") for p in OTHER_PRESETS]
    return reduce(lambda a, b: a.unionByName(b), texts)


#: Short names that stand in for the dataset names of a catalogue; the last two are in no table.
SHORT_NAMES = ["Beauty", "Sports", "Toys", "Games", "Industrial_and_Scientific", "Books", "Toys_and_Games", "Office_Products", "Nowhere", ""]


def _lookup_sql(mapping: dict, col: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


@register("dataset_names", FX.with_ctes(
    {"it": f"SELECT p_partkey AS item_id, {SHORT_NAMES!r}[p_size % {len(SHORT_NAMES)} + 1] AS name FROM part"},
    f"""SELECT item_id, name, {_lookup_sql(TX.AMAZON18_FULL_NAMES, 'name')} AS full_name_18,
       {_lookup_sql(TX.AMAZON14_FULL_NAMES, 'name')} AS full_name_14, {_lookup_sql(TX.CATEGORY_LABELS, 'name')} AS label FROM it"""))
def dataset_names(spark, d):
    """B4 + B14: each item's dataset short name with its full names and prompt phrase; unknown names stay null."""
    names = F.array(*[F.lit(n) for n in SHORT_NAMES])
    it = FX.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.element_at(names, F.col("p_size") % len(SHORT_NAMES) + 1).alias("name"))
    return it.select("item_id", "name", TX.dataset_full_name("name").alias("full_name_18"),
                     TX.dataset_full_name("name", amazon14=True).alias("full_name_14"), TX.category_label("name").alias("label"))


@register("word_drop", f"""SELECT doc_id, array_to_string(list_filter(string_split(text, ' '),
       lambda w, i: ({X.portable_hash_sql('doc_id', 'i - 1', seed=7)} + 1) / {float(X.HASH_PRIME)} > 0.1), ' ') AS text FROM documents""")
def word_drop(spark, d):
    """Drop each word of every document with probability 0.1 (seeded, repeatable)."""
    return FX.table(spark, d, "documents").select("doc_id", TX.word_drop("text", "doc_id", 0.1, seed=7).alias("text"))


@register("description_first", FX.with_ctes({"it": FX.ITEMS_SQL}, "SELECT item_id, description[1] AS description FROM it"))
def description_first(spark, d):
    """First element of a list-literal description."""
    return FX.items(spark, d).select("item_id", TX.description_first("description_raw").alias("description"))


@register("description_longest", FX.with_ctes({"it": FX.ITEMS_SQL,
    "pl": """SELECT item_id, title, description_raw AS d,
       from_json(replace(description_raw, '''', '"'), '["VARCHAR"]') AS l FROM it""",
    "ex": """SELECT item_id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM pl""",
    "best": f"""SELECT item_id, arg_min(v, (-length(v), i)) AS v FROM ex WHERE v IS NOT NULL AND {X.strip_ws_sql('v')} <> '' GROUP BY item_id"""},
    r"""SELECT pl.item_id, CASE WHEN d IS NULL OR d = '' THEN title
       WHEN starts_with(d, '[') AND ends_with(d, ']') AND l IS NULL THEN CASE WHEN regexp_replace(d, '^\s+|\s+$', '', 'g') <> '' THEN d ELSE title END
       WHEN starts_with(d, '[') AND ends_with(d, ']') THEN coalesce(best.v, title)
       WHEN trim(d) <> '' THEN d ELSE title END AS description
FROM pl LEFT JOIN best ON best.item_id = pl.item_id"""))
def description_longest(spark, d):
    """Longest non-blank description element, title fallbacks."""
    return FX.items(spark, d).select("item_id", TX.description_longest("description_raw", "title").alias("description"))


def _history_titles(spark, d):
    from .sequence_queries import inter

    i = inter(spark, d)
    ex = i.select("user_id", F.posexplode("history").alias("p", "item_id"))
    it = FX.items(spark, d).select("item_id", "title")
    j = ex.join(it, "item_id")
    g = j.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("p", "title"))).alias("_l"))
    return g.select("user_id", F.transform("_l", lambda s: s["title"]).alias("titles"))


_HT_CTES = {"ev": FX.EVENTS_SQL,
            "seq": f"SELECT user_id, list(item_id ORDER BY {FX.EVENT_ORDER_SQL}) AS items FROM ev GROUP BY user_id",
            "inter": "SELECT user_id, items[1:len(items) - 1] AS history, items[len(items)] AS target FROM seq WHERE len(items) >= 2",
            "it": FX.ITEMS_SQL,
            "hx": "SELECT user_id, unnest(history) AS hid, generate_subscripts(history, 1) AS p FROM inter",
            "ht": "SELECT hx.user_id, list(it.title ORDER BY hx.p) AS titles FROM hx JOIN it ON it.item_id = hx.hid GROUP BY hx.user_id"}


@register("render_history", FX.with_ctes(_HT_CTES, """SELECT user_id,
       array_to_string(list_transform(titles, lambda x: '"' || x || '"'), ', ') AS quoted,
       array_to_string(list_transform(titles, lambda x: '"' || x || '"'), ',' || chr(9)) AS quoted_tab,
       array_to_string(titles, '::') AS history_key FROM ht"""))
def render_history(spark, d):
    """Quoted title lists (comma and comma-tab forms) and the ``::`` history key."""
    h = _history_titles(spark, d)
    return h.select("user_id", TX.render_titles("titles", ", ").alias("quoted"), TX.render_titles("titles", ",\t").alias("quoted_tab"),
                    TX.history_key("titles").alias("history_key"))


_CONV_CTES = {"pairs": """SELECT a.conv_id, a.turn, '### User Input: ' || chr(10) || u.text || chr(10) || chr(10) || '### Response:' || chr(10) || a.text AS generated
FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
WHERE a.role = 'assistant' AND u.role = 'user'"""}


def _conv_pairs(spark, d):
    c = FX.table(spark, d, "conversations")
    a = c.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("a_text"))
    u = c.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("u_text"))
    j = a.join(u, ["conv_id", "turn"])
    return j.select("conv_id", "turn", F.concat(F.lit("### User Input: \n"), "u_text", F.lit("\n\n### Response:\n"), "a_text").alias("generated"))


@register("completion_text", FX.with_ctes(_CONV_CTES, f"""SELECT conv_id, turn,
       {X.strip_ws_sql("string_split(generated, 'Response:' || chr(10))[-1]")} AS completion FROM pairs"""))
def completion_text(spark, d):
    """The text after the last ``Response:\\n`` of each user/assistant exchange."""
    return _conv_pairs(spark, d).select("conv_id", "turn", TX.completion_text("generated").alias("completion"))


@register("strip_think", """SELECT conv_id, turn, regexp_replace('<think>' || role || chr(10) || text || '</think>' || text, '<think>.*?</think>', '', 'gs') AS text
FROM conversations""")
def strip_think(spark, d):
    """Remove ``<think>..</think>`` spans (each turn carries a reasoning span before its text)."""
    c = FX.table(spark, d, "conversations")
    t = F.concat(F.lit("<think>"), "role", F.lit("\n"), "text", F.lit("</think>"), "text")
    return c.select("conv_id", "turn", TX.strip_think(t).alias("text"))


def _template_sql(template: str, cols: dict[str, str]) -> str:
    out = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        lit = template[pos:m.start()].replace("'", "''").replace("\n", "' || chr(10) || '")
        out.append(f"'{lit}'")
        out.append(cols[m.group(1)])
        pos = m.end()
    lit = template[pos:].replace("'", "''").replace("\n", "' || chr(10) || '")
    out.append(f"'{lit}'")
    return " || ".join(out)


def _preference_sql(template: str) -> str:
    return FX.with_ctes({**_HT_CTES,
        "tt": "SELECT inter.user_id, it.title AS target_title FROM inter JOIN it ON it.item_id = inter.target"},
        "SELECT ht.user_id, " + _template_sql(template, {
            "dataset_full_name": "'Industrial_and_Scientific'",
            "item_titles": "array_to_string(list_transform(titles, lambda x: '\"' || x || '\"'), ', ')",
            "target_item_info": "tt.target_title"}) + " AS prompt FROM ht JOIN tt ON tt.user_id = ht.user_id")


def _preference_prompts(spark, d, template: str):
    from .sequence_queries import inter

    h = _history_titles(spark, d)
    tt = inter(spark, d).join(FX.items(spark, d).select(F.col("item_id").alias("target"), F.col("title").alias("target_title")), "target")
    j = h.join(tt.select("user_id", "target_title"), "user_id")
    p = TX.fill_template(template, dataset_full_name=F.lit("Industrial_and_Scientific"),
                         item_titles=TX.render_titles("titles", ", "), target_item_info=F.col("target_title"))
    return j.select("user_id", p.alias("prompt"))


@register("annotation_prompts", _preference_sql(TX.PREFERENCE_PROMPT_1))
def annotation_prompts(spark, d):
    """Preference-annotation prompts rendered from each user's history (the model call is not built)."""
    return _preference_prompts(spark, d, TX.PREFERENCE_PROMPT_1)


@register("annotation_prompts_second_form", _preference_sql(TX.PREFERENCE_PROMPT_2))
def annotation_prompts_second_form(spark, d):
    """The second preference form."""
    return _preference_prompts(spark, d, TX.PREFERENCE_PROMPT_2)


@register("intention_prompts", FX.with_ctes({"it": FX.ITEMS_SQL},
    "SELECT doc_id, " + _template_sql(TX.INTENTION_PROMPT, {"dataset_full_name": "'Industrial_and_Scientific'", "item_title": "it.title", "review": "documents.text"})
    + " AS prompt FROM documents JOIN it ON it.item_id = documents.doc_id"))
def intention_prompts(spark, d):
    """Intention prompts from an item's title and a review's whole text (a document stands in for the review of its
    number's item); a null title or review gives a null prompt."""
    reviews = FX.table(spark, d, "documents").select("doc_id", "text")
    j = reviews.join(FX.items(spark, d).select(F.col("item_id").alias("doc_id"), "title"), "doc_id")
    p = TX.fill_template(TX.INTENTION_PROMPT, dataset_full_name=F.lit("Industrial_and_Scientific"), item_title=F.col("title"), review=F.col("text"))
    return j.select("doc_id", F.when(F.col("title").isNotNull() & F.col("text").isNotNull(), p).alias("prompt"))
