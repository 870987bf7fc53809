"""Text and scalar column functions.

Everything is a built-in expression except HTML entity decoding, which has no
JVM builtin and runs as an ``arrow_udf`` (``html.unescape``).
"""

from __future__ import annotations

import ast
import html

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import expr as X


# ---- fixed values (must equal the reference's for equal output) -------------
# a tag: Python's word characters are Unicode letters, digits and the underscore
TAG_RE = r"</?[\p{L}\p{N}_]+[^>]*>"
MAX_TEXT_LEN = 2000

FEATURE_SETS = {
    "amazon_text_feature1": ["title", "category", "brand"],
    "amazon_text_feature1_ro1": ["brand", "main_cat", "category", "title"],
    "amazon_text_feature1_re1": ["title"],
    "amazon_text_feature2": ["title"],
    "amazon_text_feature3": ["description"],
    "amazon_text_feature4": ["description", "main_cat", "category", "brand"],
    "amazon_text_feature5": ["title", "description"],
}

AMAZON18_FULL_NAMES = {
    "Beauty": "All_Beauty",
    "Fashion": "AMAZON_FASHION",
    "Appliances": "Appliances",
    "Arts": "Arts_Crafts_and_Sewing",
    "Automotive": "Automotive",
    "Books": "Books",
    "CDs": "CDs_and_Vinyl",
    "Cell": "Cell_Phones_and_Accessories",
    "Clothing": "Clothing_Shoes_and_Jewelry",
    "Music": "Digital_Music",
    "Electronics": "Electronics",
    "Gift": "Gift_Cards",
    "Food": "Grocery_and_Gourmet_Food",
    "Home": "Home_and_Kitchen",
    "Industrial_and_Scientific": "Industrial_and_Scientific",
    "Kindle": "Kindle_Store",
    "Luxury": "Luxury_Beauty",
    "Magazine": "Magazine_Subscriptions",
    "Movies": "Movies_and_TV",
    "Instruments": "Musical_Instruments",
    "Office": "Office_Products",
    "Garden": "Patio_Lawn_and_Garden",
    "Pet": "Pet_Supplies",
    "Pantry": "Prime_Pantry",
    "Software": "Software",
    "Sports": "Sports_and_Outdoors",
    "Tools": "Tools_and_Home_Improvement",
    "Toys_and_Games": "Toys_and_Games",
    "Games": "Video_Games",
}

AMAZON14_FULL_NAMES = {"Beauty": "Beauty", "Sports": "Sports_and_Outdoors", "Toys": "Toys_and_Games"}

CATEGORY_LABELS = {
    "Industrial_and_Scientific": "industrial and scientific items",
    "Office_Products": "office products",
    "Toys_and_Games": "toys and games",
    "Sports": "sports and outdoors",
    "Books": "books",
}

INTENTION_PROMPT = (
    "After purchasing a {dataset_full_name} item named \"{item_title}\", the user left a comment expressing his opinion and personal preferences. The user's comment is as follows: \n\"{review}\" "
    "\nAs we all know, user comments often contain information about both their personal preferences and the characteristics of the item they interacted with. From this comment, you can infer both the user's personal preferences and the characteristics of the item. "
    "Please describe your inferred user preferences and item characteristics in the first person and in the following format:\n\nMy preferences: []\nThe item's characteristics: []\n\n"
    "Note that your inference of the personalized preferences should not include any information about the title of the item."
)

PREFERENCE_PROMPT_1 = (
    "A user has bought a variety of {dataset_full_name} items in chronological order: \n{item_titles}. \nAfter purchasing these items, the user then chose to buy the following item: {target_item_info}. "
    "Based on this purchasing pattern and the final choice, please analyze what this reveals about the user's personalized preferences. Provide a brief third-person summary that explains the logical progression from the historical purchases to this final choice, highlighting the key factors that influence the user's decisions. "
    "In your analysis, do not mention the specific name/title of the target item, but focus on the characteristics and features that drove the user to make this particular choice. Your analysis should be brief and in the third person."
)

PREFERENCE_PROMPT_2 = (
    "A user has purchased a chronological list of {dataset_full_name} items: \n{item_titles}. \nThen, the user made a final purchase: {target_item_info}. "
    "Based on this purchasing progression, please provide a concise analysis of what drove the user to choose this specific type of item. Focus on the logical connection between the user's purchase history and this final choice. "
    "Explain the purchasing pattern and what it reveals about the user's evolving needs or interests. Your analysis should be brief and in the third person."
)
# -----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Text bytes that are Python strings at a time while entities are decoded.
UNESCAPE_BYTES = 1 << 20


def _unescaped(texts: pa.Array) -> pa.Array:
    """``html.unescape`` of every text.  Only texts with an ``&`` become Python strings, about a megabyte at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    step = np.cumsum(sizes, dtype=np.int64) // UNESCAPE_BYTES
    cuts = [0, *(np.nonzero(np.diff(step))[0] + 1).tolist(), len(texts)]
    parts = []
    for start, end in zip(cuts, cuts[1:]):
        part = texts.slice(start, end - start)
        found = pc.fill_null(pc.match_substring(part, "&"), False)
        if pc.any(found).as_py():
            part = pc.replace_with_mask(part, found, pa.array((html.unescape(v.as_py()) for v in part.filter(found)), part.type))
        parts.append(part)
    return pa.concat_arrays(parts)


@F.arrow_udf(T.StringType())
def html_unescape(s: pa.Array) -> pa.Array:
    """HTML entity decoding (no JVM builtin) on Arrow arrays."""
    return _unescaped(s)


@F.arrow_udf(T.ArrayType(T.StringType()))
def html_unescape_list(s: pa.Array) -> pa.Array:
    """Element-wise HTML entity decoding of string arrays (a Python UDF cannot sit
    inside a higher-order lambda, so the whole array goes through one Arrow call)."""
    sizes = pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), _unescaped(s.flatten()), mask=s.is_null())


def _dots(c: Column) -> Column:
    """Collapse trailing dots to one; the first character is never removed,
    so ``...`` -> ``..`` and '' -> ``.``."""
    return F.concat(F.regexp_replace(c, r"(?s)\A(.)(.*?)\.*\z", "$1$2"), F.lit("."))


def _blank_long(c: Column) -> Column:
    # as a replacement: a CASE over the length would evaluate the whole chain twice
    return F.regexp_replace(c, rf"(?s)\A.{{{MAX_TEXT_LEN},}}\z", "")


def _clean_core(c: Column, unescape: bool) -> Column:
    if unescape:
        c = html_unescape(c)
    c = F.regexp_replace(c, TAG_RE, "")
    return F.regexp_replace(c, '["\n\r]', "")


def clean_text(col, unescape: bool = True) -> Column:
    """B1 for a scalar: strip, unescape, drop tags and ``" \\n \\r``, dot rule, blank when >= 2000 chars."""
    c = _clean_core(X.strip_ws(col), unescape)
    return _blank_long(_dots(c))


def clean_text_list(col, unescape: bool = True) -> Column:
    """B1 for a list: clean each element (stripped after tag removal), join by space, dot rule."""
    arr = html_unescape_list(_c(col)) if unescape else _c(col)
    parts = F.transform(arr, lambda e: X.strip_ws(_clean_core(e, False)))
    return _blank_long(_dots(F.array_join(parts, " ")))


def item_text(df: DataFrame, fields, list_fields=(), key: str = "item_id", unescape: bool = True) -> DataFrame:
    """B2: clean the chosen fields in order, skip blank ones, join by space, else ``unknown item``."""
    parts = []
    for f in fields:
        c = clean_text_list(f, unescape) if f in list_fields else clean_text(f, unescape)
        parts.append(F.when(F.col(f).isNotNull(), X.strip_ws(c)))
    arr = F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))
    return df.select(key, F.when(F.size(arr) == 0, F.lit("unknown item")).otherwise(F.array_join(arr, " ")).alias("text"))


def word_drop(text_col, key_col, p: float, seed: int = 0) -> Column:
    """Drop each space-separated word with probability ``p`` (seeded hash of key, position)."""
    words = F.split(_c(text_col), " ")
    keep = F.filter(words, lambda w, i: X.unit_interval(X.portable_hash(key_col, i, seed=seed)) > F.lit(p))
    return F.array_join(keep, " ")


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_list(s: pd.Series) -> pd.Series:
    """List literals as lists of texts; null for what is no list literal (``ast.literal_eval``, never ``eval``)."""

    def parse(v):
        if v is None:
            return None
        try:
            x = ast.literal_eval(v)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        return [None if e is None else str(e) for e in x] if isinstance(x, (list, tuple)) else None

    return s.map(parse)


def description_first(col) -> Column:
    """Element 0 of a text that looks like a list of quoted texts (``['...']``); any other text,
    an empty list or a literal that does not parse stays as it is."""
    c = _c(col)
    looks = c.startswith("['") & c.endswith("']")
    parsed = literal_list(F.when(looks, c))
    return F.when(F.size(parsed) > 0, F.try_element_at(parsed, F.lit(1))).otherwise(c)


def description_longest(desc, title) -> Column:
    """Empty -> title; list -> longest non-blank (first on ties); all blank -> title;
    unparsable list text -> the text (or title when blank)."""
    d, t = _c(desc), _c(title)
    looks = d.startswith("[") & d.endswith("]")
    parsed = literal_list(F.when(looks, d))
    nonblank = F.filter(parsed, lambda x: x.isNotNull() & (X.strip_ws(x) != ""))
    ranked = F.array_sort(F.transform(nonblank, lambda x, i: F.struct((-F.length(x)).alias("l"), i.alias("i"), x.alias("v"))))
    longest = F.try_element_at(ranked, F.lit(1))["v"]
    plain = F.when(X.strip_ws(d) != "", d).otherwise(t)
    return (F.when(d.isNull() | (d == ""), t)
            .when(looks & parsed.isNull(), plain)
            .when(looks, F.coalesce(longest, t))
            .otherwise(plain))


def render_titles(col, sep: str = ", ") -> Column:
    """Quoted title list ``"a", "b"`` (``sep`` may be ``",\\t"``)."""
    return F.array_join(F.transform(_c(col), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), sep)


def render_sids(col) -> Column:
    """SID list ``a, b``."""
    return F.array_join(_c(col), ", ")


def history_key(col) -> Column:
    """``::``-joined history key."""
    return F.array_join(_c(col), "::")


def norm_pred(col) -> Column:
    """Prediction ``strip('"\\n')`` then whitespace strip."""
    return X.strip_ws(X.strip_chars(col, '"\n'))


def norm_target(col) -> Column:
    """Target ``strip(' \\n"')`` (the metrics-table rule, T4)."""
    return X.strip_chars(col, ' \n"')


def completion_text(col) -> Column:
    """Text after the last ``Response:\\n``, stripped."""
    return X.strip_ws(F.substring_index(_c(col), "Response:\n", -1))


def strip_think(col) -> Column:
    """Remove ``<think>..</think>`` spans."""
    return F.regexp_replace(_c(col), r"(?s)<think>.*?</think>", "")


def fill_template(template: str, **cols) -> Column:
    """Fill ``{name}`` slots of a fixed prompt with columns (``format_string``)."""
    fmt = template.replace("%", "%%")
    order = []
    for name in cols:
        fmt = fmt.replace("{" + name + "}", "%s")
    # slots in order of appearance
    import re

    for m in re.finditer(r"\{(\w+)\}", template):
        order.append(m.group(1))
    return F.format_string(fmt, *[_c(cols[n]) for n in order])


def lookup_map(mapping: dict) -> Column:
    """Literal map column for a fixed lookup table."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def dataset_full_name(col, amazon14: bool = False) -> Column:
    """Dataset short name -> full category name (fixed table; unknown names stay NULL)."""
    table = AMAZON14_FULL_NAMES if amazon14 else AMAZON18_FULL_NAMES
    return F.element_at(lookup_map(table), _c(col))


def category_label(col) -> Column:
    """Category name -> the phrase used inside prompts (fixed table)."""
    return F.element_at(lookup_map(CATEGORY_LABELS), _c(col))
