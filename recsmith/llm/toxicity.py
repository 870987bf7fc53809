"""Operator 9: toxicity by a weighted lexicon, matched with Aho-Corasick on folded text."""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import cut_lineage, id_text, map_texts, sample_order

#: Labelled rows of each class that the lexicon is learnt from at most.
MAX_FIT_ROWS = 6_000
#: Different toxic texts that an entry stands in at least, whatever the number of labels.
LEAST_TEXTS = 3
#: Entries of the lexicon at most.
MAX_TERMS = 2_000
#: Phrases that are no insult although an entry stands in them.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "circus clown", "clown fish", "pond scum", "good loser")

# Letters of other alphabets that look Latin, in folded (lower) case.
LOOKALIKE = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
        "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "ѵ": "v", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
        "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i",
        **{chr(0xFF41 + i): chr(97 + i) for i in range(26)},
        **{chr(0xFF10 + i): str(i) for i in range(10)},
        **{c: None for c in "­​‌‍⁠﻿"},
    }
)
_FOREIGN = re.compile(f"[{''.join(map(chr, LOOKALIKE))}]")
DIGITS = (("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("8", "b"), ("9", "g"), ("@", "a"))
_MONEY = re.compile(r"(?<=[^\W\d_])\$(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, look-alike letters as Latin ones, digits and signs as the letters they stand for."""
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = text.translate(LOOKALIKE)
    for sign, letter in DIGITS:
        if sign in text:
            text = text.replace(sign, letter)
    return _MONEY.sub("s", text) if "$" in text else text


class Lexicon(NamedTuple):
    """``terms``: (letters, whole word or word start, weight); ``line``: bias and slopes of the score."""

    terms: tuple[tuple[str, bool, float], ...]
    exceptions: tuple[str, ...]
    line: tuple[float, float, float]


@functools.lru_cache(maxsize=4)
def _automaton(lexicon: Lexicon):
    import ahocorasick

    found = ahocorasick.Automaton()
    entries: dict[str, list] = defaultdict(list)
    for letters, whole, weight in lexicon.terms:
        entries[letters].append((whole, weight))
    for phrase in lexicon.exceptions:
        entries[fold(phrase)].append((True, None))
    for letters, kinds in entries.items():
        found.add_word(letters, (len(letters), kinds))
    if entries:
        found.make_automaton()
    return found if entries else None


def hits(text: str, lexicon: Lexicon) -> tuple[float, float]:
    """Sum of the weights found, and that sum for each thousand characters."""
    found = _automaton(lexicon)
    if found is None or not text:
        return 0.0, 0.0
    folded = fold(text)
    spans, safe, last = [], [], len(folded)
    for end, (size, kinds) in found.iter(folded):
        start, end = end - size + 1, end + 1
        if start and folded[start - 1].isalpha():
            continue
        closed = end == last or not folded[end].isalpha()
        for whole, weight in kinds:
            if closed or not whole:
                (safe if weight is None else spans).append((start, end, weight))
    kept = [w for s, e, w in spans if not any(a <= s and e <= b for a, b, _ in safe)] if safe else [w for *_, w in spans]
    total = float(sum(kept))
    return total, 1000 * total / (len(folded) + 200)


def _score(found: list[tuple[float, float]], line: tuple[float, float, float]) -> np.ndarray:
    x = np.array(found, float).reshape(-1, 2)
    z = line[0] + line[1] * np.log1p(x[:, 0]) + line[2] * np.log1p(x[:, 1])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _terms(word: str, shortest: int = 4, longest: int = 9) -> list[str]:
    """The whole word (closed by a space) and its beginnings."""
    return [word + " ", *(word[:n] for n in range(shortest, min(len(word), longest) + 1))]


def held_out(id_col: str) -> Column:
    """Rows whose labels are not learnt from: CRC-32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _choose(seen: dict[str, dict[int, int]], weight: dict[str, float], least: int, demand: int, most: int) -> list[str]:
    """Greedy cover: entries that explain texts in which fewer than ``demand`` places are explained yet.

    ``seen`` has for each entry the texts and the number of places in them.
    """
    holders: dict[int, list[str]] = defaultdict(list)
    for t, docs in seen.items():
        for d in docs:
            holders[d].append(t)
    need = dict.fromkeys(holders, demand)
    gain = {t: len(docs) for t, docs in seen.items()}  # texts of the entry that still need places
    chosen: list[str] = []
    left = dict(seen)
    while left and len(chosen) < most:
        best = max(left, key=lambda t: (gain[t] * weight[t], t))
        if gain[best] < least:
            break
        family = [t for t in left if _kin(t, best) and gain[t] >= 0.9 * gain[best]]
        best = max(family, key=lambda t: (t.endswith(" "), len(t), t))
        chosen.append(best)
        for d, places in left[best].items():
            if 0 < need[d] <= places:
                for t in holders[d]:
                    gain[t] -= 1
            need[d] -= places
        left = {t: docs for t, docs in left.items() if not _kin(t, best)}
    return chosen


def _kin(a: str, b: str) -> bool:
    return a.strip().startswith(b.strip()) or b.strip().startswith(a.strip())


def fit_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    max_rows: int = MAX_FIT_ROWS,
    max_terms: int = MAX_TERMS,
    exceptions: tuple[str, ...] = EXCEPTIONS,
    id_col: str = "doc_id",
    text_col: str = "text",
    demand: int = 6,
    least: int = LEAST_TEXTS,
) -> Lexicon:
    """Learn the lexicon and the score from labelled rows that are not held out.

    Of each class at most ``max_rows`` rows are taken in a fixed pseudo-random order; the
    score weighs them by the class's size among all labels with a document, so its bias
    does not depend on ``max_rows``.
    Spark counts the places of words and word starts in texts of each class; those with
    log odds above 3 for toxic texts (half a place added to each count) compete in a greedy
    cover.  An entry needs ``least`` different texts, a fixed number whatever the table's
    size; texts of the same folded words count once, so copies add nothing.  Without
    labels of both classes the lexicon is empty and every score is low.
    """
    empty = Lexicon((), tuple(exceptions), (-3.0, 0.0, 0.0))
    named = labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("_y")).where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    named = named.where(~held_out("_label_id"))
    order = [*sample_order("_label_id"), "_y"]
    sample = named.where("_y = 1").orderBy(*order).limit(max_rows).union(named.where("_y = 0").orderBy(*order).limit(max_rows))
    # at most 2 * max_rows ids: the bound makes the broadcast safe
    texts = cut_lineage(id_text(docs, id_col, text_col).join(F.broadcast(sample), F.col("_id") == F.col("_label_id")).select("_y", "_text"))
    sizes = {r["_y"]: r["count"] for r in texts.groupBy("_y").count().collect()}
    if len(sizes) < 2:
        return empty
    joined = docs.select(F.col(id_col).cast("bigint").alias("_id")).join(named, F.col("_id") == F.col("_label_id"))
    share = {r["_y"]: r["count"] / sizes[r["_y"]] for r in joined.groupBy("_y").count().collect()}

    def count(ys: list, bodies: list[str]) -> dict:
        found: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])  # places in clean and toxic texts, toxic texts
        for y, body in zip(ys, bodies, strict=True):
            places = Counter(t for w in _WORD.findall(fold(body)) for t in _terms(w))
            for term, n in places.items():
                found[term][y] += n
                found[term][2] += y
            found[""][y] += sum(n for t, n in places.items() if t[-1] == " ")
        return {"term": list(found), **{k: [v[i] for v in found.values()] for i, k in enumerate(("clean", "toxic", "texts"))}}

    counted = map_texts(texts, count, "term string, clean bigint, toxic bigint, texts bigint", "_y", "_text")
    counted = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "texts")]).where((F.col("texts") >= least) | (F.col("term") == ""))
    counted = cut_lineage(counted)
    words = counted.where("term = ''").first()
    odds = F.log((F.col("toxic") + 0.5) / (words["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (words["clean"] + 1))
    strong = counted.where("term != ''").withColumn("odds", odds).where(F.col("odds") > 3)
    weight = {r["term"]: r["odds"] for r in strong.orderBy(F.desc("texts"), "term").limit(10 * max_terms).collect()}
    if not weight:
        return empty

    def places(ys: list, bodies: list[str]) -> dict:
        out: dict[str, list] = {"term": [], "doc": [], "count": []}
        for body in bodies:
            words = _WORD.findall(fold(body))
            doc = hash_of(" ".join(words))
            for t, n in Counter(t for w in words for t in _terms(w) if t in weight).items():
                out["term"].append(t)
                out["doc"].append(doc)
                out["count"].append(n)
        return out

    found = map_texts(texts.where("_y = 1"), places, "term string, doc bigint, count bigint", "_y", "_text")
    seen: dict[str, dict[int, int]] = defaultdict(dict)
    for r in found.distinct().collect():  # at most max_rows texts with entries of a bounded list
        seen[r["term"]][r["doc"]] = r["count"]
    chosen = _choose(seen, weight, least, demand, max_terms)
    terms = tuple((t.strip(), t.endswith(" "), round(float(weight[t]), 6)) for t in sorted(chosen))
    draft = Lexicon(terms, tuple(exceptions), (0.0, 0.0, 0.0))

    def measure(ys: list, bodies: list[str]) -> dict:
        got = [hits(b, draft) for b in bodies]
        return {"y": ys, "sum": [g[0] for g in got], "rate": [g[1] for g in got]}

    rows = map_texts(texts, measure, "y bigint, sum double, rate double", "_y", "_text").toPandas()
    return draft._replace(line=_fit_line(rows[["sum", "rate"]].to_numpy(), rows["y"].to_numpy(), rows["y"].map(share).to_numpy()))


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text, 7) >> 1


def _fit_line(x: np.ndarray, y: np.ndarray, rows: np.ndarray, steps: int = 60) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge; each row counts for ``rows`` rows."""
    a = np.column_stack([np.ones(len(x)), np.log1p(x)])
    weight = rows / rows.sum()
    beta, ridge = np.zeros(3), np.diag([1e-6, 1e-4, 1e-4])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (weight * (p - y)) + ridge @ beta
        beta = beta - np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, grad)
    return tuple(round(float(b), 9) for b in beta)


def toxicity(df: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every whole text.

    One pass without a shuffle; only the text is an input of the score.  Null and empty
    texts get the score of a text without hits; null ids are not held out; null and
    repeated ids and rows each give a row; an empty table gives no rows; other columns
    are ignored.
    """

    def run(ids: list, texts: list[str]) -> dict:
        return {"doc_id": ids, "score": _score([hits(t, lexicon) for t in texts], lexicon.line)}

    scored = map_texts(df, run, "doc_id bigint, score double", id_col, text_col)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity_score(text: Column, lexicon: Lexicon) -> Column:
    """The score as a column, for filters that keep whole rows."""
    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(_score([hits(t, lexicon) for t in texts], lexicon.line))

    return score(F.coalesce(text, F.lit("")))
