"""Operator 7: quality rules by gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import cut_lineage, id_text, map_texts, sample_order
from .trees import Forest, fit_boosted, probability

#: Labelled rows the classifier is fitted on at most (those with the smallest hash of their id).
MAX_FIT_ROWS = 20_000

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate",
    "mark_rate", "stop_rate", "distinct_rate", "line_words", "pipe_rate", "other_rate",
)
#: More symbols, repeated lines or repeated words never raise a text's quality.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "pipe_rate": -1}

_WHITE = list(b" \t\n\v\f\r")
_SYMBOLS = list(SYMBOLS.encode())
_WORD_BLOCK = 2_000_000


def repeated_words(ids: np.ndarray, window: int = 3) -> int:
    """Words that stand in a window found twice or more, the first finding included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    code = ids[:n].astype(np.int64)
    for i in range(1, window):
        if len(ids) > _WORD_BLOCK:  # keep codes below 2**63
            code = np.unique(code, return_inverse=True)[1]
        code = code * (int(ids.max()) + 1) + ids[i : n + i]
    _, where, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[where] > 1
    covered = np.zeros(len(ids), bool)
    for i in range(window):
        covered[i : n + i] |= again
    return int(covered.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts and the classifier's features of one text."""
    data = text.encode()
    words = data.split()  # on bytes, white space is exactly space and \t to \r
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    chars = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines: set[str] = set()
    full = repeated = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            full += 1
            repeated += line in lines
            lines.add(line)
    white = int(chars[_WHITE].sum())
    base = [len(words), len(text) - white, int(chars[_SYMBOLS].sum()), repeated, repeated_words(ids)]
    n, size = max(1, len(words)), max(1, base[1])
    features = [
        np.log1p(len(words)), base[1] / n, base[2] / n, repeated / max(1, full), base[4] / n,
        chars[65:91].sum() / size, chars[48:58].sum() / size, (chars[33] + chars[63]) / n,
        (chars[46] + chars[44]) / n, len(seen) / n, np.log1p(len(words) / max(1, full)), chars[124] / n,
        (chars[35:48].sum() + chars[58:65].sum() + chars[91:97].sum() + chars[123:127].sum()) / size,
    ]
    return base, [float(f) for f in features]


def base_failed(base: list[int], min_words: int = 50, repeat_percent: int = 50) -> bool:
    return base[0] < min_words or 100 * base[4] > repeat_percent * base[0]


def fit_quality(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", **tree_options
) -> Forest | None:
    """Boosted trees from labelled documents; None if the labels lack one of the classes.

    At most ``max_rows`` labelled ids are taken, in a fixed pseudo-random order; only
    their statistics (13 numbers a row) reach the driver.
    """
    named = labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).alias("_y")).where("_label_id is not null and _y in (0, 1)")
    sample = named.orderBy(*sample_order("_label_id"), "_y").limit(max_rows)
    # at most max_rows ids: the bound makes the broadcast safe
    rows = id_text(docs, id_col, text_col).join(F.broadcast(sample), F.col("_id") == F.col("_label_id"))

    def run(ids: list, texts: list[str]) -> dict:
        return {"y": ids, "x": [statistics(t)[1] for t in texts]}

    got = cut_lineage(map_texts(rows, run, "y bigint, x array<double>", "_y", "_text")).limit(2 * max_rows).toPandas()
    if got["y"].nunique() < 2:
        return None
    order = np.lexsort([*np.stack(got["x"].to_numpy()).T, got["y"].to_numpy()])  # independent of task order
    x, y = np.stack(got["x"].to_numpy())[order], got["y"].to_numpy()[order]
    return fit_boosted(x, y, monotone=[MONOTONE.get(f, 0) for f in FEATURES], **tree_options)


def _verdicts(stats: list, model: Forest | None, threshold: float) -> tuple[list, list]:
    p = probability(model, [s[1] for s in stats]).tolist() if model is not None and stats else [1.0] * len(stats)
    return p, [not base_failed(s[0]) and x >= threshold for s, x in zip(stats, p, strict=True)]


def quality_rules(df: DataFrame, model: Forest | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every whole text.

    Returns ``doc_id``, the base counts, ``base_failed``, ``quality`` (the trees'
    probability of a good text) and ``kept`` (base rules passed and probability at least
    ``threshold``; without a model the base rules alone decide).  One pass, no shuffle.
    Null texts have no words and fail; null and repeated ids and rows each give a row;
    an empty table gives no rows; other columns are ignored.
    """

    def run(ids: list, texts: list[str]) -> dict:
        stats = [statistics(t) for t in texts]
        p, kept = _verdicts(stats, model, threshold)
        out = {name: [s[0][i] for s in stats] for i, name in enumerate(BASE)}
        return {"doc_id": ids, **out, "base_failed": [base_failed(s[0]) for s in stats], "quality": p, "kept": kept}

    schema = "doc_id bigint, " + ", ".join(f"{b} bigint" for b in BASE) + ", base_failed boolean, quality double, kept boolean"
    return map_texts(df, run, schema, id_col, text_col)


def quality_kept(text: Column, model: Forest | None, threshold: float = 0.5) -> Column:
    """The verdict of ``quality_rules`` as a column, for filters that keep whole rows."""
    @F.pandas_udf(BooleanType())
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series(_verdicts([statistics(t) for t in texts], model, threshold)[1], dtype=bool)

    return kept(F.coalesce(text, F.lit("")))
