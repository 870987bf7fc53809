"""Operator 3: token counts of whole texts, and the encoder that operator 5 shares."""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe_codec import byte_characters
from .common import map_texts
from .segments import PieceCache, WordTable

#: Entries of a worker's caches of encoded words (about 100 MB each at most); ids take more room than lengths.
CACHE_ENTRIES = 500_000
ID_ENTRIES = 400_000

_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_FIRST = frozenset(" abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: A space at most in front, then letters, marks and single line breaks that stand between others.
_PLAIN = re.compile(f"(?: ?[{_LETTERS}{_MARKS}]+)(?:\n[{_LETTERS}{_MARKS}]+)*")
_PARTS = re.compile(f" ?[{_LETTERS}]+| ?[{_MARKS}]+|\n")


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one Spark core, one thread
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def _added(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


class WordEncoder:
    """The library's ids for words; letters, marks and line breaks in them are encoded apart.

    Letters (here those of Latin alphabets) with a space before them, a run of marks
    without an apostrophe and a lone line break are always pre-tokens of their own, so the
    library's model can encode each by itself, and ``word``, ``word,`` and ``word.`` share
    their work.  Words of anything else go through the whole tokenizer.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.entries = entries
        self.tokenizer = _tokenizer(path)
        self.model = Tokenizer(self.tokenizer.model)  # no pre-tokenizer: one string, one pre-token
        self.table = dict(enumerate(byte_characters())) | {0: 0}
        self.known: dict[str, bytes] = {}

    def _alone(self, parts: list[str], step: int = 1 << 14) -> list[bytes]:
        """Ids of parts that are a pre-token each: a call's list of pre-tokens gives one run of ids with their words' numbers."""
        out: list[bytes] = []
        for at in range(0, len(parts), step):
            # no part holds the zero character
            some = "\0".join(parts[at : at + step]).encode().decode("latin-1").translate(self.table).split("\0")
            got = self.model.encode(some, is_pretokenized=True, add_special_tokens=False)
            data = np.array(got.ids, "<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)))).tolist()
            out += [data[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def __call__(self, words: list[str]) -> list[bytes]:
        split: list[tuple | list | None] = []
        for w in words:
            if w.isascii() and w[1:].isalpha() and w[0] in _FIRST:
                split.append((w,))
            else:
                split.append(_PARTS.findall(w) if _PLAIN.fullmatch(w) else None)
        if len(self.known) > self.entries:
            self.known.clear()
        known = self.known
        missing = list({part for s in split if s is not None for part in s} - known.keys())
        known.update(zip(missing, self._alone(missing), strict=True))
        others = iter(_ids(self.tokenizer, [w for w, s in zip(words, split, strict=True) if s is None]))
        return [next(others) if s is None else known[s[0]] if len(s) == 1 else b"".join([known[x] for x in s]) for s in split]


def _ids(tokenizer, words: list[str]) -> list[bytes]:
    return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@functools.lru_cache(maxsize=2)
def _length_cache(path: str) -> PieceCache:
    encode = _encoder(path)
    return PieceCache(lambda words: (len(x) // 4 for x in encode(words)), CACHE_ENTRIES)


@functools.lru_cache(maxsize=2)
def _id_table(path: str) -> WordTable:
    return WordTable(WordEncoder(path, 0), ID_ENTRIES)  # its pieces are the encoder's parts: kept once


def _whole(texts: list[str], path: str) -> dict[int, str]:
    """Texts that hold the string of an added token: the library cuts there first, so they stay whole."""
    added = _added(path)
    return {i: t for i, t in enumerate(texts) if any(a in t for a in added)}


def text_lengths(texts: list[str], path: str) -> list[int]:
    """Token counts as the library gives them, without added special tokens."""
    whole = _whole(texts, path)
    got = [first + sum(rest) for first, rest in _length_cache(path).lookup([("" if i in whole else t) for i, t in enumerate(texts)])]
    for i, t in whole.items():
        got[i] = len(_tokenizer(path).encode(t, add_special_tokens=False))
    return got


def text_ids(texts: pa.StringArray, path: str) -> list[memoryview]:
    """Token ids (little-endian unsigned 32-bit) as the library gives them; ``texts`` without nulls."""
    data, at = _id_table(path).lookup(texts)
    bounds = at.tolist()
    got = [data[a:b] for a, b in zip(bounds, bounds[1:])]
    # the library cuts at the strings of added tokens first, so texts that hold one go to it whole
    for token in _added(path):
        for i in np.nonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False))[0].tolist():
            got[i] = memoryview(_ids(_tokenizer(path), [texts[i].as_py()])[0])
    return got


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Token count of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    Texts reach the encoder in slices of equal bytes, cut at boundaries the
    pre-tokeniser always has (``segments``); each slice is one batch call over its
    distinct parts and only lengths come back.  There is no shuffle, and a worker holds
    one slice plus a bounded cache.

    Null texts count as empty (0 bytes, 0 tokens); null and repeated ids and rows each
    give a row; an empty table gives no rows; other input columns are ignored.
    ``over_limit`` is ``n_tokens > limit``.
    """

    def count(ids: list, texts: list[str]) -> dict:
        n = text_lengths(texts, tokenizer_path)
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(df, count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", id_col, text_col)
