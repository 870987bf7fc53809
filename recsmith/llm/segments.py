"""Cut texts at places where byte-level BPE pre-tokenisation always has a boundary.

The split pattern of these vocabularies lets a token start with one space but never
holds white space after another character, and it leaves the last white-space
character of a run to the word that follows it.  So the place before a space is a
boundary whenever the character before it or the one after it is not white space:
the parts can be encoded alone, in any order, and joined again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

# Python's \s also holds \x1c-\x1f; taking more characters as white space only means fewer cuts.
_RISKY_ASCII = tuple(c + " " for c in " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_RISKY_OTHER = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
_AFTER_WORD = re.compile(r"(?<=\S) ")
#: Letters, digits and marks (no apostrophe) of ASCII: runs of each are pre-tokens of their own.
_RUN = np.zeros(256, np.uint8)
_RUN[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_RUN[[*range(0x30, 0x3A)]] = 2
_RUN[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 3
#: White space by its UTF-8 bytes: single ones, pairs, and beginnings and ends of three.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WHITE_PAIRS = [(0xC2, 0x85), (0xC2, 0xA0)]
_WHITE_TRIPLES = [(0xE1, 0x9A, 0x80, 0x80), (0xE2, 0x80, 0x80, 0x8A), (0xE2, 0x80, 0xA8, 0xA9), (0xE2, 0x80, 0xAF, 0xAF), (0xE2, 0x81, 0x9F, 0x9F), (0xE3, 0x80, 0x80, 0x80)]


def pieces(text: str) -> list[str]:
    """Parts of ``text`` that encode independently; ``" ".join(pieces(text)) == text``.

    Every part but the first stands for itself with one space before it.
    """
    for pair in _RISKY_ASCII:
        if pair in text:
            return _AFTER_WORD.split(text)
    if not text.isascii() and _RISKY_OTHER.search(text):
        return _AFTER_WORD.split(text)
    return text.split(" ")


class PieceCache:
    """Encoded forms of pieces, filled batch by batch and bounded in entries.

    ``encode`` takes a list of strings and returns one value for each.  The cache only
    saves repeated work: when it is full it starts anew, results do not change.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable], entries: int):
        self.encode, self.entries = encode, entries
        self.inner: dict = {}  # " " + key
        self.first: dict = {}

    def _fill(self, known: dict, wanted: Iterable[str], before: str) -> None:
        missing = [w for w in wanted if w not in known]
        if len(known) + len(missing) > self.entries:
            known.clear()
            missing = list(wanted)
        if missing:
            known.update(zip(missing, self.encode([before + w for w in missing]), strict=True))

    def lookup(self, texts: list[str]) -> list[tuple[object, list]]:
        """For each text the value of its first piece and the list of values of the others."""
        parts = [pieces(t) for t in texts]
        heads = [p.pop(0) for p in parts]
        self._fill(self.first, set(heads), "")
        self._fill(self.inner, set().union(*parts), " ")
        first, inner = self.first, self.inner
        return [(first[h], list(map(inner.__getitem__, p))) for h, p in zip(heads, parts, strict=True)]


def _after_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place (1 or later) of UTF-8 bytes is white space."""
    last = data[at - 1]
    white = _WHITE[last]
    wide = np.nonzero(last >= 0x80)[0]  # such a character has at least two bytes
    if len(wide):
        c, b = last[wide], data[at[wide] - 2]
        a = data[np.maximum(at[wide] - 3, 0)]
        found = np.zeros(len(wide), bool)
        for first, second in _WHITE_PAIRS:
            found |= (b == first) & (c == second)
        for first, second, low, high in _WHITE_TRIPLES:
            found |= (a == first) & (b == second) & (c >= low) & (c <= high)
        white[wide] = found
    return white


def _runs(data: np.ndarray) -> np.ndarray:
    """Kind of run of each byte: letter, digit, mark, or 0 for anything else."""
    run = _RUN[data]
    lead = np.nonzero(data == 0xC3)[0]  # U+00C0 to U+00FF are letters but for two signs
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    run[lead] = run[lead + 1] = 1
    return run


def arrow_pieces(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Pieces of all texts that encode independently, and the number of each text's first one (at last their count).

    A piece begins at each space that follows other than white space, where a run of
    letters, digits or marks meets a run of another kind, before a line break after such a run, and
    after it if such a run follows at once.  Byte-level pre-tokenisation has a boundary at each.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, offset=4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    begins = offsets - np.int32(low)
    run = _runs(data)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (run[1:] != run[:-1]) & (run[1:] > 0) & (run[:-1] > 0)
    spaces = np.nonzero(data[1:] == 0x20)[0] + 1
    cut[spaces[~_after_white(data, spaces)]] = True
    bound = np.zeros(len(data) + 1, bool)
    bound[begins] = True
    breaks = np.nonzero(data[1:] == 0x0A)[0] + 1
    breaks = breaks[~bound[breaks] & (run[breaks - 1] > 0)]
    cut[breaks] = True
    breaks = breaks[~bound[breaks + 1]] + 1
    cut[breaks[run[breaks] > 0]] = True
    cut &= ~bound  # a text's begin is no cut, whatever stands before it
    cuts = np.nonzero(cut)[0].astype(np.int32)
    before = np.searchsorted(cuts, begins)
    bounds = np.insert(cuts, before, begins)  # texts' begins and the end among the cuts
    words = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
    return words, np.arange(len(texts) + 1) + before


class WordTable:
    """Encoded words of Arrow pieces: distinct words of a slice are looked up once, the rest is Arrow's ``take``.

    Two generations of at most half of ``entries`` words each: words met again stay when
    the older generation goes, so results never depend on what is held.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], entries: int):
        self.encode, self.half = encode, max(1, entries // 2)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _values(self, words: list[str]) -> list[bytes]:
        got = list(map(self.young.get, words))
        absent = [i for i, x in enumerate(got) if x is None]
        again = [(i, x) for i in absent if (x := self.old.get(words[i])) is not None]
        fresh: dict[str, bytes] = {}
        for i, x in again:
            got[i] = fresh[words[i]] = x
        missing = [i for i in absent if got[i] is None]
        if missing:
            for i, x in zip(missing, self.encode([words[i] for i in missing]), strict=True):
                got[i] = fresh[words[i]] = x
        if len(self.young) + len(fresh) > self.half:
            self.old, self.young = self.young, {}
        if len(fresh) <= self.half:
            self.young.update(fresh)
        return got

    def lookup(self, texts: pa.StringArray) -> tuple[memoryview, np.ndarray]:
        """All texts' values one after the other, and each text's begin in bytes (the end at last)."""
        words, first = arrow_pieces(texts)
        if not len(words):
            return memoryview(b""), np.zeros(1, np.int64)
        coded = words.dictionary_encode()
        values = pa.array(self._values(coded.dictionary.to_pylist()), pa.large_binary())
        taken = values.take(coded.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
        return memoryview(taken.buffers()[2] or b"").cast("B"), ends[first]
