"""Operators 3, 5 and 6 against the libraries themselves, and exact round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recsmith.llm import bpe_codec, packing, segments, tokens

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "é", " ", "  ", "\n", "\t", "'s", "1", "22", "!", "%", "\x85", "\xa0", "\u2003", "\x1c", "\r\n", "word", "<|endoftext|>", "中", "'ll", " '", "\u200b", "\x0b", "😀", "ß", "e\u0301", "_", "Word.\nNext"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranked():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_codec.read_ranks(RANKS), special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=6))
def test_cutting_never_changes_ids(texts):
    library = tokens._tokenizer(JSON)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.text_ids(pa.array(texts, pa.string()), JSON)] == want
    assert tokens.text_lengths(texts, JSON) == list(map(len, want))
    codec = bpe_codec.codec(RANKS, P.PATTERN)
    ranked = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ranked.encode_ordinary(t) for t in texts]
    assert [codec.decode(x) for x in got] == [t.encode() for t in texts]


def test_full_caches_start_anew():
    texts = ["some words here, and there"] * 3 + [f"word{i} other{i}" for i in range(50)]
    cache = tokens.PieceCache(tokens.WordEncoder(JSON), 7)
    got = [a + b"".join(b) for t in texts for a, b in cache.lookup([t])]
    assert got == tokens.text_ids(pa.array(texts, pa.string()), JSON)
    table = segments.WordTable(tokens.WordEncoder(JSON), 7)
    for t in texts:
        data, at = table.lookup(pa.array([t, "", t], pa.string()).slice(1))
        assert (bytes(data), at.tolist()) == (got[texts.index(t)], [0, 0, len(data)])


def test_token_counts(odd, none, all_texts, library):
    got = Counter(map(tuple, tokens.token_counts(odd, JSON, limit=50).collect()))
    want = Counter((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 50) for i, t in all_texts)
    assert got == want
    assert tokens.token_counts(none, JSON).collect() == []


def test_round_trip(odd, none, all_texts, ranked):
    got = Counter(map(tuple, bpe_codec.bpe_round_trip(odd, RANKS, P.PATTERN).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(ids := ranked.encode_ordinary(t)), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())) for i, t in all_texts)
    assert got == want
    assert bpe_codec.bpe_round_trip(none, RANKS, P.PATTERN).count() == 0
    back = bpe_codec.bpe_decode(bpe_codec.bpe_encode(odd, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert Counter(map(tuple, back.collect())) == Counter(all_texts)


def test_words_met_again_stay_encoded(monkeypatch):
    """Words of every slice are not encoded anew when rare ones fill the cache."""
    monkeypatch.setattr(bpe_codec, "CACHE_ENTRIES", 60)
    codec = bpe_codec.Codec(RANKS, P.PATTERN)
    asked, model = Counter(), codec.model

    class Counted:
        def encode(self, words, **options):
            asked.update(words)
            return model.encode(words, **options)

    codec.model = Counted()
    for i in range(20):
        texts = [f"qzxwvq, zqzqxv. rare{chr(97 + i)}qz{chr(97 + j)}x" for j in range(9)]
        data, at = codec.encode_all(pa.array(["", *texts], pa.string()).slice(1))
        back, begins = codec.decode_all(data, at)
        assert [bytes(x) for x in bpe_codec._cut(back, begins)] == [t.encode() for t in texts]
        assert [bytes(x) for x in bpe_codec._cut(data, at)] == codec.encode(texts)
    common = [n for w, n in asked.items() if w.endswith(("qzxwvq", "zqzqxv"))]
    assert len(common) == 2 and max(common) == 1
    assert codec.decode(b"") == b"" and codec.encode([]) == []
    with pytest.raises((KeyError, IndexError)):
        codec.decode(np.array([2**31], "<u4").tobytes())


def test_packing(odd, none, all_texts, library):
    size = 64
    rows = packing.pack_documents(odd, JSON, size=size, open_bins=8).collect()
    ids = [(i, library.encode(t, add_special_tokens=False).ids + [2]) for i, t in all_texts]
    pieces = Counter()
    for doc, x in ids:
        for k, (start, length) in enumerate(packing.cut(len(x), size)):
            pieces[(doc, k, start, length, zlib.crc32(np.array(x[start : start + length], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    assert packing.pack_documents(none, JSON).count() == 0


def test_cut_only_shortens_the_first_piece():
    for n in range(0, 40):
        got = packing.cut(n, 8)
        assert sum(length for _, length in got) == n
        assert all(length == 8 for _, length in got[1:])
        assert [s for s, _ in got] == list(np.cumsum([0] + [length for _, length in got])[:-1])


def test_best_fit_chooses_the_fullest_that_fits_and_closes_the_fullest():
    b = packing.BestFit(10, open_bins=2)
    assert [b.add(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert b.add(3) == (1, 7)  # 3 free is the better fit
    assert b.add(8) == (2, 0) and b.add(9) == (3, 0)  # sequence 2 was the fullest of two open ones: closed
    assert b.add(2) == (0, 6)
    with pytest.raises(ValueError):
        b.add(11)
    rng = random.Random(4)
    lengths = [rng.randint(1, 1024) for _ in range(20_000)]
    many = packing.BestFit(1024, 2048)
    used = {many.add(n)[0] for n in lengths}
    assert len(used) < 1.02 * sum(lengths) / 1024 + 1
