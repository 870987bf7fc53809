"""Long texts without white space take time in proportion to their length; decode against enumeration;
packing is repeatable; near-dedup keeps any column and every text."""

import random
import time
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from recsmith.llm import packing as K
from recsmith.llm import pii as P
from recsmith.llm import secrets as S
from recsmith.llm import simhash as H


def took(fn, text):
    at = time.process_time()
    fn(text)
    return time.process_time() - at


def test_secret_places_in_one_pass_over_unspaced_texts():
    rng = random.Random(1)
    json = "{" + ",".join(f'"k{i}":"{rng.getrandbits(64):x}","token":"{rng.getrandbits(128):032x}"' for i in range(14_000)) + "}"
    for text in ("a:" * 500_000, "token=" * 170_000, "token=abcdefgh1234&" * 50_000, json, "x=" + "y1" * 500_000, "secret:" + "v" * 10**6):
        assert took(S._places, text) < 20, text[:20]
    got = S._places("token=abcdefgh1234&password=Zz9_kkkkkkk&x=1 auth: \"q1w2e3r4t5y6\"")
    assert {(s, e) for s, e, k in got if k == "assignment"} == {(6, 18), (28, 43), (51, 63)}


def test_personal_data_stretches_in_one_pass_over_unspaced_texts():
    for text in ("ab:1234567;" * 90_000, "a" * 10**6 + "1234567", "1234567 " * 100_000, "x@" * 200_000):
        assert took(P.stretches, text) < 20, text[:20]
    for text in ("id:1234567;" * 300, "mail a.b@c.de, 28.125.121.88 " * 20, "1234567,x 7654321"):
        rising = P.stretches(text)
        assert all(a[1] < b[0] for a, b in zip(rising, rising[1:])) and all(0 <= s < e <= len(text) for s, e in rising)
        assert all(any(s <= i < e for s, e in rising) for i, c in enumerate(text) if c.isdigit())


def test_decode_is_the_best_of_all_segmentations():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(2, 8))
        segments = sorted({tuple(sorted(rng.choice(n + 1, 2, replace=False).tolist())) for _ in range(int(rng.integers(1, 7)))})
        w = P.Window(0, list(range(n + 1)), segments, rng.normal(size=(len(segments), 3)))
        weights = rng.normal(size=(3, len(P.KINDS)))
        value = P._scores(w, weights)
        every = [c for r in range(len(segments) + 1) for c in combinations(range(len(segments)), r)
                 if all(segments[a][1] <= segments[b][0] or segments[b][1] <= segments[a][0] for a, b in combinations(c, 2))]
        best = max(sum(value[k].max() for k in c) for c in every)
        got = P.decode(w, weights)
        assert all(a[2] <= b[1] for a, b in zip(got, got[1:]))
        assert np.isclose(sum(value[segments.index((s, e)), P.KINDS.index(kind)] for kind, s, e in got), best)


def test_packing_does_not_follow_the_order_of_arrival(spark):
    rng = random.Random(3)
    rows = [(i, 0, 0, rng.randrange(1, 65), i) for i in range(4000)]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    place = lambda r: [tuple(x) for x in sorted(K.pack(spark.createDataFrame(r, schema).coalesce(1), size=64, open_bins=16).collect())]
    mixed = rng.sample(rows, len(rows))
    one = place(rows)
    assert one == place(mixed)
    used = {}
    for *_, length, _, seq, offset in one:
        used.setdefault(seq, []).append((offset, length))
    for held in used.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= 64


def test_near_dedup_keeps_any_column_and_every_text(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text), (2, text), (5, "alpha text nothing like it at all, really not"), (5, text), (5, "alpha text nothing like it at all, really not"), (7, None), (8, ""),
            (9, "a third text that is here only once with its id"), (9, "a third text that is here only once with its id"), (None, text), (3, "and a fourth one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    odd = df.select("*", F.lit("d").alias("_drop"), F.lit(1).alias("_again"), F.lit(2).alias("_row"), F.create_map(F.lit("k"), F.col("text")).alias("m"),
                    F.lit("x").alias("fp"), F.lit("r").alias("root"), F.lit("a.b").alias("with.dot"))
    got = H.near_dedup(odd)
    assert got.columns == odd.columns
    kept = sorted(((r["doc_id"] or 0, r["text"]) for r in got.collect()), key=str)
    assert kept == sorted([(0, text), (1, text), (5, rows[2][1]), (7, None), (9, rows[7][1]), (3, rows[10][1])], key=str)
    unique = H.near_dedup(odd.where("doc_id in (1, 2, 3)"))
    assert sorted(r["doc_id"] for r in unique.collect()) == [1, 3] and unique.columns == odd.columns
