"""Operator 2 against brute force, components against union-find."""

import random
import re
from collections import defaultdict

import pytest
import xxhash

from recsmith.llm import simhash as S
from recsmith.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_classes(prints):
    named = [(i, f) for i, f in prints if i is not None]
    pairs = [(a, b) for k, (a, x) in enumerate(named) for b, y in named[k + 1 :] if (x ^ y).bit_count() <= 2]
    return classes({i for i, _ in named}, pairs)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(300)]
    want = classes({n for p in links for n in p if p[0] != p[1]}, links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: r for n, r in want.items() if n in got} and set(got) == {n for a, b in links if a != b for n in (a, b)}
    assert components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0


def test_ball_links_find_every_near_pair(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)} | {0, 1, 3, (1 << 64) - 1, (1 << 63)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = sorted(map(signed, prints))
    links = [(r.a, r.b) for r in S.ball_links(spark.createDataFrame([(n,) for n in nodes], "fp bigint")).collect()]
    near = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert set(links) <= set(near)
    assert classes(nodes, links) == classes(nodes, near)
    with pytest.raises(ValueError):
        S.ball_links(spark.createDataFrame([(1,)], "fp bigint"), 3)


def test_simhash_components_on_awkward_rows(odd, none, all_texts):
    rows = S.simhash_components(odd).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in all_texts]
    want = plain_classes(prints)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=str) == sorted(((i, f"{f:016x}", want.get(i)) for i, f in prints), key=str)
    assert S.simhash_components(none).count() == 0


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "BLOCK", 7)
    assert S.fingerprint(text) == whole == plain_fingerprint(text)


def test_near_dedup_keeps_one_of_each(odd, none, all_texts):
    want = plain_classes([(i, plain_fingerprint(t)) for i, t in all_texts])
    kept = S.near_dedup(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({i for i, root in want.items() if i == root})
    assert sum(r.doc_id is None for r in kept) == 2
    assert S.near_dedup(odd).columns == odd.columns
    assert S.near_dedup(none).count() == 0


def test_query_against_brute_force(spark):
    from recsmith.llm.queries import op2_simhash_near_dedup

    d = "/root/testdata/sf0.001"
    prints = [(r.doc_id, plain_fingerprint(r.text or "")) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = plain_classes(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash_near_dedup(spark, d).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in prints}
    groups = defaultdict(list)
    for i, root in want.items():
        groups[root].append(i)
    assert any(len(g) > 1 for g in groups.values())
