"""Exact top-k, conversation trie and collocations against brute force, on awkward rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recsmith.llm import collocations as C
from recsmith.llm import prefix_trie as P
from recsmith.llm.maxscore import TopK, top_inner_products
from recsmith.llm.queries import op11_maxscore_top_k, op12_conversation_trie, op13_phrase_collocations

DIR = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- exact top-k
def plain_top(rows, k, scale=64):
    """rows: (id, vector); a dict of query id -> [(score, id)]."""

    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    whole = [(i, [math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale for x in v]) for i, v in rows if i is not None and fine(v)]
    out = {}
    for q, a in whole:
        if q % 20 == 0:
            best = out.setdefault(q, {})
            for i, b in whole:
                if i != q:
                    s = max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
                    best[i] = max(best.get(i, s), s)
    return {q: sorted(((s, i) for i, s in found.items()), key=lambda t: (-t[0], t[1]))[:k] for q, found in out.items() if found}


def as_dict(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


SCHEMA = "vec_id bigint, embedding array<double>, label int, id bigint, score string, v string, asks string, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, "s", "v", "a", 9) for i, v in rows], SCHEMA).repartition(3)


def test_top_k_on_awkward_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, rng.gauss(0, 1), -0.25, 0.5]) for _ in range(6)]) for i in range(120)]
    rows += [(200, [0.0] * 6), (220, []), (240, None), (260, [None, 1.0]), (280, [float("nan")] * 6), (300, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(20, rows[20][1]), (20, rows[21][1]), (7, rows[7][1]), (7, [9.0] * 6), (320, [1.0, 2.0]), (340, [1e-300] * 6), (360, [0.5] * 9)]
    got = top_inner_products(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=20)
    assert as_dict(got) == plain_top(rows, 20)
    small = top_inner_products(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=3, query_block=2)  # many blocks
    assert as_dict(small) == plain_top(rows, 3)


def test_top_k_scores_beyond_64_bits(spark):
    rows = [(0, [1e200, 1.0]), (20, [-3e38, 2.0]), (1, [1e300, 1.0]), (2, [3e9, 1.0]), (3, [-1e300, 4.0]), (4, [0.0, 1.0])]
    assert as_dict(top_inner_products(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=4)) == plain_top(rows, 4)


def test_top_k_few_candidates_and_empty_tables(spark):
    assert as_dict(top_inner_products(vectors(spark, [(0, [1.0]), (1, [-1.0])]), F.col("vec_id") % 20 == 0)) == {0: [(-4096, 1)]}
    assert top_inner_products(vectors(spark, [(0, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0
    assert top_inner_products(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_query_on_its_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    got = op11_maxscore_top_k(spark, DIR)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert as_dict(got) == plain_top(rows, 20)


def test_best_rows_keep_ties_and_repeats_in_order():
    best = TopK(3)
    for _ in range(40):
        best.add(np.array([9, 4, 4, 7]), np.array([5, 5, 8, 5]))
    assert best.ids.tolist() == [4, 7, 9] and best.scores.tolist() == [8, 5, 5] and best.least == 5


# ---------------------------------------------------------------- conversation trie
def plain_trie(rows):
    """rows: (conv, turn, role, text); ties in turn must not differ in content order here."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = turns.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def own(p):
        return (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0

    out, below = [], {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(below[k][0] for k in kids[p]) or (0 if kids[p] else 1)
        saved = own(p) + sum(below[k][1] for k in kids[p])
        below[p] = (leaves, saved)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def trie_rows(df):
    return sorted([tuple(r) for r in df.collect()], key=lambda r: (r[0], r[1]))


CONV = "conv_id bigint, turn bigint, role string, text string, conv bigint, depth string, x1 string, n int, pos int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", "x", 2, 3) for r in rows], CONV).repartition(4)


def talk(rng, convs):
    rows = []
    for c in convs:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["hello there", "yes", "", "no  \t no", None, "a b c d"])))
    return rows


@pytest.mark.parametrize("shard_rows,chunk", [(1, 1), (3, 2), (32_768, 1_024)])
def test_trie_against_a_plain_one(spark, shard_rows, chunk):
    rng = random.Random(shard_rows)
    rows = talk(rng, [*range(0, 130), -1, -20, -25, 10**12, 2**62])
    rows += [(500 + i, t, "user", f"t{t}") for i in range(70) for t in range(6)]  # copies of one conversation
    rows += [(700, t, "user", f"long {t % 7}") for t in range(400)] + [(701, t, "user", f"long {t % 7}") for t in range(300)]
    rows += [(800, None, None, None), (800, 3, None, "x"), (None, 1, "user", "lost"), (801, 2, "u", "same"), (801, 2, "u", "same")]
    got = P.conversation_trie(conversations(spark, rows), shard_rows=shard_rows, chunk=chunk)
    assert trie_rows(got) == plain_trie(rows)


def test_trie_of_few_and_no_conversations(spark):
    assert P.conversation_trie(spark.createDataFrame([], CONV)).count() == 0
    assert P.conversation_trie(conversations(spark, [(None, 1, "u", "x")])).count() == 0
    for rows in ([(3, 0, "u", "only")], [(0, 0, None, None)], [(21, 0, "u", "a"), (22, 0, "u", "a"), (20, 0, "b", "x y")]):
        assert trie_rows(P.conversation_trie(conversations(spark, rows))) == plain_trie(rows)


def test_trie_query_on_its_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(op12_conversation_trie(spark, DIR)) == plain_trie(rows)


def test_list_hashes_of_a_hot_node_join_pieces_in_order(spark):
    ends = spark.range(0, 5000).select(F.lit(1).alias("depth"), F.lit(2).cast("bigint").alias("x1"), F.lit(3).cast("bigint").alias("x2"), F.col("id").alias("conv"))
    got = P.list_hashes(ends.unionByName(ends.limit(3).withColumn("depth", F.lit(0))).repartition(5), piece=64).collect()
    want = {1: ",".join(map(str, range(5000))), 0: "0,1,2"}
    assert {r["depth"]: r["ends_sha256"] for r in got} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}


@pytest.mark.parametrize("block", [1, 2, 64])
def test_parentheses_find_their_closes(block):
    for seed in range(60):
        rng = random.Random(seed)
        bits, depth, left = [], 0, rng.choice([1, 4, 60, 500])
        push = rng.choice([0.3, 0.6, 0.95])
        while left or depth:
            if left and (not depth or rng.random() < push):
                bits, depth, left = [*bits, 1], depth + 1, left - 1
            else:
                bits, depth = [*bits, 0], depth - 1
        bits, stack, want = [1, *bits, 0], [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        at = np.nonzero(bits)[0]
        assert P.Parens(np.array(bits, np.uint8), block).findclose(at).tolist() == [want[i] for i in at.tolist()]


# ---------------------------------------------------------------- collocations
def plain_collocations(rows, threshold, longest=5, top=2000, cover=100):
    """rows: (lang, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        gone = {p[i : i + k] for p, a in cands.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= cover * counts[p[i : i + k]]}
        best = []
        for p, a in cands.items():
            if p not in gone:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


DOCS = "doc_id bigint, text string, lang string, _id string, hits int, words int, shard string"


def documents(spark, rows):
    return spark.createDataFrame([(i if i % 5 else None, t, lang, "x", 1, 2, "s") for i, (lang, t) in enumerate(rows)], DOCS).repartition(3)


def phrase_rows():
    rng = random.Random(9)
    base = ["New  York", "of the", "straße und\tweg", "ünder A", "a a a a a a", "x y z", "one two three four five six"]
    rows = []
    for i in range(220):
        parts = [rng.choice(base) + rng.choice([" ", ". ", ",", "\n", "; ", " and "]) for _ in range(rng.randrange(1, 25))]
        rows.append((rng.choice(["en", "de", None, ""]), "".join(parts)))
    rows += [("en", None), ("en", ""), ("xx", "   \t "), ("xx", "..!?"), ("de", "w" * 5000), ("en", "very long " * 3000), ("en", "new york, new york"), ("en", "new york, new york")]
    return rows


@pytest.mark.parametrize("threshold,shards", [(6, 4), (40, 1), (100, 3)])
def test_collocations_against_plain_counts(spark, threshold, shards):
    rows = phrase_rows()
    got = C.collocations(documents(spark, rows), threshold=threshold, shards=shards)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, threshold)
    few = C.collocations(documents(spark, rows), threshold=threshold, shards=shards, longest=3, top=2, cover_percent=60)
    assert sorted(tuple(r) for r in few.collect()) == plain_collocations(rows, threshold, longest=3, top=2, cover=60)


def test_collocations_with_a_full_filter_are_the_same(spark, monkeypatch):
    """A filter too small for its phrases lets more through; the last scan's counts still decide."""
    monkeypatch.setattr(C, "MIN_BITS", C.BLOCK_BYTES * 8)
    monkeypatch.setattr(C, "MAX_BITS", C.BLOCK_BYTES * 8)
    monkeypatch.setattr(C.PhraseFilter, "look", lambda self, hashes: (np.ones(len(hashes), bool), np.zeros(len(hashes), np.int8)))
    rows = phrase_rows()[:120]
    assert sorted(tuple(r) for r in C.collocations(documents(spark, rows), threshold=8).collect()) == plain_collocations(rows, 8)


def test_phrases_that_share_a_hash_are_told_apart(monkeypatch):
    """With hashes of 4 bits the steps count colliding phrases together; the last scan counts words."""
    monkeypatch.setattr(C, "_mix", lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60))
    letters = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    part = C.Slice(pa.array(["en"]), pa.array([letters.encode()], pa.binary()))
    steps = [(words, hashes, hits) for hashes, words, hits, _ in C.count_active(part, ALL, 1, True, 2)]
    assert [(words, int(hits.sum())) for words, _, hits in steps] == [(1, 26), (2, 25)]
    assert all(len(hashes) <= 16 for _, hashes, _ in steps)
    counted = {p: int(h) for _, phrases, words, hits in C.count_known(part, ALL, 2) if words == 2 for p, h in zip(phrases.to_pylist(), hits)}
    assert counted == {letters[i : i + 3]: 1 for i in range(0, 50, 2)}


def test_a_hash_of_several_phrases_is_marked():
    part = C.Slice(pa.array(["en", "de"]), pa.array([b"a b. a b", b"a a. a"], pa.binary()), keys=np.array([7, 9], np.int32))
    at = np.arange(len(part.word))
    hashes, _, hits, marks = C._counted(part, at, 1, np.zeros(len(at), np.uint64), np.zeros(len(at), np.int32))
    assert (hashes.tolist(), hits.tolist(), marks.check.tolist()) == ([0], [7], [-1])
    _, _, hits, marks = C._counted(part, at, 1, part.word_hash[part.key], np.zeros(len(at), np.int32))
    assert sorted(zip(hits.tolist(), marks.key.tolist())) == [(2, 7), (2, 7), (3, 9)]
    assert min(marks.check) >= 0 and len(set(marks.check.tolist())) == 3


@pytest.mark.parametrize("alone", [lambda: F.lit(False), lambda: F.col("h") % 2 == 0])
def test_phrases_whose_hash_is_shared_are_counted_by_their_words(spark, monkeypatch, alone):
    monkeypatch.setattr(C, "one_phrase", alone)
    rows = phrase_rows()
    assert sorted(tuple(r) for r in C.collocations(documents(spark, rows), threshold=20).collect()) == plain_collocations(rows, 20)


def test_each_phrase_is_named_once_however_many_tasks_hold_it(spark, monkeypatch):
    """The last scan made a row for each phrase in each task that met it."""
    seen, scan = [], C.scan_names

    def counted(texts, longest):
        names = scan(texts, longest)
        seen.append(names.count())
        return names

    monkeypatch.setattr(C, "scan_names", counted)
    rows = [("en", "one two three four five six. new york")] * 300
    docs = documents(spark, rows).repartition(24).select("doc_id", "lang", "text", F.lit("x").alias("_id"))
    done = C.frequent_phrases(docs, 100, 5)
    assert seen == [done.count()] == [1 + 8 + 6 + 4 + 3 + 2]


def test_rows_held_by_a_task_are_added_up_without_loss():
    pick = random.Random(5)
    rows = [(pick.choice(["en", "de"]), pick.choice([None, "a b", "b c", "c", "d e f"]), 2, pick.randrange(9)) for _ in range(500)]
    tables = [pa.table({c: [r[i] for r in rows[at : at + 7]] for i, c in enumerate(["lang", "phrase", "words", "hits"])}) for at in range(0, 500, 7)]
    total = Counter()
    for row in rows:
        total[row[:3]] += row[3]
    for limit in (1, 16, 64, 10_000):
        got, seen = Counter(), 0
        for batch in C._added_up(iter(tables), limit):
            seen += batch.num_rows
            for row in batch.to_pylist():
                got[row["lang"], row["phrase"], row["words"]] += row["hits"]
        assert +got == +total
    assert seen == len(total)  # one row a phrase where all are held


def test_collocations_of_empty_tables(spark):
    assert C.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert C.collocations(documents(spark, [("en", "a b")])).count() == 0


def test_long_texts_are_cut_between_words_without_loss():
    text = " ".join(random.Random(3).choice(["ab", "c", "dé", "x. y", "fgh,"]) for _ in range(4000))


    def count(part, own, into):
        for _, phrases, _, hits in C.count_known(C.Slice(pa.array(["en"]), pa.array([part], pa.binary()), own), ALL, 5):
            for p, c in zip(phrases.to_pylist(), hits.tolist()):
                into[p] += c

    whole, cut = Counter(), Counter()
    count(text.encode(), None, whole)
    for part, own in C._segments(text.encode(), 5, limit=97):
        count(part, np.array([own]), cut)
    assert cut == whole


class _All:
    recent = (None, None)

    def look(self, hashes):
        return np.ones(len(hashes), bool), np.zeros(len(hashes), np.int8)


ALL = _All()


def test_collocation_query_on_its_table(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    got = op13_phrase_collocations(spark, DIR)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 100)
