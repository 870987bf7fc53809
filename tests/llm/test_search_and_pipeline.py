"""Operator 8 against brute force; the pipeline's stages against plain Python; the registered queries."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from recsmith.llm import ann
from recsmith.llm.queries import QUERIES

from .test_dedup import plain_classes, plain_fingerprint
from .test_judges import plain_counts

SMALL, D = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute(ids, x, queries, k=5):
    size = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in queries:
        s = (x * x[q]).sum(axis=1) / (size[q] * size)
        s[ids == ids[q]] = -np.inf
        best = [i for i in np.lexsort((ids, -s)) if s[i] > -np.inf][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in best]
    return out


def found(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_with_many_lists(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32)).round(3)
    x[100:700] = x[100]  # a hot vector
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, list string")
    got = found(ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0, list_rows=64))
    want = brute(np.arange(3000), x, range(0, 3000, 50))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    assert got[100] == [(i, pytest.approx(1.0)) for i in range(101, 106)]  # ties to the smaller id


def test_few_vectors_are_compared_at_the_wanted_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 16))[rng.integers(0, 400, 8000)] + rng.normal(size=(8000, 16)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    asks = F.col("vec_id") % 50 == 0
    got, want = found(ann.nearest_neighbours(df, asks, recall=0.93)), brute(np.arange(8000), x, range(0, 8000, 50))
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    posted, asked = ann.searched_pairs(df, asks, 5, 4, 1.25, None, None, 0.93, "vec_id", "embedding")
    pairs = posted.groupBy(*ann._TASK).count().join(asked.groupBy(*ann._TASK).agg(F.count("*").alias("asks")), list(ann._TASK))
    assert pairs.agg(F.sum(F.col("count") * F.col("asks"))).first()[0] < 0.3 * len(want) * 8000


def test_vectors_of_any_size_have_a_direction(spark):
    rows = [(1, [1e-200, 0.0]), (2, [1e200, 1e199]), (3, [0.0, 5e-324]), (4, [1.7e308, 1.7e308])]
    got = found(ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.lit(True)))
    assert [i for i, _ in got[1]] == [2, 4, 3] and [i for i, _ in got[3]] == [4, 2, 1]
    assert dict(got[1])[4] == pytest.approx(0.5**0.5) and dict(got[2])[1] == pytest.approx(10 / 101**0.5)


def test_graph_search_with_full_width_is_exact():
    rng = np.random.default_rng(2)
    index = ann.Index(c := ann._unit(rng.normal(size=(60, 8))), ann.neighbour_graph(c))
    q = ann._unit(rng.normal(size=(40, 8)))
    lists, distance = ann.graph_search(index, q, 60)
    assert (np.sort(lists, axis=1) == np.arange(60)).all()
    assert (lists == np.argsort(-(q @ c.T), axis=1, kind="stable")).all() and (np.diff(distance, axis=1) >= -1e-12).all()


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0, 1.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id bigint, embedding array<double>, score double")
    got = found(ann.nearest_neighbours(df, F.col("vec_id") >= 0))
    assert set(got) == {0, 1, 2, 10}
    assert [i for i, _ in got[0]] == [1, 10, 2] and [i for i, _ in got[10]] == [0, 1, 2]
    assert ann.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0
    assert ann.nearest_neighbours(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_query_recall(spark):
    e = spark.read.parquet(f"{D}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, x = e["vec_id"].to_numpy(), np.stack(e["embedding"].to_numpy()).astype(float)
    want = brute(ids, x, np.nonzero(ids % 50 == 0)[0])
    got = found(QUERIES["op8_nearest_neighbours"](spark, D))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


# ---- pipeline


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, D).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns and len({r.doc_id for r in rows}) == len(rows) and {r.doc_id for r in rows} <= set(before)
        gone = [before[i] for i in set(before) - {r.doc_id for r in rows}]
        if name == "toxicity":
            y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
            assert all(y.get(r.doc_id, 1) for r in gone)
            assert sum(y.get(r.doc_id, 0) for r in gone) > 0.7 * sum(y.values())  # some labelled texts hold no mark at all
        elif name == "quality rules":
            y = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
            assert all(not plain_counts(r.text)[-1] for r in rows)
            assert all(plain_counts(r.text)[-1] or not y.get(r.doc_id, 0) for r in gone)
        elif name == "SimHash near-dedup":
            want = plain_classes([(i, plain_fingerprint(r.text)) for i, r in before.items()])
            assert {r.doc_id for r in rows} == {i for i, root in want.items() if i == root}
        elif name == "secret scans":
            assert len(rows) == len(before) and all(r.n_chars == len(r.text) for r in rows)
            assert not any(re.search(r'AKIA[0-9A-Z]{16}|token = "[0-9a-f]{40}|password=[0-9a-f]{18}', r.text) for r in rows)
            assert all(r.text == before[r.doc_id].text for r in rows if "[SECRET]" not in r.text)
        else:
            assert {r.doc_id for r in rows} == set(before)


def test_stages_on_empty_and_awkward_tables(spark, odd, none, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs, name in ((none.select(columns), "none"), (odd.select(columns), "odd")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SMALL).write.parquet(path := str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(path)
            assert k == 4 or docs.columns == columns
        assert (docs.count() == 0) == (name == "none")


def test_registered():
    names = [q for q in E.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in E.queries()
    assert all(E.queries()[n].__doc__ for n in names)


@pytest.mark.parametrize("name", ["pipeline", "op1_secret_scan", "op4_personal_data", "op7_quality_rules"])
def test_queries_cover_every_document(spark, name):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    rows = E.queries()[name](spark, SMALL)
    assert rows.count() == n if name in ("op4_personal_data", "op7_quality_rules") else rows.count() > 0
