"""Golden facts of a real 3-level SID index (read as data only).

Set ``RECSMITH_GOLDEN_INDEX_DIR`` to a folder holding the published ``*.index.json*`` file;
without it the tests are skipped.
"""

import glob
import os

import pytest
from pyspark.sql import functions as F

from recsmith.operators import sid as D
from recsmith.sources import readers as RD

_DIR = os.environ.get("RECSMITH_GOLDEN_INDEX_DIR", "")
_FOUND = sorted(glob.glob(os.path.join(_DIR, "**", "*.index.json*"), recursive=True)) if _DIR else []
INDEX = _FOUND[0] if _FOUND else ""
pytestmark = pytest.mark.skipif(not INDEX, reason="golden index folder not configured")


@pytest.fixture(scope="module")
def index(spark):
    return RD.read_sid_index(spark, INDEX).cache()


def test_index_shape(index):
    assert index.count() == 3686
    sizes = {r["n"]: r["c"] for r in index.groupBy(F.size("tokens").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    assert sizes == {3: 3419, 4: 267}


def test_triple_collisions(index):
    tri = index.select(F.slice("tokens", 1, 3).alias("codes"))
    rep = D.duplication_report(tri).first()
    assert rep["distinct_paths"] == 3542
    assert rep["n_groups"] == 123
    assert rep["surplus_rows"] + rep["n_groups"] == 267
    assert rep["largest_group"] == 8
    assert abs(D.collision_rate(tri).first()["collision_rate"] - 0.039067) < 1e-6


def test_quality_vocab_and_levels(index):
    q = D.sid_quality(index).first()
    assert q["format_errors"] == 0 and q["distinct_sid3"] == 3542 and q["status"] == "PASS"
    assert D.sid_vocab(index).count() == 521
    usage = {r["level"]: r["unique_codes"] for r in D.level_usage(index.select(F.slice("tokens", 1, 3).alias("codes")), 256).collect()}
    assert usage == {0: 1, 1: 256, 2: 256}
    assert index.select(D.sid_full("tokens").alias("s")).distinct().count() == 3686
