"""Streaming evaluation over prediction files written from the candidate fixture."""

import json

from pyspark.sql import functions as F

from recsmith.operators import ranking as R
from recsmith.plans import fixtures as FX
from recsmith.streaming import evaluation as SE

from .conftest import SF001


def _write_shards(spark, folder, n_shards=3):
    c = FX.candidates(spark, SF001, n=20)
    g = c.groupBy("user_id", "output").agg(F.array_sort(F.collect_list(F.struct("pos", "pred"))).alias("_l"))
    rows = g.select("user_id", "output", F.transform("_l", lambda s: s["pred"]).alias("predict")).orderBy("user_id").collect()
    for i in range(n_shards):
        with open(f"{folder}/shard_{i}.json", "w") as f:
            for r in rows[i::n_shards]:
                f.write(json.dumps({"run": "r0", "row_id": r["user_id"], "output": r["output"], "predict": list(r["predict"])}) + "\n")
    return rows


def test_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "preds"
    src.mkdir()
    rows = _write_shards(spark, str(src))
    q = SE.start_evaluation(spark, str(src), str(tmp_path / "ckpt"), sink_table="stream_eval_t", ks=(1, 5, 10, 20),
                            trigger_once=True)
    q.awaitTermination(120)
    got = {r["k"]: (r["hr"], r["ndcg"], r["n"]) for r in SE.metrics_from_sums(spark.table("stream_eval_t")).collect()}
    batch = spark.read.json(str(src))
    b = SE.metrics_from_sums(SE.running_rank_sums(batch, (1, 5, 10, 20))).collect()
    assert got == {r["k"]: (r["hr"], r["ndcg"], r["n"]) for r in b}
    assert got[20][2] == len(rows)


def test_stream_metric_log(spark, tmp_path):
    src = tmp_path / "preds"
    src.mkdir()
    _write_shards(spark, str(src), 2)
    log = tmp_path / "log"
    q = SE.start_evaluation(spark, str(src), str(tmp_path / "ckpt"), metric_log_path=str(log), ks=(5, 10), trigger_once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(str(log))
    assert out.filter(F.col("stage") == "stream_eval").count() == 4
