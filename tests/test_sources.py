"""File connectors: write small files derived from the test tables, read them back."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from recsmith.sources import readers as RD

from .conftest import SF001


def test_read_inter_skips_header_and_bad_lines(spark, tmp_path):
    p = tmp_path / "x.train.inter"
    p.write_text("user_id\titem_id_list\titem_id\n7\t1 2 3\t4\nbad line\n8\t\t5\n9\t10\t11\textra\n")
    rows = sorted(RD.read_inter(spark, str(p), "train").collect(), key=lambda r: r["line_no"])
    assert [(r["user_id"], r["history"], r["target"]) for r in rows] == [("7", [1, 2, 3], 4), ("8", [], 5)]
    assert rows[0]["line_no"] == 0


def test_read_items_keeps_key_order_and_defaults(spark, tmp_path):
    part = spark.read.parquet(f"{SF001}/part.parquet").orderBy("p_partkey").limit(20).collect()
    obj = {str(r["p_partkey"]): {"title": r["p_name"], "description": r["p_type"]} for r in reversed(part)}
    p = tmp_path / "items.json"
    p.write_text(json.dumps(obj))
    rows = RD.read_items(spark, str(p)).orderBy("item_ord").collect()
    assert [r["item_id"] for r in rows] == list(obj.keys())
    assert {r["item_type"] for r in rows} == {"O"} and {r["final_value"] for r in rows} == {0.0}


def test_read_sid_index(spark, tmp_path):
    p = tmp_path / "x.index.json"
    p.write_text(json.dumps({"0": ["<a_1>", "<b_2>", "<c_3>"], "1": ["<a_1>", "<b_2>", "<c_3>", "<d_1>"]}))
    rows = RD.read_sid_index(spark, str(p)).orderBy("idx_ord").collect()
    assert rows[1]["tokens"][-1] == "<d_1>"


def test_read_sequences_literal_fallback_and_quarantine(spark, tmp_path):
    p = tmp_path / "seq.csv"
    p.write_text('user_id,history_item_title,item_title,history_item_id,item_id,history_item_sid,item_sid\n'
                 'A1,"[\'a\', \'b\']",c,"[1, 2]",3,"[\'<a_1>\']",<a_2>\n'
                 'A2,"[\'caf\\xe9\', None]",d,"[4]",5,"[]",<a_3>\n'
                 'A3,"[oops",e,"[6]",7,"[]",<a_4>\n')
    rows = {r["user_id"]: r for r in RD.read_sequences(spark, str(p)).collect()}
    assert rows["A1"]["history_item_title"] == ["a", "b"] and rows["A1"]["history_item_id"] == [1, 2]
    assert rows["A2"]["history_item_title"] == ["caf\xe9", None]
    assert rows["A3"]["_bad"] and not rows["A1"]["_bad"]


def test_read_npy(spark, tmp_path):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet").orderBy("vec_id").limit(10).collect()
    m = np.asarray([r["embedding"] for r in emb], dtype=np.float32)
    np.save(tmp_path / "e.npy", m)
    rows = RD.read_npy(spark, str(tmp_path / "e.npy"), rows_per_task=3).orderBy("item_id").collect()
    assert len(rows) == 10 and np.allclose(rows[3]["embedding"], m[3]) and np.allclose(rows[9]["embedding"], m[9])


def test_read_predictions_and_info(spark, tmp_path):
    p = tmp_path / "pred.json"
    p.write_text(json.dumps([{"input": "x", "output": "<a_1>\n", "predict": ["<a_1>", "<a_2>"]},
                             {"input": "y", "output": "<a_2>\n", "predict": ["<a_3>", "<a_2>"]}]))
    rows = RD.read_predictions(spark, str(p), "r0").orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == [0, 1] and rows[1]["predict"] == ["<a_3>", "<a_2>"]
    i = tmp_path / "info.txt"
    i.write_text("<a_1>\tTitle one\t0\n<a_2>\tTitle two\t1\n")
    info = RD.read_info(spark, str(i)).orderBy("info_ord").collect()
    assert info[1]["sid"] == "<a_2>" and info[1]["item_id"] == "1"


def test_user_features_missing_file(spark, tmp_path):
    assert RD.read_user_features(spark, str(tmp_path / "nope.json")).count() == 0


def test_read_preferences_jsonl_fallback(spark, tmp_path):
    p = tmp_path / "pref.jsonl"
    p.write_text('{"user": "u1", "user_preference": "likes", "split": "train", "context": {"history_items": [1, 2], "target_item": 3}}\n'
                 '{"user": "u2", "user_preference": "p", "split": "train", "context": {"history_items": [4], "target_item": 5}}\n')
    rows = RD.read_preferences(spark, str(p)).collect()
    assert sorted(r["user"] for r in rows) == ["u1", "u2"]


def test_read_metrics(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps([{"name": "run_a", "step": 100, "ndcg": {"5": 0.1, "10": 0.2}, "recall": {"5": 0.3, "10": 0.4}}]))
    rows = {(r["metric"], r["k"]): r["value"] for r in RD.read_metrics(spark, str(p)).collect()}
    assert rows[("ndcg", 10)] == 0.2 and rows[("hr", 5)] == 0.3


def test_resolve_split(spark):
    paths = spark.createDataFrame([("d/Office.train.inter",), ("d/Office.valid.inter",), ("d/Office.test.inter",),
                                   ("d/Office_old.test.inter",), ("d/Toys.train.inter",)], "path string")
    r = {x["split"]: x for x in RD.resolve_split(paths, "Office", ".inter").collect()}
    assert r["train"]["problem"] is None and r["test"]["problem"] is not None


def test_sinks_round_trip(spark, tmp_path):
    from recsmith.plans import fixtures as FX

    idx = FX.sid_index(spark, SF001)
    RD.write_sid_index(idx, str(tmp_path / "idx"))
    back = spark.read.json(str(tmp_path / "idx"))
    assert back.count() == idx.count()
    RD.write_codebook(FX.codebook(spark, SF001), str(tmp_path / "cb"))
    assert spark.read.parquet(str(tmp_path / "cb")).count() == FX.CODEBOOK_K * FX.CODEBOOK_LEVELS


def test_read_items_jsonl(spark, tmp_path):
    p = tmp_path / "items.jsonl"
    p.write_text('{"item_id": "5", "title": "a"}\n{"item_id": "3", "title": "b", "item_type": "I", "final_value": 2.5}\n')
    rows = RD.read_items_jsonl(spark, str(p)).orderBy("item_ord").collect()
    assert [r["item_id"] for r in rows] == ["5", "3"] and rows[0]["item_type"] == "O" and rows[1]["final_value"] == 2.5


def test_write_sequences_and_metric_log(spark, tmp_path):
    df = spark.createDataFrame([("train", "A1", [1, 2]), ("test", "A2", [3])], "split string, user_id string, history array<bigint>")
    RD.write_sequences(df, str(tmp_path / "seq"))
    back = spark.read.parquet(str(tmp_path / "seq"))
    assert sorted(r["split"] for r in back.collect()) == ["test", "train"]
    log = spark.createDataFrame([("eval", "hr@10", 1, 0.5)], "stage string, tag string, step long, value double")
    RD.write_metric_log(log, str(tmp_path / "log"))
    RD.write_metric_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_sequences_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A1", ['x "q"', "y"], "t", [1, 2], 3, ["<a_1>"], "<a_2>")],
                               "user_id string, history_item_title array<string>, item_title string, history_item_id array<bigint>, "
                               "item_id bigint, history_item_sid array<string>, item_sid string")
    RD.write_sequences_csv(df, str(tmp_path / "csv"))
    r = RD.read_sequences(spark, str(tmp_path / "csv")).first()
    assert r["history_item_title"] == ['x "q"', "y"] and r["history_item_id"] == [1, 2] and not r["_bad"]


def test_sid_index_object_round_trip(spark, tmp_path):
    from recsmith.plans import fixtures as FX

    idx = FX.sid_index(spark, SF001)
    RD.write_sid_index_object(idx, str(tmp_path / "obj"))
    back = RD.read_sid_index(spark, str(tmp_path / "obj"))
    assert back.count() == idx.count()
    j = back.join(idx.select(F.col("item_id").cast("string").alias("item_id"), F.col("tokens").alias("t0")), "item_id")
    assert j.filter(F.col("tokens") != F.col("t0")).count() == 0


def test_inter_headers_of_every_file_and_bad_ids(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"part{k}.inter").write_text(f"user_id:token\titem_id_list:token_seq\titem_id:token\nu{k}\t1 2\t3\nv{k}\t1 x\t3\nw{k}\t\ty\n")
    assert sorted((r.user_id, r.target) for r in RD.read_inter(spark, str(tmp_path), "train").collect()) == [("u0", 3), ("u1", 3)]
    rows = {r.user_id: r for r in RD.read_inter(spark, str(tmp_path), "train", bad=True).collect()}
    assert len(rows) == 6 and rows["v0"]._bad and rows["w1"]._bad and rows["w1"].history == [] and not rows["u0"]._bad


def test_index_round_trip_through_json_lines(spark, tmp_path):
    df = spark.createDataFrame([("7", ["<a_1>", "<b_2>"]), ("8", ["<a_1>"])], "item_id string, tokens array<string>")
    RD.write_sid_index(df, str(tmp_path / "lines"))
    assert sorted((r.item_id, r.tokens) for r in RD.read_sid_index(spark, str(tmp_path / "lines")).collect()) == [("7", ["<a_1>", "<b_2>"]), ("8", ["<a_1>"])]


def test_predictions_with_mixed_outputs(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps([{"output": "a", "predict": ["x"]}, {"output": ["b", "c"], "predict": []}, {"output": "[not a list", "predict": []}]))
    assert [r.output for r in RD.read_predictions(spark, str(p), "r").orderBy("row_id").collect()] == ["a", "b", "[not a list"]


def test_broken_keyed_json_is_an_error(spark, tmp_path):
    p = tmp_path / "broken.json"
    p.write_text('{"1": {"title": "a"')
    for read in (RD.read_items, RD.read_user_features, RD.read_sid_index):
        with pytest.raises(Exception, match="not a keyed JSON object"):
            read(spark, str(p)).collect()


def test_all_item_fields(spark, tmp_path):
    p = tmp_path / "items.json"
    p.write_text(json.dumps({"1": {"title": "t", "description": ["a", "b"], "category": "c", "brand": "b", "main_cat": "m"}}))
    r = RD.read_items(spark, str(p)).first()
    assert (r.category, r.brand, r.main_cat, r.description_list) == ("c", "b", "m", ["a", "b"])


def test_resolve_split_reports_and_fails(spark):
    paths = spark.createDataFrame([("d/Office.train.inter",), ("d/Office.valid.inter",), ("e/Office.valid.inter",)], "path string")
    got = {r.split: (r.n_files, r.problem is None) for r in RD.resolve_split(paths, "Office", ".inter").collect()}
    assert got == {"train": (1, True), "valid": (2, False), "test": (0, False)}
    with pytest.raises(FileNotFoundError, match="test, valid"):
        RD.resolve_split(paths, "Office", ".inter", fail=True)
