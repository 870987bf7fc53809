"""Small golden cases for rules the SQL twins cannot tell apart on the given tables."""

import pytest
from pyspark.sql import functions as F

from recsmith.functions import expr as X
from recsmith.functions import text as TX
from recsmith.operators import examples as EX
from recsmith.operators import reports as RP
from recsmith.operators import rewards as H


def one(spark, value, fn, **more):
    return spark.createDataFrame([(value, *more.values())], ", ".join(["c string", *[f"{k} string" for k in more]])).select(fn("c", *more).alias("v")).first()["v"]


@pytest.mark.parametrize("text", [" x ", "  x y 　", "\x1cx\x85", "x\n", "\n", "", "x​", "\t x"])
def test_strip_is_pythons(spark, text):
    assert one(spark, text, X.strip_ws) == text.strip()


def test_strip_chars_before_a_final_line_break(spark):
    assert one(spark, '"a"\n', lambda c: X.strip_chars(c, '"')) == '"a"\n'.strip('"')


def test_norm_and_clean_with_no_break_spaces(spark):
    assert one(spark, ' "<a_1>"\n', TX.norm_pred) == ' "<a_1>"\n'.strip('"\n').strip()
    row = spark.createDataFrame([(["a&nbsp;", "b"],)], "c array<string>").select(TX.clean_text_list("c").alias("v")).first()
    assert row.v == "a b."


def test_descriptions(spark):
    assert one(spark, """["Bob's tool", 'short']""", TX.description_longest, title="t") == "Bob's tool"
    assert one(spark, """["x","y"]""", TX.description_first) == """["x","y"]"""
    assert one(spark, """['it\\'s', 'y']""", TX.description_first) == "it's"
    assert one(spark, "['broken]']x']", TX.description_first) == "['broken]']x']"
    assert one(spark, "[]", TX.description_longest, title="t") == "t"
    assert one(spark, "['', ' ']", TX.description_longest, title="t") == "t"
    assert one(spark, "[not a list]", TX.description_longest, title="t") == "[not a list]"
    assert one(spark, None, TX.description_longest, title="t") == "t"


def test_early_stop_starts_at_zero(spark):
    log = spark.createDataFrame([("r", i, 0.0) for i in range(3)], "run string, step int, value double")
    assert RP.early_stop(log, 1).first()["stop_step"] == 1
    log = spark.createDataFrame([("r", 0, 0.1), ("r", 1, 0.1), ("r", 2, 0.2)], "run string, step int, value double")
    assert RP.early_stop(log, 1).first()["stop_step"] is None


def test_curve_with_several_baselines(spark):
    rows = [("b", 0, "ndcg", 10, 0.2), ("a", 0, "ndcg", 10, 0.1), ("a", 5, "ndcg", 10, 0.4)]
    got = RP.curve(spark.createDataFrame(rows, "run string, step int, metric string, k int, value double")).collect()
    assert {r.baseline for r in got} == {0.1} and len(got) == 3


def test_all_pad_tokens_and_empty_masks(spark):
    assert H.token_diversity(spark.createDataFrame([([0, 0],)], "t array<int>"), "t").first()[0] == 0.0
    rows = [(1, 1, 0, -1.0, -1.0, -1.0, 0.5, 0), (1, 1, 1, -1.0, -0.5, -1.0, 0.5, 1)]
    logps = spark.createDataFrame(rows, "batch_id int, group_id int, pos int, logp double, ref_logp double, logp_old double, advantage double, mask int")
    assert H.kl_report(logps).first()["mean_kl"] == pytest.approx(2.718281828**0.5 - 0.5 - 1)
    assert H.policy_losses(logps).count() == 3 and H.policy_loss(logps).first()["loss"] is not None


def test_total_loss_and_cross_entropy(spark):
    s = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0), (2, 1, 1.0), (2, 2, 1.0)], "query_id int, item_id int, score double")
    t = spark.createDataFrame([(1, 2), (2, 1)], "query_id int, item_id int")
    assert H.cross_entropy(s, t).first()["ce"] == pytest.approx(0.6931471805599453)
    row = spark.range(1).select(H.total_loss(F.lit(1.0), F.lit(2.0), 0.5).alias("a"), H.total_loss(F.lit(1.0), F.lit(2.0), 0.0).alias("b")).first()
    assert (row.a, row.b) == (2.0, 1.0)


def test_example_options(spark):
    maps = spark.createDataFrame([(i, i, f"s{i}", f"t{i}", "d", f"long {i}") for i in range(6)], "item_id int, idx_ord int, sid3 string, title string, description string, long_description string")
    assert EX.sid_title_examples(maps, sample=5).count() == 5 and EX.sid_title_examples(maps).count() == 12
    seq = spark.createDataFrame([(0, "s1", ["s2"]), (1, "s2", ["s1", "s2"])], "line_no int, item_sid string, history_item_sid array<string>")
    rows = EX.fusion_examples(seq, maps, "description", dedup=True).collect()
    assert [(r.example_id, r.completion) for r in rows] == [(0, "long 1\n")]
    assert EX.sid_examples(seq, instruction=True).orderBy("example_id").collect()[1]["history_key"] == "s1, s2"


def test_beams_end_in_full_identifiers(spark):
    from recsmith.operators import trie as TR

    index = spark.createDataFrame([(1, ["<a_1>", "<b_1>", "<c_1>"]), (2, ["<a_1>", "<b_1>", "<c_1>", "<d_2>"]), (3, ["<a_2>", "<b_1>", "<c_3>"])], "item_id int, tokens array<string>")
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    trie, voc = TR.build_trie(index), TR.vocabulary(index)
    got = TR.beam_topk(queries, trie, voc, TR.token_logit, beams=5).collect()
    full = {"<a_1><b_1><c_1>", "<a_1><b_1><c_1><d_2>", "<a_2><b_1><c_3>"}
    for q in (1, 2):
        assert sorted(r.prefix for r in got if r.query_id == q) == sorted(full)
        assert [r.score for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.beam_rank)] == sorted((r.score for r in got if r.query_id == q), reverse=True)
    assert TR.beam_topk(queries, trie, voc, TR.token_logit, beams=5, depth=7).count() == 6  # steps beyond the end change nothing
    none = TR.beam_topk(queries, TR.build_trie(index.limit(0)), TR.vocabulary(index.limit(0)), TR.token_logit, beams=5).collect()
    assert {r.prefix for r in none} == {""}


def test_beam_keys_computed_once_a_text(spark):
    """Keys of prefixes and tokens are columns of their tables: the scored pairs hold no MD5."""
    from recsmith.operators import trie as TR

    index = spark.createDataFrame([(["<a_1>", "<b_1>"],), (["<a_1>", "<b_2>", "<c_1>"],), (["<a_2>", "<b_1>"],)], "tokens array<string>")
    queries = spark.createDataFrame([(1,), (2,), (None,)], "query_id bigint")
    trie, voc, seen = TR.build_trie(index), TR.vocabulary(index), []

    def logit(q, prefix_key, token_key):
        seen.append((str(prefix_key), str(token_key)))
        return TR.key_logit(q, prefix_key, token_key)

    want = TR.beam_topk(queries, trie, voc, TR.token_logit, beams=2).collect()
    got = TR.beam_topk(queries, trie, voc, logit, beams=2, text_key=X.string_key).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 4
    # each step scores the vocabulary by the kept keys, then the few allowed tokens
    assert all("md5" not in p for p, _ in seen) and all("md5" not in t for _, t in seen[::2])



def test_beam_query_returns_identifiers_of_the_index(spark):
    from recsmith.plans import fixtures as FX
    from recsmith.plans import trie_queries as TQ

    from .conftest import SF001

    known = {r.sid for r in FX.sid_map(spark, SF001).collect()}
    rows = TQ.beam_top5(spark, SF001).collect()
    assert rows and {r.sid for r in rows} <= known


def test_ordinals_do_not_depend_on_partitions_and_keep_no_cache(spark):
    from recsmith.sources import ordinal as O

    df = spark.range(0, 500).selectExpr("id % 7 as g", "id")
    a = {(r.g, r.id): r.ord for r in O.with_ordinal(df, ["g", "id"], "ord", 3).collect()}
    assert a == {(r.g, r.id): r.ord for r in O.with_ordinal(df.repartition(9), ["g", "id"], "ord", 11).collect()}
    assert sorted(a.values()) == list(range(500))
    n = O.group_row_number(df, "g", ["id"], num_partitions=5)
    assert {(r.g, r.id): r.rn for r in n.collect()} == {(i % 7, i): i // 7 + 1 for i in range(500)}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_metric_maps_become_log_rows(spark):
    flat = spark.createDataFrame([(3, {"train/loss": "0.5", "note": "warm", "lr": "1e-3", "gap": "NaN", "none": None}), (4, None)], "step int, metrics map<string,string>")
    got = {tuple(r) for r in RP.metric_map_rows(flat, "sft").collect()}
    assert got == {("sft", "sft/train/loss", 3, 0.5), ("sft", "sft/lr", 3, 0.001)}
    nested = spark.createDataFrame([(7, {"rewards/mean": {"rule": 1.0, "a/b": 2.0}, "kl": {}})], "step bigint, metrics map<string,map<string,double>>")
    got = {tuple(r) for r in RP.metric_map_rows(nested, "rl").collect()}
    assert got == {("rl", "rl/rewards_mean/rule", 7, 1.0), ("rl", "rl/rewards_mean/a/b", 7, 2.0)}


def test_entities_are_decoded_in_small_pieces(spark, monkeypatch):
    """Only texts with an ``&`` become Python strings, a bounded number of bytes at a time, whatever the batch."""
    import html

    import pyarrow as pa

    held = []
    real = html.unescape
    texts = ["a &amp; b", None, "", "x" * 30, "&lt;&notit;", "&#x80;&bogus", "é &eacute;", "&"] * 4
    monkeypatch.setattr(TX, "UNESCAPE_BYTES", 40)
    monkeypatch.setattr(TX.html, "unescape", lambda v: held.append(v) or real(v))
    want = [None if t is None else real(t) for t in texts]
    assert TX._unescaped(pa.array(texts)).to_pylist() == want and all("&" in v for v in held)
    assert TX._unescaped(pa.array(texts).slice(3, 9)).to_pylist() == want[3:12]
    assert TX._unescaped(pa.array([], pa.string())).to_pylist() == []
    monkeypatch.undo()
    df = spark.createDataFrame([(i, t, None if i % 5 == 0 else [t, "&gt;"]) for i, t in enumerate(texts)], "i int, t string, l array<string>")
    got = df.select("i", TX.html_unescape("t").alias("t"), TX.html_unescape_list("l").alias("l")).orderBy("i").collect()
    assert [r.t for r in got] == want
    assert [r.l for r in got] == [None if i % 5 == 0 else [w, ">"] for i, w in enumerate(want)]
