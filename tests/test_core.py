"""Expressions, ordered operators, splits, joins and sources on small fixtures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.functions import decisions
from lumaframe.functions import exprs as X
from lumaframe.functions.labels import physical_key, scene_key, split_name
from lumaframe.operators import evaluate, order, search, splits
from lumaframe.operators.skew import hot_key_join, product_join, top_per_key
from lumaframe.session import materialize, release
from lumaframe.sources import jsonl


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_exposure_arithmetic(spark):
    r = one(spark, X.relative_ev(F.lit(100.0), F.lit(1 / 60)), X.exposure_change(F.lit(200.0), F.lit(0.02), F.lit(100.0), F.lit(0.01)), X.relative_ev(F.lit(100.0), F.lit(0.0)), X.stops(F.lit(-1.0)))
    assert math.isclose(r[0], math.log2(60)) and math.isclose(r[1], 2.0) and r[2] is None and r[3] is None


def test_distances_match_hand_values(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    none = F.array().cast("array<double>")
    r = one(spark, X.cosine_distance(a, b), X.cosine_distance(a, none), X.jensen_shannon(a, b), X.euclidean(a, b), X.euclidean(a, none), X.jensen_shannon(a, a))
    assert r[0] == 1.0 and r[1] == 1.0 and math.isclose(r[2], math.sqrt(math.log(2)), rel_tol=1e-6) and math.isclose(r[3], math.sqrt(2)) and math.isinf(r[4]) and r[5] < 1e-9


def test_half_even_and_bins(spark):
    r = one(spark, X.apply_action(F.lit(100.5), F.lit(99.0))[0], X.apply_action(F.lit(100.5), F.lit(99.0))[1], X.histogram_bin(F.lit(1.0), 32), X.histogram_bin(F.lit(1.5), 32), X.shutter_token(F.lit("60")), X.shutter_token(F.lit("0")), X.shutter_token(F.lit("x")))
    assert r[0] == 100.0 and r[1] == 30.0 and r[2] == 31 and r[3] is None and math.isclose(r[4], 1 / 60) and r[5] is None and r[6] is None


def test_texts(spark):
    r = one(spark, X.strip_fence(F.lit('```json\n{"a": 1}\n```')), X.strip_fence(F.lit(" x ")), X.normalized_key(F.lit("Exposure-Time 1")), X.scene_name_parts(F.lit("0001_002_S6_00100_00060_3200_L")), X.scene_name_parts(F.lit("0001_002")))
    assert r[0] == '{"a": 1}' and r[1] == "x" and r[2] == "exposuretime1" and r[3]["scene_id"] == "0001_002" and r[3]["iso"] == 100 and math.isclose(r[3]["shutter"], 1 / 60) and r[4] is None


def test_labels(spark):
    rows = spark.createDataFrame([(" 0012-034 ", None, " VAL"), ("0012", "P007", "unknown"), (None, "phys-000", "Testing"), ("0012_034_KX_1", "x", None)], "s string, p string, d string")
    got = [tuple(r) for r in rows.select(scene_key(F.col("s")), physical_key(F.col("p"), F.col("s")), split_name(F.col("d"))).collect()]
    assert got == [("12_34", "34", "validation"), (None, "7", None), (None, "0", "test"), ("12_34", "34", None)]


def test_first_last_argmax(spark):
    rows = spark.createDataFrame([("a", 1, 5.0, 0), ("a", 2, 5.0, 0), ("b", 3, None, 0), (None, 4, 1.0, 0), (None, 5, 0.0, 0)], "k string, id int, v double, _rn int")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(order.first_wins(rows, ["k"], [F.col("id")])) == [1, 3, 4]
    assert ids(order.last_wins(rows, ["k"], [F.col("id")])) == [2, 3, 5]
    best = order.argmax_first(rows, ["k"], F.col("v"), F.col("id"))
    assert ids(best) == [1, 3, 4] and "_rn" in best.columns
    assert order.first_wins(rows.limit(0), ["k"], [F.col("id")]).count() == 0


def test_round_robin_and_running(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "g string, i int")
    assert sorted((r["g"], r["i"]) for r in order.round_robin_limit(rows, "g", [F.col("i")], 3).collect()) == [("a", 0), ("a", 1), ("b", 9)]
    run = order.running_best(spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (1, 3, 3.0)], "k int, o int, s double"), ["k"], [F.col("o")], "s")
    assert [(r["best"], r["improved"]) for r in run.orderBy("o").collect()] == [(2.0, True), (2.0, False), (3.0, True)]


@pytest.mark.parametrize("n, expected", [(0, (0, 0, 0)), (1, (1, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)), (25, (21, 2, 2)), (160, (128, 16, 16))])
def test_split_sizes(spark, n, expected):
    rows = spark.createDataFrame([(f"g{i}",) for i in range(n)] + [(None,)], "g string")
    counts = splits.split_counts(splits.grouped_split(rows, "g")).first()
    assert (counts["train"], counts["validation"], counts["test"]) == expected


def test_cross_folds_are_even(spark):
    rows = spark.createDataFrame([(f"g{i}",) for i in range(10)] * 2, "g string")
    folds = [r["fold"] for r in splits.cross_folds(rows, "g").collect()]
    assert sorted(folds.count(f) for f in range(4)) == [2, 2, 3, 3]


def test_hot_key_join_keeps_every_row(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    lookup = spark.range(50_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = hot_key_join(rows, lookup, "k")
    assert got.count() == 40_000 and got.where("w <> k * 2").count() == 0
    nulls = spark.createDataFrame([(None, 1), (5, 2), (99_999, 3)], "k bigint, v int")
    assert sorted((r["v"], r["w"]) for r in hot_key_join(nulls, lookup, "k", how="left").collect()) == [(1, None), (2, 10), (3, None)]
    assert hot_key_join(nulls.limit(0), lookup, "k").count() == 0


def test_top_per_key_limits_before_the_shuffle(spark):
    df = top_per_key(spark.range(100).select((F.col("id") % 3).alias("k"), "id"), ["k"], [F.col("id")], 2)
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()
    assert df.count() == 6


def test_jsonl(spark, tmp_path):
    lines = ['{"a": 1, "b": "x"}', "", "  ", "[1]", "3", '"s"', "null", '{"a": ', '{"a": "no"}', None]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    kinds = [r[0] for r in df.select(jsonl.line_kind(F.col("value"))).collect()]
    assert kinds == ["object", "blank", "blank", "array", "scalar", "scalar", "scalar", "broken", "object", "blank"]
    assert [tuple(r) for r in jsonl.records(df, "value", "a int, b string").collect()] == [(1, "x"), (None, None)]
    with pytest.raises(Exception, match="not JSON"):
        jsonl.records(df, "value", "a int", strict=True).collect()
    path = str(tmp_path / "sink")
    assert jsonl.read_jsonl(spark, path, "k string, v int", missing_is_empty=True).count() == 0
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert jsonl.append_new_records(batch, path, "k", [F.col("v")], "k string, v int") == 2
    assert jsonl.append_new_records(batch, path, "k", [F.col("v")], "k string, v int") == 0
    assert jsonl.count_lines(spark, path) == 2


def test_split_manifest(spark, tmp_path):
    good, bad = tmp_path / "m.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"assignments": {"s1": "train", "s2": "test"}}, indent=1))
    bad.write_text(json.dumps({"assignments": {"s1": "dev"}}))
    assert sorted(tuple(r) for r in jsonl.read_assignments(spark, str(good)).collect()) == [("s1", "train"), ("s2", "test")]
    with pytest.raises(Exception, match="no such split"):
        jsonl.read_assignments(spark, str(bad)).collect()


def test_metrics_on_nothing(spark):
    empty = spark.createDataFrame([], "k string, iso int, shutter double")
    m = evaluate.action_metrics(empty, empty, "k").first()
    assert (m["target_count"], m["match_rate"], m["iso_mae"]) == (0, 0.0, None)
    c = evaluate.confusion(spark.createDataFrame([(None, True), (True, True), (False, None)], "t boolean, p boolean"), F.col("t"), F.col("p")).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"], c["precision"], c["recall"]) == (1, 1, 0, 1, 0.5, 1.0)


def test_grid_collapses_clamped_settings(spark):
    rows = spark.createDataFrame([(1, 50, 30.0), (2, None, 1.0)], "k int, iso int, s double")
    got = search.candidate_grid(rows, "k", F.col("iso"), F.col("s")).collect()
    assert {(r["iso"], r["shutter"]) for r in got} == {(50.0, 15.0), (50.0, 30.0), (250.0, 15.0), (250.0, 30.0)} and len(got) == 4


def test_two_stage_search_keeps_the_incumbent(spark):
    rows = spark.createDataFrame([(1, 400, 1 / 60)], "k int, iso int, s double")
    score = lambda c: c.withColumn("score", -F.abs(F.col("iso") - 400.0) - F.abs(F.log2(F.col("shutter") * 60)))
    best = search.two_stage_search(rows, "k", "iso", "s", score).first()
    assert best["iso"] == 400.0 and best["ord"] == -1


def test_bounded_loop(spark):
    state = spark.createDataFrame([(1, 10.0), (2, 1000.0), (3, 1.5)], "k int, v double")
    out = search.bounded_loop(state, lambda s: s.withColumn("v", F.col("v") / 2), F.col("v") < 1, rounds=9)
    assert sorted((r["k"], r["rounds"]) for r in out.collect()) == [(1, 3), (2, 3), (3, 1)]


def test_materialize_cuts_the_lineage(spark):
    df = materialize(spark.range(5))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().toString()
    release(df)


def test_grid_needs_no_shuffle(spark):
    rows = spark.createDataFrame([(1, 100, 0.01)], "k int, iso int, s double")
    grid = search.candidate_grid(rows, "k", F.col("iso"), F.col("s"))
    assert "Exchange" not in grid._jdf.queryExecution().executedPlan().toString() and grid.count() == 9


def test_product_join_makes_each_pair_once(spark):
    left = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"))
    right = spark.range(40).select((F.col("id") % 2).alias("k"), F.col("id").alias("b"))
    plain = sorted(tuple(r) for r in left.join(right, "k").collect())
    assert sorted(tuple(r) for r in product_join(left, right, "k", pairs_per_task=50).collect()) == plain and len(plain) == 800
    assert product_join(left.limit(0), right, "k").count() == 0


def test_percentiles_equal_numpy_whatever_the_skew(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "SHARE", 0.01)
    rng = np.random.default_rng(3)
    groups = {"even": rng.random(2000), "ties": np.repeat([1.0, 2.0, 3.0], [1500, 20, 400]), "far": np.r_[rng.random(900), [1e9, -1e9]], "one": np.array([7.0]), None: rng.normal(0, 1, 50), "ten": np.arange(10.0)}
    rows = [(g, float(x), 1) for g, xs in groups.items() for x in xs] + [("even", None, 1), ("even", float("nan"), 1), ("none", None, 1)]
    points = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: r for r in evaluate.exact_percentiles(spark.createDataFrame(rows, "g string, v double, n int"), "g", F.col("v"), points).collect()}
    assert set(got) == {*groups, "none"} and got["none"]["n"] == 0 and got["none"]["p50"] is None
    for g, xs in groups.items():
        assert got[g]["n"] == len(xs)
        assert np.allclose([got[g][p] for p in points], np.percentile(xs, [100 * q for q in points.values()])), g
    empty = spark.createDataFrame([], "g string, v double")
    assert evaluate.exact_percentiles(empty, "g", F.col("v"), points).count() == 0
    c = evaluate.calibration(empty.withColumn("w", F.col("v")), F.col("v"), F.col("w")).first()
    assert c["noise_floor"] is None and c["sample_count"] == 0


def test_round_and_quality_metrics(spark):
    rows = [(2, "good", True), (3, "max_rounds_best_result", False), (0, None, None), (1, "max_rounds_best_result", True)]
    m = evaluate.round_metrics(spark.createDataFrame(rows, "n int, why string, ok boolean"), F.col("n"), F.col("why"), F.col("ok")).first()
    assert (m["runs"], m["mean_rounds"], m["success_rate"], m["unsatisfied_rate"]) == (4, 2.0, 0.5, 0.25)
    side = lambda *r: spark.createDataFrame(r, "k string, noise double, shadow double")
    e = {r["field"]: r for r in evaluate.quality_errors(side(("a", 0.5, None), ("b", 0.1, 0.2)), side(("a", 0.25, 0.1), ("b", float("nan"), None)), "k", ("noise", "shadow")).collect()}
    assert (e["noise"]["matched"], e["noise"]["mae"]) == (1, 0.25) and (e["shadow"]["matched"], e["shadow"]["mae"]) == (0, None)


def test_names_and_derived_values(spark):
    df = spark.createDataFrame([("/a/0001_002_S6/x.png", -1.0, [3, 4]), ("x.png", 0.5, [])], "p string, o double, l array<int>")
    got = df.select(X.folder_scene(F.col("p")), X.variant_name(F.lit("s"), F.col("o")), order.first_of(F.col("l")), X.is_effective(F.lit(100), F.lit(0.01), F.lit(100), F.lit(0.0102)), X.ev_or_derived(F.lit(None).cast("double"), F.lit(100), F.lit(0.5))).collect()
    assert [tuple(r) for r in got] == [("0001_002", "s--1.00", 3, False, 1.0), (None, "s-+0.50", None, False, 1.0)]
    grouped = order.grouped_keys(spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "a"), (None, "c"), ("h", None)], "g string, k string"), "g", "k").collect()
    assert [tuple(r) for r in grouped] == [("g", ["a", "b"])]


def test_manifest_is_one_document(spark, small, tmp_path):
    from lumaframe import jobs

    out = tmp_path / "splits.json"
    jobs.write_manifest(spark, small, str(out), 42, 4)
    doc = json.loads(out.read_text())
    assert doc["seed"] == 42 and sum(doc["counts"].values()) == len(doc["groups"]) > 0
    assert all((g["fold"] is None) == (g["split"] != "train") for g in doc["groups"].values())


def test_prompts_and_best_action(spark):
    meta, features = F.struct(F.lit(100).alias("iso")), F.struct(F.lit(2).alias("histogram_bins"))
    first, again = one(spark, decisions.initial_prompt(meta, features, None), decisions.initial_prompt(meta, features, F.lit('{"round_index": 1}')))
    assert json.loads(first)["image_order"] == ["original"] and json.loads(first)["previous_round_feedback"] is None and json.loads(first)["initial_metadata"] == {"iso": 100}
    assert json.loads(again)["image_order"] == ["original", "previous_result"] and json.loads(again)["previous_round_feedback"] == {"round_index": 1}
    second = json.loads(one(spark, decisions.integration_prompt(meta, features, F.lit('{"action": {"ISO": 200}}'), F.lit(None).cast("string"), None))[0])
    assert second["first_decision"] == {"action": {"ISO": 200}} and second["retrieved_experience"] is None and second["stage"] != json.loads(first)["stage"]
    contexts = ['{"best_experience": {"final_action": {"ISO": 400, "Shutter": 0.01}}}', '{"examples": [{"final_action": {"ISO": 100, "Shutter": 0.5}}]}', '{"best_experience": {"final_action": {"ISO": "x"}}}', "[1]", "{", None]
    got = spark.createDataFrame([(c,) for c in contexts], "c string").select(decisions.best_action(F.col("c")).alias("a")).collect()
    assert [None if r["a"] is None else tuple(r["a"]) for r in got] == [(400, 0.01), (100, 0.5), None, None, None, None]


def test_chat_messages_are_normalized(spark):
    rows = [
        '[{"role": "user", "content": [{"image": "a.png"}, {"text": "t"}, {"type": "image", "image": "/b.png"}]}, {"role": "assistant", "content": "x"}]',
        '[{"role": "robot", "content": "x"}]', "{", None, "[]", '[{"role": "user", "content": [{"sound": "s"}]}]',
    ]
    got = [r["m"] for r in spark.createDataFrame([(r,) for r in rows], "m string").select(decisions.normalized_messages(F.col("m"), "/data").alias("m")).collect()]
    assert [(i["type"], i["value"]) for i in got[0]["messages"][0]["content"]] == [("image", "/data/a.png"), ("text", "t"), ("image", "/b.png")]
    assert got[0]["error"] is None and got[0]["messages"][1]["content"][0]["value"] == "x"
    assert [g["error"] for g in got[1:]] == ["unknown role", "no list of messages", "no list of messages", "no list of messages", "unknown content"]


def test_example_ids_depend_on_every_field(spark):
    base = dict.fromkeys(decisions.IDENTITY, "v")
    ids = {one(spark, decisions.example_id(**{k: F.lit(v) for k, v in {**base, **change}.items()}))[0] for change in [{}, *[{k: "w"} for k in base], *[{k: None} for k in base]]}
    assert len(ids) == 2 * len(base) + 1 == 25 and all(len(i) == 20 for i in ids)


def test_only_split(spark):
    df = spark.createDataFrame([("a", "train"), ("b", None), ("c", "test")], "k string, dataset_split string")
    keys = lambda d: sorted(r["k"] for r in d.collect())
    assert keys(splits.only_split(df)) == ["a", "b", "c"] and keys(splits.only_split(df, "train")) == ["a", "b"]
    with pytest.raises(ValueError, match="no rows"):
        splits.only_split(df, "validation", required=True)
