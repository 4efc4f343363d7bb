"""Schema drift and nested runs on small fixtures."""

import json

from lumaframe.operators import drift, labels, nested


def runs(spark, *docs):
    return nested.iteration_candidates(spark.createDataFrame([(i, d if d is None or isinstance(d, str) else json.dumps(d), 0) for i, d in enumerate(docs, 1)], "run_key bigint, run_json string, level int"))


def test_levels_in_every_shape(spark):
    step = {"vlm_decision": {"reason": "r1"}, "updated_metadata": {"iso": "320"}}
    docs = [
        {"iterations": [dict(step, index=4), None, step]},
        {"iterations": {"2": step, "1": dict(step, index=7)}},
        {"iterations": step},
        {"iterations": json.dumps([step])},
        {"schema": 2, "result": {"iterations": [step]}},
        {"iterations": {}}, {"iterations": None}, {}, "{", None, "[1]", "",
    ]
    got = sorted(tuple(r) for r in runs(spark, *docs).collect())
    assert got == [(1, 3, 0, 320, "r1"), (1, 4, 0, 320, "r1"), (2, 2, 0, 320, "r1"), (2, 7, 0, 320, "r1"), (3, 1, 0, 320, "r1"), (4, 1, 0, 320, "r1"), (5, 1, 0, 320, "r1")]


def test_candidates_and_fields(spark):
    doc = {
        "iterations": [
            {
                "index": 1, "vlm_decision": "```json\n{\"reason\": \"über 好\"}\n```", "updated_metadata": {"ISO": {"value": 640.0}},
                "memory_context": {"examples": [{"iterations": [{"index": 9}]}]},
                "optimizer_trace": {"candidates": [{"stage": "c", "updated_metadata": {"iso": None}}, {"stage": "c", "updated_metadata": {"iso": 100}}]},
            },
            {"index": 2, "vlm_decision": None, "optimizer_trace": {"enabled": False}},
        ]
    }
    got = sorted(tuple(r) for r in runs(spark, doc).collect())
    assert got == [(1, 1, 0, 640, "über 好"), (1, 1, 1, -1, ""), (1, 1, 2, 100, ""), (1, 2, 0, -1, "")]
    flat = nested.flatten_runs(spark.createDataFrame([(1, json.dumps(doc))], "run_key bigint, run_json string"))
    parents = {r["iteration_id"] for r in nested.iterations_table(flat).collect()}
    assert {r["iteration_id"] for r in nested.candidates_table(flat).collect()} <= parents
    assert nested.runs_table(flat).first()["iterations"] == 2
    assert nested.subtype_table(nested.iterations_table(flat), "listed_iterations.none").count() == 1


def test_reports_hold_feedback_decisions_quality_and_retrieval(spark):
    action, best = {"iso_delta": 200}, {"run_id": "m-1", "gain": float("nan")}
    steps = [
        {"index": 1, "vlm_decision": {"action": action, "reason": "r"}, "evaluated_quality": {"noise": 0.5}, "memory_context": {"best_experience": best, "retrieval_type": "t", "distance_weights": {"visual": 0.35}}},
        {"index": 2, "vlm_decision": json.dumps({"action": action, "reason": "über"}), "feedback_input": {"round_index": 1}, "memory_context": {"examples": [{"run_id": "m-2"}]}, "quality_gain_from_original": 0.25},
        {"index": 3, "memory_context": None},
    ]
    docs = [(1, json.dumps({"run_id": "a", "stop_reason": "s", "iterations": steps})), (2, json.dumps({"run_id": "b", "iterations": []}))]
    flat = nested.flatten_runs(spark.createDataFrame(docs, "run_key bigint, run_json string"), details=True)
    got = {r["run_key"]: r for r in labels.run_reports(nested.runs_table(flat), nested.iterations_table(flat, "details")).collect()}
    one, two, three = json.loads(got[1]["report"])["rounds"]
    assert one["rag_retrieval"] == {"retrieved": True, "retrieval_type": "t", "distance_weights": {"visual": 0.35}, "best_experience": {"run_id": "m-1", "gain": None}}
    assert one["vlm_first_recommendation"]["action"] == two["vlm_first_recommendation"]["action"] == action
    assert one["objective_quality"] == {"noise": 0.5} and one["previous_round_feedback"] is None
    assert two["previous_round_feedback"] == {"round_index": 1} and two["quality_gain_from_original"] == 0.25
    assert two["rag_retrieval"]["best_experience"] == {"run_id": "m-2"} and two["reason_text"] == "über"
    assert three["rag_retrieval"] == {"retrieved": False, "best_experience": None} and three["iteration_no"] == 3
    assert "RAG: {\"run_id\":\"m-2\"}" in got[1]["markdown"] and got[1]["markdown"].count("no experience retrieved") == 1
    assert json.loads(got[2]["report"]) == {"run_id": "b", "stopped": "", "rounds": []} and got[2]["rounds"] == 0


def leaves(value, path=""):
    """Every scalar, null, empty object and empty list of a document with its path."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "[", "`"):
        inner = nested.read_json(value)
        value = inner if isinstance(inner, (dict, list)) else value
    if isinstance(value, dict) and value:
        return {x for k, v in value.items() for x in leaves(v, f"{path}/{k}")}
    if isinstance(value, list) and value:
        return {x for i, v in enumerate(value, 1) for x in leaves(v, f"{path}/{i}")}
    return {(path, json.dumps(value))}


def rebuilt(rows):
    """The documents put together again from the typed tables."""
    nodes = {}
    for r in sorted(rows, key=lambda r: int(r["node_id"].split("/")[1])):
        more = json.loads(r["more"]) if r["more"] else {}
        own = more[""] if "" in more else {**more, **{c: r[c] for c in nested._TYPED[r["level"]] if r[c] is not None}}
        nodes[r["node_id"]] = own
        if r["parent_id"]:
            up = nodes[r["parent_id"]]
            if r["role"] in ("iterations", "candidates"):
                up.setdefault(r["role"], {})[str(r["place"])] = own
            else:
                up[r["role"]] = own
    return nodes


def test_nothing_of_a_run_is_lost(spark, small):
    docs = spark.read.parquet(f"{small}/agent_runs_self_evolving.parquet").select("run_key", "run_json")
    nodes = nested.run_nodes(docs).collect()
    by_run = {}
    for r in nodes:
        by_run.setdefault(r["run_key"], []).append(r)
    checked = 0
    for key, text in docs.collect():
        value = nested.read_json(text)
        if not isinstance(value, dict) or "result" in value:
            continue
        got = leaves(rebuilt(by_run[key])[f"{key}/0"])
        number = lambda x: json.dumps(float(x)) if x not in ("true", "false", "null") and x[:1] not in '"[{' else x
        single = isinstance(value.get("iterations"), dict) and not all(k.isdigit() for k in value["iterations"])
        if not single:
            assert {(p, number(v)) for p, v in got if v not in ("{}", "[]")} == {(p, number(v)) for p, v in leaves(value) if v not in ("{}", "[]")}, key
            checked += 1
    assert checked > 20
    levels = {r["level"] for r in nodes}
    assert {"run", "iteration", "candidate", "decision", "action", "metadata", "quality", "trace", "context"} <= levels
    table = nested.level_table(nested.run_nodes(docs), "decision", "object_text")
    assert table.count() > 0 and "reason" in table.columns and "iso" not in table.columns


def test_documents_of_any_depth(spark):
    deep = "[" * 4000 + "]" * 4000
    text = '{"run_id": "x", "iterations": [{"index": 1, "deep": %s, "updated_metadata": {"iso": 5}}]}' % deep
    wide = '{"metadata":' * 3000 + "1" + "}" * 3000
    df = spark.createDataFrame([(1, text), (2, "[" * 200_000), (3, '{"iterations": [%s]}' % wide)], "run_key bigint, run_json string")
    assert [tuple(r) for r in nested.iteration_candidates(df).where("run_key = 1").collect()] == [(1, 1, 0, 5, "")]
    kept = {r["run_key"]: r["more"] for r in nested.run_nodes(df).where("level = 'iteration'").collect()}
    assert deep in kept[1]
    got = drift.unified_records(lines(spark, {("s", 1): ['{"a": %s, "b": 1}' % deep], ("s", 2): ['{"a": %s, "c": 1}' % deep]})).collect()
    assert {r["fields"]["a"] for r in got} == {deep}
    assert nested.dump_json({"a": [1, float("nan"), {"b": []}], "c": {}}) == '{"a":[1,null,{"b":[]}],"c":{}}'


def test_repeated_runs_count_twice_and_empty_is_empty(spark):
    d = {"iterations": [{"index": 1}]}
    assert runs(spark, d, d).count() == 2
    assert nested.flatten_runs(spark.createDataFrame([], "run_key bigint, run_json string")).count() == 0


def lines(spark, files):
    rows = []
    for (stream, seq), objs in files.items():
        for n, o in enumerate(objs, 1):
            rows.append((f"{stream}/{seq}", stream, seq, n, o if o is None or isinstance(o, str) else json.dumps(o), "extra"))
    return spark.createDataFrame(rows, "file_name string, stream_name string, file_seq int, line_no int, line_text string, path string")


def rec(i, **more):
    return {"id": f"record-{i:04d}", "path": f"p/{i * 7}.png", "meta": {"img": f"i{i}", "iso": 100 + i, "q": i / 7}, "gain": i / 13, "note": f"n{i * i}", **more}


def test_changes(spark):
    old = [rec(i, weight=i / 3, gone=True) for i in range(6)]
    new = []
    for i in range(3, 9):
        r = rec(i, w8=i / 3, fresh="x")
        r["gain"] = str(r["gain"])
        r["meta"] = {"img": r["meta"]["img"], "ISO": r["meta"]["iso"], "q": r["meta"]["q"]}
        new.append(r)
    junk = ["", None, "[1, 2]", '{"id": ', "5"]
    got = sorted(tuple(r) for r in drift.schema_changes(lines(spark, {("s", 1): old + junk, ("s", 3): new + junk + [new[0]]})).collect())
    assert got == [
        ("s/3", "fresh", "added", ""), ("s/3", "gain", "type_changed", ""), ("s/3", "gone", "removed", ""),
        ("s/3", "meta.iso", "renamed", "meta.ISO"), ("s/3", "weight", "renamed", "w8"),
    ]


def test_whole_object_renamed_and_null_tells_nothing(spark):
    a = [rec(i) for i in range(4)]
    b = [{**{k: v for k, v in rec(i).items() if k not in ("meta", "note")}, "source": rec(i)["meta"], "note": None} for i in range(4)]
    got = sorted(tuple(r) for r in drift.schema_changes(lines(spark, {("s", 1): a, ("s", 2): b})).collect())
    assert got == [("s/2", "meta", "renamed", "source")]


def test_first_file_and_empty_table(spark):
    assert drift.schema_changes(lines(spark, {("s", 5): [rec(1)]})).count() == 0
    empty = spark.createDataFrame([], "file_name string, stream_name string, file_seq int, line_no int, line_text string")
    assert drift.schema_changes(empty).count() == 0
    assert drift.unified_records(empty).count() == 0


def test_same_values_without_a_vanished_name_are_no_rename(spark):
    a = [rec(i, x=i) for i in range(5)]
    b = [rec(i, y=i + 1) for i in range(5)]
    kinds = sorted(r["change_kind"] for r in drift.schema_changes(lines(spark, {("s", 1): a, ("s", 2): b})).collect())
    assert kinds == ["added", "removed"]


def test_unified_table_keeps_first_names(spark):
    a = [rec(i, weight=i / 3) for i in range(5)]
    b = [rec(i, w=i / 3) for i in range(5)]
    c = [rec(i, w8=str(i / 3)) for i in range(5)]
    rows = drift.unified_records(lines(spark, {("s", 1): a, ("s", 2): b, ("s", 3): c})).collect()
    assert len(rows) == 15
    assert all("weight" in r["fields"] for r in rows if r["file_name"] != "s/3")
    assert {r["fields"]["meta.iso"] for r in rows} == {"100", "101", "102", "103", "104"}


def test_unified_values_stay_as_they_are(spark):
    a = [{"id": f"r{i}", "v": "1.10", "e": "1e5", "n": "NaN", "z": "007", "l": [3], "k": 2**60, "f": True, "m": i, "w": {"value": 4}, "o": {"x": {"y": 1}}, "s_": "a", "S_": "b"} for i in range(3)]
    b = [dict(r, m=str(r["m"]), id=f"q{i}") for i, r in enumerate(a)] + [{"id": None, "v": 2.5}]
    df = lines(spark, {("s", 1): a, ("s", 2): b})
    got = {tuple(r["fields"][k] for k in ("v", "e", "n", "z", "l", "k", "w")) for r in drift.unified_records(df).collect() if "e" in r["fields"]}
    assert got == {("1.10", "1e5", "NaN", "007", "[3]", str(2**60), "4")}
    table = drift.unified_table(df)
    kinds = dict(table.dtypes)
    assert (kinds["v"], kinds["e"], kinds["k"], kinds["f"], kinds["m"], kinds["w"], kinds["o__x__y"], kinds["l"]) == ("string", "string", "string", "boolean", "double", "double", "double", "string")
    assert {"s_", "S__"} <= set(table.columns) or {"S_", "s__"} <= set(table.columns)
    assert table.count() == 7 and {r["m"] for r in table.where("m is not null").select("m").collect()} == {0.0, 1.0, 2.0}
    few = drift.unified_table(df, most=2)
    assert len(few.columns) == 6 and all("e" in r["rest"] for r in few.collect() if r["rest"])


def test_names_follow_chains_swaps_and_renamed_parents(spark):
    rows = lambda **names: [{"id": f"record-{i:04d}", "note": f"n{i * i}", "p": f"p/{i * 7}", **{k: f(i) for k, f in names.items()}} for i in range(6)]
    x, y = (lambda i: f"x{i}"), (lambda i: i * 1.5 + 0.25)
    files = {("s", 1): rows(a=x, b=y), ("s", 2): rows(a2=x, b=y), ("s", 3): rows(a3=x, b2=y), ("s", 4): rows(a=x, b2=y), ("s", 5): rows(a4=x, b=y), ("s", 6): rows(a4=x, b=y)}
    got = drift.unified_records(lines(spark, files)).collect()
    assert len(got) == 36
    for r in got:
        assert r["fields"]["a"].startswith("x") and not r["fields"]["b"].startswith("x") and set(r["fields"]) == {"id", "note", "p", "a", "b"}, r
    inner = lambda name, leaf: [{"id": f"record-{i:04d}", "note": f"n{i * i}", name: {leaf: f"v{i}", "k": i / 7}} for i in range(6)]
    moved = drift.unified_records(lines(spark, {("t", 1): inner("meta", "x"), ("t", 2): inner("info", "x"), ("t", 3): inner("info", "y")})).collect()
    assert all({"meta.x", "meta.k"} <= set(r["fields"]) for r in moved)


def test_matching_prefers_the_heavier_pairs():
    best = drift._best_matching({("a", "x"): 3.0, ("a", "y"): 2.0, ("b", "x"): 2.5})
    assert sorted(best) == [("a", "y"), ("b", "x")]
