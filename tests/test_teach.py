"""Labels from search on rendered frames, on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from lumaframe.operators import images, teach



def settings():
    return "px", (8, 8), F.col("iso0"), F.col("shutter0")


def frames(spark):
    rng = np.random.default_rng(2)
    ramp = np.repeat(np.linspace(0.05, 0.95, 64)[:, None], 3, axis=1).ravel()
    rows = [(i, f"g{i % 5}", (ramp * s + rng.random(192) * 0.02).clip(0, 1).tolist(), 100, 0.01, 9) for i, s in enumerate([1.0, 0.9, 0.2, 0.1, 0.05, 1.0, 0.3, 0.15, 0.8, 0.02])]
    rows += [(20, "g1", (ramp * 0.2 * 255).tolist(), 100, 0.01, 9), (30, "g1", None, 100, 0.01, 9), (31, "g1", [0.5] * 3, 100, 0.01, 9), (32, "g1", [float("nan")] * 192, 100, 0.01, 9), (33, "g1", ramp.tolist(), None, 0.01, 9), (34, "g1", ramp.tolist(), 100, 0.0, 9), (None, None, ramp.tolist(), 100, 0.01, 9)]
    return spark.createDataFrame(rows, "row_id bigint, grp string, px array<double>, iso0 int, shutter0 double, candidates int")


def test_search_finds_the_best_of_what_it_measures():
    frame = np.repeat(np.linspace(0.01, 0.2, 64).reshape(8, 8, 1), 3, axis=2)
    iso, shutter, quality, tried = teach.search_frame(frame, 100, 0.01, 200, 0.02)
    own = images.quality(frame)["overall_quality"]
    assert quality > own and 9 <= tried <= 19
    assert abs(images.quality(images.render(frame, 100, 0.01, iso, shutter))["overall_quality"] - quality) < 1e-12
    for to in teach._cells(200, 0.02, teach.COARSE):
        assert images.quality(images.render(frame, 100, 0.01, *to))["overall_quality"] <= quality + 1e-9


def test_pseudo_labels(spark):
    got = teach.pseudo_labels(frames(spark), "row_id", *settings(), ("grp",)).collect()
    assert len(got) == 3 * 12 and {r["row_id"] for r in got} == {*range(10), 20, None}
    assert all(r["quality_after"] >= r["quality_before"] - 1e-9 for r in got)
    assert all((r["candidates"] == 0 and r["quality_gain"] == 0 and r["valid"]) == r["acceptable"] or not r["acceptable"] for r in got)
    assert any(r["valid"] and not r["acceptable"] and r["effective"] for r in got)
    assert all(abs(r["shutter"] - 0.01 * 2 ** r["offset"]) < 1e-12 for r in got)
    assert teach.pseudo_labels(frames(spark).limit(0), "row_id", *settings()).count() == 0


def test_integration_and_preparation(spark):
    df = frames(spark)
    near = spark.createDataFrame([(2, 3, 1, 0.1), (2, 4, 2, 0.2), (3, 99, 1, 0.1)], "query_id bigint, other_id bigint, rank int, score double")
    memory = spark.createDataFrame([(3, (800, 0.02), 0.3), (4, (50, 0.5), 0.3)], "row_id bigint, final_action struct<iso int, shutter double>, quality_gain double")
    got = teach.integrated_labels(df, near, memory, "row_id", *settings()).collect()
    assert [(r["row_id"], r["other_id"]) for r in got] == [(2, 3)] and 0.2 <= got[0]["weight"] <= 0.75 and 100 <= got[0]["start_iso"] <= 800
    made = teach.prepared(df, "row_id", "grp", *settings())
    split = {r["grp"]: r["split"] for r in made["splits"].collect()}
    labels = made["labels"].collect()
    assert all(split[r["grp"]] == r["split"] for r in labels) and all((r["fold"] is None) == (r["split"] != "train") for r in labels)
    memory = made["memory"].collect()
    assert memory and len({r["row_id"] for r in memory}) == len(memory) and all(r["split"] == "train" and r["quality_gain"] >= 0.02 for r in memory)
    assert sum(r["labels"] for r in made["summary"].collect()) == len(labels)
