"""Weighted neighbours against brute force; image kernels; streams."""

import numpy as np
from pyspark.sql import functions as F

from lumaframe.operators import images, retrieval
from lumaframe.plans import catalog
from lumaframe.streaming import memory


def test_weighted_neighbors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 60
    v, h, g = rng.normal(size=(n, 5)), rng.random((n, 4)), rng.integers(0, 6, n)
    rows = [(i, v[i].tolist(), h[i].tolist(), None if i % 11 == 0 else int(g[i])) for i in range(n)] + [(100, None, h[0].tolist(), 1), (101, [float("nan")] * 5, h[0].tolist(), 1), (102, [1.0], h[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, h array<double>, g int")
    parts = [retrieval.Component("v", "cosine", 5, 0.6), retrieval.Component("h", "jensen_shannon", 4, 0.3), retrieval.Component("v", "euclidean", 5, 0.1, 2.0)]
    got = {(r["query_id"], r["rank"]): (r["other_id"], r["score"]) for r in retrieval.weighted_neighbors(df.where("id % 20 = 0"), df, "id", parts, 3, ("g",)).collect()}

    def score(a, b):
        cos = 1 - v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
        p, q = h[a] / h[a].sum(), h[b] / h[b].sum()
        m = (p + q) / 2
        js = np.sqrt(0.5 * (p * np.log(p / m)).sum() + 0.5 * (q * np.log(q / m)).sum())
        return 0.6 * cos + 0.3 * js + 0.1 * np.linalg.norm(v[a] - v[b]) / 2

    for a in (0, 20, 40):
        fits = [b for b in range(n) if b != a and (a % 11 == 0 or b % 11 == 0 or g[a] != g[b])]
        best = sorted(fits, key=lambda b: (round(score(a, b), 9), b))[:3]
        assert [got[a, k][0] for k in (1, 2, 3)] == best
    assert len(got) == 9
    assert retrieval.weighted_neighbors(df.limit(0), df, "id", parts, 3).count() == 0


def test_full_score_has_all_five_components(spark, small):
    def parts(r):
        f, m, a = r["fixed_features"], r["initial_metadata"], r["initial_vlm_action"]
        try:
            o, lengths = f["objective_quality"], (len(f["visual_embedding"]), len(f["luminance_histogram"]))
            quality = [o["quality"][c] for c in ("brightness", "noise", "motion_blur", "highlight", "shadow")] + [o["dynamic_range"], o["midtone_ratio"]]
            settings = [m["iso"], m["shutter_speed_s"], a["iso"], a["shutter"]]
            if lengths != (192, 32) or min(settings) <= 0:
                return None
            exposure = [np.log2(max(m["iso"], 1) / 100) / 8, np.log2(max(m["shutter_speed_s"], 1e-9) * 60) / 16]
            action = [np.log2(a["iso"] / m["iso"]) / 8, np.log2(a["shutter"] / m["shutter_speed_s"]) / 8]
            out = [np.array(x, dtype=float) for x in (f["visual_embedding"], f["luminance_histogram"], quality, exposure, action)]
        except TypeError:  # a null
            return None
        return out if all(np.isfinite(x).all() for x in out) else None

    rows = {r["row_id"]: r for r in spark.read.parquet(f"{small}/experiences.parquet").collect()}
    usable = {i: p for i, r in rows.items() if (p := parts(r))}

    def score(a, b):
        (v, h, *rest), (w, g, *others) = usable[a], usable[b]
        norm = np.linalg.norm(v) * np.linalg.norm(w)
        p, q = np.maximum(h, 1e-12) / np.maximum(h, 1e-12).sum(), np.maximum(g, 1e-12) / np.maximum(g, 1e-12).sum()
        m = (p + q) / 2
        js = np.sqrt(max(0.5 * (p * np.log(p / m)).sum() + 0.5 * (q * np.log(q / m)).sum(), 0))
        total = 0.35 * (np.clip(1 - v @ w / norm, 0, 2) if norm > 0 else 1) + 0.3 * js
        return total + sum(c * np.linalg.norm(x - y) / np.sqrt(len(x)) for c, x, y in zip((0.2, 0.1, 0.05), rest, others, strict=True))

    def apart(a, b):
        return a != b and not any(rows[a][c] is not None and rows[a][c] == rows[b][c] for c in ("scene_id", "physical_scene_id"))

    want = {(a, k, b): s for a in usable if a % 20 == 0 for k, (s, b) in enumerate(sorted((round(score(a, b), 9), b) for b in usable if apart(a, b))[:3], 1)}
    got = {(r["query_id"], r["rank"], r["other_id"]): r["score"] for r in catalog.queries()["retrieve_full_score"](spark, small).collect()}
    assert want and got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_crossfold_neighbors_keep_folds_apart(spark):
    rows = [(i, [float(i)], fold) for i, fold in enumerate([0, 0, 1, None, 1, 0, None, 2])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, fold int")
    got = retrieval.crossfold_neighbors(df, df.where("id <> 6"), "id", [retrieval.Component("v", "euclidean", 1, 1.0)], 2, "fold").collect()
    near = {i: [r["other_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] for i in range(8)}
    assert near == {0: [2, 4], 1: [2, 4], 2: [1, 0], 3: [2, 4], 4: [5, 1], 5: [4, 7], 6: [5, 7], 7: [5, 4]}


def test_images():
    ramp = np.repeat(np.linspace(0, 1, 32)[None, :, None], 32, axis=0).repeat(3, axis=2)
    dark, fair = images.quality(ramp * 0.1), images.quality(ramp)
    assert dark["overall_quality"] < fair["overall_quality"] and dark["shadow"] > fair["shadow"]
    board = (np.indices((64, 64)).sum(axis=0) % 2).astype(float)[..., None].repeat(3, axis=2)
    assert images.quality(images.blur(board, 2.0))["motion_blur"] > images.quality(board)["motion_blur"]
    assert np.allclose(images.to_srgb(images.to_linear(ramp)), ramp, atol=1e-6)
    assert images.luminance(images.render(ramp, 100, 0.01, 200, 0.01)).mean() > images.luminance(images.render(ramp, 100, 0.01, 100, 0.01)).mean()
    again = [images.render(ramp, 100, 0.01, 800, 0.02) for _ in range(2)]
    assert np.array_equal(*again)
    assert np.isclose(images.histogram(ramp).sum(), 1, atol=1e-6) and len(images.descriptor(ramp)) == 192
    flat = np.full((8, 8), 0.5)
    assert np.allclose(images.demosaic(flat), 0.5) and images.develop((flat * 65535).astype(np.uint16)).shape == (8, 8, 3)


def test_raw_chain():
    assert images.mosaic_pattern([2, 1, 1, 0]) == "BGGR" and images.mosaic_pattern([7, 0, 0, 0]) == images.mosaic_pattern(None) == "RGGB"
    raw = np.arange(35, dtype=np.uint16).reshape(5, 7)
    assert images.demosaic(raw.astype(float), "nonsense").shape == (4, 6, 3)
    corner = images.demosaic(np.array([[8.0, 1.0], [1.0, 4.0]]))
    assert corner[0, 0, 0] == 8 and corner[1, 1, 2] == 4 and corner[0, 0, 1] == 1 and corner[1, 1, 0] == 8
    assert images.default_crop(raw, (2, 1), (3, 2)).tolist() == raw[1:3, 2:5].tolist()
    assert images.default_crop(raw, (-1, 0), (3, 2)) is raw and images.default_crop(raw, None, (1, 1)) is raw
    assert images.normalize_raw(np.array([[0.2, 0.9]])).tolist() == [[0.2, 0.9]] and images.normalize_raw(np.array([[600, 100]], np.uint16), 100, 1100).tolist() == [[0.5, 0.0]]
    warm, cool = np.eye(3) * 2, np.eye(3)
    warm[0, 1] = 2
    assert images.colour_matrix(warm, cool, 3000)[0].tolist() == [0.5, 0.5, 0] and images.colour_matrix(warm, cool, 6500).tolist() == cool.tolist()
    assert images.colour_matrix(None, None, None) is None and images.colour_matrix([1, 2], None, 5000) is None
    grey = np.full((4, 4, 3), 0.25)
    assert np.allclose(images.develop_linear(grey, neutral=(0.5, 1.0, 0.5)), [[0.5, 0.25, 0.5]]) and np.allclose(images.develop_linear(grey, gains=(2, 1, 4), white_level=0.5), [[1, 0.5, 1]])
    assert np.allclose(images.develop_linear(np.full((2, 2, 4), 0.5)), 0.5) and images.develop_linear(np.zeros((2, 4)), orientation=6).shape == (4, 2, 3)
    assert np.allclose(images.develop_linear(grey, matrix=np.zeros((3, 3))), 0.25)
    white = images.develop_linear(np.full((2, 2, 3), 0.3), matrix=np.linalg.inv(np.linalg.inv(images.XYZ_TO_SRGB)))
    assert white.shape == (2, 2, 3)


def test_image_stage_skips_bad_pixels(spark):
    df = spark.createDataFrame([(1, [0.5] * 12), (2, None), (3, [0.5]), (4, [float("nan")] * 12), (5, [255.0] * 12), (6, [256.0] * 12), (7, [-0.1] * 12)], "row_id bigint, px array<double>")
    assert [r["row_id"] for r in images.quality_reports(df, "row_id", "px", 2, 2).collect()] == [1, 5]  # 5 is in 8-bit units


def test_stream_appends_each_key_once(spark, tmp_path):
    source, sink, mark = (str(tmp_path / d) for d in ("in", "out", "ck"))
    schema = "run_id string, gain double"
    for rows in ([("a", 0.5), ("a", 0.1), ("b", 0.0)], [("a", 0.9), ("c", 0.3), (None, 0.7)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        memory.append_stream(stream, sink, mark, "run_id", [F.desc("gain")], F.col("gain") >= 0.02).awaitTermination()
    assert sorted(tuple(r) for r in memory.read_memory(spark, sink).collect()) == [("a", 0.5), ("c", 0.3)]


def test_windowed_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("2031-01-01 01:00:00", "x", 1.0), ("2031-01-01 02:00:00", "x", 3.0), ("2031-01-02 00:00:00", "x", 5.0)], "t string, g string, v double").write.json(source)
    stream = spark.readStream.schema("t timestamp, g string, v double").json(source)
    query = memory.windowed_gains(stream, "t", "g", F.col("v")).writeStream.format("memory").queryName("gains").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["rows"], r["mean_gain"]) for r in spark.table("gains").collect()) == [(1, 5.0), (2, 2.0)]
