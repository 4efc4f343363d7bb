"""Image files, RAW arrays, decisions and training rows."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.functions import decisions
from lumaframe.operators import labels
from lumaframe.sources import images


@pytest.mark.parametrize("filters", [0, 1, 2, 3, 4])
def test_png_filters(filters):
    rng = np.random.default_rng(filters)
    pixels = rng.integers(0, 256, (5, 7, 3)).astype(np.int64)
    lines, above = b"", np.zeros(21, np.int64)
    for row in pixels.reshape(5, 21):
        left = np.concatenate([np.zeros(3, np.int64), row[:-3]])
        corner = np.concatenate([np.zeros(3, np.int64), above[:-3]])
        base = left + above - corner
        paeth = np.array([min((a, b, c), key=lambda v, p=p: abs(p - v)) for a, b, c, p in zip(left, above, corner, base)])
        guess = {0: 0, 1: left, 2: above, 3: (left + above) // 2, 4: paeth}[filters]
        lines += bytes([filters]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert np.array_equal(np.rint(images.decode_png(data) * 255), pixels)


def test_png_round_trip_and_damage():
    image = np.random.default_rng(0).integers(0, 256, (6, 4, 3)) / 255
    data = images.encode_png(image)
    assert np.allclose(images.decode_png(data), image)
    for bad in (b"", b"nothing", data[:40], data[:20] + b"x" * 30):
        with pytest.raises(ValueError):
            images.decode_png(bad)


def test_mat_arrays():
    def element(kind, body):
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    values = np.arange(6, dtype="<u2").reshape(2, 3)
    matrix = element(6, struct.pack("<II", 11, 0)) + element(5, struct.pack("<ii", 2, 3)) + element(1, b"x") + element(4, values.tobytes(order="F"))
    small = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", 1, 1)) + element(1, b"y") + element(9, struct.pack("<d", 2.5))
    packed = zlib.compress(element(14, small))
    data = b" " * 124 + b"\x00\x01IM" + element(14, matrix) + struct.pack("<II", 15, len(packed)) + packed
    got = images.read_mat(data)
    assert np.array_equal(got["x"], values) and got["y"][0, 0] == 2.5 and images.largest_array(got) is got["x"]
    with pytest.raises(ValueError):
        images.read_mat(b"short")


def test_resize():
    image = np.arange(48.0).reshape(4, 4, 3)
    assert images.resize(image, 8) is image
    assert np.allclose(images.resize(image, 2)[0, 0], image[:2, :2].mean(axis=(0, 1)))


def test_scene_folders(spark, tmp_path):
    image = images.encode_png(np.full((2, 2, 3), 0.5))
    for folder, names in {"0001_001_S6_00100_00060_3200_L": ["NOISY_SRGB_010.PNG", "noisy_a.png", "GT_SRGB_010.PNG"], "0002_002_GP_00200_00400_5500_N": ["NOISY_x.png", "readme.txt"], "odd": ["GT_1.png"]}.items():
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(image if n.lower().endswith("png") else b"?")
    (tmp_path / "odd" / "GT_2.png").write_bytes(b"broken")
    files = images.scene_files(spark, str(tmp_path))
    pairs = {r["folder"]: (r["noisy"].rsplit("/", 1)[1], r["truth"] and r["truth"].rsplit("/", 1)[1], r["scene"]["iso"]) for r in images.noisy_with_truth(files).collect()}
    assert pairs == {"0001_001_S6_00100_00060_3200_L": ("NOISY_SRGB_010.PNG", "GT_SRGB_010.PNG", 100), "0002_002_GP_00200_00400_5500_N": ("NOISY_x.png", None, 200)}
    measured = images.decoded(files.where(F.upper("file").like("%.PNG")), lambda a: [float(a.mean())], 1)
    assert measured.where("ok").count() == 5 and measured.where("not ok").first()["error"] == "not a PNG"


def test_decisions(spark):
    fine = '{"quality": {"noise": 0.2}, "action": {"iso": 200, "shutter": 0.01}, "continue": true, "reason": "ok"}'
    answers = [fine, f"```json\n{fine}\n```", "I think so", '{"action": {"iso": 200}}', fine.replace("200", "0"), fine.replace("0.2", "7"), None]
    df = spark.createDataFrame([(a,) for a in answers], "a string")
    got = [r["p"]["error"] for r in df.select(decisions.parse_decision(F.col("a")).alias("p")).collect()]
    assert got == [None, None, "not JSON", "no absolute action", "action out of range", "quality out of range", "no answer"]


def test_last_answer(spark):
    chats = ['[{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]', '[{"role": "assistant", "content": "a"}, {"role": "user", "content": "q"}]', "[]", "{", None]
    df = spark.createDataFrame([(c,) for c in chats], "m string")
    assert [r[0] for r in df.select(decisions.last_answer(F.col("m"))).collect()] == ["a", None, None, None, None]


def test_variants_and_offsets(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, None)], "k int, s double")
    got = sorted(tuple(r) for r in labels.exposure_variants(rows, "k", F.col("s")).where("k = 1").collect())
    assert got == [(1, -1.0, 0.25, False), (1, 0.0, 0.5, True), (1, 1.0, 1.0, False)]
    assert labels.parse_offsets("-1, ,0.5") == (-1.0, 0.5)
    for bad in ("", "4", "nan"):
        with pytest.raises(ValueError):
            labels.parse_offsets(bad)


def test_reports(spark):
    runs = spark.createDataFrame([(1, "r", "s"), (2, None, None)], "run_key bigint, run_id string, stop_reason string")
    steps = spark.createDataFrame([(1, "1/2", 2, 100, "b", None), (1, "1/1", 1, 200, "a", "x")], "run_key bigint, iteration_id string, iteration_no int, iso_value int, reason_text string, stop_reason string")
    got = {r["run_key"]: r for r in labels.run_reports(runs, steps).collect()}
    assert got[1]["rounds"] == 2 and got[1]["markdown"] == "## r\n- 1: ISO 200, a\n- 2: ISO 100, b" and got[2]["rounds"] == 0
    assert labels.two_stage_examples(steps).select("example_id").distinct().count() == 4


def test_metadata_maps(spark):
    from lumaframe.functions import metadata as M

    doc = '{"Image": {"ExposureTime": "0.01", "ISO Speed": 200, "list": [%s]}, "x": null, "iso": "y"}' % ",".join(map(str, range(40)))
    flat = M.flatten_metadata(spark.createDataFrame([(1, doc), (2, "["), (3, None)], "k int, t string"), "k", "t")
    got = {r["key"]: r["metadata"] for r in flat.collect()}
    assert got["1"]["Image.ISO Speed"] == "200" and '"length": 40' in got["1"]["Image.list"] and "x" not in got["1"] and got["2"] == got["3"] == {}
    r = flat.where("key = '1'").select(
        M.allowed_only(F.col("metadata"), ["exposure_time"]).alias("a"), M.find_number(F.col("metadata"), ["iso", "iso_speed"]).alias("n"),
        M.merged(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"))).alias("m"), M.settings_of(F.lit('{"a": 2, "b": 3}'), {"a": "int", "c": "int"})["a"].alias("s"),
    ).first()
    assert r["a"] == {"Image.ExposureTime": "0.01"} and r["n"] == 200.0 and r["m"] == {"a": "2"} and r["s"] == 2


def test_settings(monkeypatch):
    from lumaframe.config import Settings

    monkeypatch.setenv("LUMAFRAME_TOP_K", "7")
    assert Settings.from_environment().top_k == 7 and Settings.from_environment().seed == 42


def test_command_line(spark, small, tmp_path, capsys):
    from lumaframe import jobs

    jobs.main(["list"])
    assert "run_metrics" in capsys.readouterr().out
    jobs.main(["run", "run_metrics", "--data", small, "--out", str(tmp_path / "o"), "--format", "json"])
    assert spark.read.json(str(tmp_path / "o")).count() > 0
    jobs.main(["splits", "--data", small, "--out", str(tmp_path / "m.json")])
    import json

    assert set(json.loads((tmp_path / "m.json").read_text())["counts"]) == {"train", "validation", "test"}
