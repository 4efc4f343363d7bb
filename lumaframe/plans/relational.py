"""Queries over scenes, folds, experiences and the star schema, each with its SQL.

Floats are rounded to six decimals on both sides; ordered operators end in a unique
key (``l_orderkey, l_linenumber`` is none, so more columns follow).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions import decisions
from lumaframe.functions import exprs as X
from lumaframe.functions.labels import SPLIT_SYNONYMS, physical_key, scene_key, split_name
from lumaframe.operators import evaluate, labels, order, retrieval, search, splits
from lumaframe.session import materialize, shared_dir
from lumaframe.sources.jsonl import line_kind
from lumaframe.sources.tables import table
from lumaframe.streaming import memory

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c, decimals: int):
    return F.round(c, decimals) + F.lit(0.0)


def r6(c):
    return _r(c, 6)


# --- sources ---------------------------------------------------------------


@query("""
SELECT stream_name, kind, count(*) AS lines FROM (
  SELECT stream_name, CASE WHEN trim(regexp_replace(coalesce(line_text, ''), '\\s+', ' ', 'g')) = '' THEN 'blank' WHEN NOT json_valid(line_text) THEN 'broken'
    WHEN json_type(line_text) = 'OBJECT' THEN 'object' WHEN json_type(line_text) = 'ARRAY' THEN 'array' ELSE 'scalar' END AS kind FROM memory_lines)
GROUP BY ALL""")
def tolerant_scan(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "memory_lines")
    return lines.groupBy("stream_name", line_kind(F.col("line_text")).alias("kind")).agg(F.count("*").alias("lines"))


@query("""
SELECT event_type, count(*) AS events, count(k) AS readable, sum(k)::BIGINT AS total FROM (
  SELECT event_type, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY event_type""")
def json_guarded_cast(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("events"), F.count("k").alias("readable"), F.sum("k").alias("total"))


@query("""
SELECT folder_name, concat(t[1], '_', t[2]) AS scene, t[2] AS physical, t[3] AS camera_code, try_cast(t[4] AS INTEGER) AS iso_value,
  CASE WHEN try_cast(t[5] AS DOUBLE) >= 10 THEN round(1 / try_cast(t[5] AS DOUBLE), 6) WHEN try_cast(t[5] AS DOUBLE) > 0 THEN round(try_cast(t[5] AS DOUBLE), 6) END AS shutter_s,
  try_cast(t[6] AS INTEGER) AS kelvin, t[7] AS level
FROM (SELECT folder_name, string_split(folder_name, '_') AS t FROM scenes) WHERE len(t) >= 7""")
def scene_name_parse(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "scenes").select("folder_name", X.scene_name_parts(F.col("folder_name")).alias("p")).where("p is not null")
    return named.select(
        "folder_name", F.col("p.scene_id").alias("scene"), F.col("p.physical_scene_id").alias("physical"), F.col("p.camera").alias("camera_code"),
        F.col("p.iso").alias("iso_value"), F.round("p.shutter", 6).alias("shutter_s"), F.col("p.color_temperature").alias("kelvin"), F.col("p.brightness_level").alias("level"),
    )


@query("""
SELECT scene_id, CASE WHEN original_image_path LIKE '/%' THEN original_image_path ELSE concat('/data/', original_image_path) END AS path, count(*) AS n FROM fold_0 WHERE original_image_path IS NOT NULL GROUP BY ALL""")
def manifest_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "fold_0").where("original_image_path is not null")
    return rows.groupBy("scene_id", X.resolve_path(F.col("original_image_path"), "/data").alias("path")).agg(F.count("*").alias("n"))


# --- dedup, order, unions ----------------------------------------------------


@query("""
SELECT content_id, doc_id FROM (SELECT substr(sha256(text), 1, 20) AS content_id, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1""")
def first_seen_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null").select(F.sha2("text", 256).alias("h"), "doc_id")
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select(F.substring("h", 1, 20).alias("content_id"), "doc_id")


@query("""
SELECT scene_id, row_id, dataset_split, quality_gain_r FROM (SELECT scene_id, row_id, dataset_split, round(quality_gain, 6) AS quality_gain_r,
  row_number() OVER (PARTITION BY scene_id ORDER BY recorded_at DESC NULLS LAST, row_id DESC) AS rn FROM fold_0 WHERE scene_id IS NOT NULL AND NOT isnan(coalesce(quality_gain, 0))) WHERE rn = 1""")
def last_row_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "fold_0").where("scene_id is not null and not isnan(coalesce(quality_gain, 0d))")
    rows = rows.select("scene_id", "row_id", "dataset_split", F.round("quality_gain", 6).alias("quality_gain_r"), "recorded_at")
    return order.last_wins(rows, ["scene_id"], [F.col("recorded_at"), F.col("row_id")]).drop("recorded_at")


@query("""
SELECT scene_id, source_no, row_id FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY source_no, row_id) AS rn FROM (
  SELECT scene_id, row_id, 0 AS source_no FROM experiences WHERE scene_id IS NOT NULL UNION ALL SELECT scene_id, row_id, 1 FROM fold_0 WHERE scene_id IS NOT NULL)) WHERE rn = 1""")
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, t).where("scene_id is not null").select("scene_id", "row_id") for t in ("experiences", "fold_0")]
    return order.union_distinct(parts, ["scene_id"], [F.col("row_id")])


@query("""
SELECT event_id, user_id, depth FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS depth FROM events) ORDER BY depth, user_id LIMIT 500""")
def round_robin_limit(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return order.round_robin_limit(rows, "user_id", [F.col("ts"), F.col("event_id")], 500).select("event_id", "user_id", "depth")


@query("""
SELECT scene_id, row_id, gain FROM (SELECT scene_id, row_id, round(quality_gain, 6) AS gain, row_number() OVER (PARTITION BY scene_id ORDER BY coalesce(round(quality_gain, 6), 0) DESC, row_id) AS rn
  FROM fold_0 WHERE scene_id IS NOT NULL AND NOT isnan(coalesce(quality_gain, 0))) WHERE rn = 1""")
def argmax_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "fold_0").where("scene_id is not null and not isnan(coalesce(quality_gain, 0d))").select("scene_id", "row_id", F.round("quality_gain", 6).alias("gain"))
    return order.argmax_first(rows, ["scene_id"], F.col("gain"), F.col("row_id"))


_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


@query(f"""
SELECT l_orderkey, l_linenumber, l_quantity, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS previous_l_quantity FROM lineitem""")
def feedback_lag(spark: SparkSession, sf: str) -> DataFrame:
    rows = order.previous_row(_lines(spark, sf), ["l_orderkey"], [F.col(c.strip()) for c in _LINE_ORDER.split(",")], ["l_quantity"])
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "previous_l_quantity")


@query(f"""
SELECT l_orderkey, l_linenumber, l_quantity, max(l_quantity) OVER w AS best, coalesce(l_quantity > max(l_quantity) OVER b, true) AS improved FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER} ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_best(spark: SparkSession, sf: str) -> DataFrame:
    rows = order.running_best(_lines(spark, sf), ["l_orderkey"], [F.col(c.strip()) for c in _LINE_ORDER.split(",")], "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "best", "improved")


@query("""
SELECT scene_id, count(DISTINCT physical_scene_id) AS values FROM fold_0 WHERE scene_id IS NOT NULL GROUP BY scene_id HAVING count(DISTINCT physical_scene_id) > 1""")
def group_fd_check(spark: SparkSession, sf: str) -> DataFrame:
    return order.violations_of_dependency(table(spark, sf, "fold_0"), "scene_id", "physical_scene_id")


# --- splits ------------------------------------------------------------------

_SHUFFLED = """SELECT physical_scene_id, row_number() OVER (ORDER BY md5('42:' || physical_scene_id), physical_scene_id) AS place, count(*) OVER () AS n
  FROM (SELECT DISTINCT physical_scene_id FROM fold_0 WHERE physical_scene_id IS NOT NULL)"""
_SPLIT = f"""SELECT physical_scene_id, CASE WHEN place <= n - 2 * greatest(1, round_even(n * 0.1::DOUBLE, 0)) THEN 'train' WHEN place <= n - greatest(1, round_even(n * 0.1::DOUBLE, 0)) THEN 'validation' ELSE 'test' END AS split
  FROM ({_SHUFFLED})"""


@query(_SPLIT)
def grouped_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.grouped_split(table(spark, sf, "fold_0"), "physical_scene_id")


@query(f"""
WITH s AS ({_SPLIT}), t AS (SELECT physical_scene_id, row_number() OVER (ORDER BY md5('42:' || physical_scene_id), physical_scene_id) AS place FROM s WHERE split = 'train')
SELECT physical_scene_id, ((place - 1) % 4)::INTEGER AS fold FROM t""")
def crossfold_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Folds of the training groups; held-out groups have none."""
    train = grouped_split(spark, sf).where("split = 'train'")
    return splits.cross_folds(train, "physical_scene_id")


@query("""
SELECT physical_scene_id, string_agg(DISTINCT scene_id, ',' ORDER BY scene_id) AS keys FROM fold_0 WHERE physical_scene_id IS NOT NULL AND scene_id IS NOT NULL GROUP BY physical_scene_id""")
def scenes_of_groups(spark: SparkSession, sf: str) -> DataFrame:
    return order.grouped_keys(table(spark, sf, "fold_0"), "physical_scene_id", "scene_id").select("physical_scene_id", F.array_join("keys", ",").alias("keys"))


@query(f"SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM ({_SPLIT})")
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_counts(grouped_split(spark, sf))


_WORD = "regexp_replace(lower(dataset_split), '[^a-z]+', '', 'g')"
_NAMED = "CASE " + " ".join(f"WHEN {_WORD} IN ({', '.join(repr(w) for w in words)}) THEN '{name}'" for name, words in SPLIT_SYNONYMS.items()) + " END"


@query(f"""
WITH o AS (SELECT scene_id, min({_NAMED}) AS own FROM experiences GROUP BY scene_id), g AS ({_SPLIT})
SELECT f.row_id, coalesce(o.own, g.split) AS split FROM fold_0 f LEFT JOIN o USING (scene_id) LEFT JOIN g USING (physical_scene_id)""")
def split_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The split that another table records for a row's scene, else that of its group."""
    own = table(spark, sf, "experiences").groupBy("scene_id").agg(F.min(split_name(F.col("dataset_split"))).alias("split"))
    rows = table(spark, sf, "fold_0").select("row_id", "scene_id", "physical_scene_id")
    return splits.split_of_scene(rows, own, grouped_split(spark, sf)).select("row_id", "split")


@query(f"SELECT coalesce(dataset_split, '') AS value, count(*) AS rows FROM fold_0 WHERE {_NAMED} IS NULL GROUP BY 1")
def invalid_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded split values that name no split, with their rows."""
    rows = table(spark, sf, "fold_0").where(split_name(F.col("dataset_split")).isNull())
    return rows.groupBy(F.coalesce("dataset_split", F.lit("")).alias("value")).agg(F.count("*").alias("rows"))


@query("SELECT DISTINCT scene_id FROM fold_0 WHERE scene_id IS NOT NULL AND scene_id NOT IN (SELECT scene_id FROM scenes WHERE scene_id IS NOT NULL)")
def stale_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return splits.unassigned(table(spark, sf, "fold_0"), table(spark, sf, "scenes"), "scene_id")


@query("SELECT coalesce(dataset_split, 'train') AS split, count(*) AS n FROM fold_0 GROUP BY 1")
def split_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "fold_0").groupBy(F.coalesce("dataset_split", F.lit("train")).alias("split")).agg(F.count("*").alias("n"))


# --- metrics -------------------------------------------------------------------


@query("""
WITH t AS (SELECT * FROM (SELECT scene_id, final_action.iso AS ti, final_action.shutter AS ts, row_number() OVER (PARTITION BY scene_id ORDER BY recorded_at DESC NULLS LAST, row_id DESC) AS rn FROM fold_0 WHERE scene_id IS NOT NULL) WHERE rn = 1),
p AS (SELECT * FROM (SELECT scene_id, final_action.iso AS pi, final_action.shutter AS ps, row_number() OVER (PARTITION BY scene_id ORDER BY recorded_at DESC NULLS LAST, row_id DESC) AS rn FROM experiences WHERE scene_id IS NOT NULL) WHERE rn = 1),
j AS (SELECT t.*, pi, ps, coalesce(p.scene_id IS NOT NULL AND ti IS NOT NULL AND pi IS NOT NULL, false) AS hit FROM t LEFT JOIN p USING (scene_id))
SELECT count(*) AS target_count, count(*) FILTER (hit) AS matched, round(count(*) FILTER (hit) / count(*), 6) + 0.0 AS match_rate,
  round(avg(abs(ti - pi)::DOUBLE) FILTER (hit), 6) + 0.0 AS iso_mae, round(avg(abs(log2(greatest(ps, 1e-8::DOUBLE) / greatest(ts, 1e-8::DOUBLE)))) FILTER (hit), 6) + 0.0 AS shutter_stops_mae FROM j""")
def action_metrics(spark: SparkSession, sf: str) -> DataFrame:
    def last(name: str) -> DataFrame:
        rows = table(spark, sf, name).where("scene_id is not null").select("scene_id", "row_id", "recorded_at", F.col("final_action.iso").alias("iso"), F.col("final_action.shutter").alias("shutter"))
        return order.last_wins(rows, ["scene_id"], [F.col("recorded_at"), F.col("row_id")])

    m = evaluate.action_metrics(last("fold_0"), last("experiences"), "scene_id")
    return m.select("target_count", "matched", *[r6(F.col(c)).alias(c) for c in ("match_rate", "iso_mae", "shutter_stops_mae")])


_ERROR_FIELDS = ("brightness", "noise", "motion_blur", "highlight", "shadow", "overall_quality")
_LAST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY recorded_at DESC NULLS LAST, row_id DESC) AS rn FROM experiences WHERE scene_id IS NOT NULL) WHERE rn = 1)"""


@query("WITH l AS " + _LAST + " " + " UNION ALL ".join(f"""
SELECT '{f}' AS field, count(abs(a - b)) AS matched, round(avg(abs(a - b)), 8) + 0.0 AS mae FROM (SELECT CASE WHEN NOT isnan(quality_before.quality.{f}) THEN quality_before.quality.{f} END AS a, CASE WHEN NOT isnan(quality_after.quality.{f}) THEN quality_after.quality.{f} END AS b FROM l)""" for f in _ERROR_FIELDS))
def quality_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Mean absolute error of each quality field, the report before taken as a prediction of that after."""
    rows = table(spark, sf, "experiences").where("scene_id is not null").select("scene_id", "row_id", "recorded_at", "quality_before", "quality_after")
    last = order.last_wins(rows, ["scene_id"], [F.col("recorded_at"), F.col("row_id")])
    side = lambda c: last.select("scene_id", f"{c}.quality.*")
    m = evaluate.quality_errors(side("quality_after"), side("quality_before"), "scene_id", _ERROR_FIELDS)
    return m.select("field", "matched", _r(F.col("mae"), 8).alias("mae"))


@query("""
SELECT label_source, count(*) AS runs, round(count(*) FILTER (successful) / count(*), 6) + 0.0 AS success_rate, round(avg(CASE WHEN NOT isnan(quality_gain) THEN quality_gain END), 6) + 0.0 AS mean_gain,
  round(avg(abs(final_action.iso - initial_metadata.iso)::DOUBLE), 6) + 0.0 AS mean_iso_change,
  round(avg(CASE WHEN final_action.shutter > 0 AND initial_metadata.shutter_speed_s > 0 THEN abs(log2(final_action.shutter / initial_metadata.shutter_speed_s)) END), 6) + 0.0 AS mean_stop_change
FROM fold_0 GROUP BY label_source""")
def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    m = evaluate.run_metrics(
        table(spark, sf, "fold_0"), "label_source", c("quality_gain"), c("successful"), c("final_action.iso"), c("initial_metadata.iso"), c("final_action.shutter"), c("initial_metadata.shutter_speed_s")
    )
    return m.select("label_source", "runs", *[r6(c(x)).alias(x) for x in ("success_rate", "mean_gain", "mean_iso_change", "mean_stop_change")])


@query("""
WITH b AS (SELECT coalesce(successful, false) AS t, coalesce(quality_after.acceptable, false) AS p FROM experiences),
c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM b),
d AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0.0) AS re FROM c)
SELECT tp, fp, fn, tn, round(pr, 6) + 0.0 AS precision, round(re, 6) + 0.0 AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0.0), 6) + 0.0 AS f1 FROM d""")
def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.confusion(table(spark, sf, "experiences"), F.col("successful"), F.col("quality_after.acceptable"))
    return m.select("tp", "fp", "fn", "tn", *[r6(F.col(x)).alias(x) for x in ("precision", "recall", "f1")])


@query("""
WITH b AS (SELECT event_type, least(31, floor(value / 500 * 32))::INTEGER AS bin FROM events WHERE value >= 0 AND value <= 500)
SELECT event_type, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 8) AS share FROM b GROUP BY event_type, bin""")
def value_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.value_histogram(table(spark, sf, "events"), "event_type", X.histogram_bin(F.col("value"), 32, 0.0, 500.0))


@query("""
SELECT event_type, round(quantile_cont(value, 0.05), 6) + 0.0 AS p5, round(quantile_cont(value, 0.5), 6) + 0.0 AS p50, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95, count(value) AS n FROM events GROUP BY event_type""")
def percentile_bounds(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.percentile_bounds(table(spark, sf, "events"), "event_type", F.col("value"), {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    return m.select("event_type", *[r6(F.col(c)).alias(c) for c in ("p5", "p50", "p95")], "n")


@query("""
SELECT round(quantile_cont(x, 0.5), 6) + 0.0 AS noise_floor, round(quantile_cont(x, 0.5) + greatest(0.005::DOUBLE, 4 * quantile_cont(x, 0.9)), 6) + 0.0 AS noise_reference,
  round(greatest(quantile_cont(y, 0.5), 1e-5::DOUBLE), 6) + 0.0 AS sharpness_reference, count(x) AS sample_count
FROM (SELECT CASE WHEN NOT isnan(quality_before.quality.noise) THEN quality_before.quality.noise END AS x, CASE WHEN NOT isnan(quality_before.sharpness_score) THEN quality_before.sharpness_score END AS y FROM experiences)""")
def calibration_stats(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.calibration(table(spark, sf, "experiences"), F.col("quality_before.quality.noise"), F.col("quality_before.sharpness_score"))
    return m.select(*[r6(F.col(c)).alias(c) for c in ("noise_floor", "noise_reference", "sharpness_reference")], "sample_count")


@query("""
SELECT cross_fold, count(*) AS n, count(DISTINCT scene_id) AS scenes, count(DISTINCT physical_scene_id) AS groups FROM fold_0 GROUP BY cross_fold""")
def summary_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "fold_0").groupBy("cross_fold").agg(F.count("*").alias("n"), F.count_distinct("scene_id").alias("scenes"), F.count_distinct("physical_scene_id").alias("groups"))


# --- scalar functions ------------------------------------------------------------


@query("""
SELECT row_id, round(CASE WHEN i > 0 AND s > 0 THEN log2(1 / s) - log2(i / 100.0::DOUBLE) END, 6) + 0.0 AS ev, round(CASE WHEN fi > 0 AND fs > 0 AND i > 0 AND s > 0 THEN fi / i * fs / s END, 6) + 0.0 AS scale,
  round(CASE WHEN fi > 0 AND fs > 0 AND i > 0 AND s > 0 THEN log2(fi / i) + log2(fs / s) END, 6) + 0.0 AS change,
  round(CASE WHEN fi > 0 AND fs > 0 AND i > 0 AND s > 0 THEN abs(log2(fi / i)) + abs(log2(fs / s)) END, 6) + 0.0 AS distance
FROM (SELECT row_id, initial_metadata.iso::DOUBLE AS i, initial_metadata.shutter_speed_s AS s, final_action.iso::DOUBLE AS fi, final_action.shutter AS fs FROM fold_0)""")
def exposure_stops(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "fold_0").select("row_id", F.col("initial_metadata.iso").cast("double").alias("i"), F.col("initial_metadata.shutter_speed_s").alias("s"), F.col("final_action.iso").cast("double").alias("fi"), F.col("final_action.shutter").alias("fs"))
    i, s, fi, fs = (F.col(c) for c in ("i", "s", "fi", "fs"))
    positive = (i > 0) & (s > 0) & (fi > 0) & (fs > 0)
    return rows.select(
        "row_id", r6(X.relative_ev(i, s)).alias("ev"), r6(F.when(positive, X.exposure_scale(fi, fs, i, s))).alias("scale"),
        r6(F.when(positive, X.exposure_change(fi, fs, i, s))).alias("change"), r6(F.when(positive, X.proposal_distance(fi, fs, i, s))).alias("distance"),
    )


@query("""
SELECT row_id, round_even(0.7::DOUBLE * a + 0.3::DOUBLE * b, 0) AS linear_iso, round(exp(0.7::DOUBLE * ln(s) + 0.3::DOUBLE * ln(t)), 6) + 0.0 AS shutter,
  round(least(0.75::DOUBLE, greatest(0.2::DOUBLE, 0.2::DOUBLE + 0.55::DOUBLE * exp(-3::DOUBLE * 0.1::DOUBLE) * least(greatest(g, 0) / 0.1::DOUBLE, 1))), 6) + 0.0 AS weight
FROM (SELECT row_id, initial_vlm_action.iso::DOUBLE AS a, final_action.iso::DOUBLE AS b, initial_vlm_action.shutter AS s, final_action.shutter AS t, quality_gain AS g FROM experiences)
WHERE a > 0 AND b > 0 AND s > 0 AND t > 0 AND g IS NOT NULL AND NOT isnan(g)""")
def blends(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "experiences").select("row_id", F.col("initial_vlm_action.iso").cast("double").alias("a"), F.col("final_action.iso").cast("double").alias("b"), F.col("initial_vlm_action.shutter").alias("s"), F.col("final_action.shutter").alias("t"), F.col("quality_gain").alias("g"))
    rows = rows.where("a > 0 and b > 0 and s > 0 and t > 0 and g is not null and not isnan(g)")
    a, b, s, t, g = (F.col(c) for c in "abstg")
    return rows.select("row_id", X.linear_blend(a, b, 0.3).alias("linear_iso"), r6(X.geometric_blend(s, t, F.lit(0.3))).alias("shutter"), r6(X.blend_weight(F.lit(0.1), g)).alias("weight"))


@query("""
SELECT row_id, concat_ws(',', CASE WHEN q.shadow > 0.3 THEN 'shadow' END, CASE WHEN q.highlight > 0.03 THEN 'highlight' END, CASE WHEN m < 0.55 THEN 'midtone' END, CASE WHEN d < 0.2 THEN 'dynamic_range' END,
  CASE WHEN q.noise > 0.45 THEN 'noise' END, CASE WHEN q.motion_blur > 0.55 AND c > 0.5 THEN 'blur' END, CASE WHEN q.overall_quality < 0.65 THEN 'overall' END) AS unmet
FROM (SELECT row_id, quality_before.quality AS q, quality_before.midtone_ratio AS m, quality_before.dynamic_range AS d, quality_before.sharpness_confidence AS c FROM experiences WHERE quality_before IS NOT NULL AND quality_before.quality IS NOT NULL)""")
def unmet_criteria(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "experiences").where("quality_before is not null and quality_before.quality is not null")
    b = lambda c: F.col(f"quality_before.{c}")
    unmet = X.unmet_criteria(b("quality.shadow"), b("quality.highlight"), b("midtone_ratio"), b("dynamic_range"), b("quality.noise"), b("quality.motion_blur"), b("sharpness_confidence"), b("quality.overall_quality"))
    return rows.select("row_id", F.array_join(unmet, ",").alias("unmet"))


@query("""
WITH q AS (SELECT row_id, quality_before.quality.shadow AS s, quality_before.quality.highlight AS h, quality_before.midtone_ratio AS m, quality_before.contrast_score AS c, quality_before.noise_score AS n, quality_before.sharpness_score AS p FROM experiences),
e AS (SELECT *, greatest(0, least(1, 0.3::DOUBLE * greatest(0, least(1, 1 - s / 0.6::DOUBLE)) + 0.3::DOUBLE * greatest(0, least(1, 1 - h / 0.06::DOUBLE)) + 0.4::DOUBLE * greatest(0, least(1, m / 0.55::DOUBLE)))) AS x FROM q
  WHERE s IS NOT NULL AND h IS NOT NULL AND m IS NOT NULL AND c IS NOT NULL AND n IS NOT NULL AND p IS NOT NULL)
SELECT row_id, round(x, 10) + 0.0 AS exposure, round(greatest(0, least(1, 0.4::DOUBLE * x + 0.2::DOUBLE * c + 0.2::DOUBLE * n + 0.2::DOUBLE * p)), 10) + 0.0 AS overall FROM e""")
def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    b = lambda c: F.col(f"quality_before.{c}")
    rows = table(spark, sf, "experiences").select("row_id", b("quality.shadow").alias("s"), b("quality.highlight").alias("h"), b("midtone_ratio").alias("m"), b("contrast_score").alias("c"), b("noise_score").alias("n"), b("sharpness_score").alias("p")).dropna()
    x = X.exposure_score(F.col("s"), F.col("h"), F.col("m"))
    return rows.select("row_id", _r(x, 10).alias("exposure"), _r(X.overall_score(x, F.col("c"), F.col("n"), F.col("p")), 10).alias("overall"))


@query("""
SELECT row_id, coalesce(a = b AND abs(s - t) <= greatest(1e-9::DOUBLE * greatest(abs(s), abs(t)), 1e-12::DOUBLE), false) AS unchanged, coalesce(abs(a - b) < 1 AND abs(log2(t / s)) < 0.02::DOUBLE, false) AS small
FROM (SELECT row_id, initial_vlm_action.iso AS a, final_action.iso AS b, initial_vlm_action.shutter AS s, final_action.shutter AS t FROM experiences) WHERE s > 0 AND t > 0""")
def action_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "experiences").select("row_id", F.col("initial_vlm_action.iso").alias("a"), F.col("final_action.iso").alias("b"), F.col("initial_vlm_action.shutter").alias("s"), F.col("final_action.shutter").alias("t")).where("s > 0 and t > 0")
    a, b, s, t = (F.col(c) for c in "abst")
    no = F.lit(False)
    return rows.select("row_id", F.coalesce(X.is_unchanged(a, s, b, t), no).alias("unchanged"), F.coalesce(X.is_small(a, s, b, t), no).alias("small"))


@query("""
SELECT row_id, greatest(round_even(i * CASE WHEN b THEN 1 WHEN d AND l > 0.45 THEN 2 WHEN d THEN 1 WHEN n > 0.45 THEN 0.5 WHEN l > 0.55 AND c > 0.5 THEN 2 ELSE 1 END::DOUBLE, 0), 1) AS iso,
  round(s * CASE WHEN b THEN 0.6 WHEN d AND l > 0.45 THEN 1 WHEN d THEN 1.5 WHEN n > 0.45 THEN 2 WHEN l > 0.55 AND c > 0.5 THEN 0.5 ELSE 1 END::DOUBLE, 10) + 0.0 AS shutter
FROM (SELECT row_id, initial_metadata.iso::DOUBLE AS i, initial_metadata.shutter_speed_s AS s, coalesce(quality_before.quality.highlight > 0.03, false) AS b,
  coalesce(quality_before.quality.shadow > 0.3, false) OR coalesce(quality_before.midtone_ratio < 0.55, false) AS d, quality_before.quality.noise AS n, quality_before.quality.motion_blur AS l, quality_before.sharpness_confidence AS c
  FROM experiences WHERE initial_metadata.iso IS NOT NULL AND initial_metadata.shutter_speed_s IS NOT NULL)""")
def heuristic_actions(spark: SparkSession, sf: str) -> DataFrame:
    b = lambda c: F.col(f"quality_before.{c}")
    iso, shutter = X.heuristic_action(
        b("quality.shadow"), b("quality.highlight"), b("midtone_ratio"), b("quality.noise"), b("quality.motion_blur"), b("sharpness_confidence"), F.col("initial_metadata.iso"), F.col("initial_metadata.shutter_speed_s")
    )
    rows = table(spark, sf, "experiences").where("initial_metadata.iso is not null and initial_metadata.shutter_speed_s is not null")
    return rows.select("row_id", iso.alias("iso"), _r(shutter, 10).alias("shutter"))


@query("""
SELECT row_id, coalesce(abs(log2(fi / i) + log2(fs / s)) >= 0.05::DOUBLE, false) AS effective, round(coalesce(ev, CASE WHEN i > 0 AND s > 0 THEN log2(1 / s) - log2(i / 100) END), 6) + 0.0 AS ev
FROM (SELECT row_id, initial_metadata.ev AS ev, CASE WHEN initial_metadata.iso > 0 THEN initial_metadata.iso::DOUBLE END AS i, CASE WHEN initial_metadata.shutter_speed_s > 0 THEN initial_metadata.shutter_speed_s END AS s,
  CASE WHEN final_action.iso > 0 THEN final_action.iso::DOUBLE END AS fi, CASE WHEN final_action.shutter > 0 THEN final_action.shutter END AS fs FROM experiences)""")
def effective_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a final action changes the exposure at all, and the EV it started from, derived where it isn't stated."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double"))
    i, s, fi, fs = (positive(c) for c in ("initial_metadata.iso", "initial_metadata.shutter_speed_s", "final_action.iso", "final_action.shutter"))
    rows = table(spark, sf, "experiences")
    return rows.select("row_id", F.coalesce(X.is_effective(i, s, fi, fs), F.lit(False)).alias("effective"), r6(X.ev_or_derived(F.col("initial_metadata.ev"), i, s)).alias("ev"))


# --- search and loop ----------------------------------------------------------------

_GRID = """
WITH c AS (SELECT row_id, initial_metadata.iso::DOUBLE AS i, initial_metadata.shutter_speed_s AS s FROM fold_0 WHERE initial_metadata.iso IS NOT NULL AND initial_metadata.shutter_speed_s IS NOT NULL),
o AS (SELECT (d + 1) * 3 + k AS ord, d * 200.0::DOUBLE AS d, (2.0::DOUBLE ** (k - 1)) AS f FROM (SELECT unnest([-1, 0, 1]) AS d), (SELECT unnest([0, 1, 2]) AS k)),
g AS (SELECT row_id, ord::INTEGER AS ord, greatest(50.0::DOUBLE, least(12800.0::DOUBLE, round_even(greatest(i + d, 1), 0))) AS iso, greatest(1 / 8000.0::DOUBLE, least(30.0::DOUBLE, greatest(s * f, 1e-8::DOUBLE))) AS shutter, i, s FROM c, o),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, iso, round(shutter, 10) ORDER BY ord) AS rn FROM g) WHERE rn = 1)
"""


def _grid(spark: SparkSession, sf: str, keep: tuple = ()) -> DataFrame:
    return search.candidate_grid(table(spark, sf, "fold_0"), "row_id", F.col("initial_metadata.iso"), F.col("initial_metadata.shutter_speed_s"), keep=keep)


@query(_GRID + "SELECT row_id, ord, iso, round(shutter, 10) + 0.0 AS shutter FROM u")
def candidate_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf).select("row_id", "ord", "iso", _r(F.col("shutter"), 10).alias("shutter"))


def _toy_score(iso, shutter):
    """A smooth score with its best at ISO 400 and 1/60 s."""
    return F.exp(-F.abs(F.log2(iso / F.lit(400.0))) - F.abs(F.log2(shutter * F.lit(60.0))))


@query(_GRID + """, r AS (SELECT *, round(exp(-abs(log2(iso / 400.0::DOUBLE)) - abs(log2(shutter * 60.0::DOUBLE))), 9) AS score, round(abs(log2(iso / i)) + abs(log2(shutter / s)), 9) AS distance FROM u WHERE i > 0 AND s > 0)
SELECT row_id, ord, iso, score + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, distance, ord) AS k FROM r) WHERE k = 1""")
def grid_argmax(spark: SparkSession, sf: str) -> DataFrame:
    center = (F.col("initial_metadata.iso").cast("double").alias("_ci"), F.col("initial_metadata.shutter_speed_s").alias("_cs"))
    scored = _grid(spark, sf, center).where("_ci > 0 and _cs > 0").withColumn("score", _toy_score(F.col("iso"), F.col("shutter")))
    best = search.best_candidate(scored, "row_id", "score", F.col("_ci"), F.col("_cs"))
    return best.select("row_id", "ord", "iso", _r(F.col("score"), 9).alias("score"))


_SCORE = "round(exp(-abs(log2({0} / 400.0::DOUBLE)) - abs(log2({1} * 60.0::DOUBLE))), 9)"
_AWAY = "round(abs(log2({0} / i)) + abs(log2({1} / s)), 9)"


@query(_GRID + f""", a AS (SELECT row_id, -1 AS ord, i AS iso, s AS shutter, i, s FROM c WHERE i > 0 AND s > 0 UNION ALL SELECT row_id, ord, iso, shutter, i, s FROM u WHERE i > 0 AND s > 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY {_SCORE.format("iso", "shutter")} DESC, {_AWAY.format("iso", "shutter")}, ord) AS k FROM a) WHERE k = 1),
o2 AS (SELECT (d + 1) * 3 + k AS ord, d * 100.0::DOUBLE AS d, CASE k WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 1.0 ELSE 1.25 END AS f FROM (SELECT unnest([-1, 0, 1]) AS d), (SELECT unnest([0, 1, 2]) AS k)),
g2 AS (SELECT row_id, o2.ord, greatest(50.0::DOUBLE, least(12800.0::DOUBLE, round_even(greatest(b.iso + d, 1), 0))) AS iso, greatest(1 / 8000.0::DOUBLE, least(30.0::DOUBLE, greatest(b.shutter * f, 1e-8::DOUBLE))) AS shutter, i, s FROM b, o2),
u2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, iso, round(shutter, 10) ORDER BY ord) AS rn FROM g2) WHERE rn = 1),
z AS (SELECT row_id, ord, iso, shutter, i, s FROM b UNION ALL SELECT row_id, ord + 9, iso, shutter, i, s FROM u2)
SELECT row_id, ord::INTEGER AS ord, iso, round(shutter, 10) + 0.0 AS shutter, score + 0.0 AS score, distance + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, distance, ord) AS k
  FROM (SELECT *, {_SCORE.format("iso", "shutter")} AS score, {_AWAY.format("iso", "shutter")} AS distance FROM z)) WHERE k = 1""")
def two_stage_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "fold_0").select("row_id", F.col("initial_metadata.iso").alias("iso0"), F.col("initial_metadata.shutter_speed_s").alias("shutter0")).where("iso0 > 0 and shutter0 > 0")
    out = search.two_stage_search(rows, "row_id", "iso0", "shutter0", lambda c: c.withColumn("score", _toy_score(F.col("iso"), F.col("shutter"))))
    return out.select("row_id", "ord", "iso", _r(F.col("shutter"), 10).alias("shutter"), _r(F.col("score"), 9).alias("score"), _r(F.col("distance"), 9).alias("distance"))


@query("""
WITH RECURSIVE b AS (SELECT row_id, initial_metadata.shutter_speed_s AS s, final_action.shutter AS t FROM experiences WHERE initial_metadata.shutter_speed_s > 0 AND final_action.shutter > 0 AND isfinite(initial_metadata.shutter_speed_s) AND isfinite(final_action.shutter)),
l AS (SELECT row_id, s AS shutter, t, 0 AS rounds, false AS good FROM b UNION ALL SELECT row_id, x, t, rounds + 1, abs(log2(x / t)) < 0.25::DOUBLE FROM (SELECT *, exp(0.7::DOUBLE * ln(t) + 0.3::DOUBLE * ln(shutter)) AS x FROM l WHERE rounds < 3 AND NOT good))
SELECT row_id, round(shutter, 8) + 0.0 AS shutter, rounds::INTEGER AS rounds, CASE WHEN good THEN 'satisfied' ELSE 'max_rounds_best_result' END AS stop_reason FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY rounds DESC) AS rn FROM l) WHERE rn = 1""")
def closed_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Shutter times drawn towards the final action round by round, until they are within a quarter stop."""
    finite = "initial_metadata.shutter_speed_s > 0 and final_action.shutter > 0 and initial_metadata.shutter_speed_s < double('infinity') and final_action.shutter < double('infinity')"
    state = table(spark, sf, "experiences").where(finite).select("row_id", F.col("initial_metadata.shutter_speed_s").alias("shutter"), F.col("final_action.shutter").alias("t"))
    near = F.abs(F.log2(F.col("shutter") / F.col("t"))) < F.lit(0.25)
    out = search.bounded_loop(state, lambda r: r.withColumn("shutter", X.geometric_blend(F.col("t"), F.col("shutter"), F.lit(0.3))), near)
    return out.select("row_id", _r(F.col("shutter"), 8).alias("shutter"), "rounds", search.stop_reason(near).alias("stop_reason"))


# --- retrieval ------------------------------------------------------------------------

_PARTS = [retrieval.Component("v", "cosine", 192, 0.35), retrieval.Component("h", "jensen_shannon", 32, 0.30), retrieval.Component("x", "euclidean", 2, 0.10, 2**0.5)]
_FULL_PARTS = [*_PARTS, retrieval.Component("q", "euclidean", 7, 0.20, 7**0.5), retrieval.Component("a", "euclidean", 2, 0.05, 2**0.5)]
_QUALITY = ("quality.brightness", "quality.noise", "quality.motion_blur", "quality.highlight", "quality.shadow", "dynamic_range", "midtone_ratio")
_FULL_ROWS_SQL = f"""
r AS (SELECT *, fixed_features.visual_embedding AS v, fixed_features.luminance_histogram AS h, [{", ".join(f"fixed_features.objective_quality.{c}" for c in _QUALITY)}] AS q,
    initial_metadata.iso::DOUBLE AS i, initial_metadata.shutter_speed_s AS t, initial_vlm_action.iso::DOUBLE AS ai, initial_vlm_action.shutter AS ts FROM experiences),
g AS (SELECT * FROM r WHERE i > 0 AND t > 0 AND isfinite(t) AND ai > 0 AND ts > 0 AND isfinite(ts) AND len(v) = 192 AND len(h) = 32
    AND list_bool_and(list_transform(list_concat(v, h, q), lambda z: z IS NOT NULL AND isfinite(z)))),
m AS (SELECT *, [CASE WHEN i > 0 THEN log2(greatest(i, 1) / 100) / 8 END, CASE WHEN t > 0 THEN log2(greatest(t, 1e-9::DOUBLE) * 60) / 16 END] AS x,
    [CASE WHEN ai / i > 0 THEN log2(ai / i) / 8 END, CASE WHEN ts / t > 0 THEN log2(ts / t) / 8 END] AS a FROM g),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda z: z * z))) AS nv, list_transform(h, lambda z: greatest(z, 1e-12::DOUBLE) / list_sum(list_transform(h, lambda y: greatest(y, 1e-12::DOUBLE)))) AS p FROM m)"""
_FULL_SCORE_SQL = """round(0.35::DOUBLE * CASE WHEN q.nv > 0 AND o.nv > 0 THEN greatest(0, least(2, 1 - list_dot_product(q.v, o.v) / (q.nv * o.nv))) ELSE 1 END
    + 0.3::DOUBLE * sqrt(greatest(0, 0.5::DOUBLE * list_sum(list_transform(list_zip(q.p, o.p), lambda z: z[1] * ln(2 * z[1] / (z[1] + z[2])) + z[2] * ln(2 * z[2] / (z[1] + z[2]))))))
    + 0.2::DOUBLE * list_distance(q.q, o.q) / sqrt(7.0::DOUBLE) + 0.1::DOUBLE * list_distance(q.x, o.x) / sqrt(2.0::DOUBLE) + 0.05::DOUBLE * list_distance(q.a, o.a) / sqrt(2.0::DOUBLE), 9) AS score"""


def _full_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Experiences with all five components; where one can't be computed it is null."""
    iso, shutter, to_iso, to_shutter = (F.col(c) for c in ("initial_metadata.iso", "initial_metadata.shutter_speed_s", "initial_vlm_action.iso", "initial_vlm_action.shutter"))
    usable = (iso > 0) & (shutter > 0) & (to_iso > 0) & (to_shutter > 0)
    return table(spark, sf, "experiences").select(
        "row_id", "run_id", "scene_id", "physical_scene_id", "dataset_split", "quality_gain", F.col("fixed_features.visual_embedding").alias("v"), F.col("fixed_features.luminance_histogram").alias("h"),
        F.array(*[F.col(f"fixed_features.objective_quality.{c}") for c in _QUALITY]).alias("q"),
        F.when(usable, X.exposure_vector(iso, shutter)).alias("x"), F.when(usable, X.action_vector(to_iso, to_shutter, iso, shutter)).alias("a"),
    )


@query(f"""WITH {_FULL_ROWS_SQL},
s AS (SELECT q.row_id AS query_id, o.row_id AS other_id, {_FULL_SCORE_SQL} FROM n q, n o
  WHERE q.row_id % 20 = 0 AND q.row_id <> o.row_id AND NOT coalesce(q.scene_id = o.scene_id, false) AND NOT coalesce(q.physical_scene_id = o.physical_scene_id, false)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, other_id) AS rank FROM s)
SELECT query_id, other_id, rank::INTEGER AS rank, round(score, 6) + 0.0 AS score FROM k WHERE rank <= 3""")
def retrieve_full_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = _full_rows(spark, sf)
    near = retrieval.weighted_neighbors(rows.where("row_id % 20 = 0"), rows, "row_id", _FULL_PARTS, 3, ("scene_id", "physical_scene_id"))
    return near.select("query_id", "other_id", "rank", r6(F.col("score")).alias("score"))


_TRAIN = ", ".join(f"'{w}'" for w in SPLIT_SYNONYMS["train"])
_NUMBER_OF = lambda text, i: f"nullif(regexp_extract_all({text}, '[0-9]+')[{i}], '')"
_UNPADDED = lambda text: f"regexp_replace({text}, '^0+([0-9])', '\\1')"


_MEMORY_SQL = f"""WITH {_FULL_ROWS_SQL},
c AS (SELECT *, coalesce(regexp_replace(lower(dataset_split), '[^a-z]+', '', 'g') IN ({_TRAIN}), false) AS train, {_UNPADDED(_NUMBER_OF("scene_id", 1))} || '_' || {_UNPADDED(_NUMBER_OF("scene_id", 2))} AS scene,
    {_UNPADDED(f"coalesce({_NUMBER_OF('physical_scene_id', 1)}, {_NUMBER_OF('scene_id', 2)})")} AS grp FROM experiences),
f AS (SELECT grp, (row_number() OVER (ORDER BY md5('42:' || grp), grp) - 1) % 4 AS fold FROM (SELECT DISTINCT grp FROM c WHERE train AND grp IS NOT NULL)),
w AS (SELECT n.*, c.train, c.scene, c.grp, CASE WHEN c.train THEN f.fold END AS fold FROM n JOIN c USING (row_id) LEFT JOIN f ON f.grp = c.grp),
s AS (SELECT q.row_id AS query_id, o.row_id AS other_id, {_FULL_SCORE_SQL} FROM w q, w o
  WHERE q.row_id % 20 = 0 AND o.train AND o.quality_gain >= 0.02 AND NOT isnan(o.quality_gain) AND q.row_id <> o.row_id {{fold}}
    AND NOT coalesce(q.scene = o.scene, false) AND NOT coalesce(q.grp = o.grp, false) AND NOT coalesce(q.run_id = o.run_id, false)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, other_id) AS rank FROM s)
"""
_TOP = "SELECT query_id, other_id, rank::INTEGER AS rank, round(score, 6) + 0.0 AS score FROM k WHERE rank <= 3"
_APART = ("scene", "grp", "run_id")


def _memory_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _full_rows(spark, sf).withColumns({"train": F.coalesce(split_name(F.col("dataset_split")) == "train", F.lit(False)), "scene": scene_key(F.col("scene_id")), "grp": physical_key(F.col("physical_scene_id"), F.col("scene_id"))})


_USEFUL = "train and quality_gain >= 0.02 and not isnan(quality_gain)"


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest useful training rows of another scene, physical scene and run."""
    rows = materialize(_memory_rows(spark, sf))
    return retrieval.weighted_neighbors(rows.where("row_id % 20 = 0"), rows.where(_USEFUL), "row_id", _FULL_PARTS, 3, _APART)


@query(_MEMORY_SQL.format(fold="") + _TOP)
def retrieve_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).select("query_id", "other_id", "rank", r6(F.col("score")).alias("score"))


_WEIGHTS = {"visual": 0.35, "histogram": 0.30, "quality": 0.20, "exposure": 0.10, "initial_action": 0.05}


@query(_MEMORY_SQL.format(fold="") + """SELECT query_id, arg_min(other_id, rank) AS best_id, string_agg(other_id, ',' ORDER BY rank) AS others, arg_min(coalesce(label_source, '-'), rank) AS best_source,
  string_agg(coalesce(final_action.iso::VARCHAR, '-'), ',' ORDER BY rank) AS isos, 1.0::DOUBLE AS weight FROM k JOIN experiences e ON e.row_id = other_id WHERE rank <= 3 GROUP BY query_id""")
def retrieve_context(spark: SparkSession, sf: str) -> DataFrame:
    """What a query is told: its neighbours with the fields of their rows, the best one, the weights."""
    told = ("scene_id", "physical_scene_id", "cross_fold", "run_id", "initial_metadata", "final_metadata", "initial_vlm_action", "integrated_vlm_action", "final_action", "quality_before", "quality_after", "quality_gain", "successful", "label_source")
    c = retrieval.context(_ranked(spark, sf), table(spark, sf, "experiences"), "row_id", told, _WEIGHTS)
    listed = lambda f: F.array_join(F.transform("examples", f), ",")
    return c.select(
        "query_id", F.col("best.other_id").alias("best_id"), listed(lambda e: e["other_id"].cast("string")).alias("others"), F.coalesce("best.label_source", F.lit("-")).alias("best_source"),
        listed(lambda e: F.coalesce(e["final_action"]["iso"].cast("string"), F.lit("-"))).alias("isos"), r6(F.aggregate(F.map_values("distance_weights"), F.lit(0.0), lambda a, w: a + w)).alias("weight"),
    )


@query(f"""WITH {_FULL_ROWS_SQL},
s AS (SELECT q.row_id AS query_id, o.row_id AS other_id, {_FULL_SCORE_SQL} FROM n q, n o WHERE q.row_id % 20 = 0 AND q.row_id <> o.row_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, other_id) AS rank FROM s)
SELECT count(*) AS checked, count(*) FILTER (a.physical_scene_id = b.physical_scene_id) AS leaking FROM k JOIN experiences a ON a.row_id = query_id JOIN experiences b ON b.row_id = other_id WHERE rank <= 3""")
def leakage_check(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours by a search that isolates nothing, and those among them that share their query's physical scene."""
    rows = materialize(_full_rows(spark, sf))
    ranked = materialize(retrieval.weighted_neighbors(rows.where("row_id % 20 = 0"), rows, "row_id", _FULL_PARTS, 3))
    found = retrieval.leaks(ranked, table(spark, sf, "experiences"), "row_id", "physical_scene_id").agg(F.count("*").alias("leaking"))
    return ranked.agg(F.count("*").alias("checked")).crossJoin(found)  # one row each


@query(_MEMORY_SQL.format(fold="AND (q.fold IS NULL OR coalesce(q.fold <> o.fold, false))") + _TOP)
def crossfold_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours among useful training rows: of other folds for training rows, of all for held-out ones."""
    rows = _memory_rows(spark, sf)
    folds = splits.cross_folds(rows.where("train"), "grp").withColumn("train", F.lit(True))
    rows = materialize(rows.join(folds, ["grp", "train"], "left"))
    near = retrieval.crossfold_neighbors(rows.where("row_id % 20 = 0"), rows.where(_USEFUL), "row_id", _FULL_PARTS, 3, "fold", _APART)
    return near.select("query_id", "other_id", "rank", r6(F.col("score")).alias("score"))


@query("""
WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda z: z::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, o.vec_id AS other_id, round(1 - list_dot_product(q.v, o.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(o.v, o.v))), 9) AS score FROM n q, n o WHERE q.vec_id % 20 = 0 AND q.vec_id <> o.vec_id AND NOT coalesce(q.label = o.label, false)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, other_id) AS rank FROM s)
SELECT query_id, other_id, rank::INTEGER AS rank, round(score, 6) + 0.0 AS score FROM k WHERE rank <= 5""")
def embedding_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    near = retrieval.weighted_neighbors(rows.where("vec_id % 20 = 0"), rows, "vec_id", [retrieval.Component("embedding", "cosine", 64, 1.0)], 5, ("label",))
    return near.select("query_id", "other_id", "rank", r6(F.col("score")).alias("score"))


# --- training rows, decisions, streams -------------------------------------------------


@query("""
SELECT row_id, o AS "offset", round(final_action.shutter * 2.0::DOUBLE ** o, 10) + 0.0 AS shutter, o = 0 AS own_image FROM fold_0, (SELECT unnest([-1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE]) AS o)""")
def exposure_variants(spark: SparkSession, sf: str) -> DataFrame:
    out = labels.exposure_variants(table(spark, sf, "fold_0"), "row_id", F.col("final_action.shutter"))
    return out.select("row_id", "offset", _r(F.col("shutter"), 10).alias("shutter"), "own_image")


@query("""
SELECT example_id, min(row_id) AS row_id FROM (SELECT row_id, substr(sha256(concat_ws(chr(31), coalesce(run_id, chr(9216)), coalesce(scene_id, chr(9216)), coalesce(cross_fold::VARCHAR, chr(9216)))), 1, 20) AS example_id FROM fold_0) GROUP BY example_id""")
def example_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "fold_0").select("row_id", X.stable_id(F.col("run_id"), F.col("scene_id"), F.col("cross_fold")).alias("example_id"))
    return rows.groupBy("example_id").agg(F.min("row_id").alias("row_id"))


@query("SELECT row_id, coalesce(label_source, '') || ' at ' || coalesce(final_action.iso::VARCHAR, '?') AS answer FROM experiences")
def chat_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Chat rows made of experiences, and the answer read back from each."""
    answer = F.concat(F.coalesce("label_source", F.lit("")), F.lit(" at "), F.coalesce(F.col("final_action.iso").cast("string"), F.lit("?")))
    row = decisions.chat_row(F.lit("Set the exposure."), F.col("original_image_path"), F.coalesce("scene_id", F.lit("unknown scene")), answer)
    content = decisions.last_answer(row)
    return table(spark, sf, "experiences").select("row_id", F.get(F.from_json(content, "array<struct<type string, value string>>"), F.lit(0))["value"].alias("answer"))


@query("""
SELECT row_id, stage, final_action.iso AS iso, round(final_action.shutter, 8) + 0.0 AS shutter, original_image_path AS image FROM experiences, (SELECT unnest(['initial', 'integration']) AS stage)
WHERE final_action.iso >= 1 AND final_action.shutter > 0 AND isfinite(final_action.shutter) AND initial_metadata IS NOT NULL AND original_image_path IS NOT NULL""")
def memory_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Chat rows of every experience, and what the answer and the question of each hold, read back from the text."""
    rows = labels.memory_examples(table(spark, sf, "experiences"))
    return rows.select(
        "row_id", "stage", F.get_json_object("messages", "$[2].content[0].value").alias("a"), F.get_json_object("messages", "$[1].content[0].value").alias("image"),
    ).select("row_id", "stage", F.get_json_object("a", "$.action.ISO").cast("int").alias("iso"), _r(F.get_json_object("a", "$.action.Shutter").cast("double"), 8).alias("shutter"), "image")


@query("""
SELECT coalesce(CASE WHEN initial_vlm_action IS NULL OR initial_vlm_action.iso IS NULL OR initial_vlm_action.shutter IS NULL THEN 'no absolute action'
  WHEN initial_vlm_action.iso < 1 OR initial_vlm_action.shutter <= 0 OR isnan(initial_vlm_action.shutter) THEN 'action out of range' END, 'fine') AS verdict, count(*) AS n FROM experiences GROUP BY 1""")
def decision_checks(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("initial_vlm_action").alias("action"), F.lit("x").alias("reason"))), F.lit("\n```"))
    parsed = table(spark, sf, "experiences").select(decisions.parse_decision(raw).alias("p"))
    return parsed.groupBy(F.coalesce("p.error", F.lit("fine")).alias("verdict")).agg(F.count("*").alias("n"))


@query("""
SELECT date_trunc('day', recorded_at)::TIMESTAMP AS window_start, label_source, count(*) AS rows, round(avg(CASE WHEN NOT isnan(quality_gain) THEN quality_gain END), 10) + 0.0 AS mean_gain
FROM fold_0 WHERE recorded_at IS NOT NULL GROUP BY ALL""")
def streamed_gains(spark: SparkSession, sf: str) -> DataFrame:
    """Daily gains of the fold rows read as a stream; the result has one row a day and source."""
    schema = table(spark, sf, "fold_0").schema
    name = f"gains_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(f"{sf}/fold_0.parque[t]")
    gains = memory.windowed_gains(stream, "recorded_at", "label_source", evaluate.number(F.col("quality_gain")))
    gains.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{shared_dir(spark)}/{name}").start().awaitTermination()
    return spark.table(name).select("window_start", "label_source", "rows", _r(F.col("mean_gain"), 10).alias("mean_gain"))
