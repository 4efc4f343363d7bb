"""Training rows from runs: variants, examples, chat rows, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import decisions
from lumaframe.functions.exprs import lit, stable_id


def exposure_variants(rows: DataFrame, key: str, shutter: Column, offsets: tuple[float, ...] = (-1.0, 0.0, 1.0)) -> DataFrame:
    """(key, offset, shutter, own_image): each row at every offset in stops.

    An offset of zero reuses the row's own image.  Offsets beyond three stops raise.
    """
    if not offsets or any(abs(o) > 3 for o in offsets):
        raise ValueError("offsets must be given and lie within three stops")
    each = rows.select(F.col(key), shutter.cast("double").alias("_s")).withColumn("offset", F.explode(F.array(*[lit(o) for o in offsets])))
    return each.select(key, "offset", (F.col("_s") * F.pow(lit(2), F.col("offset"))).alias("shutter"), (F.abs("offset") < 1e-12).alias("own_image"))


def parse_offsets(text: str) -> tuple[float, ...]:
    """A comma list of offsets; blank parts are passed over."""
    out = tuple(float(p) for p in text.split(",") if p.strip())
    if not out or any(not abs(o) <= 3 for o in out):
        raise ValueError(f"no offsets within three stops: {text!r}")
    return out


def two_stage_examples(iterations: DataFrame) -> DataFrame:
    """Two rows per iteration, one for each stage, with a stable example id."""
    staged = iterations.withColumn("stage", F.explode(F.array(F.lit("initial"), F.lit("integration"))))
    return staged.withColumn("example_id", stable_id(F.col("run_key"), F.col("iteration_no"), F.col("stage"), F.col("iso_value"), F.col("reason_text")))


def run_reports(runs: DataFrame, iterations: DataFrame) -> DataFrame:
    """(run_key, rounds, report, markdown): each run's rounds in order, as JSON and text.

    Where ``iterations`` has the column ``details`` of ``flatten_runs``, rounds hold
    feedback, decisions, search, quality and what was retrieved too.  A run without
    rounds has an empty list.  A run's rounds are few by nature, so they are gathered
    per run.
    """
    detailed = "details" in iterations.columns
    item = F.struct("iteration_no", "iteration_id", "iso_value", "reason_text", F.coalesce("stop_reason", F.lit("")).alias("stop_reason"))
    plain = F.to_json(item)
    whole = F.col("_plain") if not detailed else F.concat(F.expr("left(_plain, length(_plain) - 1)"), F.lit(","), F.substr("details", F.lit(2)))
    told = lambda path, none: F.coalesce(F.get_json_object("details", path), F.lit(none))
    lines = [F.lit("- "), F.col("iteration_no").cast("string"), F.lit(": ISO "), F.col("iso_value").cast("string"), F.lit(", "), F.col("reason_text")]
    if detailed:
        lines += [
            F.lit("\n  - feedback: "), told("$.previous_round_feedback", "none, original input"), F.lit("\n  - first decision: "), told("$.vlm_first_recommendation", "none"),
            F.lit("\n  - RAG: "), told("$.rag_retrieval.best_experience", "no experience retrieved"), F.lit("\n  - integrated decision: "), told("$.vlm_experience_integrated_recommendation", "none"),
            F.lit("\n  - final action: "), told("$.final_action", "none"), F.lit("\n  - quality: "), told("$.objective_quality", "none"), F.lit("\n  - gain: "), told("$.quality_gain_from_original", "unknown"),
        ]
    rounds = iterations.withColumn("_plain", plain).select("run_key", F.struct("iteration_no", "iteration_id", whole.alias("json"), F.concat(*lines).alias("text")).alias("step"))
    rounds = rounds.groupBy("run_key").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    joined = runs.select("run_key", "run_id", F.col("stop_reason").alias("stopped")).join(rounds, "run_key", "left")
    steps = F.coalesce("steps", F.array().cast("array<struct<iteration_no:int,iteration_id:string,json:string,text:string>>"))
    text = F.concat(F.lit("## "), F.coalesce("run_id", F.lit("")), F.lit("\n"), F.array_join(F.transform(steps, lambda s: s["text"]), "\n"))
    head = F.to_json(F.struct(F.coalesce("run_id", F.lit("")).alias("run_id"), F.coalesce("stopped", F.lit("")).alias("stopped")))
    report = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"rounds":['), F.array_join(F.transform(steps, lambda s: s["json"]), ","), F.lit("]}"))
    return joined.select("run_key", F.size(steps).alias("rounds"), report.alias("report"), text.alias("markdown"))


def memory_examples(memory: DataFrame) -> DataFrame:
    """Two chat rows for every row of a memory: the first question, and the one with what was retrieved.

    Input: experience rows with ``row_id``.  Output: ``row_id, stage, example_id,
    dataset_split, messages``.  Rows without a usable final action, starting settings or
    image path give none.  All of it is one projection and one explode.
    """
    iso, shutter = F.col("final_action.iso"), F.col("final_action.shutter")
    usable = (iso >= 1) & (shutter > 0) & (shutter < lit(float("inf"))) & F.col("initial_metadata").isNotNull() & F.col("original_image_path").isNotNull()
    rows = memory.where(F.coalesce(usable, F.lit(False)))
    action = F.struct(iso.alias("ISO"), shutter.alias("Shutter"))
    first = F.to_json(F.struct(F.struct(F.col("initial_vlm_action.iso").alias("ISO"), F.col("initial_vlm_action.shutter").alias("Shutter")).alias("action")))
    meta, features = F.col("initial_metadata"), F.col("fixed_features")
    prompts = F.array(
        F.struct(F.lit("initial").alias("stage"), decisions.initial_prompt(meta, features, None).alias("question")),
        F.struct(F.lit("integration").alias("stage"), decisions.integration_prompt(meta, features, first, None, None).alias("question")),
    )
    staged = rows.withColumn("_p", F.explode(prompts))
    ids = decisions.example_id(
        cross_fold=F.col("cross_fold"), feedback_image_path=F.lit(None).cast("string"), image_path=F.col("original_image_path"), metadata=meta, physical_scene_id=F.col("physical_scene_id"),
        quality_calibration_version=F.col("quality_after.calibration_version"), scene_id=F.col("scene_id"), simulator_version=F.col("simulator_version"), source=F.col("label_source"),
        split=F.col("dataset_split"), stage=F.col("_p.stage"), target_action=action,
    )
    answer = F.to_json(F.struct(F.col("quality_after.quality").alias("quality"), action.alias("action"), F.lit(False).alias("continue"), F.col("label_source").alias("reason")))
    chat = decisions.chat_row(F.lit("You set the exposure of a camera. Answer in JSON."), F.col("original_image_path"), F.col("_p.question"), answer)
    return staged.select("row_id", F.col("_p.stage").alias("stage"), ids.alias("example_id"), "dataset_split", chat.alias("messages"))
