"""Reading and checking model decisions; prompts as columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaframe.functions.exprs import resolve_path, strip_fence
from lumaframe.schemas import DECISION


def parse_decision(raw: Column) -> Column:
    """struct<decision, error> of a model's answer, fenced or not.

    The error is null for a decision whose action holds an ISO of at least 1 and a
    positive shutter; quality values must lie in [0, 1] where given.
    """
    text = strip_fence(raw)
    d = F.from_json(text, DECISION)
    iso, shutter = d["action"]["iso"], d["action"]["shutter"]
    quality = d["quality"]
    fields = ("brightness", "noise", "motion_blur", "highlight", "shadow", "overall_quality")
    off = F.lit(False)
    for f in fields:
        off = off | F.coalesce((quality[f] < 0) | (quality[f] > 1) | F.isnan(quality[f]), F.lit(False))
    error = (
        F.when(raw.isNull(), F.lit("no answer"))
        .when(F.try_parse_json(text).isNull(), F.lit("not JSON"))
        .when(d["action"].isNull() | iso.isNull() | shutter.isNull(), F.lit("no absolute action"))
        .when((iso < 1) | (shutter <= 0) | F.isnan(shutter), F.lit("action out of range"))
        .when(off, F.lit("quality out of range"))
    )
    return F.struct(F.when(error.isNull(), d).alias("decision"), error.alias("error"))


def chat_content(image: Column, text: Column) -> Column:
    """User content as typed items: the image where there is one, then the text."""
    item = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    return F.array_compact(F.array(F.when(image.isNotNull(), item("image", image)), item("text", text)))


def chat_row(system: Column, image: Column, question: Column, answer: Column) -> Column:
    """A training conversation as JSON: system, user with image and text, assistant."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.array(message("system", chat_content(F.lit(None).cast("string"), system)), message("user", chat_content(image, question)), message("assistant", chat_content(F.lit(None).cast("string"), answer))))


def last_answer(messages: Column) -> Column:
    """The content of the last message of a JSON list if an assistant sent it, else null."""
    rows = F.from_json(messages, "array<struct<role string, content string>>")
    last = F.try_element_at(rows, F.lit(-1))
    return F.when(last["role"] == "assistant", last["content"])


# Roles of a conversation.
ROLES = ("system", "user", "assistant")
#: Fields that tell one training example from another.
IDENTITY = (
    "cross_fold", "feedback_image_path", "image_path", "metadata", "physical_scene_id", "quality_calibration_version", "scene_id", "simulator_version", "source", "split", "stage", "target_action",
)
RULES = (
    "Answer with one JSON object and nothing else.",
    "ISO and Shutter are the settings to take, not changes to the present ones.",
    "Leave EV out: it follows from ISO and shutter.",
    "A higher ISO costs noise, a longer shutter costs sharpness.",
    "Repeat the present settings if nothing should change.",
)
SCHEMA = {"quality": {f: "0..1" for f in ("brightness", "noise", "motion_blur", "highlight", "shadow", "overall_quality")}, "action": {"ISO": "whole number from 1", "Shutter": "seconds above 0"}, "continue": "true or false", "reason": "text"}


def example_id(**fields: Column) -> Column:
    """20 hex digits of the SHA-256 of an example's ``IDENTITY`` fields as JSON in the order of their names."""
    if set(fields) != set(IDENTITY):
        raise ValueError(f"an example is told by {IDENTITY}")
    whole = F.to_json(F.struct(*[fields[f].alias(f) for f in IDENTITY]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(whole, 256), 1, 20)


def _raw(text: Column | None) -> Column:
    """A JSON text as it stands, or null."""
    return F.lit("null") if text is None else F.coalesce(text, F.lit("null"))


def _prompt(stage: str, task: str, feedback: Column | None, members: dict[str, Column]) -> Column:
    order = F.lit('["original"]') if feedback is None else F.when(feedback.isNull(), '["original"]').otherwise('["original","previous_result"]')
    head = {"stage": F.lit(json.dumps(stage)), "task": F.lit(json.dumps(task)), "image_order": order, "rules": F.lit(json.dumps(RULES)), "required_schema": F.lit(json.dumps(SCHEMA))}
    parts = {**head, **members, "previous_round_feedback": _raw(feedback)}
    pieces = [F.concat(F.lit(("," if i else "{") + json.dumps(k) + ":"), v) for i, (k, v) in enumerate(parts.items())]
    return F.concat(*pieces, F.lit("}"))


def _struct(value: Column) -> Column:
    return F.coalesce(F.to_json(value, {"ignoreNullFields": "false"}), F.lit("null"))


def initial_prompt(metadata: Column, features: Column, feedback: Column | None) -> Column:
    """The first question to a model as JSON: settings and features of the frame, and the last round's outcome if there is one."""
    members = {"initial_metadata": _struct(metadata), "fixed_scene_features": _struct(features)}
    return _prompt("initial", "Propose ISO and shutter for the frame from its picture and features.", feedback, members)


def integration_prompt(metadata: Column, features: Column, decision: Column, context: Column | None, feedback: Column | None) -> Column:
    """The second question: the first answer is to be weighed against what was retrieved (both JSON texts)."""
    members = {"initial_metadata": _struct(metadata), "fixed_scene_features": _struct(features), "first_decision": _raw(decision), "retrieved_experience": _raw(context)}
    return _prompt("integration", "Weigh the first proposal against settings that did well on frames like this one.", feedback, members)


def best_action(context: Column) -> Column:
    """struct<iso, shutter> of the best experience in a retrieval context, else of its first example; null if neither can be read."""
    read = lambda at: F.from_json(F.get_json_object(context, f"$.{at}.final_action"), "ISO string, Shutter string")
    for_ = lambda a: F.struct(a["ISO"].try_cast("int").alias("iso"), a["Shutter"].try_cast("double").alias("shutter"))
    fine = lambda x: (x["iso"] >= 1) & (x["shutter"] > 0)
    tried = [for_(read("best_experience")), for_(read("examples[0]"))]
    return F.coalesce(*[F.when(fine(x), x) for x in tried])


def normalized_messages(messages: Column, base: str) -> Column:
    """struct<messages, error>: a conversation with typed content and whole image paths.

    Content may be a text or a list of items that hold an image or a text; relative image
    paths are taken from ``base``.  The error names the first thing wrong, and the
    messages are null then.
    """
    rows = F.from_json(messages, "array<struct<role string, content string>>")
    item = F.struct
    listed = lambda c: F.from_json(c, "array<struct<image string, text string>>")
    typed = lambda i: F.when(i["image"].isNotNull(), item(F.lit("image").alias("type"), resolve_path(i["image"], base).alias("value"))).when(i["text"].isNotNull(), item(F.lit("text").alias("type"), i["text"].alias("value")))
    content = lambda c: F.when(F.ltrim(c).startswith("["), F.transform(listed(c), typed)).otherwise(F.array(item(F.lit("text").alias("type"), c.alias("value"))))
    whole = F.transform(rows, lambda m: item(m["role"].alias("role"), content(m["content"]).alias("content")))
    bad_role = F.exists(rows, lambda m: m.isNull() | m["role"].isNull() | ~m["role"].isin(*ROLES))
    bad_item = F.exists(whole, lambda m: m["content"].isNull() | F.exists(m["content"], lambda i: i.isNull() | i["value"].isNull()))
    error = F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, "no list of messages").when(F.coalesce(bad_role, F.lit(True)), "unknown role").when(F.coalesce(bad_item, F.lit(True)), "unknown content")
    return item(F.when(error.isNull(), whole).alias("messages"), error.alias("error"))


def search_summary(trace: Column) -> Column:
    """What is kept of a search's JSON: kind, counts, qualities and best action; null if it was not enabled."""
    kept = ("search_type", "candidate_count", "baseline_quality", "best_quality", "best_gain", "best_action", "best_candidate")
    own = F.struct(*[F.get_json_object(trace, f"$.{k}").alias(k) for k in kept])
    return F.when(F.coalesce(F.get_json_object(trace, "$.enabled") == "true", F.lit(False)), own)
