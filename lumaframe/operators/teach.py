"""Labels for training from search on rendered frames, and the batch that prepares them.

A frame is rendered at several exposure offsets; each variant is measured, gets the
rule's proposal, and is searched around it in two stages by rendering and measuring
every candidate.  Pixels stay in Arrow batches beside their row: the only shuffles are
those of the retrieval.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import exprs as X
from lumaframe.operators import images, order, splits
from lumaframe.operators.search import COARSE, FINE
from lumaframe.operators.skew import hot_key_join
from lumaframe.session import materialize

GAIN = 0.02  # least gain of a useful label
_FOUND = "best_iso double, best_shutter double, best_quality double, candidates int"


def _variants(frames: np.ndarray, c: dict[str, np.ndarray]) -> np.ndarray:
    """Each frame at its offset in stops; an offset of zero is the frame itself."""
    return np.stack([f if not o else images.render(f, i, s, i, s * 2.0**o) for f, i, s, o in zip(frames, c["iso"], c["shutter"], c["offset"])])


def _cells(iso: float, shutter: float, stage: tuple) -> list[tuple[float, float]]:
    step, factors = stage
    low, high = X.SHUTTER_RANGE
    made = [(float(np.clip(np.rint(max(iso + d * step, 1.0)), *X.ISO_RANGE)), float(np.clip(max(shutter * f, 1e-8), low, high))) for d in (-1, 0, 1) for f in factors]
    kept: dict[tuple, tuple[float, float]] = {}
    for cell in made:
        kept.setdefault((cell[0], round(cell[1], 10)), cell)
    return list(kept.values())


def search_frame(frame: np.ndarray, iso: float, shutter: float, to_iso: float, to_shutter: float) -> tuple[float, float, float, int]:
    """(iso, shutter, quality, candidates): the best settings near a proposal, measured on renderings.

    The frame's own settings compete too.  Ties in quality to 9 decimals go to the
    settings nearest to the proposal, then to the earlier candidate.
    """
    seen: dict[tuple, tuple[float, float, float]] = {}

    def score(cells: list[tuple[float, float]]) -> None:
        fresh = [x for x in cells if (x[0], round(x[1], 10)) not in seen]
        if fresh:
            got = images.quality_of(np.stack([images.render(frame, iso, shutter, *x) for x in fresh]))["overall_quality"]
            seen.update({(x[0], round(x[1], 10)): (*x, float(q)) for x, q in zip(fresh, got)})

    def best() -> tuple[float, float, float]:
        away = lambda x: abs(np.log2(x[0] / to_iso)) + abs(np.log2(x[1] / to_shutter))
        return min(seen.values(), key=lambda x: (-round(x[2], 9), round(away(x), 9)))

    score([(iso, shutter), *_cells(to_iso, to_shutter, COARSE)])
    near = best()
    score(_cells(near[0], near[1], FINE))
    return (*best(), len(seen))


def _searched(frames: np.ndarray, c: dict[str, np.ndarray]) -> list[np.ndarray]:
    frames = _variants(frames, c)
    out = []
    for f, i, s, o, ti, ts, good, q in zip(frames, c["iso"], c["shutter"], c["offset"], c["start_iso"], c["start_shutter"], c["acceptable"], c["overall_quality"]):
        out.append((i, s * 2.0**o, q, 0) if good else search_frame(f, i, s * 2.0**o, ti, ts))
    return [np.array(x) for x in zip(*out)]


def _usable(rows: DataFrame, key: str, pixels: str, iso: Column, shutter: Column, keep: tuple[str, ...]) -> DataFrame:
    inf = F.lit(float("inf"))
    picked = rows.select(F.col(key).cast("bigint").alias(key), *keep, F.col(pixels).cast("array<double>").alias("px"), iso.cast("double").alias("iso"), shutter.cast("double").alias("shutter"))
    return picked.where((F.col("iso") >= 1) & (F.col("shutter") > 0) & (F.col("shutter") < inf))


def _measured(variants: DataFrame, side: tuple[int, int]) -> DataFrame:
    names = [c.split()[0] for c in images.REPORT.split(",")]

    def work(frames: np.ndarray, c: dict[str, np.ndarray]) -> list[np.ndarray]:
        report = images.quality_of(_variants(frames, c))
        return [report[n] for n in names]

    out = images.with_frames(variants, "px", *side, images.REPORT, work)
    r = {n: F.col(n) for n in names}
    unmet = X.unmet_criteria(r["shadow"], r["highlight"], r["midtone_ratio"], r["dynamic_range"], r["noise"], r["motion_blur"], r["sharpness_confidence"], r["overall_quality"])
    return out.withColumn("acceptable", F.size(unmet) == 0)


def _audit(searched: DataFrame, key: str, keep: tuple[str, ...], *more: str) -> DataFrame:
    at = F.col("shutter") * F.pow(F.lit(2.0), F.col("offset"))
    gain = F.when(F.col("acceptable"), 0.0).otherwise(F.col("best_quality") - F.col("overall_quality"))
    return searched.select(
        key, *keep, "offset", "iso", at.alias("shutter"), "acceptable", F.col("overall_quality").alias("quality_before"), "start_iso", "start_shutter", "best_iso", "best_shutter", F.col("best_quality").alias("quality_after"),
        "candidates", gain.alias("quality_gain"), (F.col("acceptable") | (gain >= GAIN)).alias("valid"), F.coalesce(X.is_effective(F.col("iso"), at, F.col("best_iso"), F.col("best_shutter")), F.lit(False)).alias("effective"), *more,
    )


def pseudo_labels(rows: DataFrame, key: str, pixels: str, side: tuple[int, int], iso: Column, shutter: Column, keep: tuple[str, ...] = (), offsets: tuple[float, ...] = (-1.0, 0.0, 1.0)) -> DataFrame:
    """One audit row per frame and offset: settings, measured quality, proposal, what the search found, and whether it is a label.

    Frames that are acceptable keep their settings; all others are searched around the
    rule's proposal.  Rows without usable pixels, ISO or shutter are left out.
    """
    base = _usable(rows, key, pixels, iso, shutter, keep).withColumn("offset", F.explode(F.array(*[X.lit(o) for o in offsets])))
    measured = _measured(base, side)
    c = F.col
    to_iso, to_shutter = X.heuristic_action(c("shadow"), c("highlight"), c("midtone_ratio"), c("noise"), c("motion_blur"), c("sharpness_confidence"), c("iso"), c("shutter") * F.pow(F.lit(2.0), c("offset")))
    start = X.apply_action(to_iso, to_shutter)
    started = measured.withColumns({"start_iso": start[0].cast("double"), "start_shutter": start[1].cast("double")})
    return _audit(images.with_frames(started, "px", *side, _FOUND, _searched), key, keep)


def integrated_labels(rows: DataFrame, neighbors: DataFrame, memory: DataFrame, key: str, pixels: str, side: tuple[int, int], iso: Column, shutter: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Audit rows whose search starts between the rule's proposal and the best retrieved action.

    ``neighbors``: ``query_id, other_id, rank, score``, whose query ids are keys of ``rows``;
    ``memory`` has ``final_action`` and ``quality_gain`` for the others.  The weight of what was
    retrieved falls with its distance and grows with its gain.  Rows without a neighbour
    are left out (nothing is to be integrated).
    """
    best = neighbors.where("rank = 1").select("query_id", "other_id", "score")
    told = memory.select(F.col(key).alias("other_id"), F.col("final_action.iso").cast("double").alias("near_iso"), F.col("final_action.shutter").alias("near_shutter"), F.col("quality_gain").alias("near_gain"))
    best = materialize(hot_key_join(best, told, "other_id").where("near_iso > 0 and near_shutter > 0").withColumnRenamed("query_id", key).select(key, "other_id", "score", "near_iso", "near_shutter", "near_gain"))
    base = _usable(rows, key, pixels, iso, shutter, keep).join(best, key).withColumn("offset", X.lit(0))
    c = F.col
    measured = _measured(base, side)
    to_iso, to_shutter = X.heuristic_action(c("shadow"), c("highlight"), c("midtone_ratio"), c("noise"), c("motion_blur"), c("sharpness_confidence"), c("iso"), c("shutter"))
    weight = X.blend_weight(c("score"), F.coalesce(c("near_gain"), X.lit(0)))
    mixed = X.apply_action(X.geometric_blend(to_iso.cast("double"), c("near_iso"), weight), X.geometric_blend(to_shutter, c("near_shutter"), weight))
    started = measured.withColumn("weight", weight).withColumns({"start_iso": mixed[0].cast("double"), "start_shutter": mixed[1].cast("double")})
    return _audit(images.with_frames(started, "px", *side, _FOUND, _searched), key, keep, "other_id", "score", "weight")


def experiences_of(audit: DataFrame, key: str, split: str, group: str) -> DataFrame:
    """Memory rows of an audit: valid training labels with enough gain, the best variant of each frame."""
    useful = audit.where((F.col(split) == "train") & F.col("valid") & (F.col("quality_gain") >= GAIN))
    best = order.argmax_first(useful, [key], F.col("quality_gain"), F.abs("offset"), F.col("offset"))
    action = F.struct(F.col("best_iso").cast("int").alias("iso"), F.col("best_shutter").alias("shutter"))
    return best.select(key, group, split, "offset", action.alias("final_action"), "quality_before", "quality_after", "quality_gain", F.lit("local_search_best").alias("label_source"))


def prepared(rows: DataFrame, key: str, group: str, pixels: str, side: tuple[int, int], iso: Column, shutter: Column, seed: int = 42, folds: int = 4) -> dict[str, DataFrame]:
    """The whole batch: group splits, folds of the training groups, labels of all frames, memory, counts.

    Everything keeps groups apart: a row's split and fold are those of its group; rows without a
    group take no part.
    """
    assigned = materialize(splits.grouped_split(rows, group, seed))
    numbered = materialize(splits.cross_folds(assigned.where("split = 'train'"), group, folds, seed))
    placed = hot_key_join(hot_key_join(rows, assigned, group), numbered, group, how="left")
    audit = materialize(pseudo_labels(placed, key, pixels, side, iso, shutter, (group, "split", "fold")))
    memory = experiences_of(audit, key, "split", group)
    counts = audit.groupBy("split").agg(F.count("*").alias("labels"), F.count_if("valid").alias("valid"), F.count_if("effective").alias("effective"), F.count_distinct(key).alias("frames"), F.count_distinct(group).alias("groups"), F.avg("quality_gain").alias("mean_gain"))
    return {"splits": assigned, "folds": numbered, "labels": audit, "memory": memory, "summary": counts}
