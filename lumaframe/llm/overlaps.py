"""Evaluation records that also appear, exactly or nearly, in the training split."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions.labels import scene_key, split_name
from lumaframe.llm.vectors import NearKernel, bucket_entries, sample_vectors, sliced, threshold_index, vector_rows
from lumaframe.operators.blocks import stream_blocks
from lumaframe.operators.skew import hot_key_join, product_join
from lumaframe.session import materialize, release

ROWS_PER_SLICE = 50_000


def _side(rows: DataFrame, train: bool) -> DataFrame:
    side = F.col("_split") == "train" if train else F.col("_split").isin("validation", "test")
    return rows.where(side)


_PAIRS = "rep_eval bigint, rep_train bigint, cosine double"


def _classes(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per side and distinct vector, one row per record with its class)."""
    train = (F.col("_split") == "train").cast("int").alias("train")
    classes = materialize(points.select("h1", "h2", "vec", "row_id", train).groupBy("train", "h1", "h2").agg(F.min("row_id").alias("rep"), F.first("vec").alias("vec")))
    same = F.concat_ws("_", "train", "h1", "h2").alias("same")
    reps = materialize(classes.select(same, "rep"))
    marked = points.withColumn("train", train).select("row_id", "_split", "_scene", same)
    members = materialize(hot_key_join(marked, reps, "same").drop("same"))
    release(reps)
    return classes, members


def near_classes(rows: DataFrame, least: float, dim: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """Usable rows with their exact class, and class pairs (evaluation, train) that are near.

    A vector's words are the signs of its centred projections on random orthonormal
    directions; each table takes some of them as one n-gram, whose hash names a
    bucket.  Evaluation n-grams are partitioned, training vectors scanned past them,
    and hits checked in floats.  ``containment`` is the share of the evaluation
    record's n-grams that the training record has too.  The n-grams get longer with the
    rows and as many as keep the share of missed pairs below ``miss``.
    """
    points = materialize(vector_rows(rows, F.col("fixed_features.visual_embedding"), dim, F.col("_split"), F.col("_scene")))
    classes, members = _classes(points)
    release(points)
    index = threshold_index(sample_vectors(classes, dim), classes.count(), dim, least, miss)
    entries = bucket_entries(classes, index, dim, extra="train")
    asking, scanned = entries.where("train = 0").drop("train"), entries.where("train = 1").drop("train")
    hits = stream_blocks(asking, scanned, partial(NearKernel, least), _PAIRS, dim, fixed=True)
    pairs = materialize(hits.groupBy("rep_eval", "rep_train").agg(F.max("cosine").alias("cosine"), (F.count("*") / F.lit(float(index.tables))).alias("containment")))
    release(classes)
    return members, pairs


def _read(rows: DataFrame) -> DataFrame:
    read = rows.select("row_id", "fixed_features", split_name(F.col("dataset_split")).alias("_split"), scene_key(F.col("scene_id")).alias("_scene"))
    return read.where(F.col("_split").isNotNull() & F.col("row_id").isNotNull())


def overlap_classes(rows: DataFrame, least: float = 0.99, dim: int = 192, miss: float = 4e-4) -> tuple[DataFrame, DataFrame]:
    """Near-same records without any pair spelt out: ``(membership, links)``.

    ``membership``: ``row_id, split, class_id`` of every usable record, class_id the least
    row_id of the records of its side (train or evaluation) with that very vector.
    ``links``: ``eval_class, train_class, cosine, containment`` between classes.  Whoever
    needs pairs of records can join the two (``cross_split_pairs``).
    """
    members, near = near_classes(_read(rows), least, dim, miss)
    return (
        members.select("row_id", F.col("_split").alias("split"), F.col("rep").alias("class_id")),
        near.select(F.col("rep_eval").alias("eval_class"), F.col("rep_train").alias("train_class"), "cosine", "containment"),
    )


def cross_split_pairs(rows: DataFrame, least: float = 0.99, dim: int = 192, miss: float = 4e-4) -> DataFrame:
    """Pairs of an evaluation row and a train row that are the same or nearly so.

    Output: ``eval_id, train_id, same_scene, cosine, containment``; the last two are null
    where the vectors are not near.  Rows without a readable split or row_id take no
    part; a null or unreadable scene names none; unusable vectors are compared by scene
    only.  Re-delivered rows count like all others.  Every pair comes out once.

    Two vectors at the threshold itself are missed with a probability of about
    ``miss``, closer ones far less; equal ones never.
    """
    read = _read(rows)
    members, near = near_classes(read, least, dim, miss)
    ids = read.select("row_id", "_split", "_scene").where(F.col("_scene").isNotNull())
    unknown = F.lit(None).cast("double")
    evals = _side(ids, False).select(F.col("row_id").alias("eval_id"), "_scene")
    trains = _side(ids, True).select(F.col("row_id").alias("train_id"), "_scene")
    same = product_join(evals, trains, "_scene").select("eval_id", "train_id", F.lit(True).alias("same_scene"), unknown.alias("cosine"), unknown.alias("containment"))
    evals = _side(members, False).select(F.col("row_id").alias("eval_id"), F.col("_scene").alias("_se"), F.col("rep").alias("rep_eval"))
    trains = _side(members, True).select(F.col("row_id").alias("train_id"), F.col("_scene").alias("_st"), F.col("rep").alias("rep_train"))
    alike = product_join(product_join(near, evals, "rep_eval"), trains, "rep_train")
    alike = alike.select("eval_id", "train_id", F.coalesce(F.col("_se") == F.col("_st"), F.lit(False)).alias("same_scene"), "cosine", "containment")
    # a pair that is both comes from either side: the one with its cosine stays
    both = same.unionByName(alike.where("same_scene")).groupBy("eval_id", "train_id").agg(F.lit(True).alias("same_scene"), F.max("cosine").alias("cosine"), F.max("containment").alias("containment"))
    out = materialize(both.unionByName(alike.where("not same_scene")))
    release(members)
    release(near)
    return out


def overlap_counts(rows: DataFrame, least: float = 0.99, dim: int = 192, miss: float = 4e-4) -> DataFrame:
    """Per evaluation split and label source: rows, overlapping rows, pairs by kind.

    ``near_pairs`` are those of different scenes.  They are counted from the sizes of
    classes and scenes; no pair of records is made.
    """
    read = _read(rows)
    members, near = near_classes(read, least, dim, miss)
    scenes = _side(read, True).where(F.col("_scene").isNotNull()).groupBy("_scene").agg(F.count("*").alias("scene_pairs"))
    held = materialize(_side(members, True).groupBy(F.col("rep").alias("rep_train"), "_scene").agg(F.count("*").alias("n")))
    sizes = held.groupBy("rep_train").agg(F.sum("n").alias("n"))
    alike = hot_key_join(near, sizes, "rep_train").groupBy("rep_eval").agg(F.sum("n").alias("all_near"))
    own = held.where(F.col("_scene").isNotNull())
    asked = _side(members, False).select(F.col("rep").alias("rep_eval"), "_scene").where(F.col("_scene").isNotNull()).distinct()
    # links of an evaluation class and scene to train classes that hold rows of that scene
    links = product_join(near.select("rep_eval", "rep_train"), asked, "rep_eval")
    within = links.join(own, ["rep_train", "_scene"]).groupBy("rep_eval", "_scene").agg(F.sum("n").alias("own_near"))
    label = rows.select("row_id", "label_source")
    each = _side(read, False).select("row_id", F.col("_split").alias("split"), "_scene").join(label, "row_id")
    each = each.join(_side(members, False).select("row_id", F.col("rep").alias("rep_eval")), "row_id", "left")
    each = hot_key_join(materialize(each), scenes, "_scene", "left")
    each = hot_key_join(each, alike, "rep_eval", "left").join(within, ["rep_eval", "_scene"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    counted = each.select("split", "label_source", zero("scene_pairs").alias("s"), (zero("all_near") - zero("own_near")).alias("n"))
    return counted.groupBy("split", "label_source").agg(
        F.count("*").alias("rows"), F.count_if((F.col("s") > 0) | (F.col("n") > 0)).alias("overlapping_rows"), F.sum("s").alias("scene_pairs"), F.sum("n").alias("near_pairs"),
    )


def overlap_recall(rows: DataFrame, queries: Column, least: float = 0.99, dim: int = 192, miss: float = 4e-4) -> DataFrame:
    """(pairs, found, recall) of near class pairs, for evaluation classes whose least row has ``queries``: the index against all."""
    read = _read(rows)
    points = materialize(vector_rows(read, F.col("fixed_features.visual_embedding"), dim, F.col("_split"), F.col("_scene"), queries.alias("_asked")))
    classes, members = _classes(points)
    asked = points.where("_asked").select(F.col("row_id").alias("rep")).distinct()
    evals, trains = materialize(classes.where("train = 0").join(asked, "rep", "left_semi")), classes.where("train = 1")
    slices = max(1, math.ceil(trains.count() / ROWS_PER_SLICE))
    exact = stream_blocks(sliced(evals, slices, True), sliced(trains, slices, False), partial(NearKernel, least), _PAIRS, dim, fixed=True)
    found = near_classes(read, least, dim, miss)[1].select("rep_eval", "rep_train", F.lit(1).alias("hit"))
    both = exact.select("rep_eval", "rep_train").join(found, ["rep_eval", "rep_train"], "left")
    counts = both.agg(F.count("*").alias("pairs"), F.count("hit").alias("found"))
    return counts.select("pairs", "found", F.round(F.coalesce(F.try_divide(F.col("found"), F.col("pairs")), F.lit(1.0)), 4).alias("recall"))
