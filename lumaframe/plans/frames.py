"""Queries that run image kernels over stored thumbnails (no SQL can express them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.operators import images, teach
from lumaframe.plans import relational
from lumaframe.sources.tables import table

SIDE = 8  # the stored descriptor is an 8 x 8 image of three channels
_PIXELS = "fixed_features.visual_embedding"


def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.quality_reports(table(spark, sf_dir, "experiences"), "row_id", _PIXELS, SIDE, SIDE)


def render_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every thumbnail as its final action would take it."""
    return images.rendered_quality(
        table(spark, sf_dir, "experiences"), "row_id", _PIXELS, SIDE, SIDE, "initial_metadata.iso", "initial_metadata.shutter_speed_s", "final_action.iso", "final_action.shutter"
    )


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "experiences").withColumn("px", F.col(_PIXELS))


def _settings() -> tuple:
    return "px", (SIDE, SIDE), F.col("initial_metadata.iso"), F.col("initial_metadata.shutter_speed_s")


def pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search on renderings finds for every thumbnail at three offsets."""
    return teach.pseudo_labels(_frames(spark, sf_dir), "row_id", *_settings())


def integrated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the retrieval's query set, starting between the rule and the best row of another fold."""
    near = relational.crossfold_retrieve(spark, sf_dir)
    return teach.integrated_labels(_frames(spark, sf_dir), near, table(spark, sf_dir, "experiences"), "row_id", *_settings())


def preparation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per split of the whole preparation of the experiences' thumbnails."""
    return teach.prepared(_frames(spark, sf_dir), "row_id", "physical_scene_id", *_settings())["summary"]


QUERIES = {f.__name__: f for f in (image_quality, render_next, pseudo_labels, integrated_labels, preparation_summary)}
ORACLES: dict[str, str] = {}
