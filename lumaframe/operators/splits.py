"""Group-disjoint splits and cross folds by seeded hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _shuffled(groups: DataFrame, group: str, seed: int) -> DataFrame:
    """Distinct non-null groups numbered in the order of md5('<seed>:<group>').

    The number is a global rank, taken without one big sort task: groups are
    counted by the first three hex digits (at most 4,096 buckets), ranked inside
    their bucket, and the buckets' bases added.
    """
    hashed = groups.select(F.col(group).alias("g")).where("g is not null").distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("g").cast("string"))))
    hashed = hashed.withColumn("bucket", F.substring("h", 1, 3))
    inside = hashed.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy("h", "g")))
    bases = hashed.groupBy("bucket").count()
    base = F.coalesce(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("count").over(Window.partitionBy())
    bases = bases.select("bucket", base.alias("base"), total.alias("n"))
    return inside.join(F.broadcast(bases), "bucket").select(F.col("g").alias(group), (F.col("rn") + F.col("base")).alias("place"), "n")


def grouped_split(rows: DataFrame, group: str, seed: int = 42) -> DataFrame:
    """(group, split): 80/10/10 by group; one group is train, two are train and validation."""
    tenth = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(0.1), 0).cast("int"))
    validation = F.when(F.col("n") < 2, 0).otherwise(F.when(F.col("n") == 2, 1).otherwise(tenth))
    test = F.when(F.col("n") < 3, 0).otherwise(tenth)
    place = F.col("place")
    train = F.col("n") - validation - test
    split = F.when(place <= train, "train").when(place <= train + validation, "validation").otherwise("test")
    return _shuffled(rows, group, seed).select(group, split.alias("split"))


def cross_folds(rows: DataFrame, group: str, folds: int = 4, seed: int = 42) -> DataFrame:
    """(group, fold): every ``folds``-th group of the shuffled order."""
    return _shuffled(rows, group, seed).select(group, F.pmod(F.col("place") - 1, F.lit(folds)).cast("int").alias("fold"))


def split_counts(assigned: DataFrame, column: str = "split") -> DataFrame:
    """One row with the counts of all three splits, zeros included."""
    return assigned.agg(*[F.count_if(F.col(column) == s).alias(s) for s in ("train", "validation", "test")])


def split_of_scene(scenes: DataFrame, by_scene: DataFrame, by_group: DataFrame) -> DataFrame:
    """The scene's own split, else its group's; null where neither has one."""
    own = by_scene.select("scene_id", F.col("split").alias("_own"))
    grouped = by_group.select("physical_scene_id", F.col("split").alias("_group"))
    return scenes.join(own, "scene_id", "left").join(grouped, "physical_scene_id", "left").withColumn("split", F.coalesce("_own", "_group")).drop("_own", "_group")


def unassigned(scenes: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """Scenes a manifest lacks: it is stale if there are any."""
    return scenes.select(key).where(F.col(key).isNotNull()).distinct().join(assigned.select(key), key, "left_anti")


def only_split(rows: DataFrame, split: str | None = None, column: str = "dataset_split", required: bool = False) -> DataFrame:
    """Rows of one split, a missing one counting as train; all rows without ``split``.

    ``required``: an empty result raises.
    """
    out = rows if split is None else rows.where(F.coalesce(F.col(column), F.lit("train")) == split)
    if required and out.isEmpty():
        raise ValueError(f"no rows of the split {split!r}")
    return out
