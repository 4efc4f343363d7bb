"""Splits that keep related records together, and the units a recorded split tears."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions.labels import physical_key, scene_key, split_name
from lumaframe.llm.components import connected_components
from lumaframe.operators.skew import hot_key_join
from lumaframe.session import materialize


def _keyed(rows: DataFrame) -> DataFrame:
    """row_id, the entity through which the row belongs to its unit, and its marks."""
    scene = scene_key(F.col("scene_id"))
    physical = physical_key(F.col("physical_scene_id"), F.col("scene_id"))
    split = split_name(F.col("dataset_split"))
    return rows.select(
        "row_id",
        F.concat(F.lit("s"), scene).alias("_scene"),
        F.concat(F.lit("p"), physical).alias("_physical"),
        split.alias("_split"),
        F.when(split == "train", F.col("cross_fold")).alias("_fold"),
    ).withColumn("_key", F.coalesce("_physical", "_scene"))


def related_units(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units of rows linked by an equal scene or physical scene.

    Returns ``(keyed rows, units)``: ``units`` has one row per entity ``_key`` with
    its ``root`` entity, the smallest ``unit_id`` (row_id) of the whole unit and the
    unit's counts.  Rows without scene and physical scene have a null ``_key`` and
    are units of their own.  Null row_ids are dropped (they name no row).
    """
    keyed = materialize(_keyed(rows).where(F.col("row_id").isNotNull()))
    links = keyed.where(F.col("_key").isNotNull()).groupBy("_key", "_scene").count()
    edges = links.select(F.col("_key").alias("u"), F.coalesce("_scene", "_key").alias("v"))
    roots = materialize(connected_components(edges))
    marks = [F.max((F.col("_split") == s).cast("int")).alias(f"_{s}") for s in ("train", "validation", "test")]
    by_key = keyed.where(F.col("_key").isNotNull()).groupBy("_key").agg(
        F.min("row_id").alias("unit_id"), F.min("_fold").alias("_low"), F.max("_fold").alias("_high"), F.count("*").alias("rows"), *marks
    )
    by_key = by_key.join(roots.select(F.col("node").alias("_key"), "root"), "_key")
    by_key = materialize(by_key)
    units = by_key.groupBy("root").agg(
        F.min("unit_id").alias("unit_id"),
        F.sum("rows").alias("unit_rows"),
        (sum(F.coalesce(F.max(f"_{s}"), F.lit(0)) for s in ("train", "validation", "test"))).alias("splits"),
        F.coalesce(F.min("_low") != F.max("_high"), F.lit(False)).alias("fold_torn"),
    )
    return keyed, hot_key_join(by_key.select("_key", "root"), materialize(units), "root")


def torn_rows(rows: DataFrame) -> DataFrame:
    """(unit_id, row_id) of every row of a unit whose splits or train folds disagree.

    Nulls: a null, empty or unknown split names none; a null fold names none; a row
    without any entity is alone and never torn.  Repeated row_ids give repeated
    rows.  Empty input: empty result.
    """
    keyed, units = related_units(rows)
    torn = materialize(units.where((F.col("splits") >= 2) | F.col("fold_torn")).select("_key", "unit_id"))
    found = hot_key_join(keyed.select("_key", "row_id"), torn, "_key")
    return found.select(F.col("unit_id").cast("bigint"), F.col("row_id").cast("bigint"))


def _ranges(unit_id: Column, salt: Column, shares: list[tuple[str, float]]) -> Column:
    """The split whose range of [0, 1) the salted hash of a unit falls into."""
    point = F.shiftrightunsigned(F.xxhash64(salt, unit_id), 11) / F.lit(float(2**53))
    total, at, edges = sum(s for _, s in shares), 0.0, []
    for n, s in shares[:-1]:
        at += s / total
        edges.append((n, at))
    name = F.lit(shares[-1][0])
    for n, edge in reversed(edges):
        name = F.when(point < edge, F.lit(n)).otherwise(name)
    return name


SPLITS = 100  # splits with a target; their number is checked


def assign_splits(rows: DataFrame, targets: DataFrame, salts: int = 64, salt: int | None = None) -> DataFrame:
    """(row_id, unit_id, split_name): all rows of a unit share one split.

    The unit's identifier is hashed to a number in [0, 1) which falls into one of
    the consecutive ranges that the shares of ``targets`` (normalized to sum 1, in
    the order of their names) cut.  As a few units may hold much of the rows, the
    hash takes that of ``salts`` salts under which the largest difference between
    target and actual share of rows is least (``best_salt``); only one row of sums comes
    to the driver.  That choice depends on the data: a table that grows may get another
    salt, which deals all units anew.  To keep rows where they were, store the salt of
    the first build and give it as ``salt``; a unit then moves only if its least row_id
    changes or it merges with another.  Targets with a null or non-positive share get
    nothing.
    """
    shares = _shares(targets)
    keyed, units = related_units(rows)
    units = materialize(units.select("_key", "root", "unit_id", "unit_rows"))
    chosen = _best_salt(units, shares, salts) if salt is None else salt
    placed = hot_key_join(keyed.select("_key", "row_id"), units.select("_key", "unit_id"), "_key", how="left")
    placed = placed.withColumn("unit_id", F.coalesce("unit_id", "row_id").cast("bigint"))
    return placed.select(F.col("row_id").cast("bigint"), "unit_id", _ranges(F.col("unit_id"), F.lit(chosen), shares).alias("split_name"))


def best_salt(rows: DataFrame, targets: DataFrame, salts: int = 64) -> int:
    """The salt ``assign_splits`` takes for these rows, to be stored for later builds."""
    return _best_salt(related_units(rows)[1], _shares(targets), salts)


def _shares(targets: DataFrame) -> list[tuple[str, float]]:
    given = targets.where("split_name is not null and target_share > 0").select("split_name", "target_share").orderBy("split_name").limit(SPLITS + 1).collect()
    if not given or len(given) > SPLITS:
        raise ValueError(f"between 1 and {SPLITS} splits must have a positive share")
    return [(r[0], float(r[1])) for r in given]


def _best_salt(units: DataFrame, shares: list[tuple[str, float]], salts: int) -> int:
    """Sums per salt and split: the copies of a unit are folded into them inside the map task that makes them."""
    each = units.select("root", "unit_id", "unit_rows").distinct().select("unit_id", "unit_rows", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    held: dict[int, dict[str, int]] = {}
    for r in each.groupBy("salt", _ranges(F.col("unit_id"), F.col("salt"), shares).alias("split")).agg(F.sum("unit_rows").alias("n")).collect():
        held.setdefault(r["salt"], {})[r["split"]] = r["n"]
    total = sum(x for _, x in shares)

    def worst(salt: int) -> float:
        n = sum(held[salt].values())
        return max(abs(held[salt].get(name, 0) / n - x / total) for name, x in shares)

    return min(held, key=lambda s: (worst(s), s), default=0)


def split_shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of every split, zero rows included."""
    counts = assigned.groupBy("split_name").agg(F.count("*").alias("rows"), F.count_distinct("unit_id").alias("units"))
    total = assigned.agg(F.count("*").alias("_all"))
    out = targets.select("split_name", "target_share").join(counts, "split_name", "left").crossJoin(total)  # one row
    return out.select(
        "split_name", "target_share", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("units", F.lit(0)).alias("units"),
        F.coalesce(F.try_divide(F.col("rows"), F.col("_all")), F.lit(0.0)).alias("actual_share"),
    )
