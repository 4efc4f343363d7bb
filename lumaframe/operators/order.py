"""Operators that depend on order: first and last wins, argmax, round robin, running best.

Order is always explicit: a column list that ends in a unique key where ties matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in ``order``; null keys form one key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rn = unused(df, "_rn")
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key: ``order`` is given ascending and reversed here."""
    ord_ = unused(df, "_ord")
    numbered = df.withColumn(ord_, F.struct(*[o.alias(f"c{i}") for i, o in enumerate(order)]))
    return first_wins(numbered, keys, [F.desc(ord_)]).drop(ord_)


def argmax_first(df: DataFrame, keys: list[str], score: Column, *ties: Column) -> DataFrame:
    """The row with the highest score (null counts as 0), the first of equals by ``ties``."""
    return first_wins(df, keys, [F.coalesce(score, F.lit(0.0)).desc(), *ties])


def round_robin_limit(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """``limit`` rows taken depth by depth over the groups in ascending order.

    Only rows within the first ``limit`` of their group travel: the window's rank
    limit is pushed below its shuffle.
    """
    depth = df.withColumn("depth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("depth") <= limit)
    return depth.orderBy("depth", group).limit(limit)


def previous_row(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Each column's value in the row before, as ``previous_<column>``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"previous_{c}": F.lag(c, 1).over(w) for c in columns})


def running_best(df: DataFrame, keys: list[str], order: list[Column], score: str) -> DataFrame:
    """The best score so far and whether the row improved on it strictly."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    prior = F.max(score).over(before)
    return df.withColumns({"best": F.max(score).over(w), "improved": F.coalesce(F.col(score) > prior, F.col(score).isNotNull())})


def union_distinct(frames: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of several sources, an earlier source winning on equal keys."""
    tagged = [f.withColumn("source_no", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return first_wins(out, keys, [F.col("source_no"), *order])


def violations_of_dependency(df: DataFrame, left: str, right: str) -> DataFrame:
    """Values of ``left`` that meet more than one value of ``right``: (left, values)."""
    return df.where(F.col(left).isNotNull()).groupBy(left).agg(F.count_distinct(right).alias("values")).where("values > 1")


def quarantine(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows); a null test counts as bad."""
    test = F.coalesce(ok, F.lit(False))
    return df.where(test), df.where(~test)


def first_of(items: Column) -> Column:
    """The first entry of a list, null for an empty or null one."""
    return F.get(items, F.lit(0))


def grouped_keys(df: DataFrame, group: str, key: str) -> DataFrame:
    """(group, keys): the distinct keys of every group in ascending order; null groups and keys are left out.

    For groups that are small by nature, as a group's keys are one array.
    """
    return df.where(F.col(group).isNotNull() & F.col(key).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(key)).alias("keys"))
