"""Joins and top-k that hold when one key owns a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.session import materialize


HOT_ROWS = 10_000  # a key with fewer rows is never hot


def largest_keys(counts: DataFrame, key: str, count: str, most: int = 1_000, least_rows: int | None = None) -> list:
    """The keys of ``counts(key, count)`` with most rows: at most ``most``, each with at least ``least_rows`` (``HOT_ROWS``)."""
    least = HOT_ROWS if least_rows is None else least_rows
    large = counts.where(F.col(key).isNotNull() & (F.col(count) >= least))
    return [r[0] for r in large.orderBy(F.desc(count)).limit(most).select(key).collect()]


def hot_keys(rows: DataFrame, key: str, most: int = 1_000, least_rows: int | None = None) -> list:
    """The keys with most rows: at most ``most``, each with at least ``least_rows``.

    ``most`` is the proven bound on what comes to the driver.  A key with more than
    1 / ``most`` of the rows is always among them.  Counting is pre-aggregated
    map-side and each task sends its ``most`` largest only.  Null keys never join
    and are left out.
    """
    return largest_keys(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")), key, "_n", most, least_rows)


def hot_key_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``rows JOIN lookup`` on ``key`` where ``lookup`` has one row per key.

    Rows of hot keys meet a broadcast of the (at most 1,000) lookup rows of those
    keys and are not shuffled; all other rows take a shuffle join, in which no key
    holds more than a thousandth of the rows.  ``how`` is ``inner`` or ``left``.
    ``hot``: the hot keys where they are known, else they are counted.  Null keys:
    dropped by ``inner``, kept with nulls by ``left``.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(lookup, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    warm = rows.where(is_hot).join(F.broadcast(lookup.where(F.col(key).isin(hot))), key, how)
    cold = rows.where(~is_hot).join(lookup.where(~F.col(key).isin(hot)), key, how)
    return warm.unionByName(cold)


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key in ``order``; ranks start at 1.

    Catalyst turns the filter on ``row_number`` into a partial limit before the
    shuffle, so that no more than ``k`` rows per key and input task travel.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


PAIRS_PER_TASK = 4_000_000


def product_join(left: DataFrame, right: DataFrame, key: str, pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """Inner join in which both sides repeat a key; no task makes much more than ``pairs_per_task``.

    A key whose counts on both sides multiply to more is cut into so many salts: its
    left rows are dealt to them by a hash, its right rows copied to each.  All pairs
    come out, each once.  Null keys join nothing.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_l")).join(right.groupBy(key).agg(F.count("*").alias("_r")), key)
    salts = counts.select(key, F.ceil(F.col("_l") * F.col("_r") / F.lit(pairs_per_task)).cast("int").alias("_salts"))
    large = materialize(salts.where("_salts > 1"))
    if large.isEmpty():
        return left.join(right, key)
    one = F.coalesce("_salts", F.lit(1))
    dealt = hot_key_join(left, large, key, how="left").withColumn("_salt", F.pmod(F.xxhash64(*[c for c in left.columns if c != key]), one).cast("int")).drop("_salts")
    copied = hot_key_join(right, large, key, how="left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")
