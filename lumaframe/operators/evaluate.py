"""Metrics of predicted actions, of runs, and of binary outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions.exprs import lit, stops
from lumaframe.operators.skew import hot_key_join
from lumaframe.session import materialize


def number(x: Column) -> Column:
    """The number, or null for NaN."""
    return F.when(~F.isnan(x), x)


def action_metrics(targets: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Counts, match rate and mean absolute errors of matched predictions.

    Both sides have one row per key with ``iso`` and ``shutter``; targets without an
    action count but never match.  Means over nothing are null, rates 0.
    """
    t = targets.select(key, F.col("iso").alias("_ti"), F.col("shutter").alias("_ts"))
    p = predictions.select(key, F.col("iso").alias("_pi"), F.col("shutter").alias("_ps"), F.lit(True).alias("_there"))
    j = t.join(p, key, "left")
    hit = F.col("_there") & F.col("_ti").isNotNull() & F.col("_pi").isNotNull()
    floor = lambda c: F.greatest(F.col(c), lit(1e-8))
    return j.agg(
        F.count("*").alias("target_count"),
        F.count_if(hit).alias("matched"),
        F.coalesce(F.try_divide(F.count_if(hit), F.count("*")), lit(0)).alias("match_rate"),
        F.avg(F.when(hit, F.abs(F.col("_ti") - F.col("_pi")).cast("double"))).alias("iso_mae"),
        F.avg(F.when(hit, F.abs(F.log2(floor("_ps") / floor("_ts"))))).alias("shutter_stops_mae"),
    )


def run_metrics(runs: DataFrame, by: str, gain: Column, success: Column, iso: Column, ref_iso: Column, shutter: Column, ref_shutter: Column) -> DataFrame:
    """Per group: rates over all runs, means over the runs that have the number."""
    return runs.groupBy(F.col(by).alias(by)).agg(
        F.count("*").alias("runs"),
        F.coalesce(F.try_divide(F.count_if(success), F.count("*")), lit(0)).alias("success_rate"),
        F.avg(number(gain)).alias("mean_gain"),
        F.avg(F.abs((iso - ref_iso).cast("double"))).alias("mean_iso_change"),
        F.avg(F.abs(stops(F.try_divide(shutter, ref_shutter)))).alias("mean_stop_change"),
    )


def confusion(rows: DataFrame, target: Column, predicted: Column) -> DataFrame:
    """Confusion counts with precision, recall and F1, 0 on empty denominators; nulls are false."""
    t, p = F.coalesce(target, F.lit(False)), F.coalesce(predicted, F.lit(False))
    c = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    zero = lambda x: F.coalesce(x, lit(0))
    c = c.withColumns({"precision": zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))), "recall": zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))})
    return c.withColumn("f1", zero(F.try_divide(lit(2) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def value_histogram(rows: DataFrame, by: str, bin_no: Column) -> DataFrame:
    """Counts and shares of each bin per group; values without a bin are left out."""
    counts = rows.select(by, bin_no.alias("bin")).where("bin is not null").groupBy(by, "bin").count()
    totals = counts.groupBy(by).agg(F.sum("count").alias("_all"))
    return counts.join(totals, by).select(by, "bin", F.col("count").alias("n"), F.round(F.col("count") / F.col("_all"), 8).alias("share"))


SHARE = 1e-3  # half the share of a group's values among which a percentile's neighbours are looked for


def exact_percentiles(rows: DataFrame, by: str, value: Column, points: dict[str, float]) -> DataFrame:
    """(by, ...points, n): exact percentiles with linear interpolation, null and NaN left out.

    A sketch, merged map-side, brackets each percentile between two values of the group;
    the second pass counts what lies below the bracket and groups what lies within it.
    So one task sorts about a five-hundredth of a group's distinct values, not all of
    them.  A bracket that a heavy value makes wider holds that value once, with its
    count.  Groups without a number have null percentiles and n = 0.
    """
    v = rows.select(F.col(by).alias("_g"), number(value.cast("double")).alias("_v"))
    names = list(points)
    ends = [min(1.0, max(0.0, points[n] + d)) for n in names for d in (-SHARE, SHARE)]
    sketch = v.groupBy("_g").agg(F.percentile_approx("_v", F.array(*[lit(e) for e in ends]), F.lit(int(10 / SHARE))).alias("_q"), F.count("_v").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    sketch = materialize(sketch)
    few = F.col("n") < 4 / SHARE  # so few values are all taken: a bracket could miss the next rank
    low = lambda i: F.when(few | F.lit(points[names[i]] <= SHARE), F.col("_min")).otherwise(F.get("_q", F.lit(2 * i)))
    high = lambda i: F.when(few | F.lit(points[names[i]] >= 1 - SHARE), F.col("_max")).otherwise(F.get("_q", F.lit(2 * i + 1)))
    keyed = v.where("_v is not null").withColumn("_k", F.coalesce(F.col("_g").cast("string"), F.lit("\0")))
    bounds = sketch.select(F.coalesce(F.col("_g").cast("string"), F.lit("\0")).alias("_k"), *[low(i).alias(f"_l{i}") for i in range(len(names))], *[high(i).alias(f"_h{i}") for i in range(len(names))])
    near = hot_key_join(keyed, bounds, "_k")
    # one row per point: below the bracket all values fold into one, inside each value has its own
    sides = F.array(*[F.struct(F.lit(i).alias("p"), F.when(F.col("_v") >= F.col(f"_l{i}"), F.col("_v")).alias("x")) for i in range(len(names))])
    inside = F.array(*[F.col("_v") <= F.col(f"_h{i}") for i in range(len(names))])
    each = near.withColumn("_s", F.explode(F.filter(sides, lambda s: F.get(inside, s["p"])))).groupBy("_k", "_s.p", "_s.x").agg(F.count("*").alias("c"))
    order = Window.partitionBy("_k", "p").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("upto", F.sum("c").over(order))
    keys = sketch.select("_g", "n", F.coalesce(F.col("_g").cast("string"), F.lit("\0")).alias("_k"))
    ranked = hot_key_join(each, keys.select("_k", "n"), "_k")
    at = lambda i: lit(points[names[i]]) * (F.col("n") - 1)
    holds = lambda i, rank: (F.col("p") == i) & (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
    picked = ranked.groupBy("_k").agg(*[F.max(F.when(holds(i, f(at(i))), F.col("x"))).alias(f"_{e}{i}") for i in range(len(names)) for e, f in (("a", F.floor), ("b", F.ceil))])
    part = lambda i: at(i) - F.floor(at(i))
    mixed = [(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * part(i)).alias(n) for i, n in enumerate(names)]
    return keys.join(picked, "_k", "left").select(F.col("_g").alias(by), *mixed, "n")


def percentile_bounds(rows: DataFrame, by: str, value: Column, points: dict[str, float]) -> DataFrame:
    """``exact_percentiles`` of a value per group."""
    return exact_percentiles(rows, by, value, points)


def calibration(rows: DataFrame, noise: Column, sharpness: Column) -> DataFrame:
    """Noise floor and reference, sharpness reference and sample count, in one row."""
    each = rows.select(F.explode(F.array(F.struct(F.lit("n").alias("of"), noise.alias("x")), F.struct(F.lit("s").alias("of"), sharpness.alias("x")))).alias("e")).select("e.of", "e.x")
    found = exact_percentiles(each, "of", F.col("x"), {"half": 0.5, "most": 0.9})
    of = lambda name, c: F.max(F.when(F.col("of") == name, F.col(c)))
    return found.agg(
        of("n", "half").alias("noise_floor"), (of("n", "half") + F.greatest(lit(0.005), lit(4) * of("n", "most"))).alias("noise_reference"),
        F.greatest(of("s", "half"), lit(1e-5)).alias("sharpness_reference"), F.coalesce(of("n", "n"), F.lit(0)).alias("sample_count"),
    )


def quality_errors(targets: DataFrame, predictions: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(field, matched, mae): mean absolute error of each quality field where both sides have it; null where none has."""
    t = targets.select(key, *[F.col(f).cast("double").alias(f"_t_{f}") for f in fields])
    p = predictions.select(key, *[F.col(f).cast("double").alias(f"_p_{f}") for f in fields])
    gap = {f: F.abs(number(F.col(f"_t_{f}")) - number(F.col(f"_p_{f}"))) for f in fields}
    wide = t.join(p, key).agg(*[F.count(g).alias(f"_n_{f}") for f, g in gap.items()], *[F.avg(g).alias(f"_m_{f}") for f, g in gap.items()])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_n_{f}").alias("matched"), F.col(f"_m_{f}").alias("mae")) for f in fields])
    return wide.select(F.explode(each).alias("e")).select("e.field", "e.matched", "e.mae")


def round_metrics(runs: DataFrame, rounds: Column, stopped: Column, acceptable: Column, exhausted: str = "max_rounds_best_result") -> DataFrame:
    """One row: runs, mean rounds of those with any, success rate and share that ran out of rounds unsatisfied.

    Rates are over all runs, runs without rounds included; 0 without runs.
    """
    had = rounds > 0
    good = F.coalesce(acceptable, F.lit(False))
    rate = lambda c: F.coalesce(F.try_divide(F.count_if(c), F.count("*")), lit(0))
    return runs.agg(
        F.count("*").alias("runs"), F.avg(F.when(had, rounds)).alias("mean_rounds"), rate(F.coalesce(had & good, F.lit(False))).alias("success_rate"),
        rate(F.coalesce(had & (stopped == exhausted) & ~good, F.lit(False))).alias("unsatisfied_rate"),
    )
