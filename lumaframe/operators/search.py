"""Candidate settings around a proposal, their scores, and a bounded feedback loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions.exprs import apply_action, lit, proposal_distance
from lumaframe.operators.order import first_wins
from lumaframe.session import materialize, release

# The two stages' ISO step and shutter factors.
COARSE = (200.0, (0.5, 1.0, 2.0))
FINE = (100.0, (0.8, 1.0, 1.25))


def candidate_grid(rows: DataFrame, key: str, iso: Column, shutter: Column, stage: tuple[float, tuple[float, ...]] = COARSE, keep: tuple[Column, ...] = ()) -> DataFrame:
    """(key, ord, iso, shutter, ...keep): the 3 x 3 neighbours of each row's settings.

    Settings are brought into the camera's range first; what then coincides (ISO
    equal, shutter to 10 decimals) is kept once, the earliest place winning.  Rows
    without ISO or shutter have no candidates.  The grid is an array per row, made
    and thinned in place: nothing is joined or shuffled.
    """
    step, factors = stage

    def cell(i: int, d: float, j: int, f: float) -> Column:
        to_iso, to_shutter = apply_action(F.greatest(F.col("_iso") + lit(d * step), lit(1)), F.greatest(F.col("_shutter") * lit(f), lit(1e-8)))
        return F.struct(F.lit(i * len(factors) + j).alias("ord"), to_iso.alias("iso"), to_shutter.alias("shutter"), F.round(to_shutter, 10).alias("same"))

    cells = F.array(*[cell(i, d, j, f) for i, d in enumerate((-1.0, 0.0, 1.0)) for j, f in enumerate(factors)])
    base = rows.select(F.col(key), *keep, iso.cast("double").alias("_iso"), shutter.cast("double").alias("_shutter")).where("_iso is not null and _shutter is not null")
    kept = [c for c in base.columns if c not in (key, "_iso", "_shutter")]
    made = base.select(key, *kept, cells.alias("_cells"))
    earlier = lambda c, i: F.exists(F.slice("_cells", F.lit(1), i), lambda e: (e["iso"] == c["iso"]) & (e["same"] == c["same"]))
    each = made.select(key, *kept, F.explode(F.filter("_cells", lambda c, i: ~earlier(c, i))).alias("c"))
    return each.select(key, F.col("c.ord").alias("ord"), F.col("c.iso").alias("iso"), F.col("c.shutter").alias("shutter"), *kept)


def best_candidate(scored: DataFrame, key: str, score: str, center_iso: Column, center_shutter: Column) -> DataFrame:
    """The best candidate per key: score to 9 decimals, then nearest to the centre, then place."""
    ranked = scored.withColumns({"_s": F.round(score, 9), "distance": F.round(proposal_distance(F.col("iso"), F.col("shutter"), center_iso, center_shutter), 9)})
    return first_wins(ranked, [key], [F.desc("_s"), F.col("distance"), F.col("ord")]).drop("_s")


def two_stage_search(rows: DataFrame, key: str, iso: str, shutter: str, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Coarse candidates, then fine ones around the best; the row's own settings are the incumbent.

    ``scorer`` adds ``score`` to (key, ord, iso, shutter).
    """
    own = [F.col(iso).cast("double").alias("_ci"), F.col(shutter).cast("double").alias("_cs")]
    there = rows.where(F.col(iso).isNotNull() & F.col(shutter).isNotNull())
    incumbent = there.select(key, F.lit(-1).alias("ord"), own[0].alias("iso"), own[1].alias("shutter"), *own)
    coarse = candidate_grid(there, key, F.col(iso), F.col(shutter), COARSE, tuple(own))

    def pick(candidates: DataFrame) -> DataFrame:
        best = best_candidate(scorer(candidates), key, "score", F.col("_ci"), F.col("_cs"))
        return best.select(key, "ord", "iso", "shutter", "_ci", "_cs", "score", "distance")

    first = pick(incumbent.unionByName(coarse))
    fine = candidate_grid(first, key, F.col("iso"), F.col("shutter"), FINE, (F.col("_ci"), F.col("_cs"))).withColumn("ord", F.col("ord") + 9)
    return pick(first.drop("score", "distance").unionByName(fine)).drop("_ci", "_cs")


def bounded_loop(state: DataFrame, step: Callable[[DataFrame], DataFrame], done: Column, rounds: int = 3) -> DataFrame:
    """Apply ``step`` to the rows that are not ``done`` for at most ``rounds`` rounds.

    Only unfinished rows are carried on; each round's rows are written to the shared
    folder, so that the plan stays as short as one step.  The result has ``rounds``,
    the number of steps each row took.  ``rounds`` is kept between 1 and 3.
    """
    rounds = max(1, min(rounds, 3))
    active, parts, spent = state.withColumn("rounds", F.lit(0)), [], []
    for r in range(1, rounds + 1):
        now = materialize(step(active).withColumn("rounds", F.lit(r)))
        spent.append(now)
        finished = F.coalesce(done, F.lit(False))
        parts.append(now if r == rounds else now.where(finished))
        active = now.where(~finished)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = materialize(out)
    for s in spent:
        release(s)
    return out


def stop_reason(satisfied: Column) -> Column:
    """Why a loop ended for a row: it was satisfied, or the rounds ran out and its best stays."""
    return F.when(F.coalesce(satisfied, F.lit(False)), "satisfied").otherwise("max_rounds_best_result")
