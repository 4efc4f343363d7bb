"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lumaframe.operators import skew
from lumaframe.operators.skew import hot_key_join, largest_keys
from lumaframe.session import materialize, release


def _noted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``df`` written, and metrics taken while it is written: no job of their own reads it again."""
    named = [m.alias(name) for name, m in metrics.items()]
    seen = Observation()
    out = materialize(df.observe(seen, *named))
    got = seen.get
    return out, got if set(got) == set(metrics) else out.agg(*named).first().asDict()  # an optimized empty plan notes nothing


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, dict]:
    """One star step on directed pairs ``(u, v)``.

    The minimum of each neighbourhood is pre-aggregated map-side; it goes back to
    the pairs through a join whose hot centres are broadcast, so that a node that
    owns a third of all links is spread over all tasks.  Counting for the hot centres
    is part of the same aggregate.
    """
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lows = around.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).withColumn("low", F.least("low", "u"))
    counted, seen = _noted(lows, most=F.max("n"))
    lows = counted.select("u", "low")
    hot = largest_keys(counted, "u", "n") if (seen["most"] or 0) >= skew.HOT_ROWS else []
    joined = hot_key_join(around, lows, "u", hot=hot)
    if large:
        linked = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        near = joined.select(F.col("v").alias("u"), F.col("low").alias("v"))
        own = lows.select("u", F.col("low").alias("v"))
        linked = near.unionByName(own)
    out, mark = _noted(linked.where(F.col("u") != F.col("v")).distinct(), **_mark())
    release(counted)
    return out, mark


def _mark() -> dict[str, Column]:
    """What tells one set of links from another: their number and the sum of their hashes."""
    return {"links": F.count("*"), "hashes": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the least node.

    Alternates large-star (link every larger neighbour to the least) and
    small-star (link smaller neighbours to the least) until nothing changes;
    each round is written to the shared folder, so plans stay short.  Self links
    name nodes without joining anything.  Links with a null end are ignored; an
    empty input gives an empty result.
    Raises RuntimeError if ``max_rounds`` rounds do not settle it.
    """
    edges = edges.select("u", "v").where(F.col("u").isNotNull() & F.col("v").isNotNull())
    edges = materialize(edges.distinct())
    nodes = materialize(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    first = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    stars, last = _noted(first, **_mark())
    release(edges)
    for _ in range(max_rounds):
        if not last["links"]:
            break
        after, _ = _star(stars, True)
        release(stars)
        stars, now = _star(after, False)
        release(after)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # every node is on one row of either side, so no key is hot here
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
