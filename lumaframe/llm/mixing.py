"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form one stream, cut into blocks of equal size.  Of the T
blocks of the whole mixture n are a source's, so its weight is n / T, a fraction that
is never rounded: its j-th block may start at slot floor((j - 1) T / n) and is due by
slot ceil(j T / n); in each slot the released block with the earliest deadline goes
next.  At every slot, whatever the length, each source is then less than one block
from its target.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaframe.llm.tokens import TOKENIZER, TOKENIZER_DIR, token_counts
from lumaframe.session import materialize

BLOCK_TOKENS = 4_096  # least size of a block
SLOTS = 500_000  # blocks a mixture has at most, but for one rest a source: larger mixtures get larger blocks
SOURCES = 10_000  # sources with a target; their number is checked
ROWS_PER_BUCKET = 20_000


def source_key(source: Column) -> Column:
    """One name for all spellings of a source."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


def quotas(supply: dict[str, tuple[float, int, int]], total: int) -> dict[str, int]:
    """Tokens each source gives: {name: (target share, tokens held, max repeats)}.

    All sources get their share of ``total``; one that cannot, even at its most
    repeats, gives all it can, and the rest is shared by the others in the ratio of
    their targets (water filling).
    """
    left = {s: w for s, (w, held, times) in supply.items() if w > 0 and held > 0 and times > 0}
    out = dict.fromkeys(supply, 0)
    rest = float(total)
    while left:
        scale = rest / sum(left.values())
        short = [s for s, w in left.items() if supply[s][1] * supply[s][2] <= w * scale]
        if not short:
            for s, w in left.items():
                out[s] = math.floor(w * scale)
            break
        for s in short:
            out[s] = supply[s][1] * supply[s][2]
            rest -= out[s]
            del left[s]
        if rest <= 0:
            break
    return out


def feasible_total(supply: dict[str, tuple[float, int, int]]) -> int:
    """The largest size at which every source that has tokens meets its share.

    The shares of sources without tokens go to the others in the ratio of theirs.
    """
    giving = [(w, held * times) for w, held, times in supply.values() if w > 0 and held > 0 and times > 0]
    share = sum(w for w, _ in giving)
    return min((math.floor(most * share / w) for w, most in giving), default=0)


def pfair_slots(counts: dict[str, int]) -> list[str]:
    """The source of each of the sum(counts) slots: earliest deadline first.

    Windows are taken from whole numbers, so nothing is rounded.  On one line of slots
    earliest deadline first meets every window that any order can meet, and for weights
    that sum to one an order exists; ties go to the window that ends the source's
    earlier block, then to the name.
    """
    slots = sum(counts.values())
    waiting: list[tuple[int, str, int]] = []  # (release, source, block)
    for s, n in sorted(counts.items()):
        if n:
            heapq.heappush(waiting, (0, s, 1))
    ready: list[tuple[int, int, str, int]] = []  # (deadline, next release, source, block)
    out: list[str] = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            n = counts[s]
            heapq.heappush(ready, (-(-j * slots // n), (j * slots) // n, s, j))
        _, _, s, j = heapq.heappop(ready)
        out.append(s)
        if j < counts[s]:
            heapq.heappush(waiting, ((j * slots) // counts[s], s, j + 1))
    return out


def block_size(total: int, least: int = BLOCK_TOKENS, slots: int = SLOTS) -> int:
    """Tokens of a block: ``least``, or as many as leave a mixture of ``total`` tokens ``slots`` blocks."""
    return max(least, -(-total // slots))


def _streams(docs: DataFrame, targets: DataFrame, tokenizer: str) -> tuple[DataFrame, dict[str, tuple[float, int, int]]]:
    """Documents with the token offset in their source's stream, and each source's supply.

    The offsets are prefix sums in hash order, taken bucket by bucket, so that a
    source with most of the rows is spread over many tasks.  Only one row per
    source and one small row per bucket is summed up beyond them.
    """
    wanted = targets.select(source_key(F.col("source_name")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
    wanted = wanted.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    named = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", source_key(F.col("source")).alias("source"))
    given = wanted.limit(SOURCES + 1).collect()
    if len(given) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources have a target")
    held = named.where(F.col("source").isin([r["source"] for r in given]))
    sized = materialize(token_counts(held, "source", tokenizer=tokenizer).where("tokens > 0"))
    sums = {r[0]: (r[1], r[2]) for r in sized.groupBy("source").agg(F.sum("tokens"), F.count("*")).collect()}
    supply = {r["source"]: (r["target_share"], *((sums.get(r["source"], (0, 0))[0]), r["max_repeats"] or 0)) for r in given}
    buckets = max(1, -(-max([n for _, n in sums.values()], default=0) // ROWS_PER_BUCKET))
    width = 2**62 // buckets + 1
    spread = sized.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 2))
    spread = materialize(spread.withColumn("bucket", F.expr(f"cast(h div {width}L as int)")))
    per_bucket = spread.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_bucket.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.withColumn("at", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(bases, ["source", "bucket"])
    return offsets.select("doc_id", "source", "tokens", (F.col("at") + F.col("base")).alias("offset")), supply


def mix_documents(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK_TOKENS, tokenizer: str = f"{TOKENIZER_DIR}/{TOKENIZER}") -> DataFrame:
    """The mixture, in order: ``slot, source_name, doc_id, repeat_no, tokens``.

    ``total_tokens`` is the size of the mixture, by default the largest at which every
    source that has documents meets its target share.  A larger one is filled by the
    sources that can: those that can't give their most, and the actual shares differ
    from the targets.  A source is read in whole passes and a last partial
    one up to its quota, never beyond ``max_repeats`` passes.  A document belongs to
    the block in which it starts.  Documents of sources without a target, with a
    null source or doc_id, or without tokens are not chosen; a target without
    documents gives nothing and its share goes to the others.  Sort by slot,
    source_name, repeat_no, doc_id to read the mixture.

    A block has ``block`` tokens or, in a mixture of more than ``SLOTS`` such blocks,
    a ``SLOTS``-th of the mixture (``block_size``): the schedule is made slot by slot
    on the driver, and that bounds it (about a second, one number a slot).
    """
    streams, supply = _streams(docs, targets, tokenizer)
    total = total_tokens or feasible_total(supply)
    block = block_size(total, block)
    quota = {s: q for s, q in quotas(supply, total).items() if q > 0}
    spark = docs.sparkSession
    if not quota:
        return spark.createDataFrame([], "slot bigint, source_name string, doc_id bigint, repeat_no int, tokens bigint")
    counts = {s: -(-q // block) for s, q in quota.items()}
    plan = spark.createDataFrame(
        [(s, quota[s], supply[s][1], supply[s][2], counts[s]) for s in counts],
        "source string, quota bigint, held bigint, times int, blocks bigint",
    )  # at most SOURCES rows
    rows = streams.join(F.broadcast(plan), "source")
    # the documents whose middle lies before the quota's end in a pass are in that pass
    passes = F.least(F.col("times").cast("bigint"), F.floor((F.col("quota") - F.col("offset") - F.col("tokens") / 2) / F.col("held")) + 1).cast("int")
    rows = rows.withColumn("passes", passes).where("passes > 0").withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    number = F.floor(((F.col("repeat_no") - 1).cast("bigint") * F.col("held") + F.col("offset")) / F.lit(block))
    number = F.least(number, F.col("blocks") - 1)  # what starts at the very end belongs to the last block
    rows = rows.withColumn("block", number.cast("bigint")).join(_schedule(spark, counts), ["source", "block"])
    return rows.select("slot", F.col("source").alias("source_name"), "doc_id", "repeat_no", "tokens")


def _schedule(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """(source, block, slot) of every block: at most ``SLOTS`` rows and one a source."""
    names = sorted(counts)
    of = {s: i for i, s in enumerate(names)}
    order = np.array([of[s] for s in pfair_slots(counts)], dtype=np.int64)
    by_source = np.argsort(order, kind="stable")
    block = np.concatenate([np.arange(counts[s], dtype=np.int64) for s in names])
    source = pa.array(np.repeat(names, [counts[s] for s in names]).tolist())
    return spark.createDataFrame(pa.table({"source": source, "block": block, "slot": by_source.astype(np.int64)}))


def chosen_documents(mixture: DataFrame) -> DataFrame:
    """One row per chosen document: how often it is used and from which slot on."""
    return mixture.groupBy("source_name", "doc_id").agg(F.count("*").cast("int").alias("repeats"), F.first("tokens").alias("tokens"), F.min("slot").alias("first_slot"))


def mix_shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of every source of ``targets``, absent ones included."""
    used = mixture.groupBy("source_name", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).groupBy("source_name").agg(F.count("*").alias("documents"), F.max("n").alias("most_repeats"), F.sum("t").alias("tokens"))
    used = materialize(used)
    total = used.agg(F.sum("tokens").alias("_all"))
    wanted = targets.select(source_key(F.col("source_name")).alias("source_name"), "target_share", "max_repeats")
    out = wanted.join(used, "source_name", "left").crossJoin(total)  # one row
    none = F.lit(0)
    return out.select(
        "source_name", "target_share", "max_repeats", F.coalesce("documents", none).alias("documents"), F.coalesce("most_repeats", none).alias("most_repeats"),
        F.coalesce("tokens", none).alias("tokens"), F.coalesce(F.try_divide(F.col("tokens"), F.col("_all")), F.lit(0.0)).alias("actual_share"),
    )
