"""Filling fixed-capacity containers: bound-certified repacking.

Documents are dealt to partitions by a hash; each partition packs its own by
best-fit decreasing and proves, by dual feasible functions, how many containers it
needs at least.  A partition that needs what it has is certified: it keeps its
containers, all but the emptiest.  Partitions with a gap send every open container
back.  What is sent back is dealt anew to as many partitions as it needs and packed
again.  A pack (container size) is done when its whole count meets the bound of all
its pieces, when one partition holds the rest, or when an exchange gains nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.tokens import TOKENIZER, TOKENIZER_DIR, token_counts
from lumaframe.session import materialize, release

ITEMS_PER_PARTITION = 20_000
ROUNDS = 8  # most packings of a pack: a parameter of pack_documents
PACKS = 1_000  # container sizes; their number is checked


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers any packing needs, the best of two families of dual feasible functions.

    Thresholds: items above C - t count C, items below t nothing, the rest their size
    (t = 0 is the plain volume).  Rounded: x counts floor((k+1) x / C) / k unless
    (k+1) x / C is whole.
    """
    sizes = sizes[sizes > 0].astype(np.int64)
    return _bound(np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(np.int64), capacity)


def _bound(count: np.ndarray, capacity: int) -> int:
    if not count.any():
        return 0
    values = np.arange(capacity + 1, dtype=np.int64)
    upto, volume = np.cumsum(count), np.cumsum(count * values)
    t = np.arange(0, capacity // 2 + 1)
    big = upto[capacity] - upto[capacity - t]
    small = np.where(t > 0, volume[np.maximum(t - 1, 0)], 0)
    best = int(np.max(-(-(big * capacity + volume[capacity - t] - small) // capacity)))
    for k in range(2, 21):
        scaled = (k + 1) * values
        # in units of C / k: where (k+1) x / C is whole x keeps its size, else it rounds down
        units = np.where(scaled % capacity == 0, k * values / capacity, scaled // capacity)
        best = max(best, int(np.ceil((units * count).sum() / k - 1e-9)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each size (largest first, ties by place): the fullest fit."""
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(sizes), dtype=np.int64)
    room: list[int] = []  # distinct free rooms, ascending
    bins: dict[int, list[int]] = {}
    made = 0
    for i in order:
        size = int(sizes[i])
        at = bisect_left(room, size)
        if at < len(room):
            free = room[at]
            held = bins[free]
            b = held.pop()
            if not held:
                room.pop(at)
                del bins[free]
        else:
            b, free = made, capacity
            made += 1
        out[i] = b
        free -= size
        if free in bins:
            bins[free].append(b)
        else:
            bins[free] = [b]
            insort(room, free)
    return out


def _pack(part: pd.DataFrame) -> pd.DataFrame:
    """One partition packed; ``sent``: the container goes back for exchange."""
    capacity = int(part["capacity"].iloc[0])
    part = part.sort_values(["item", "piece_no"], kind="stable")
    sizes = part["tokens"].to_numpy()
    own = best_fit_decreasing(sizes, capacity)
    free = (capacity - np.bincount(own, weights=sizes)).astype(np.int64)
    if len(free) > lower_bound(sizes, capacity):  # a gap: all that is open is exchanged
        sent = free > 0
    else:  # certified: no other packing of these pieces has fewer containers, but the emptiest may take others' pieces
        sent = np.zeros(len(free), dtype=bool)
        sent[np.argmax(free)] = free.max() > 0
    out = part[[f.split()[0] for f in _PIECE.split(", ")]].copy()
    out["part"], out["bin"], out["sent"] = part["part"].to_numpy(), own, sent[own]
    return out


_PIECE = "pack_name string, capacity int, item bigint, doc_id bigint, piece_no int, start_token bigint, tokens bigint"
_PACKED = _PIECE + ", part int, bin bigint, sent boolean"


def _pieces(counts: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """One row per pack and piece: documents beyond the capacity come in full pieces and a rest."""
    sizes = F.array(*[F.struct(F.lit(name).alias("pack_name"), F.lit(capacity).cast("int").alias("capacity")) for name, capacity in specs])
    rows = counts.withColumn("s", F.explode(sizes)).select("item", "doc_id", "tokens", "s.pack_name", "s.capacity")
    last = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")).cast("int"), F.lit(1))
    rows = rows.withColumn("piece_no", F.explode(F.sequence(F.lit(1), last)))
    start = ((F.col("piece_no") - 1) * F.col("capacity")).cast("bigint")
    return rows.select("pack_name", "capacity", "item", "doc_id", "piece_no", start.alias("start_token"), F.least(F.col("tokens") - start, F.col("capacity").cast("bigint")).alias("tokens"))


_OUT = ["pack_name", "container_id", "doc_id", "piece_no", "start_token", "tokens"]


def pack_documents(docs: DataFrame, specs: DataFrame, tokenizer: str = f"{TOKENIZER_DIR}/{TOKENIZER}", rounds: int = ROUNDS) -> DataFrame:
    """The container of every document piece, for every container size of ``specs``.

    Output: ``pack_name, container_id, doc_id, piece_no, start_token, tokens``.  Null,
    empty and blank texts are packed too (empty ones take no space).  A document is
    one piece unless it exceeds the capacity; then all its pieces but the last are
    full.  Sizes with a null name, or a null or non-positive capacity, are left out; of
    equal names the least capacity counts.  Rows with a null doc_id are dropped; equal
    doc_ids count as separate documents.  ``rounds`` bounds the packings of a pack;
    what is open after the last one stays as it is.
    """
    wanted = specs.where(F.col("pack_name").isNotNull() & (F.col("capacity_tokens") > 0)).groupBy("pack_name").agg(F.min("capacity_tokens").cast("int"))
    given = sorted(tuple(r) for r in wanted.limit(PACKS + 1).collect())
    if len(given) > PACKS:
        raise ValueError(f"more than {PACKS} container sizes")
    if not given:
        return docs.sparkSession.createDataFrame([], "pack_name string, container_id string, doc_id bigint, piece_no int, start_token bigint, tokens bigint")
    sized = token_counts(docs.where(F.col("doc_id").isNotNull()), tokenizer=tokenizer)
    counts = materialize(sized.withColumn("item", F.monotonically_increasing_id()))  # the written numbers stay
    pieces = materialize(_pieces(counts, given))
    release(counts)
    out = materialize(_exchanged(pieces, rounds))
    release(pieces)
    return out


def _by_pack(numbers: dict[str, int]) -> Column:
    """The number of the row's pack."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), F.col("pack_name"))


def _exchanged(pieces: DataFrame, rounds: int) -> DataFrame:
    full = pieces.where(F.col("tokens") == F.col("capacity"))
    done = [full.withColumn("container_id", F.concat_ws("-", F.lit("full"), "item", "piece_no")).select(_OUT)]
    rest = pieces.where(F.col("tokens") < F.col("capacity"))
    bounds = {r[0]: r[1] for r in _bounds(rest).collect()}  # one number a pack
    left = {r[0]: r[1] for r in rest.groupBy("pack_name").count().collect()}  # pieces still to be packed
    settled = dict.fromkeys(left, 0)  # containers that stay as they are
    before: dict[str, int] = {}
    kept = None
    for turn in range(rounds):
        if not left:
            break
        parts = {p: max(1, -(-n // ITEMS_PER_PARTITION)) for p, n in left.items()}
        dealt = rest.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "item", "piece_no"), _by_pack(parts)).cast("int"))
        packed = materialize(dealt.groupBy("pack_name", "part").applyInPandas(_pack, _PACKED))
        packed = packed.withColumn("container_id", F.concat_ws("-", F.lit(str(turn)), "part", "bin"))
        bins = packed.groupBy("pack_name", "part", "bin").agg(F.first("sent").alias("sent"), F.count("*").alias("n")).groupBy("pack_name")
        state = {r["pack_name"]: r for r in bins.agg(F.count("*").alias("made"), F.count_if("sent").alias("open"), F.sum(F.when(F.col("sent"), F.col("n")).otherwise(0)).alias("pieces")).collect()}
        worse = [p for p in left if p in before and state[p]["made"] >= before[p]]  # the exchange gained nothing
        ended = [p for p in left if p not in worse and (settled[p] + state[p]["made"] <= bounds[p] or parts[p] == 1 or not state[p]["open"] or turn == rounds - 1)]
        if worse:
            done.append(kept.where(F.col("pack_name").isin(worse)))
        if ended:
            done.append(packed.where(F.col("pack_name").isin(ended)).select(_OUT))
        on = [p for p in left if p not in worse and p not in ended]
        going = packed.where(F.col("pack_name").isin(on))
        done.append(going.where(~F.col("sent")).select(_OUT))
        kept = going.where("sent").select(_OUT)
        rest = going.where("sent").select(*[f.split()[0] for f in _PIECE.split(", ")])
        for p in on:
            settled[p] += state[p]["made"] - state[p]["open"]
        left, before = {p: state[p]["pieces"] for p in on}, {p: state[p]["open"] for p in on}
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _bounds(pieces: DataFrame) -> DataFrame:
    """(pack_name, lower_bound) of all pieces, from their counts by size: at most ``capacity`` numbers a pack."""
    sizes = pieces.groupBy("pack_name", "capacity", "tokens").count()

    def bound(part: pd.DataFrame) -> pd.DataFrame:
        capacity = int(part["capacity"].iloc[0])
        return pd.DataFrame({"pack_name": [part["pack_name"].iloc[0]], "lower_bound": [lower_bound_by_count(part["tokens"].to_numpy(), part["count"].to_numpy(), capacity)]})

    return sizes.groupBy("pack_name").applyInPandas(bound, "pack_name string, lower_bound bigint")


def packing_summary(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per container size: containers, the certified lower bound, unused share.

    The bound is that of all pieces together, so it holds for every possible packing.
    """
    capacities = specs.where(F.col("pack_name").isNotNull() & (F.col("capacity_tokens") > 0)).groupBy("pack_name").agg(F.min("capacity_tokens").cast("int").alias("capacity"))
    bounds = _bounds(packed.join(capacities, "pack_name"))
    bins = packed.groupBy("pack_name", "container_id").agg(F.sum("tokens").alias("t"), F.count_if(F.col("piece_no") == 1).alias("d"))
    used = bins.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("d").alias("documents"), F.sum("t").alias("tokens"))
    out = used.join(bounds, "pack_name").join(capacities, "pack_name")
    return out.select("pack_name", "capacity", "documents", "tokens", "containers", "lower_bound", (F.lit(1.0) - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"))


def lower_bound_by_count(values: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """``lower_bound`` from distinct sizes and their counts."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    np.add.at(count, values.astype(np.int64), counts.astype(np.int64))
    count[0] = 0
    return _bound(count, capacity)
