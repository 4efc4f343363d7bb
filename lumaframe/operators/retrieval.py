"""Filtered, weighted nearest neighbours of a query set among all rows of a memory."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.operators.blocks import pack_floats, stream_blocks
from lumaframe.operators.skew import hot_key_join, top_per_key

ROWS_PER_SLICE = 50_000
_FLOOR = 1e-12


@dataclass(frozen=True)
class Component:
    """One distance: an array column of ``dim`` numbers, its kind, weight and divisor."""

    column: str
    kind: str  # cosine, jensen_shannon or euclidean
    dim: int
    weight: float
    scale: float = 1.0


class WeightedKernel:
    """Scores a block of queries against chunks of the memory and keeps the k best."""

    def __init__(self, parts: list[Component], excludes: int, k: int, decimals: int = 9):
        self.parts, self.excludes, self.k, self.decimals = parts, excludes, k, decimals

    def _split(self, vecs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        out, at = [], 0
        for p in self.parts:
            out.append(vecs[:, at : at + p.dim])
            at += p.dim
        return out, vecs[:, at : at + self.excludes]

    def start(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        self.ids, (self.own, self.marks) = ids, self._split(vecs)
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _distance(self, part: Component, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if part.kind == "cosine":
            na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                d = 1 - (a @ b.T) / np.outer(na, nb)
            return np.where(np.outer(na > 0, nb > 0), np.clip(d, 0, 2), 1.0)
        if part.kind == "jensen_shannon":
            p, q = np.maximum(a, _FLOOR), np.maximum(b, _FLOOR)
            p, q = p / p.sum(axis=1, keepdims=True), q / q.sum(axis=1, keepdims=True)
            ep, eq = (p * np.log(p)).sum(axis=1), (q * np.log(q)).sum(axis=1)
            mixed = np.zeros((len(p), len(q)))
            for i in range(p.shape[1]):
                m = (p[:, i : i + 1] + q[:, i]) / 2
                mixed += m * np.log(m)
            return np.sqrt(np.maximum((ep[:, None] + eq) / 2 - mixed, 0.0))
        square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
        if a.shape[1] <= 16:  # few dimensions: the exact sum of squares
            square = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
        return np.sqrt(np.maximum(square, 0.0))

    def feed(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        for i in range(0, len(ids), 1024):
            self._feed(ids[i : i + 1024], vecs[i : i + 1024])

    def _feed(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        if not len(self.ids) or not len(ids):
            return
        other, marks = self._split(vecs)
        score = np.zeros((len(self.ids), len(ids)))
        for part, a, b in zip(self.parts, self.own, other, strict=True):
            score += part.weight * self._distance(part, a, b) / part.scale
        hidden = self.ids[:, None] == ids
        for c in range(self.excludes):
            hidden |= (self.marks[:, c : c + 1] == marks[:, c]) & (self.marks[:, c : c + 1] >= 0)
        score = np.round(score, self.decimals)
        score[hidden] = np.inf
        if len(ids) > self.k:  # whatever ties with the k-th stays in
            edge = np.partition(score, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            rows, cols = np.nonzero(score <= edge)
        else:
            rows, cols = (x.ravel() for x in np.indices(score.shape))
        s, o = score[rows, cols], ids[cols]
        keep = np.isfinite(s)
        self.best.append((rows[keep], o[keep], s[keep]))
        if self.best:
            q, o, s = (np.concatenate([b[i] for b in self.best]) for i in range(3))
            order = np.lexsort((o, s, q))
            q, o, s = q[order], o[order], s[order]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
            self.best = [(q[rank < self.k], o[rank < self.k], s[rank < self.k])]

    def end(self) -> list[np.ndarray]:
        if not self.best:
            return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        q, o, s = (np.concatenate([b[i] for b in self.best]) for i in range(3))
        return [self.ids[q], o, s]


def _packed(rows: DataFrame, key: str, parts: list[Component], excludes: list[str]) -> DataFrame:
    """(id, vec): all components and exclusion marks of a row as one block of doubles."""
    arrays = [F.col(p.column).cast("array<double>").alias(f"c{i}") for i, p in enumerate(parts)]
    marks = [F.when(F.col(c).isNotNull(), F.shiftrightunsigned(F.xxhash64(c), 12)).otherwise(F.lit(-1)).cast("double").alias(f"m{i}") for i, c in enumerate(excludes)]
    whole = rows.select(F.col(key).cast("bigint").alias("id"), *arrays, *marks).where(F.col("id").isNotNull())
    for i, p in enumerate(parts):
        finite = F.forall(f"c{i}", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        whole = whole.where(F.coalesce((F.size(f"c{i}") == p.dim) & finite, F.lit(False)))
    joined = F.concat(*[F.col(f"c{i}") for i in range(len(parts))], F.array(*[F.col(f"m{i}") for i in range(len(marks))]) if marks else F.array().cast("array<double>"))
    width = sum(p.dim for p in parts) + len(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pack_floats(flat), type=pa.binary())], names=["id", "vec"])

    return whole.select("id", joined.alias("v")).mapInArrow(run, "id bigint, vec binary")


def weighted_neighbors(queries: DataFrame, memory: DataFrame, key: str, parts: list[Component], k: int, excludes: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, other_id, score, rank): the k rows of ``memory`` with the least score.

    The score is the weighted sum of the components' distances.  A pair is excluded
    if it is the same row or agrees in any of the columns ``excludes``; a null on
    either side excludes nothing.  Rows whose components are null, of another
    length or not finite take no part.  Ties: score to 9 decimals, then id.

    The query set is stated by the caller and meets the memory in blocks: the memory
    is cut into slices, each slice streams past each block of queries, and only k
    rows per query and slice leave a task.  Nothing is broadcast.
    """
    slices = max(1, math.ceil(memory.count() / ROWS_PER_SLICE), memory.sparkSession.sparkContext.defaultParallelism // 2)
    index = _packed(memory, key, parts, list(excludes)).withColumn("key", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("bigint"))
    asking = _packed(queries, key, parts, list(excludes)).withColumn("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))))
    width = sum(p.dim for p in parts) + len(excludes)
    near = stream_blocks(asking, index, partial(WeightedKernel, parts, len(excludes), k), "query_id bigint, other_id bigint, score double", width, block=1024)
    return top_per_key(near, ["query_id"], [F.col("score"), F.col("other_id")], k)


def crossfold_neighbors(queries: DataFrame, memory: DataFrame, key: str, parts: list[Component], k: int, fold: str, excludes: tuple[str, ...] = ()) -> DataFrame:
    """``weighted_neighbors`` in which a query with a fold meets only rows of other folds.

    A row of the memory without a fold is in no fold's memory, so only queries
    without one (held out) meet it: those retrieve from the full memory.
    """
    folded = weighted_neighbors(queries.where(F.col(fold).isNotNull()), memory.where(F.col(fold).isNotNull()), key, parts, k, (*excludes, fold))
    return folded.unionByName(weighted_neighbors(queries.where(F.col(fold).isNull()), memory, key, parts, k, excludes))


def context(ranked: DataFrame, memory: DataFrame | None = None, key: str = "row_id", fields: tuple[str, ...] = (), weights: dict[str, float] | None = None) -> DataFrame:
    """One row per query: its best neighbour, all of them in order, and the weights of the score.

    With ``memory`` every example carries the columns ``fields`` of its row.
    """
    item = F.struct("rank", "other_id", "score", *fields)
    if memory is not None and fields:
        ranked = hot_key_join(ranked, memory.select(F.col(key).alias("other_id"), *fields), "other_id")
    out = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("examples"))
    known = F.create_map(*[F.lit(x) for pair in (weights or {}).items() for x in pair]) if weights else F.lit(None).cast("map<string,double>")
    return out.withColumns({"best": F.get("examples", F.lit(0)), "distance_weights": known})


def leaks(ranked: DataFrame, rows: DataFrame, key: str, group: str) -> DataFrame:
    """Neighbours that share the group of their query; empty if isolation holds."""
    groups = rows.select(key, group)
    own = groups.select(F.col(key).alias("query_id"), F.col(group).alias("own"))
    theirs = groups.select(F.col(key).alias("other_id"), F.col(group).alias("theirs"))
    return ranked.join(own, "query_id").join(theirs, "other_id").where("own = theirs")
