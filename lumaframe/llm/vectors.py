"""Similar vectors through hashed buckets, compared block by block.

Vectors get binary codes which are split into substrings; rows that share a
substring meet in its bucket.  A bucket of any size is cut into query blocks, and
its rows stream past each block, so that no task ever holds a whole bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema

from lumaframe.operators.blocks import FIXED_POINT, SCORES, hits, pack_fixed
from lumaframe.operators.skew import top_per_key

SAMPLE = 10_000  # vectors on which codes are fitted, the least by hash


def usable(vector: Column, dim: int) -> Column:
    """Exactly ``dim`` finite numbers, not all zero; false for null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_rows(rows: DataFrame, vector: Column, dim: int, *keep: Column) -> DataFrame:
    """(row_id, ...keep, vec, h1, h2) of usable rows: vec is the unit vector in fixed point, (h1, h2) names it."""
    given = rows.select("row_id", *keep, vector.cast("array<double>").alias("vec")).where(usable(F.col("vec"), dim) & F.col("row_id").isNotNull())
    schema = StructType([*given.schema.fields[:-1], StructField("vec", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                cols = [*batch.columns[:-1], pa.array(pack_fixed(unit(v)), type=pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return given.mapInArrow(run, schema).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7), "vec")})


def exact_classes(points: DataFrame, members: int) -> DataFrame:
    """One row per distinct vector: rep (least row_id), its least ``members`` row_ids.

    Only that many rows of a vector leave a map task, however often it is repeated.
    """
    few = top_per_key(points.select("row_id", "vec", "h1", "h2"), ["h1", "h2"], [F.col("row_id")], members)
    return few.groupBy("h1", "h2").agg(
        F.min("row_id").alias("rep"), F.array_sort(F.collect_list("row_id")).alias("members"), F.first("vec").alias("vec")
    )


def sample_vectors(classes: DataFrame, dim: int, size: int = SAMPLE) -> np.ndarray:
    """At most ``size`` unit vectors, the least by hash: a fixed uniform sample."""
    got = classes.select("h1", "h2", "vec").orderBy("h1", "h2").limit(size).select("vec").toArrow()["vec"].to_pylist()
    return np.frombuffer(b"".join(got), dtype="<i4").reshape(len(got), dim) / FIXED_POINT


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow for huge or tiny values."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def fit_rotated_codes(sample: np.ndarray, bits: int, dim: int, rounds: int = 40, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Centre and rotated projection whose signs lose least: iterative quantization.

    Principal directions of the sample, then alternating signs and the orthogonal
    Procrustes rotation.  With fewer samples than directions, random directions
    fill up.
    """
    rng = np.random.default_rng(seed)
    if len(sample) < 2:
        return np.zeros(dim), np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :bits]
    mean = sample.mean(axis=0)
    x = sample - mean
    _, vectors = np.linalg.eigh(x.T @ x / len(x))
    top = vectors[:, ::-1][:, :bits]
    z = x @ top
    turn = np.linalg.qr(rng.standard_normal((top.shape[1], top.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
        turn = (u @ vt).T
    mix = rng.permutation(top.shape[1])  # each substring gets strong and weak directions
    return mean, (top @ turn)[:, mix]


@dataclass(frozen=True)
class Index:
    """Rotated codes of ``tables`` substrings of ``width`` bits."""

    mean: np.ndarray
    directions: np.ndarray
    tables: int
    width: int

    def substrings(self, v: np.ndarray) -> np.ndarray:
        """One number per row and table."""
        bits = (v - self.mean) @ self.directions[:, : self.tables * self.width] > 0
        return bits.reshape(len(v), self.tables, self.width) @ (1 << np.arange(self.width, dtype=np.int64))


BUCKET = 8_192  # rows a bucket has on average, as far as MOST_BITS allow
LEAST_BITS, MOST_BITS = 4, 24
TABLES = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32)  # numbers of tables that are tried


def substring_bits(classes: int, bucket: int = BUCKET) -> int:
    """Bits of a substring: with more rows buckets get narrower, so that their size stays."""
    return min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(1, classes) / bucket))))


ASKED = 300  # sample vectors whose true neighbours are looked up to choose the number of tables


def fit_index(classes: DataFrame, dim: int, k: int, recall: float) -> Index:
    """As few tables as find ``recall`` of the true neighbours of ``ASKED`` vectors, at the width for all rows.

    Rotations are fitted on the sample; substrings beyond ``dim`` bits come from further
    ones.  The ``ASKED`` first of the sample are compared with all classes in one scan.
    """
    sample, width = sample_vectors(classes, dim), min(dim, substring_bits(classes.count()))
    asked = sample[:ASKED]
    found = _nearest_of(classes, asked, k, dim).toPandas() if len(asked) else []
    if not len(found):
        return _rotated(sample, TABLES[-1], width, dim)
    theirs = np.frombuffer(b"".join(found["vec"]), dtype="<i4").reshape(len(found), dim) / FIXED_POINT
    for tables in TABLES:
        index = _rotated(sample, tables, width, dim)
        if (index.substrings(asked)[found["q"]] == index.substrings(theirs)).any(axis=1).mean() >= recall:
            break
    return index


def _rotated(sample: np.ndarray, tables: int, width: int, dim: int) -> Index:
    """Codes of ``tables * width`` bits; what goes beyond ``dim`` comes from further rotations."""
    fits, left = [], tables
    while left > 0:
        now = min(left, dim // width)
        fits.append(fit_rotated_codes(sample, now * width, dim, seed=5 + len(fits)))
        left -= now
    return Index(fits[0][0], np.concatenate([d for _, d in fits], axis=1), tables, width)


def _nearest_of(classes: DataFrame, asked: np.ndarray, k: int, dim: int) -> DataFrame:
    """(q, score, vec): the k nearest classes of each of a few vectors, its own left out."""
    schema = "q int, score float, vec binary"
    small = asked.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, s, v = np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, object)
        for batch in batches:
            blobs = np.array(batch.column(0).to_pylist() + [None], dtype=object)[:-1]
            if not len(blobs):
                continue
            score = small @ (np.frombuffer(b"".join(blobs), dtype="<i4").reshape(len(blobs), dim) / FIXED_POINT).astype(np.float32).T
            most = min(k + 1, len(blobs))
            top = np.argpartition(-score, most - 1, axis=1)[:, :most]
            q, s, v = np.r_[q, np.repeat(np.arange(len(small)), most)], np.r_[s, np.take_along_axis(score, top, 1).ravel()], np.r_[v, blobs[top.ravel()]]
            order = np.lexsort((-s, q))
            q, s, v = q[order], s[order], v[order]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            keep = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) <= k
            q, s, v = q[keep], s[keep], v[keep]
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(s, pa.float32()), pa.array(v.tolist(), pa.binary())], names=["q", "score", "vec"])

    near = classes.select("vec").mapInArrow(run, schema)
    return top_per_key(near, ["q"], [F.desc("score")], k + 1).where("rank > 1").drop("rank")


def threshold_index(sample: np.ndarray, classes: int, dim: int, least: float, miss: float, bucket: int = 4_096) -> Index:
    """As many tables of random directions as miss a pair of cosine ``least`` with probability ``miss``.

    Such a pair of centred vectors with mean square length s spans the angle
    arccos(1 - (1 - least) / s); a random direction parts it with that share of pi.
    Directions of one table are orthonormal.
    """
    width = min(dim, substring_bits(classes, bucket))
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    spread = float(((sample - mean) ** 2).sum(axis=1).mean()) if len(sample) > 1 else 1.0
    parted = math.acos(max(-1.0, 1 - (1 - least) / max(spread, 1e-9))) / math.pi
    shared = max((1 - parted) ** width, 1e-3)
    tables = min(128, max(1, math.ceil(math.log(miss) / math.log1p(-shared)) if shared < 1 else 1))
    each = max(1, dim // width)
    rng = np.random.default_rng(11)
    turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : each * width] for _ in range(-(-tables // each))]
    return Index(mean, np.concatenate(turns, axis=1), tables, width)


def bucket_keys(classes: DataFrame, index: Index, dim: int, extra: str = "") -> DataFrame:
    """(id, keys, vec, ...): a key for each table, of the table and its substring."""
    base = np.arange(index.tables, dtype=np.int64) << index.width
    schema: StructType = _parse_datatype_string("id bigint, keys array<bigint>, vec binary" + (f", {extra} int" if extra else ""))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<i4").reshape(n, dim) / FIXED_POINT
            keys = index.substrings(v) + base
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * index.tables + 1, index.tables, dtype=np.int32)), pa.array(keys.ravel()))
            cols = [batch.column(0), lists, batch.column(1), *([batch.column(2)] if extra else [])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return classes.select(F.col("rep").cast("bigint"), "vec", *([F.col(extra).cast("int")] if extra else [])).mapInArrow(run, schema)


def bucket_entries(classes: DataFrame, index: Index, dim: int, extra: str = "") -> DataFrame:
    """(id, key, vec, ...) for each table."""
    return bucket_keys(classes, index, dim, extra).select("id", F.explode("keys").alias("key"), "vec", *([extra] if extra else []))


def sliced(classes: DataFrame, slices: int, query: bool) -> DataFrame:
    """(id, key, vec) for a comparison with all: index rows in one slice each, queries in every slice."""
    key = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))) if query else F.pmod(F.xxhash64("rep"), F.lit(slices)).cast("bigint")
    return classes.select(F.col("rep").cast("bigint").alias("id"), key.alias("key"), "vec")


class NearestKernel:
    """The k nearest of each query, by cosine rounded to 6 decimals, then least id."""

    MARGIN = 4e-6  # float32 products may be wrong by less

    def __init__(self, k: int):
        self.k = k

    def start(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        self.ids, self.vecs, self.small = ids, vecs, vecs.astype(np.float32)
        self.q = np.zeros(0, np.int64)
        self.s, self.o = np.zeros(0), np.zeros(0, np.int64)
        self.floor = np.full(len(ids), -2.0, np.float32)
        self.fresh = True

    def feed(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        step = max(256, SCORES // max(1, len(self.ids)))
        for i in range(0, len(ids) if len(self.ids) else 0, step):
            self._feed(ids[i : i + step], vecs[i : i + step])

    def _feed(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        score = self.small @ vecs.astype(np.float32).T
        k = self.k + 1  # one of them may be the query itself
        if self.fresh and score.shape[1] > k:  # later chunks are cut by what the first left
            few = score[:, :1024]
            self.floor = np.partition(few, few.shape[1] - k, axis=1)[:, few.shape[1] - k] - self.MARGIN
            self.fresh = False
        qi, xi = hits(score >= self.floor[:, None])
        keep = self.ids[qi] != ids[xi]
        qi, xi = qi[keep], xi[keep]
        exact = np.empty(len(qi))
        for i in range(0, len(qi), 65_536):
            exact[i : i + 65_536] = np.einsum("ij,ij->i", self.vecs[qi[i : i + 65_536]], vecs[xi[i : i + 65_536]])
        q, s, o = np.concatenate([self.q, qi]), np.concatenate([self.s, np.round(exact, 6)]), np.concatenate([self.o, ids[xi]])
        order = np.lexsort((o, -s, q))
        q, s, o = q[order], s[order], o[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], (s[last] - self.MARGIN).astype(np.float32))
        self.q, self.s, self.o = q[keep], s[keep], o[keep]

    def end(self) -> list[np.ndarray]:
        return [self.ids[self.q], self.o, self.s]


class NearKernel:
    """All (query, other, cosine) with a cosine of at least ``least``."""

    def __init__(self, least: float):
        self.least = least

    def start(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        self.ids, self.vecs, self.small = ids, vecs, vecs.astype(np.float32)
        self.out: list[tuple] = []

    def feed(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        step = max(256, SCORES // max(1, len(self.ids)))
        for i in range(0, len(ids) if len(self.ids) else 0, step):
            self._feed(ids[i : i + step], vecs[i : i + step])

    def _feed(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        qi, xi = hits(self.small @ vecs.astype(np.float32).T >= self.least - 1e-5)
        for i in range(0, len(qi), 65_536):
            a, b = qi[i : i + 65_536], xi[i : i + 65_536]
            exact = np.einsum("ij,ij->i", self.vecs[a], vecs[b])
            near = exact >= self.least
            self.out.append((self.ids[a[near]], ids[b[near]], exact[near]))

    def drain(self, least: int = 1 << 20) -> list[np.ndarray] | None:
        """The hits so far once there are many: a dense block never fills the worker."""
        if sum(len(o[0]) for o in self.out) < least:
            return None
        out = self.end()
        self.out = []
        return out

    def end(self) -> list[np.ndarray]:
        if not self.out:
            return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return [np.concatenate([o[i] for o in self.out]) for i in range(3)]
