"""A query set against an index in blocks: buckets of any size, bounded memory."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lumaframe.session import materialize

BLOCK = 16_384  # query vectors a task holds at once
SCORES = 1 << 24  # scores a kernel should compute at once
CHUNK = 4096  # rows handed to a kernel at once
TASK_BYTES = 24 << 20  # bytes of vectors a shuffle partition should hold
FIXED_POINT = 2.0**31  # unit vectors can travel as 32-bit fixed point, with an error below 2.4e-10


def pack_fixed(vecs: np.ndarray) -> list[bytes]:
    """Numbers in [-1, 1] as 32-bit fixed point, one blob per row."""
    whole = np.clip(np.rint(vecs * FIXED_POINT), -FIXED_POINT, FIXED_POINT - 1).astype("<i4")
    return [row.tobytes() for row in whole]


def hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true cells of a sparse mask, eight cells at a time."""
    flat = mask.ravel()
    whole = flat.size // 8 * 8
    eights = flat[:whole].view(np.uint64)
    words = np.flatnonzero(eights)
    at, bit = np.nonzero(flat[:whole].reshape(-1, 8)[words])
    cells = np.concatenate([words[at] * 8 + bit, whole + np.flatnonzero(flat[whole:])])
    return np.divmod(cells, mask.shape[1]) if mask.shape[1] else (cells, cells)


def pack_floats(vecs: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(vecs, dtype="<f8")]


def stream_blocks(queries: DataFrame | None, index: DataFrame, kernel: Callable, schema: str, dim: int, block: int = BLOCK, fixed: bool = False) -> DataFrame:
    """Each bucket's index rows stream past each block of its queries.

    ``queries`` None: the index queries itself.  A bucket with n queries is cut into
    ceil(n / block) blocks by a hash of the id; block and bucket name the shuffle
    key, so the blocks of a hot bucket spread over all tasks.  ``kernel()`` makes an
    object with ``start(ids, vecs)``, ``feed(ids, vecs)`` and ``end() -> columns``;
    one whose results are unbounded also has ``drain() -> columns or None``, which is
    asked after every chunk.
    ``vec`` is a blob made by ``pack_floats``, or by ``pack_fixed`` if ``fixed``.
    """
    asking = index if queries is None else queries
    sizes = materialize(asking.groupBy("key").count().withColumn("blocks", F.ceil(F.col("count") / block).cast("int")))
    counts = sizes.select("key", "blocks")  # one small row per bucket; their number is 2^width a table
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = index.join(F.broadcast(counts), "key").withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    if queries is None:
        rows = spread.withColumn("role", (F.col("blk") != own).cast("int")).select("key", "blk", "role", "id", "vec")
    else:
        asked = queries.join(F.broadcast(counts), "key").select("key", own.alias("blk"), F.lit(0).alias("role"), "id", "vec")
        rows = asked.unionByName(spread.select("key", "blk", F.lit(1).alias("role"), "id", "vec"))
    per_key = sizes if queries is None else index.groupBy("key").count().join(counts, "key")
    copies = per_key.agg(F.sum(F.col("count") * F.col("blocks"))).first()[0] or 0
    parts = max(index.sparkSession.sparkContext.defaultParallelism, math.ceil(copies * dim * (4 if fixed else 8) / TASK_BYTES))
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    self_join = queries is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, at = kernel(), None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        started = False

        def made(cols: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
            if cols is not None and len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        drain = getattr(work, "drain", lambda: None)

        def begin() -> Iterator[pa.RecordBatch]:
            nonlocal started
            ids = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.int64)
            vecs = np.concatenate([h[1] for h in held]) if held else np.zeros((0, dim))
            held.clear()
            work.start(ids, vecs)
            if self_join:
                for i in range(0, len(ids), CHUNK):
                    work.feed(ids[i : i + CHUNK], vecs[i : i + CHUNK])
                    yield from made(drain())
            started = True

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal started
            if not started:
                yield from begin()
            cols = work.end()
            started = False
            yield from made(cols)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, blk, role, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            vecs = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype="<i4" if fixed else "<f8").reshape(n, dim)
            if fixed:
                vecs = vecs / FIXED_POINT
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(blk) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, n], strict=True):
                here = (key[a], blk[a])
                if here != at:
                    if at is not None:
                        yield from finish()
                    at = here
                if role[a] == 0:
                    held.append((ids[a:b], vecs[a:b]))
                else:
                    if not started:
                        yield from begin()
                    for i in range(a, b, CHUNK):
                        work.feed(ids[i : min(b, i + CHUNK)], vecs[i : min(b, i + CHUNK)])
                        yield from made(drain())
        if at is not None:
            yield from finish()

    return rows.repartition(parts, "key", "blk").sortWithinPartitions("key", "blk", "role").mapInArrow(run, schema)
