"""Helpers for Arrow-batched Python stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

ROWS_PER_BATCH = 5_000


def clean_text(text: str) -> str:
    """``text`` with lone surrogates replaced, as UTF-8 cannot hold them."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where a scan has fewer partitions than there are cores.

    A small file is one partition whatever the Python work on it.  Inputs that are
    computed by shuffles are left as they are.
    """
    execution = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in execution.executedPlan().toString() or execution.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def flat_map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., list[tuple]]], schema: str) -> DataFrame:
    """Each row's ``columns`` go through ``make()(...)``, which gives any number of rows.

    ``make`` runs once per task, so that models and tables are built once.  Output
    is cut into bounded batches: one very long row cannot fill the worker's memory
    beyond its own result.
    """
    out_type: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, rows = make(), []

        def pack(part: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*part, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for values in zip(*(batch.column(i).to_pylist() for i in range(len(columns))), strict=True):
                rows.extend(each(*values))
                while len(rows) >= ROWS_PER_BATCH:
                    yield pack(rows[:ROWS_PER_BATCH])
                    del rows[:ROWS_PER_BATCH]
        if rows:
            yield pack(rows)

    return spread(df.select(*columns)).mapInArrow(run, out_type)
