"""JSON-lines sources and sinks.

A line counts as a record only if it is a JSON object: blank, cut-off, array and
scalar lines are passed over (tolerant) or raise (strict).  ``spark.read.json`` is
not used, as it explodes arrays and voids rows with one odd field.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumaframe.functions.exprs import resolve_path
from lumaframe.operators.order import first_wins
from lumaframe.session import materialize, release


def line_kind(line: Column) -> Column:
    """``object``, ``array``, ``scalar``, ``blank`` or ``broken``."""
    value = F.try_parse_json(line)
    shape = F.schema_of_variant(value)
    return (
        F.when(F.coalesce(F.trim(F.regexp_replace(line, r"\s+", " ")), F.lit("")) == "", F.lit("blank"))
        .when(value.isNull(), F.lit("broken"))
        .when(shape.startswith("OBJECT"), F.lit("object"))
        .when(shape.startswith("ARRAY"), F.lit("array"))
        .otherwise(F.lit("scalar"))
    )


def records(lines: DataFrame, column: str, schema: str | StructType, strict: bool = False) -> DataFrame:
    """Object lines as typed columns; fields the line lacks or holds otherwise are null.

    ``strict``: a line that is neither blank nor JSON raises; non-objects are
    passed over either way.
    """
    kind = line_kind(F.col(column))
    if strict:
        kind = F.when(kind == "broken", F.raise_error(F.concat(F.lit("not JSON: "), F.substring(column, 1, 80))).cast("string")).otherwise(kind)
    return lines.where(kind == "object").select(F.from_json(column, schema).alias("r")).select("r.*")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, strict: bool = False, missing_is_empty: bool = False) -> DataFrame:
    """Records of a JSON-lines file or folder; a missing one is empty where asked."""
    if missing_is_empty and not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return records(spark.read.text(path), "value", schema, strict)


def read_image_manifest(spark: SparkSession, path: str, schema: str, base: str) -> DataFrame:
    """Manifest rows with ``image_path`` resolved below ``base``."""
    return read_jsonl(spark, path, schema).withColumn("image_path", resolve_path(F.col("image_path"), base))


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, split) of a one-document split manifest; raises on other split names."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "assignments map<string,string>").alias("m"))
    rows = doc.select(F.explode("m.assignments").alias("scene_id", "split"))
    fine = F.col("split").isin("train", "validation", "test")
    return rows.withColumn("split", F.when(fine, F.col("split")).otherwise(F.raise_error(F.concat(F.lit("no such split: "), "split")).cast("string")))


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_new_records(df: DataFrame, path: str, key: str, order: list[Column], schema: str | StructType) -> int:
    """Append rows whose key is neither in the sink nor earlier in ``df``; their number."""
    spark = df.sparkSession
    held = read_jsonl(spark, path, schema, missing_is_empty=True).select(key)
    fresh = first_wins(df, [key], order).join(held, key, "left_anti")
    fresh = materialize(fresh)  # the sink it reads is the one it appends to
    count = fresh.count()
    if count:
        append_records(fresh, path)
    release(fresh)
    return count


def count_lines(spark: SparkSession, path: str) -> int:
    """Non-blank lines."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def write_one_file(lines: DataFrame, path: str) -> None:
    """The sorted one-column ``lines`` as one text file at ``path``, written by a task through Hadoop's file system.

    For documents whose readers want a single file; the lines pass through one task, in
    order, and never through the driver.
    """
    spark = lines.sparkSession
    folder = f"{path}.writing-{uuid.uuid4().hex}"
    lines.coalesce(1).write.text(folder)
    jvm = spark.sparkContext._jvm
    at, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-"))
    fs.delete(at, False)
    fs.rename(part, at)
    fs.delete(source, True)
