"""Command line: run a registered query and write its result.

    python -m lumaframe.jobs list
    python -m lumaframe.jobs run NAME --data DIR --out PATH [--format parquet|json|csv]
    python -m lumaframe.jobs show NAME --data DIR [--rows 20]
    python -m lumaframe.jobs splits --data DIR --out FILE [--seed 42] [--folds 4]
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import functions as F

from lumaframe.operators import splits
from lumaframe.plans import catalog
from lumaframe.session import get_spark
from lumaframe.sources.jsonl import write_one_file
from lumaframe.sources.tables import table


def all_queries() -> dict:
    """Core queries, and those of any installed extension module named in the entry."""
    try:
        return importlib.import_module("__spark_entry__").queries()
    except ImportError:
        return catalog.queries()


def write_manifest(spark, data: str, out: str, seed: int, folds: int) -> None:
    """Splits and folds of the physical scenes as one JSON document (one entry a scene group)."""
    rows = table(spark, data, "fold_0")
    assigned = splits.grouped_split(rows, "physical_scene_id", seed)
    train = rows.join(assigned.where("split = 'train'"), "physical_scene_id", "left_semi")
    numbered = assigned.join(splits.cross_folds(train, "physical_scene_id", folds, seed), "physical_scene_id", "left")
    counts = splits.split_counts(assigned).first().asDict()
    entry = F.to_json(F.struct(F.col("physical_scene_id").alias("k")))
    name = F.expr("substr(j, 6, length(j) - 6)")  # the group as a JSON string
    body = numbered.select("physical_scene_id", entry.alias("j"), F.to_json(F.struct("split", "fold"), {"ignoreNullFields": "false"}).alias("v"))
    body = body.select(F.lit(1).alias("part"), "physical_scene_id", F.concat(name, F.lit(": "), "v").alias("line"))
    first = F.col("physical_scene_id") == F.lit(assigned.agg(F.min("physical_scene_id")).first()[0])
    body = body.withColumn("line", F.concat(F.when(first, "").otherwise(","), "line"))
    head, foot = '{"seed": %d, "counts": %s, "groups": {' % (seed, json.dumps(counts)), "}}"
    ends = spark.createDataFrame([(0, None, head), (2, None, foot)], "part int, physical_scene_id string, line string")
    write_one_file(ends.unionByName(body).orderBy("part", "physical_scene_id").select("line"), out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lumaframe")
    parser.add_argument("command", choices=["list", "run", "show", "splits"])
    parser.add_argument("name", nargs="?")
    parser.add_argument("--data")
    parser.add_argument("--out")
    parser.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    parser.add_argument("--rows", type=int, default=20)
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--folds", type=int, default=4)
    parser.add_argument("--master")
    args = parser.parse_args(argv)
    queries = all_queries()
    if args.command == "list":
        print("\n".join(sorted(queries)))
        return
    if not args.data or (args.command in ("run", "splits") and not args.out) or (args.command != "splits" and args.name not in queries):
        parser.error("a known query, --data and (to write) --out are needed")
    spark = get_spark("lumaframe", args.master)
    if args.command == "splits":
        write_manifest(spark, args.data, args.out, args.seed, args.folds)
        return
    result = queries[args.name](spark, args.data)
    if args.command == "show":
        result.limit(args.rows).show(args.rows, truncate=False)
        return
    if args.format == "csv":  # nested columns as JSON text
        result = result.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else c for c, t in result.dtypes])
    result.write.mode("overwrite").format(args.format).save(args.out)


if __name__ == "__main__":
    main()
