"""Queries over semi-structured records: schema drift and nested runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.operators import drift, labels, nested
from lumaframe.session import materialize
from lumaframe.sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf_dir, "memory_lines"))


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records under one set of names and types, a column for each field; what has none as JSON."""
    unified = drift.unified_table(table(spark, sf_dir, "memory_lines"))
    return unified.withColumn("rest", F.to_json("rest"))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_found(spark, sf_dir).groupBy("change_kind").agg(F.count("*").alias("changes"), F.count_distinct("file_name").alias("files"))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_runs(table(spark, sf_dir, "agent_runs_self_evolving"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.iteration_candidates(table(spark, sf_dir, "agent_runs_self_evolving"))


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.runs_table(_flat(spark, sf_dir))


def p5_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.iterations_table(_flat(spark, sf_dir))


def p5_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.candidates_table(_flat(spark, sf_dir))


def p5_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).groupBy("level", "variant").agg(F.count("*").alias("nodes"))


def p5_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every level of every run, each row with its typed members and the rest as JSON."""
    return nested.run_nodes(table(spark, sf_dir, "agent_runs_self_evolving"))


def p5_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.level_table(p5_nodes(spark, sf_dir), "decision")


def p5_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.level_table(p5_nodes(spark, sf_dir), "metadata")


def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = materialize(nested.flatten_runs(table(spark, sf_dir, "agent_runs_self_evolving"), details=True))
    return labels.run_reports(nested.runs_table(flat), nested.iterations_table(flat, "details"))


def two_stage_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.two_stage_examples(nested.iterations_table(_flat(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (p4_found, p4_table, p4_counts, p5_found, p5_runs, p5_iterations, p5_candidates, p5_variants, p5_nodes, p5_decisions, p5_metadata, run_reports, two_stage_examples)}
ORACLES: dict[str, str] = {}
