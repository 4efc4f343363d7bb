"""The training-data queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm import mixing, neighbors, overlaps, packing, sentences, splits
from lumaframe.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.torn_rows(table(spark, sf_dir, "fold_0"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(table(spark, sf_dir, "fold_0"), table(spark, sf_dir, "split_targets"))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "split_targets")
    return splits.split_shares(splits.assign_splits(table(spark, sf_dir, "fold_0"), targets), targets)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlaps.cross_split_pairs(table(spark, sf_dir, "experiences"))
    return pairs.select(F.least("eval_id", "train_id").cast("bigint").alias("row_a"), F.greatest("eval_id", "train_id").cast("bigint").alias("row_b"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.overlap_counts(table(spark, sf_dir, "experiences"))


def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against brute force, for every evaluation row whose id is divisible by 20."""
    return overlaps.overlap_recall(table(spark, sf_dir, "experiences"), F.col("row_id") % 20 == 0)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "experiences")
    found = [neighbors.neighbor_pairs(rows, F.col(f"fixed_features.{name}"), dim, name) for name, dim in (("visual_embedding", 192), ("luminance_histogram", 32))]
    return found[0].unionByName(found[1])


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against brute force, for every row whose id is divisible by 20."""
    rows = table(spark, sf_dir, "experiences")
    asked = F.col("row_id") % 20 == 0
    found = [neighbors.recall_of_index(rows, asked, F.col(f"fixed_features.{name}"), dim, name) for name, dim in (("visual_embedding", 192), ("luminance_histogram", 32))]
    return found[0].unionByName(found[1])


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"))


def p6_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_summary(p6_packing(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.chosen_documents(_mixture(spark, sf_dir))


def p7_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_shares(_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_rows(table(spark, sf_dir, "documents")).select("doc_id", "end_pos")


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


_ALL = (p1_found, p1_splits, p1_shares, p2_found, p2_counts, p2_recall, p3_found, p3_recall, p6_packing, p6_summary, p7_mix, p7_schedule, p7_shares, p8_found, p8_sentences)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_WHOLE = "regexp_replace({}, '^0*([0-9]+)$', '\\1')"
_READ = f"""
n AS (SELECT *, regexp_extract_all(scene_id, '[0-9]+') AS sn, regexp_extract_all(physical_scene_id, '[0-9]+') AS pn, regexp_replace(lower(dataset_split), '[^a-z]+', '', 'g') AS word FROM {{table}}),
k AS (SELECT *, CASE WHEN len(sn) >= 2 THEN {_WHOLE.format("sn[1]")} || '_' || {_WHOLE.format("sn[2]")} END AS scene,
  {_WHOLE.format("CASE WHEN len(pn) >= 1 THEN pn[1] WHEN len(sn) >= 2 THEN sn[2] END")} AS physical,
  CASE WHEN word IN ('train', 'training') THEN 'train' WHEN word IN ('validation', 'val', 'valid', 'dev') THEN 'validation' WHEN word IN ('test', 'testing') THEN 'test' END AS split FROM n)
"""

P1_FOUND = (
    "WITH RECURSIVE "
    + _READ.format(table="fold_0")
    + """,
e AS (SELECT DISTINCT 'p' || physical AS u, coalesce('s' || scene, 'p' || physical) AS v FROM k WHERE physical IS NOT NULL),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT u AS node, u AS other FROM b UNION SELECT r.node, b.v FROM reach r JOIN b ON b.u = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
m AS (SELECT k.row_id, k.split, CASE WHEN k.split = 'train' THEN cross_fold END AS fold, root FROM k JOIN roots ON node = 'p' || physical),
t AS (SELECT root, min(row_id) AS unit_id FROM m GROUP BY root HAVING count(DISTINCT split) >= 2 OR count(DISTINCT fold) >= 2)
SELECT unit_id::BIGINT AS unit_id, row_id::BIGINT AS row_id FROM m JOIN t USING (root)"""
)

P2_FOUND = (
    "WITH "
    + _READ.format(table="experiences")
    + """,
v AS (SELECT row_id, split, scene, CASE WHEN len(x) = 192 AND list_bool_and(list_transform(x, lambda z: z IS NOT NULL AND isfinite(z))) AND list_bool_or(list_transform(x, lambda z: z <> 0)) THEN x END AS x
  FROM (SELECT row_id, split, scene, fixed_features.visual_embedding AS x FROM k WHERE split IS NOT NULL)),
u AS (SELECT row_id, split, scene, x, sqrt(list_sum(list_transform(x, lambda z: z * z))) AS n FROM v)
SELECT least(a.row_id, b.row_id)::BIGINT AS row_a, greatest(a.row_id, b.row_id)::BIGINT AS row_b FROM u a JOIN u b ON a.split <> 'train' AND b.split = 'train'
WHERE coalesce(a.scene = b.scene, false) OR coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) / (a.n * b.n) >= 0.99, false)"""
)


_USABLE = """
v AS (SELECT row_id, split, scene, label_source, CASE WHEN len(x) = 192 AND list_bool_and(list_transform(x, lambda z: z IS NOT NULL AND isfinite(z))) AND list_bool_or(list_transform(x, lambda z: z <> 0)) THEN x END AS x
  FROM (SELECT row_id, split, scene, label_source, fixed_features.visual_embedding AS x FROM k WHERE split IS NOT NULL)),
u AS (SELECT *, sqrt(list_sum(list_transform(x, lambda z: z * z))) AS n FROM v)"""

P2_COUNTS = (
    "WITH "
    + _READ.format(table="experiences")
    + ","
    + _USABLE
    + """,
c AS (SELECT a.row_id, coalesce(a.scene = b.scene, false) AS same, coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) / (a.n * b.n) >= 0.99, false) AS near FROM u a JOIN u b ON a.split <> 'train' AND b.split = 'train'),
p AS (SELECT row_id, count(*) FILTER (same) AS s, count(*) FILTER (near AND NOT same) AS n FROM c GROUP BY row_id)
SELECT split, label_source, count(*) AS rows, count(*) FILTER (coalesce(p.s, 0) + coalesce(p.n, 0) > 0) AS overlapping_rows, coalesce(sum(p.s), 0)::BIGINT AS scene_pairs, coalesce(sum(p.n), 0)::BIGINT AS near_pairs
FROM u LEFT JOIN p USING (row_id) WHERE split <> 'train' GROUP BY split, label_source"""
)


def oracle_sql() -> dict[str, str]:
    """SQL of the exact, non-iterative results; the others are tested against brute force."""
    return {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_counts": P2_COUNTS}
