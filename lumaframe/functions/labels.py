"""Readings of dirty identifiers: scenes, physical scenes and split names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the three split names (compared trimmed, lower case).
SPLIT_SYNONYMS = {
    "train": ["train", "training", "trn", "tr"],
    "validation": ["validation", "val", "valid", "dev", "develop", "development", "eval"],
    "test": ["test", "testing", "tst", "te", "holdout"],
}


def _numbers(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(r"([0-9]+)"), 1)


def _whole(text: Column) -> Column:
    """A digit string without its leading zeros: equal iff the numbers are equal."""
    return F.regexp_replace(text, "^0+(?=[0-9])", "")


def scene_key(scene_id: Column) -> Column:
    """``'a_b'`` of the first two numbers in ``scene_id``; null with fewer than two."""
    n = _numbers(scene_id)
    return F.when(F.size(n) >= 2, F.concat(_whole(F.get(n, F.lit(0))), F.lit("_"), _whole(F.get(n, F.lit(1)))))


def physical_key(physical_scene_id: Column, scene_id: Column) -> Column:
    """The number in ``physical_scene_id``, else the second one in ``scene_id``, else null."""
    own = F.get(_numbers(physical_scene_id), F.lit(0))
    return _whole(F.coalesce(own, F.get(_numbers(scene_id), F.lit(1))))


def split_name(col: Column) -> Column:
    """``train``, ``validation``, ``test`` or null for anything that names none."""
    word = F.regexp_replace(F.lower(col), r"[^a-z]+", "")
    out = F.lit(None).cast("string")
    for name, words in SPLIT_SYNONYMS.items():
        out = F.when(word.isin(words), F.lit(name)).otherwise(out)
    return out
