"""Free-form camera metadata: flattening, allow-lists, tolerant lookups.

Flattened keys hold dots, so metadata is a map, never columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions.arrow import clean_text, flat_map_rows
from lumaframe.functions.exprs import normalized_key
from lumaframe.operators.nested import dump_json

LIST_ITEMS = 32  # longer lists are cut, with their length kept beside them


def _flatten(value: dict) -> dict[str, str]:
    """Leaves by dotted key, in the order they stand, without recursion."""
    out: dict[str, str] = {}
    todo = [("", value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            todo.extend((f"{at}.{k}" if at else str(k), x) for k, x in reversed(v.items()))
        elif isinstance(v, list) and len(v) > LIST_ITEMS:
            out[at] = dump_json({"truncated": True, "length": len(v), "head": v[:LIST_ITEMS]})
        elif v is not None:
            out[at] = v if isinstance(v, str) else dump_json(v)
    return out


def _make_flatten() -> Callable[..., list[tuple]]:
    def one(key: str | None, text: str | None) -> list[tuple]:
        try:
            value = json.loads(text) if text else None
        except (ValueError, RecursionError):
            value = None
        out = _flatten(value) if isinstance(value, dict) else {}
        return [(key, {clean_text(k): clean_text(v) for k, v in out.items()})]

    return one


def flatten_metadata(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, metadata map<string,string>): nested JSON with dotted keys.

    Texts that hold no object, null ones included, give an empty map; null values
    are left out; lists beyond ``LIST_ITEMS`` keep their head and their length.
    """
    picked = rows.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    return flat_map_rows(picked, ["key", "text"], _make_flatten, "key string, metadata map<string,string>")


def allowed_only(metadata: Column, names: list[str]) -> Column:
    """Entries whose key, or its last dotted part, is one of ``names`` after normalization."""
    wanted = [n.lower().replace("_", "").replace("-", "").replace(" ", "").replace(".", "") for n in names]
    return F.map_filter(metadata, lambda k, v: normalized_key(k).isin(wanted) | normalized_key(F.element_at(F.split(k, r"\."), -1)).isin(wanted))


def find_value(metadata: Column, name: str) -> Column:
    """The value of the first key in key order whose last part reads as ``name``, else null."""
    return F.get(F.map_values(_sorted(allowed_only(metadata, [name]))), F.lit(0))


def _sorted(metadata: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(metadata)))


def find_number(metadata: Column, names: list[str]) -> Column:
    """The first of ``names`` that holds a number."""
    return F.coalesce(*[find_value(metadata, n).try_cast("double") for n in names])


def merged(left: Column, right: Column) -> Column:
    """Both maps in one, the right one winning on equal keys."""
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def settings_of(text: Column, allowed: dict[str, str]) -> dict[str, Column]:
    """Known settings of a JSON document by name; unknown keys are passed over, absent ones null."""
    doc = F.from_json(text, ", ".join(f"{k} {t}" for k, t in allowed.items()))
    return {k: doc[k] for k in allowed}
