"""Schemas that drift between the files of a stream: every change, and one table.

Each file's columns are profiled (names, types, value sketches).  Between a file
and the one before it, vanished and new names of one object are matched as a
bipartite graph whose weights come from the records that both files hold and from
name similarity; matched pairs are renames, the rest removals and additions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions.arrow import clean_text, flat_map_rows
from lumaframe.operators.nested import dump_json
from lumaframe.operators.skew import hot_key_join, product_join, top_per_key
from lumaframe.session import materialize, release

SEP = "\x1f"  # between the names of a path, as names may hold dots
SKETCH_SIZE = 64  # smallest value hashes kept per column
SAME_RECORD = 0.2  # share of a record's leaf values that must be common and unique

_TYPES = {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}


def _read_object(text: str | None) -> dict | None:
    if not text or "{" not in text:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _nodes(obj: dict) -> Iterator[tuple[str, object]]:
    """(path, value) of every field, objects before what is in them, without recursion."""
    todo = [iter([(clean_text(name), value) for name, value in obj.items()])]
    while todo:
        for path, value in todo[-1]:
            yield path, value
            if isinstance(value, dict):
                todo.append(iter([(path + SEP + clean_text(name), v) for name, v in value.items()]))
                break
        else:
            todo.pop()


def _sorted_json(value) -> str:
    try:
        return json.dumps(value, sort_keys=True)
    except RecursionError:
        return dump_json(value)


def _canonical(value) -> str:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(float(value)) if abs(value) < 2**53 else repr(value)
    return _sorted_json(value)


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1e".join(parts).encode("utf-8", "surrogatepass")) - 2**63


def _make_shapes() -> Callable[..., list[tuple]]:
    cache: dict[tuple, str] = {}

    def shape(stream: str, file: str, seq: int, text: str | None) -> list[tuple]:
        obj = _read_object(text)
        if obj is None:
            return [(stream, file, seq, None)]
        key = tuple((p, _TYPES[type(v)]) for p, v in _nodes(obj))
        if key not in cache:
            if len(cache) > 10_000:
                cache.clear()
            cache[key] = json.dumps(sorted(key))
        return [(stream, file, seq, cache[key])]

    return shape


def profile_schemas(lines: DataFrame) -> DataFrame:
    """One row per file: its place in the stream, the file before, both schemas.

    Lines become shapes (their paths and types); only distinct shapes leave a task.
    """
    shapes = flat_map_rows(lines, ["stream_name", "file_name", "file_seq", "line_text"], _make_shapes, "stream_name string, file_name string, file_seq int, shape string").distinct()
    shapes = materialize(shapes)  # lines are read as JSON once for all three uses below
    fields = shapes.select("file_name", F.explode(F.from_json("shape", "array<array<string>>")).alias("f"))
    schema = fields.groupBy("file_name").agg(F.collect_set("f").alias("fields"))
    order = Window.partitionBy("stream_name").orderBy("file_seq", "file_name")
    files = shapes.select("stream_name", "file_name", "file_seq").distinct()
    files = files.where(F.col("file_name").isNotNull() & F.col("stream_name").isNotNull() & F.col("file_seq").isNotNull()).withColumn("before", F.lag("file_name").over(order))
    now = schema.select("file_name", F.col("fields").alias("fields_now"))
    old = schema.select(F.col("file_name").alias("before"), F.col("fields").alias("fields_before"))
    return files.join(now, "file_name", "left").join(old, "before", "left")


def _tree(fields: list | None) -> dict[str, set[str]]:
    tree: dict[str, set[str]] = {}
    for path, kind in fields or []:
        tree.setdefault(path, set()).update({kind} - {"null"})
    return tree


def _make_diff() -> Callable[..., list[tuple]]:
    def diff(file: str, before: str, fields_before: list | None, fields_now: list | None) -> list[tuple]:
        old, new = _tree(fields_before), _tree(fields_now)
        out: list[tuple] = []

        def under(tree: dict, prefix: str) -> set[str]:
            return {p for p in tree if p.startswith(prefix) and SEP not in p[len(prefix) :]}

        def walk(prefix: str) -> None:
            a, b = under(old, prefix), under(new, prefix)
            gone, come = sorted(a - b), sorted(b - a)
            pairs = [(g, n) for g in gone for n in come if old[g] & new[n]]
            out.extend((file, before, "gone", g, None) for g in gone)
            out.extend((file, before, "new", n, None) for n in come)
            out.extend((file, before, "pair", g, n) for g, n in pairs)
            for p in sorted(a & b):
                if old[p] and new[p] and not old[p] & new[p]:
                    out.append((file, before, "type_changed", p, None))
                elif "object" in old[p] and "object" in new[p]:
                    walk(p + SEP)

        walk("")
        return out

    return diff


def _make_records() -> Callable[..., list[tuple]]:
    def record(file: str, text: str | None, watch: list[str]) -> list[tuple]:
        obj = _read_object(text)
        if obj is None:
            return []
        wanted, tokens, seen = set(watch), set(), {}
        for path, value in _nodes(obj):
            if value is None:
                continue
            kind = _TYPES[type(value)]
            if kind != "object":
                tokens.add(_hash(path, kind, _canonical(value)))
            if path in wanted:
                seen[path] = _hash(kind, _canonical(value))
        return [(file, _hash(_sorted_json(obj)), len(tokens), sorted(tokens), list(seen), list(seen.values()))]

    return record


def _best_matching(weights: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """Maximum-weight bipartite matching (Hungarian method with potentials)."""
    left, right = sorted({a for a, _ in weights}), sorted({b for _, b in weights})
    if not left:
        return []
    size = max(len(left), len(right))
    cost = [[-weights.get((left[i], right[j]), 0.0) if i < len(left) and j < len(right) else 0.0 for j in range(size)] for i in range(size)]
    u, v, match = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        low, via, done = [float("inf")] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        while True:
            done[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, size + 1):
                if not done[j]:
                    slack = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if slack < low[j]:
                        low[j], via[j] = slack, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(size + 1):
                if done[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[via[j0]], via[j0]
    pairs = [(left[match[j] - 1], right[j - 1]) for j in range(1, size + 1) if match[j] <= len(left) and j <= len(right)]
    return [p for p in pairs if weights.get(p, 0.0) > 0]


def _make_match() -> Callable[..., list[tuple]]:
    def match(file: str, pairs: list[dict]) -> list[tuple]:
        weights = {}
        for p in pairs:
            old, new = p["gone"], p["new"]
            alike = SequenceMatcher(None, old.rpartition(SEP)[2].lower(), new.rpartition(SEP)[2].lower()).ratio()
            weights[(old, new)] = p["same"] + 0.5 * alike
        return [(file, a, b) for a, b in _best_matching(weights)]

    return match


def _renames(lines: DataFrame, diffs: DataFrame) -> DataFrame:
    """(file_name, gone, new) of the pairs that shared records and the matching confirm."""
    pairs = diffs.where("kind = 'pair'").select("file_name", "before", F.col("path").alias("gone"), F.col("other").alias("new"))
    watched = pairs.select("file_name", F.col("new").alias("path")).unionByName(pairs.select(F.col("before").alias("file_name"), F.col("gone").alias("path")))
    watch = materialize(watched.groupBy("file_name").agg(F.collect_set("path").alias("watch")))
    involved = hot_key_join(lines.select("file_name", "line_text"), watch, "file_name")
    records = flat_map_rows(
        involved, ["file_name", "line_text", "watch"], _make_records,
        "file_name string, rec bigint, leaves int, tokens array<bigint>, paths array<string>, hashes array<bigint>",
    ).dropDuplicates(["file_name", "rec"])
    records = materialize(records)

    # Value sketches: the smallest hashes of each watched column.  A pair whose
    # sketches hold all values of both columns and share none can't be a rename.
    values = records.select("file_name", F.explode(F.arrays_zip("paths", "hashes")).alias("v")).select("file_name", F.col("v.paths").alias("path"), F.col("v.hashes").alias("h")).distinct()
    sketch = top_per_key(values, ["file_name", "path"], [F.col("h")], SKETCH_SIZE).groupBy("file_name", "path").agg(F.collect_list("h").alias("sketch"))
    pairs = pairs.join(sketch.select(F.col("file_name").alias("before"), F.col("path").alias("gone"), F.col("sketch").alias("_a")), ["before", "gone"])
    pairs = pairs.join(sketch.select("file_name", F.col("path").alias("new"), F.col("sketch").alias("_b")), ["file_name", "new"])
    full = (F.size("_a") == SKETCH_SIZE) | (F.size("_b") == SKETCH_SIZE)
    pairs = materialize(pairs.where(full | F.arrays_overlap("_a", "_b")).select("file_name", "before", "gone", "new"))

    # The same record in both files: most leaf values that are unique in their file agree.
    tokens = records.select("file_name", "rec", "leaves", F.explode("tokens").alias("token"))
    unique = tokens.groupBy("file_name", "token").agg(F.count("*").alias("n"), F.min("rec").alias("rec"), F.min("leaves").alias("leaves")).where("n = 1").drop("n")
    unique = materialize(unique)
    follows = materialize(pairs.select("file_name", "before").distinct())
    a = hot_key_join(unique.select(F.col("file_name").alias("before"), "token", F.col("rec").alias("rec_a"), F.col("leaves").alias("la")), follows, "before")
    b = hot_key_join(unique.select("file_name", "token", F.col("rec").alias("rec_b"), F.col("leaves").alias("lb")), follows.select("file_name"), "file_name")
    links = a.join(b, ["file_name", "token"]).groupBy("file_name", "before", "rec_a", "rec_b").agg(F.count("*").alias("n"), F.min("la").alias("la"), F.min("lb").alias("lb"))
    links = links.where(F.col("n") >= F.greatest(F.lit(2), SAME_RECORD * F.least("la", "lb")))
    links = top_per_key(links, ["file_name", "rec_b"], [F.desc("n"), F.col("rec_a")], 1).select("file_name", "before", "rec_a", "rec_b")

    held = records.select("file_name", "rec", F.map_from_arrays("paths", "hashes").alias("held"))
    links = links.join(held.select(F.col("file_name").alias("before"), F.col("rec").alias("rec_a"), F.col("held").alias("held_a")), ["before", "rec_a"])
    links = links.join(held.select("file_name", F.col("rec").alias("rec_b"), F.col("held").alias("held_b")), ["file_name", "rec_b"])
    wanted = materialize(pairs.groupBy("file_name").agg(F.collect_list(F.struct("gone", "new")).alias("wanted")))
    each = hot_key_join(links.select("file_name", "held_a", "held_b"), wanted, "file_name").select("file_name", "held_a", "held_b", F.explode("wanted").alias("w"))
    x, y = F.try_element_at("held_a", F.col("w.gone")), F.try_element_at("held_b", F.col("w.new"))
    counts = each.select("file_name", "w.gone", "w.new", F.coalesce(x == y, F.lit(False)).cast("int").alias("same"), (~x.eqNullSafe(y)).cast("int").alias("differ"))
    counts = counts.groupBy("file_name", "gone", "new").agg(F.sum("same").alias("same"), F.sum("differ").alias("differ")).where("same > 0 and differ = 0")
    solved = counts.groupBy("file_name").agg(F.collect_list(F.struct("gone", "new", "same")).alias("pairs"))
    return flat_map_rows(solved, ["file_name", "pairs"], _make_match, "file_name string, gone string, new string")


def _dotted(col: str):
    return F.replace(F.col(col), F.lit(SEP), F.lit("."))


def schema_changes(lines: DataFrame) -> DataFrame:
    """Every change between a file of a stream and the file before it.

    Input: ``stream_name, file_name, file_seq, line_text``.  Output: ``file_name,
    field_path, change_kind, new_path``.  Blank, cut-off, array and scalar lines
    are passed over; lines written twice count once; a name that only holds null
    has no type and is neither retyped nor renamed by type; files without object
    lines have an empty schema.  Ties between equal rename candidates go to the
    more similar name.  Rows with a null file, stream or sequence are dropped.
    """
    internal = _changes(lines)
    return internal.select("file_name", _dotted("field_path").alias("field_path"), "change_kind", _dotted("new_path").alias("new_path"))


def _changes(lines: DataFrame) -> DataFrame:
    files = profile_schemas(lines).where(F.col("before").isNotNull())
    diffs = materialize(flat_map_rows(files, ["file_name", "before", "fields_before", "fields_now"], _make_diff, "file_name string, before string, kind string, path string, other string"))
    renames = materialize(_renames(lines, diffs))
    gone = diffs.where("kind = 'gone'").select("file_name", F.col("path").alias("field_path"))
    come = diffs.where("kind = 'new'").select("file_name", F.col("path").alias("field_path"))
    retyped = diffs.where("kind = 'type_changed'").select("file_name", F.col("path").alias("field_path"))
    old = renames.select("file_name", F.col("gone").alias("field_path"))
    new = renames.select("file_name", F.col("new").alias("field_path"))
    none = F.lit("").alias("new_path")
    parts = [
        renames.select("file_name", F.col("gone").alias("field_path"), F.lit("renamed").alias("change_kind"), F.col("new").alias("new_path")),
        gone.join(old, ["file_name", "field_path"], "left_anti").select("file_name", "field_path", F.lit("removed").alias("change_kind"), none),
        come.join(new, ["file_name", "field_path"], "left_anti").select("file_name", "field_path", F.lit("added").alias("change_kind"), none),
        retyped.select("file_name", "field_path", F.lit("type_changed").alias("change_kind"), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _leaf(col: str) -> Column:
    return F.substring_index(F.col(col), SEP, -1)


def _origins(renames: DataFrame, files: DataFrame) -> DataFrame:
    """(file_name, path, leaf): each present path that was renamed up to a file, and the name it had first.

    A rename keeps the parent, so only the last name of a path changes.  Each rename
    points to the one of the same stream by which its old path had come, if any; the
    pointers are doubled until all lead to a first name, in as many rounds as the
    logarithm of the longest chain.  No task holds a stream.
    """
    events = renames.join(files, "file_name").select("stream_name", "file_seq", "file_name", F.col("field_path").alias("old"), F.col("new_path").alias("new"))
    # what happens to a path in order: it comes by a rename (made) or goes by one
    marks = events.select("stream_name", F.col("new").alias("path"), "file_seq", "file_name", F.lit(1).alias("made")).unionByName(
        events.select("stream_name", F.col("old").alias("path"), "file_seq", "file_name", F.lit(0).alias("made"))
    )
    order = Window.partitionBy("stream_name", "path").orderBy("file_seq", "file_name", "made")
    spans = marks.withColumns({
        "until_seq": F.lead("file_seq").over(order), "until_file": F.lead("file_name").over(order),
        "came": F.last(F.when(F.col("made") == 1, F.struct("file_seq", "file_name")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "last_made": F.lag("made").over(order),
    })
    spans = materialize(spans)
    link = spans.where("made = 0").select("stream_name", F.col("path").alias("old"), "file_name", F.when(F.col("last_made") == 1, F.col("came.file_name")).alias("from_file"))
    chain = events.join(link, ["stream_name", "old", "file_name"]).select(
        "stream_name", "file_name", "new", F.col("old").alias("first"), F.col("from_file"), F.when(F.col("from_file").isNotNull(), F.col("old")).alias("from_path")
    )
    chain = materialize(chain)
    while not chain.where("from_file is not null").isEmpty():
        before = chain.select("stream_name", F.col("file_name").alias("from_file"), F.col("new").alias("from_path"), F.col("first").alias("_first"), F.col("from_file").alias("_file"), F.col("from_path").alias("_path"))
        now = chain.join(before, ["stream_name", "from_file", "from_path"], "left")
        now = materialize(now.select("stream_name", "file_name", "new", F.coalesce("_first", "first").alias("first"), F.col("_file").alias("from_file"), F.col("_path").alias("from_path")))
        release(chain)
        chain = now
    active = spans.where("made = 1").select("stream_name", F.col("path").alias("new"), F.col("file_seq").alias("_seq"), "file_name", "until_seq", "until_file")
    active = active.join(chain.select("stream_name", "file_name", "new", _leaf("first").alias("leaf")), ["stream_name", "file_name", "new"]).withColumnRenamed("file_name", "_file")
    here = F.struct("file_seq", "file_name")
    each = product_join(files, active, "stream_name").where((here >= F.struct("_seq", "_file")) & (F.col("until_seq").isNull() | (here < F.struct("until_seq", "until_file"))))
    out = materialize(each.where(_leaf("new") != F.col("leaf")).select("file_name", F.col("new").alias("path"), "leaf"))
    release(spans)
    release(chain)
    return out


_NUMERAL = re.compile(r"-?(?:0|[1-9]\d{0,14})(?:\.\d{0,14}[1-9])?")


def _kind_of(value) -> str:
    """The kind of a leaf; a text that reads as one number and as nothing else is a numeral."""
    if isinstance(value, str):
        return "numeral" if _NUMERAL.fullmatch(value) and value != "-0" else "string"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return "number" if abs(value) < 2**53 else "string"  # text keeps what a double can't
    return _TYPES[type(value)]


def _make_unify() -> Callable[..., list[tuple]]:
    def unify(stream: str, file: str, line_no: int, text: str | None, present: list[str] | None, first: list[str] | None) -> list[tuple]:
        obj = _read_object(text)
        if obj is None:
            return []
        moved = dict(zip(present or [], first or [], strict=True))
        names, values, kinds = [], [], []
        todo = [(obj, "", "")]
        while todo:
            value, at, to = todo.pop()
            for name, v in value.items():
                name = clean_text(name)
                here = at + name
                there = to + moved.get(here, name)
                while isinstance(v, dict) and len(v) == 1 and "value" in v:  # a wrapper adds nothing
                    v = v["value"]
                if isinstance(v, dict) and v:
                    todo.append((v, here + SEP, there + "."))
                    continue
                names.append(there)
                kinds.append(_kind_of(v))
                values.append(None if v is None else clean_text(v) if isinstance(v, str) else dump_json(v))
        if len(set(names)) < len(names):  # a dot in a name can make two paths look alike: the later one counts
            at = {n: i for i, n in enumerate(names)}
            names, values, kinds = list(at), [values[i] for i in at.values()], [kinds[i] for i in at.values()]
        return [(stream, file, line_no, names, values, kinds)]

    return unify


def unified_records(lines: DataFrame) -> DataFrame:
    """Every object line as one row: ``stream_name, file_name, line_no, fields, kinds``.

    ``fields`` maps each dotted path, under the name the field had first in its
    stream, to its value: texts and numbers as they stand, arrays and empty objects as
    JSON.  A wrapper ``{"value": x}`` is passed over.  ``kinds`` maps the same paths to
    the kind of the value.  Lines that are no objects are passed over; repeated lines
    stay; of paths that look alike in dots the later one counts.
    """
    files = materialize(lines.select("stream_name", "file_name", "file_seq").distinct().where("stream_name is not null and file_name is not null and file_seq is not null"))
    renames = _changes(lines).where("change_kind = 'renamed'").select("file_name", "field_path", "new_path")
    origins = _origins(materialize(renames), files)
    names = origins.groupBy("file_name").agg(F.collect_list("path").alias("present"), F.collect_list("leaf").alias("first"))  # the fields of one file
    rows = hot_key_join(lines.select("stream_name", "file_name", "line_no", "line_text"), materialize(names), "file_name", how="left")
    flat = flat_map_rows(rows, ["stream_name", "file_name", "line_no", "line_text", "present", "first"], _make_unify, "stream_name string, file_name string, line_no int, k array<string>, v array<string>, t array<string>")
    return flat.select("stream_name", "file_name", "line_no", F.map_from_arrays("k", "v").alias("fields"), F.map_from_arrays("k", "t").alias("kinds"))


def resolved_types(records: DataFrame, most: int = 1_000) -> list[tuple[str, str]]:
    """(path, type) of the ``most`` paths that most lines have: what holds every value unaltered.

    Numbers, and texts that are numerals throughout beside them, give double; booleans
    boolean; all else, and every mixture, string.
    """
    seen = records.select(F.explode("kinds").alias("path", "kind")).groupBy("path", "kind").count()
    per_path = seen.groupBy("path").agg(F.collect_set(F.when(F.col("kind") != "null", F.col("kind"))).alias("kinds"), F.sum("count").alias("n"))
    out = []
    for r in per_path.orderBy(F.desc("n"), "path").limit(most).collect():
        kinds = set(r["kinds"])
        out.append((r["path"], "double" if "number" in kinds and kinds <= {"number", "numeral"} else "boolean" if kinds == {"boolean"} else "string"))
    return out


def unified_table(lines: DataFrame, most: int = 1_000) -> DataFrame:
    """One table of all object lines: a typed column for each field, under the name it had first.

    Columns are the ``most`` paths that most lines have, with the types of
    :func:`resolved_types`, in the order of their names after ``stream_name, file_name,
    line_no``; dots in a path become ``__`` and a name that is taken gets ``_`` behind.
    Whatever has no column is in the map ``rest``.  A field that a line lacks, or that is
    null there, is null.
    """
    records = materialize(unified_records(lines))
    types = sorted(resolved_types(records, most))
    taken, columns = {"stream_name", "file_name", "line_no", "rest"}, []
    for path, kind in types:
        name = path.replace(".", "__")
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        columns.append(F.try_element_at("fields", F.lit(path)).cast(kind).alias(name))
    held = F.array(*[F.lit(p) for p, _ in types]) if types else F.array().cast("array<string>")
    return records.select("stream_name", "file_name", "line_no", *columns, F.map_filter("fields", lambda k, v: ~F.array_contains(held, k)).alias("rest"))
