"""Deeply nested records to flat parent-child tables, by a tree automaton.

The same level of a record can be stored in different shapes: a list, an object
keyed by number, a single object, or any of these as JSON text.  A bottom-up tree
automaton gives every node of the document a state from its kind, its keys and the
states of its children; the state names the structural variant.  Each node goes to
the typed table of its level, each variant to its subtype of that table; all keep the
keys they share and the link to their parent.  Members without a typed column, and
values whose own type is another, stay as JSON in ``more``, so nothing is lost.
Documents of any depth are read without recursion.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.functions.arrow import clean_text, flat_map_rows

_FENCE = re.compile(r"^\s*```[A-Za-z0-9_-]*\s*\n?(.*?)\n?\s*```\s*$", re.S)
_NUMBER = re.compile(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")
NOT_JSON = object()


def read_json(text: str | None):
    """The value of a JSON text (a Markdown fence around it is ignored), else NOT_JSON."""
    if text is None:
        return NOT_JSON
    fenced = _FENCE.match(text)
    try:
        return json.loads(fenced.group(1) if fenced else text)
    except (ValueError, RecursionError):
        return NOT_JSON


@dataclass(frozen=True)
class Rule:
    """A transition: nodes of ``kind`` that fit get ``state``.

    ``any_keys``: at least one of these keys (compared in lower case) is there.
    ``key_like``: every key matches this pattern.  ``children``: the states that
    every child must have.  ``has``: required state of the child under a key.
    """

    state: str
    kind: str
    any_keys: frozenset[str] = frozenset()
    key_like: str = ""
    children: frozenset[str] | None = None
    has: dict[str, frozenset[str]] = field(default_factory=dict)


class Node(NamedTuple):
    """A classified node: its state, its value, and its children by key or place."""

    state: str
    value: object
    children: dict | list | None = None
    text: bool = False

    @property
    def variant(self) -> str:
        return self.state + ("_text" if self.text else "")


_SCALARS = {type(None): "null", bool: "boolean", int: "number", float: "number"}


class TreeAutomaton:
    """Deterministic bottom-up automaton: the first rule that fits decides."""

    def __init__(self, rules: list[Rule], opaque: frozenset[str] = frozenset()):
        self.rules, self.opaque = rules, opaque

    def classify(self, value) -> Node:
        """The node of a value, children first, with a stack of its own instead of recursion."""
        out: list[Node | None] = [None]
        todo: list[tuple] = [(value, None, None, out, 0, False)]  # (value, keys, child nodes, list and place it goes to, stored as text)
        while todo:
            value, keys, nodes, target, at, text = todo.pop()
            if nodes is not None:  # all children are there
                states = [n.state for n in nodes]
                if keys is None:
                    target[at] = Node(self._state("array", None, states), value, nodes, text)
                else:
                    keyed = dict(zip(keys, nodes))
                    target[at] = Node(self._state("object", keyed, states), value, keyed, text)
                continue
            if isinstance(value, str):
                inner = read_json(value) if value.lstrip()[:1] in ("{", "[", "`") else NOT_JSON
                if not isinstance(inner, (dict, list)):
                    target[at] = Node("string", value)
                    continue
                value, text = inner, True
            elif (plain := _SCALARS.get(type(value))) is not None:
                target[at] = Node(plain, value)
                continue
            keys = list(value) if isinstance(value, dict) else None
            nodes = [None] * len(value)
            todo.append((value, keys, nodes, target, at, text))
            for i, v in enumerate(value.values() if keys is not None else value):
                if keys is not None and keys[i] in self.opaque:
                    nodes[i] = Node("opaque", v)
                elif (plain := _SCALARS.get(type(v))) is not None:
                    nodes[i] = Node(plain, v)
                else:
                    todo.append((v, None, None, nodes, i, False))
        return out[0]

    def _state(self, kind: str, keyed: dict | None, states: list[str]) -> str:
        for rule in self.rules:
            if rule.kind != kind:
                continue
            if keyed is not None:
                if rule.any_keys and not any(k.lower() in rule.any_keys for k in keyed):
                    continue
                if rule.key_like and not all(re.fullmatch(rule.key_like, k) for k in keyed):
                    continue
                if any(k not in keyed or keyed[k].state not in allowed for k, allowed in rule.has.items()):
                    continue
            if rule.children is not None and not rule.children.issuperset(states):
                continue
            return rule.state
        return kind


# The levels of an agent run.  An object without keys holds no levels, so that it
# counts as an empty map.
_STEP = frozenset({"iteration", "null", "empty"})
AGENT_RUN = TreeAutomaton(
    [
        Rule("empty", "object", key_like=r"(?!)"),
        Rule("candidate", "object", any_keys=frozenset({"stage", "overall_quality"})),
        Rule("iteration", "object", any_keys=frozenset({"vlm_decision", "updated_metadata", "optimizer_trace", "memory_context", "evaluated_quality", "index", "image_path"})),
        Rule("keyed_iterations", "object", key_like=r"\d+", children=_STEP),
        Rule("wrapped_run", "object", has={"result": frozenset({"run"})}),
        Rule("run", "object", any_keys=frozenset({"run_id", "iterations"})),
        Rule("listed_iterations", "array", children=_STEP),
        Rule("candidates", "array", children=frozenset({"candidate", "iteration", "null", "empty"})),
    ],
    opaque=frozenset({"memory_context"}),
)


def whole_number(value) -> int | None:
    """A number stored as number, text or ``{"value": ...}``; None if there is none."""
    if isinstance(value, dict):
        by_name = {k.lower(): v for k, v in value.items()}
        return whole_number(by_name.get("value"))
    if isinstance(value, str):
        found = _NUMBER.search(value)
        value = float(found.group()) if found else None
    if value is None or isinstance(value, (bool, list)) or not math.isfinite(value):
        return None
    value = int(round(value))
    return value if abs(value) < 2**31 else None


def _child(node: Node | None, name: str) -> Node | None:
    if node is None or not isinstance(node.children, dict):
        return None
    if name in node.children and node.children[name].state != "null":
        return node.children[name]
    return next((v for k, v in node.children.items() if k.lower() == name and v.state != "null"), None)


def _iso(node: Node) -> int:
    meta = _child(node, "updated_metadata")
    iso = _child(meta, "iso")
    number = whole_number(iso.value) if iso is not None else None
    return -1 if number is None else number


def _text(node: Node | None) -> str:
    return clean_text(node.value) if node is not None and isinstance(node.value, str) else ""


def _entries(node: Node | None, single: str) -> list[tuple[int, Node]]:
    """(key or 1-based place, entry) of a level in any of its shapes."""
    if node is None or node.state in ("null", "empty") or node.children is None:
        return []
    if isinstance(node.children, list):
        return list(enumerate(node.children, 1))
    if node.children and all(re.fullmatch(r"\d+", k) for k in node.children):
        return sorted(((int(k), v) for k, v in node.children.items()), key=lambda x: x[0])
    return [(1, node)] if node.state == single else []


#: What a round's report keeps beside the flat fields: its name there, and the names it is stored under.
_REPORTED = {
    "previous_round_feedback": ("feedback_input",),
    "vlm_first_recommendation": ("initial_vlm_decision", "vlm_decision"),
    "vlm_experience_integrated_recommendation": ("integrated_vlm_decision",),
    "local_search": ("optimizer_trace",),
    "final_action": ("final_action",),
    "metadata": ("final_metadata", "updated_metadata"),
    "objective_quality": ("objective_quality_after", "evaluated_quality"),
    "quality_gain_from_original": ("quality_gain_from_original",),
    "satisfactory": ("satisfactory",),
}


def dump_json(value) -> str:
    """``value`` as JSON text, however deep; numbers that JSON can't hold become null."""
    try:
        return json.dumps(value, ensure_ascii=False, allow_nan=False)
    except (ValueError, RecursionError):
        pass
    out, todo = [], [(value, "")]
    while todo:  # texts to be written, and values behind their prefix
        value, prefix = todo.pop()
        out.append(prefix)
        if isinstance(value, dict) and value:
            todo.append((_END, "}"))
            todo.extend((v, ("," if i else "{") + json.dumps(k, ensure_ascii=False) + ":") for i, (k, v) in reversed(list(enumerate(value.items()))))
        elif isinstance(value, list) and value:
            todo.append((_END, "]"))
            todo.extend((v, "," if i else "[") for i, v in reversed(list(enumerate(value))))
        elif value is not _END:
            out.append("null" if isinstance(value, float) and not math.isfinite(value) else json.dumps(value, ensure_ascii=False))
    return "".join(out)


_END = object()


def rag_report(context) -> dict:
    """What was retrieved; the best experience is the named one, else the first example."""
    inner = read_json(context) if isinstance(context, str) else context
    if not isinstance(inner, dict):
        return {"retrieved": False, "best_experience": None}
    examples, best = inner.get("examples"), inner.get("best_experience")
    if best is None and isinstance(examples, list):
        best = next((e for e in examples if e is not None), None)
    return {"retrieved": best is not None, "retrieval_type": inner.get("retrieval_type"), "distance_weights": inner.get("distance_weights"), "best_experience": best}


def _details(step: Node) -> str:
    out = {}
    for name, stored in _REPORTED.items():
        node = next((n for n in (_child(step, x) for x in stored) if n is not None), None)
        out[name] = None if node is None else node.value
    context = _child(step, "memory_context")
    out["rag_retrieval"] = rag_report(None if context is None else context.value)
    return clean_text(dump_json(out))


FLAT_SCHEMA = (
    "run_key bigint, level string, variant string, iteration_id string, iteration_no int, candidate_no int,"
    " iso_value int, reason_text string, stop_reason string, stage string, overall_quality double, run_id string, iterations int"
)
#: Typed columns of the node table: name, kind, and the members that fill it, by level.
_TYPED = {
    "run": {"run_id": "text", "scene_id": "text", "physical_scene_id": "text", "dataset_split": "text", "stop_reason": "text", "original_image_path": "text", "final_image_path": "text"},
    "iteration": {"index": "real", "image_path": "text", "stop_reason": "text", "quality_gain_from_original": "real", "satisfactory": "flag"},
    "candidate": {"stage": "text", "overall_quality": "real", "distance_from_semi_final": "real", "output_image_path": "text"},
    "decision": {"reason": "text", "continue": "flag", "continue_adjustment": "flag"},
    "action": {"iso": "real", "shutter": "real", "iso_delta": "real", "shutter_multiplier": "real"},
    "metadata": {"image_id": "text", "iso": "real", "shutter_speed_s": "real", "ev": "real", "aperture": "real"},
    "quality": {"brightness": "real", "noise": "real", "motion_blur": "real", "highlight": "real", "shadow": "real", "overall_quality": "real"},
    "trace": {"enabled": "flag", "reason": "text"},
    "context": {"enabled": "flag", "retrieval_type": "text"},
}
#: Level of the members that are nodes of their own.
_LEVELS = {
    "vlm_decision": "decision", "initial_vlm_decision": "decision", "integrated_vlm_decision": "decision", "action": "action", "final_action": "action", "semi_final_action": "action",
    "metadata": "metadata", "updated_metadata": "metadata", "initial_metadata": "metadata", "final_metadata": "metadata", "quality": "quality", "evaluated_quality": "quality", "final_quality": "quality",
    "optimizer_trace": "trace", "memory_context": "context",
}
#: Levels a level can hold beside iterations and candidates; anything else nested stays in ``more``.
_BELOW = {"run": {"metadata", "quality"}, "iteration": {"decision", "action", "metadata", "quality", "trace", "context"}, "candidate": {"action", "metadata", "quality"}, "decision": {"action", "quality"}}
_COLUMNS = {name: kind for columns in _TYPED.values() for name, kind in columns.items()}
_SQL = {"text": "string", "real": "double", "flag": "boolean"}
NODE_SCHEMA = "run_key bigint, level string, variant string, role string, node_id string, parent_id string, place int, " + ", ".join(f"`{n}` {_SQL[k]}" for n, k in _COLUMNS.items()) + ", more string"


def _reads_as(value, kind: str) -> bool:
    if kind == "text":
        return isinstance(value, str)
    if kind == "flag":
        return isinstance(value, bool)
    return isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) < 2**53


def _run_of(root: Node) -> tuple[Node, list[Node]]:
    """The run's own node, and the wrappers around it."""
    run, around = root, []
    while (inner := _child(run, "result")) is not None and "iterations" not in run.children and isinstance(inner.children, dict):
        around.append(run)
        run = inner
    return run, around


def node_rows(run_key: int | None, run_json: str | None) -> list[tuple]:
    """Every level of one document as typed rows; see :func:`run_nodes`."""
    value = read_json(run_json)
    root = AGENT_RUN.classify(value) if value is not NOT_JSON else None
    if root is None or not isinstance(root.children, dict):
        return []
    run, around = _run_of(root)
    rows: list[tuple] = []

    def put(node: Node, level: str, role: str, parent: str | None, place: int) -> None:
        own = f"{run_key}/{len(rows)}"
        typed = dict.fromkeys(_COLUMNS)
        at = len(rows)
        rows.append(())
        more, below = {}, []
        value, members = node.value, node.children
        if node.state == "opaque":
            inner = read_json(value) if isinstance(value, str) else value
            members = {k: Node("opaque", v) for k, v in inner.items()} if isinstance(inner, dict) else None
        if not isinstance(members, dict):
            more = {"": value}
            members = {}
        for name, child in members.items():
            kind = _TYPED[level].get(name)
            to = _LEVELS.get(name)
            if kind is not None and _reads_as(child.value, kind):
                typed[name] = clean_text(child.value) if kind == "text" else float(child.value) if kind == "real" else child.value
            elif to in _BELOW.get(level, ()) and (isinstance(child.children, dict) or (child.state == "opaque" and child.value is not None)):
                below.append((child, to, name, 1))
            elif name == "iterations" and level == "run":
                steps = _entries(child, "iteration")
                if not steps and child.state not in ("listed_iterations", "keyed_iterations", "empty"):
                    more[name] = child.value
                below += [(n, "iteration", name, k) for k, n in steps]
            elif name == "candidates" and level == "trace":
                entries = _entries(child, "candidate")
                if not entries and child.state not in ("candidates", "empty"):
                    more[name] = child.value
                below += [(n, "candidate", name, k) for k, n in entries]
            elif not (name == "result" and child is run):
                more[name] = child.value
        if level == "run" and around:
            more[".."] = [{k: v for k, v in w.value.items() if k.lower() != "result"} for w in around]
        rows[at] = (run_key, level, node.variant, role, own, parent, place, *typed.values(), clean_text(dump_json(more)) if more else None)
        for child, to, name, k in below:
            put(child, to, name, own, k)

    put(run, "run", "run", None, 1)
    return rows


def run_nodes(docs: DataFrame) -> DataFrame:
    """Every level of every readable document of ``docs(run_key, run_json)`` as one typed row.

    ``level`` is run, iteration, candidate, decision, action, metadata, quality, trace or
    context and names the typed table, ``variant`` its subtype (the automaton's state of
    the stored shape), ``role`` the member it is stored under, ``node_id`` and
    ``parent_id`` the link to the parent, ``place`` the key or place in a list.  Typed
    columns hold the members of that type; all other members, and a null entry of a
    list, are in ``more`` as JSON, so that a document can be put together again.  Null,
    unreadable and non-object documents give nothing; documents delivered twice count
    under each key.  Columns beside the two are ignored.
    """
    return flat_map_rows(docs, ["run_key", "run_json"], lambda: node_rows, NODE_SCHEMA)


def level_table(nodes: DataFrame, level: str, variant: str | None = None) -> DataFrame:
    """The typed table of one level, or one variant's subtype of it, with keys and links."""
    rows = nodes.where(F.col("level") == level)
    if variant is not None:
        rows = subtype_table(rows, variant)
    return rows.select("run_key", "variant", "role", "node_id", "parent_id", "place", *_TYPED[level], "more")


def flatten_run(run_key: int | None, run_json: str | None, details: bool = False) -> list[tuple]:
    """All flat rows of one document: the run, its iterations, their candidates.

    With ``details`` a row has one more field: an iteration's report as JSON.
    """
    value = read_json(run_json)
    root = AGENT_RUN.classify(value) if value is not NOT_JSON else None
    if root is None or not isinstance(root.children, dict):
        return []
    run, _ = _run_of(root)
    level = _child(run, "iterations")
    rows: list[tuple] = []
    more = [None] if details else []
    count = 0
    for place, step in _entries(level, "iteration"):
        if not isinstance(step.children, dict):
            continue
        own = _child(step, "index")
        number = whole_number(own.value) if own is not None else None
        number = place if number is None else number
        count += 1
        link = f"{run_key}/{count}"
        decision, trace = _child(step, "vlm_decision"), _child(step, "optimizer_trace")
        shape = f"{level.variant}.{decision.variant if decision is not None else 'none'}"
        rows.append((run_key, "iteration", shape, link, number, 0, _iso(step), _text(_child(decision, "reason")), _text(_child(step, "stop_reason")), None, None, None, None, *([_details(step)] if details else [])))
        for at, entry in _entries(_child(trace, "candidates"), "candidate"):
            quality = _child(entry, "overall_quality")
            score = float(quality.value) if quality is not None and quality.state == "number" else None
            rows.append((run_key, "candidate", entry.variant, link, number, at, _iso(entry), "", None, _text(_child(entry, "stage")), score, None, None, *more))
    shape = f"{root.variant}.{level.variant if level is not None else 'none'}"
    rows.append((run_key, "run", shape, None, None, None, None, None, _text(_child(run, "stop_reason")), None, None, _text(_child(run, "run_id")), count, *more))
    return rows


def _make_flatten() -> Callable[..., list[tuple]]:
    return flatten_run


def _make_detailed() -> Callable[..., list[tuple]]:
    return lambda run_key, run_json: flatten_run(run_key, run_json, True)


def flatten_runs(docs: DataFrame, details: bool = False) -> DataFrame:
    """One flat row per node of every readable document of ``docs(run_key, run_json)``.

    ``level`` is run, iteration or candidate, ``variant`` the automaton's state of
    the stored shape, ``iteration_id`` the link from candidates to their iteration
    (unique per document and place), ``run_key`` the link to the run.  Null,
    unreadable and non-object documents give nothing; documents delivered twice
    count under each key; null keys stay null.  Columns beside the two are ignored.
    :func:`run_nodes` has every level and member; this is the view by place.
    ``details`` adds a column of that name: what an iteration's report holds, as JSON.
    """
    if details:
        return flat_map_rows(docs, ["run_key", "run_json"], _make_detailed, FLAT_SCHEMA + ", details string")
    return flat_map_rows(docs, ["run_key", "run_json"], _make_flatten, FLAT_SCHEMA)


def runs_table(flat: DataFrame) -> DataFrame:
    return flat.where("level = 'run'").select("run_key", "run_id", "variant", "stop_reason", "iterations")


def iterations_table(flat: DataFrame, *more: str) -> DataFrame:
    return flat.where("level = 'iteration'").select("run_key", "iteration_id", "variant", "iteration_no", "iso_value", "reason_text", "stop_reason", *more)


def candidates_table(flat: DataFrame) -> DataFrame:
    return flat.where("level = 'candidate'").select("run_key", "iteration_id", "variant", "iteration_no", "candidate_no", "stage", "iso_value", "overall_quality")


def subtype_table(table: DataFrame, variant: str) -> DataFrame:
    """The rows of one structural variant; the shared keys and links stay."""
    return table.where(F.col("variant") == variant)


def iteration_candidates(docs: DataFrame) -> DataFrame:
    """Iterations (candidate_no 0) and candidates in one table keyed by place."""
    flat = flatten_runs(docs).where("level <> 'run'")
    return flat.select("run_key", "iteration_no", "candidate_no", "iso_value", "reason_text")
