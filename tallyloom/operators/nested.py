"""Nested workspaces into related flat tables that keep their parents' ids.

Method: structural-variant tables. A tree automaton (``shape_automaton``) gives
each part of a record its state and its variant, whatever wraps it. Every part
becomes one row with the columns of the supertype (record, case, parent, kind, own
id, place) and is routed by its variant to the table of its subtype, which is
written apart: timed segments and bare segment references, readings with and
without a value, observations, classes, task scopes, references to evidence, and
the cases themselves. ``all_links`` is the union of the supertype columns of those
tables. Fields that no subtype has are kept, with the part they belong to.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import shape_automaton as shapes
from tallyloom.session import materialise

#: Columns that every subtype has: record_key tells deliveries apart, variant is the automaton's signature of the part.
SUPERTYPE = {"record_key": "string", "case_id": "string", "parent_id": "string", "child_kind": "string", "child_id": "string", "ordinal": "int", "variant": "string"}
#: Columns of the subtypes.
OWN = {
    "state_id": "string", "task_scope": "string", "state_z": "double", "confidence": "double", "missing_fraction": "double", "report_permission": "boolean",
    "value": "double", "description": "string", "start_sec": "double", "end_sec": "double", "text": "string",
}
_READING = ("value", "description")
SUBTYPES: dict[str, tuple[str, ...]] = {
    "case": (),
    "task_scope": (),
    "class": ("value",),
    "observation": ("state_id", "task_scope", "state_z", "confidence", "missing_fraction", "report_permission"),
    "evidence_reference": (),
    "valued_reading": _READING,
    "bare_reading": ("description",),
    "timed_segment": ("start_sec", "end_sec", "text"),
    "segment_reference": (),
}
_COLUMNS = {**SUPERTYPE, "subtype": "string", **OWN}
PART = ", ".join(f"{k} {v}" for k, v in _COLUMNS.items()) + ", extra map<string,string>"
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
#: Fields of each kind of part that the subtypes know. Fixed values of the record format.
KNOWN = {
    "case": {"case_id", "case_context", "base_probabilities", "corrected_probabilities", "state_observations", "evidence_registry", "case_transcript", "record_id", "delivered_at"},
    "state": {"evidence_id", "state_id", "task_scope", "state_z", "confidence", "missing_fraction", "report_permission", "metric_evidence_ids", "supporting_metrics", "counter_evidence", "evidence_segments"},
    "reading": {"metric_id", "value", "description"},
    "segment": {"segment_id", "start_sec", "end_sec", "text"},
}


_NO_FIELDS = (None,) * len(OWN)


def _text(x: Any) -> str | None:
    if x.__class__ is str:
        return x if x.strip() else None
    if x is None or isinstance(x, (dict, list)):
        return None
    s = ("true" if x else "false") if isinstance(x, bool) else str(x)
    return s if s.strip() else None


def _number(x: Any) -> float | None:
    try:
        v = None if x is None or isinstance(x, (bool, dict, list)) else float(x)
    except (ValueError, OverflowError):
        return None
    return v if v is not None and math.isfinite(v) else None


def _flag(x: Any) -> bool | None:
    if isinstance(x, str):
        x = {"true": True, "false": False}.get(x.strip().lower())
    return x if isinstance(x, bool) else None


def _id(x: Any, *keys: str) -> str | None:
    return next((t for k in keys if (t := _text(x.get(k))) is not None), None) if isinstance(x, dict) else _text(x)


class _Reader:
    """The parts of one workspace, read by the states of its tree."""

    def __init__(self, tree: shapes.Tree, key: str, workspace: dict[str, Any]) -> None:
        self.tree, self.key, self.workspace = tree, key, workspace
        self.case = _text(workspace.get("case_id"))

    def items(self, x: Any, key: str) -> list[Any]:
        """A list from a list, a single value, or an object keyed by the elements' ids."""
        if x is None:
            return []
        if isinstance(x, list):
            return x
        if isinstance(x, dict) and self.tree.state(x) == "keyed":
            return [_Keyed(key, k, v) for k, v in x.items()]
        return [x]

    def row(self, kind: str, subtype: str, parent: str | None, own: str, ordinal: int, part: Any, known: str | None = None, **fields: Any) -> tuple:
        part = part.value if isinstance(part, _Keyed) else part
        more: dict[str, str] = {}
        if known and isinstance(part, dict) and not part.keys() <= KNOWN[known]:
            more = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in part.items() if k not in KNOWN[known] and v is not None}
        own_fields = map(fields.get, OWN) if fields else _NO_FIELDS
        return (self.key, self.case, parent, kind, own, ordinal, self.tree.signature(part), subtype, *own_fields, more)

    def parts(self) -> Iterator[tuple]:
        """A row for each part with an id; nothing of a record without a case_id or below an observation without an evidence_id."""
        w = self.workspace
        if self.case is None:
            return
        yield self.row("case", "case", None, self.case, 0, w, "case")
        context = w.get("case_context")
        for i, x in enumerate(self.items(context.get("task_scopes") if isinstance(context, dict) else None, "task_scope")):
            if own := _id(_plain(x), "task_scope"):
                yield self.row("task_scope", "task_scope", self.case, own, i, x)
        scores = w.get("base_probabilities")
        if isinstance(scores, list):
            scores = {k: v for x in scores if isinstance(x, dict) for k, v in x.items()}
        for i, (k, v) in enumerate(scores.items() if isinstance(scores, dict) else ()):
            if k.strip():
                yield self.row("class", "class", self.case, k, i, v, value=_number(v))
        for i, x in enumerate(self.items(w.get("state_observations"), "evidence_id")):
            yield from self.observation(i, x)

    def observation(self, ordinal: int, part: Any) -> Iterator[tuple]:
        o = _plain(part)
        if not isinstance(o, dict) or (own := _text(o.get("evidence_id"))) is None:
            return
        fields = {c: _text(o.get(c)) for c in ("state_id", "task_scope")} | {c: _number(o.get(c)) for c in ("state_z", "confidence", "missing_fraction")}
        yield self.row("state", "observation", self.case, own, ordinal, part, "state", report_permission=_flag(o.get("report_permission")), **fields)
        for i, x in enumerate(self.items(o.get("metric_evidence_ids"), "evidence_id")):
            if ref := _id(_plain(x), "evidence_id", "metric_evidence_id", "metric_id"):
                yield self.row("metric", "evidence_reference", own, ref, i, x)
        for kind, name in (("supporting", "supporting_metrics"), ("counter", "counter_evidence")):
            for i, x in enumerate(self.items(o.get(name), "metric_id")):
                d = _plain(x)
                if ref := _id(d, "metric_id"):
                    d = d if isinstance(d, dict) else {}
                    value = _number(d.get("value"))
                    yield self.row(kind, "bare_reading" if value is None else "valued_reading", own, ref, i, x, "reading", value=value, description=_text(d.get("description")))
        for i, x in enumerate(self.items(o.get("evidence_segments"), "segment_id")):
            d = _plain(x)
            if ref := _id(d, "segment_id"):
                d = d if isinstance(d, dict) else {}
                fields = {"start_sec": _number(d.get("start_sec")), "end_sec": _number(d.get("end_sec")), "text": _text(d.get("text"))}
                timed = any(v is not None for v in fields.values())
                yield self.row("segment", "timed_segment" if timed else "segment_reference", own, ref, i, x, "segment", **fields)


class _Keyed:
    """A part that stood under its id."""

    def __init__(self, key: str, own: str, value: dict[str, Any]) -> None:
        self.value, self.full = value, {key: own, **value}


def _plain(x: Any) -> Any:
    return x.full if isinstance(x, _Keyed) else x


def records_of_lines(lines: DataFrame, key: str = "line_no", payload: str = "payload") -> DataFrame:
    """The parts of every workspace in the payloads, one row each.

    Null, blank and torn payloads, and complete JSON without a workspace, give
    none. Repeated lines give repeated parts under their own record_key. extra:
    fields that the part's subtype lacks, as text or JSON. Each line is parsed once
    and walked once, in Arrow batches; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [*[_ARROW[t] for t in _COLUMNS.values()], pa.map_(pa.string(), pa.string())]
        for batch in batches:
            rows: list[tuple] = []
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = shapes.parse(p)
                if not isinstance(value, (dict, list)):
                    continue
                tree = shapes.Tree(value)
                for i, w in enumerate(tree.workspaces()):
                    rows += _Reader(tree, f"line:{k}" if i == 0 else f"line:{k}:{i}", w).parts()
            if rows:
                *columns, extra = zip(*rows, strict=True)
                arrays = [pa.array(c, t) for c, t in zip([*columns, [list(x.items()) for x in extra]], types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*_COLUMNS, "extra"])

    narrow = lines.where(F.col(payload).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(payload).alias("p"))
    return narrow.mapInArrow(run, schema=PART)


def _present(x: Column) -> Column:
    """Null for blank ids."""
    return F.when(F.trim(x) != "", x)


def _text_state(x: Column) -> Column:
    return F.when(x.rlike(shapes.NUMBER_TEXT), "numeric_text").otherwise("text")


def _list_of(x: Column, element: Column | str) -> Column:
    """The state of an array: of texts by each one, of objects by their one state."""
    if isinstance(element, str):
        return F.when(F.exists(x, lambda e: e.isNotNull()), f"list<{element}>").otherwise("list<>")
    return F.concat(F.lit("list<"), F.array_join(F.array_sort(F.array_distinct(element)), "|"), F.lit(">"))


def _variant(states: dict[str, Column]) -> Column:
    """The signature of a typed object: a null state leaves its field out."""
    return F.concat_ws(",", *[F.concat(F.lit(f"{k}:"), states[k]) for k in sorted(states)])


def records_of_workspaces(workspaces: DataFrame) -> DataFrame:
    """The parts of typed workspaces, one row each, as ``records_of_lines`` gives those of their JSON.

    The automaton's states follow from the types and from nullness here, so this
    stays in the JVM: a record's parts are built as one array and exploded.
    """
    columns = set(workspaces.columns)

    def texts(x: Column) -> Column:
        return _list_of(x, F.transform(F.filter(x, lambda e: e.isNotNull()), _text_state))

    def some(x: Column, state: Column | str) -> Column:
        return F.when(x.isNotNull(), F.lit(state) if isinstance(state, str) else state)

    def part(parent: Column | None, kind: str, own: Column, ordinal: Column, subtype: Column | str, variant: Column, **fields: Column) -> Column:
        have = {"parent_id": F.lit(None) if parent is None else parent, "child_kind": F.lit(kind), "child_id": own, "ordinal": ordinal, "variant": variant, "subtype": F.lit(subtype) if isinstance(subtype, str) else subtype} | fields
        return F.struct(*[have.get(c, F.lit(None)).cast(t).alias(c) for c, t in _COLUMNS.items() if c not in ("record_key", "case_id")])

    def below(x: Column, f) -> Column:
        """The parts of the elements that are there, with their places; none of a null array."""
        numbered = F.filter(F.transform(x, lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda s: s["e"].isNotNull())
        return F.transform(numbered, lambda s: f(s["e"], s["i"]))

    def flat(*arrays: Column) -> Column:
        return F.flatten(F.filter(F.array(*arrays), lambda a: a.isNotNull()))

    def reading(kind: str, parent: Column, described: bool):
        def one(m: Column, i: Column) -> Column:
            states = {"metric_id": some(m["metric_id"], _text_state(m["metric_id"])), "value": some(m["value"], "number")}
            fields = {"value": F.when(~F.isnan(m["value"]) & (F.abs(m["value"]) < float("inf")), m["value"])}
            if described:
                states["description"], fields["description"] = some(m["description"], _text_state(m["description"])), _present(m["description"])
            return part(parent, kind, m["metric_id"], i, F.when(fields["value"].isNull(), "bare_reading").otherwise("valued_reading"), _variant(states), **fields)

        return one

    def segment(parent: Column):
        def one(s: Column, i: Column) -> Column:
            states = {c: some(s[c], "number") for c in ("start_sec", "end_sec")} | {c: some(s[c], _text_state(s[c])) for c in ("segment_id", "text")}
            timed = s["start_sec"].isNotNull() | s["end_sec"].isNotNull() | _present(s["text"]).isNotNull()
            return part(parent, "segment", s["segment_id"], i, F.when(timed, "timed_segment").otherwise("segment_reference"), _variant(states), start_sec=s["start_sec"], end_sec=s["end_sec"], text=_present(s["text"]))

        return one

    def observation(o: Column, i: Column) -> Column:
        own = o["evidence_id"]
        plain = {c: o[c] for c in SUBTYPES["observation"]}
        states = {c: some(o[c], _text_state(o[c])) for c in ("evidence_id", "state_id", "task_scope")} | {c: some(o[c], "number") for c in ("state_z", "confidence", "missing_fraction")}
        states["report_permission"] = some(o["report_permission"], "flag")
        states["metric_evidence_ids"] = some(o["metric_evidence_ids"], texts(o["metric_evidence_ids"]))
        for c, s in (("supporting_metrics", "reading"), ("counter_evidence", "reading"), ("evidence_segments", "segment")):
            states[c] = some(o[c], _list_of(o[c], s))
        return flat(
            F.array(part(F.col("case_id"), "state", own, i, "observation", _variant(states), **plain)),
            below(o["metric_evidence_ids"], lambda x, j: part(own, "metric", x, j, "evidence_reference", _text_state(x))),
            below(o["supporting_metrics"], reading("supporting", own, True)),
            below(o["counter_evidence"], reading("counter", own, False)),
            below(o["evidence_segments"], segment(own)),
        )

    case = F.col("case_id")
    scores = F.map_entries("base_probabilities")
    plain = {"case_id": _text_state(case)}
    if "case_context" in columns:
        plain["case_context"] = some(F.col("case_context"), "other")
    for c in {"base_probabilities", "corrected_probabilities"} & columns:
        plain[c] = some(F.col(c), F.when(F.size(c) > 0, "scores").otherwise("other"))
    if "state_observations" in columns:
        plain["state_observations"] = some(F.col("state_observations"), _list_of(F.col("state_observations"), "observation"))
    if "evidence_registry" in columns:
        plain["evidence_registry"] = some(F.col("evidence_registry"), _list_of(F.col("evidence_registry"), "entry"))
    if "case_transcript" in columns:
        plain["case_transcript"] = some(F.col("case_transcript"), "other")
    parts = flat(
        F.array(part(None, "case", case, F.lit(0), "case", _variant(plain))),
        below(F.col("case_context.task_scopes"), lambda x, i: part(case, "task_scope", x, i, "task_scope", _text_state(x))),
        below(scores, lambda e, i: part(case, "class", e["key"], i, "class", F.coalesce(some(e["value"], "number"), F.lit("nil")), value=e["value"])),
        F.flatten(below(F.col("state_observations"), lambda o, i: F.when(F.trim(o["evidence_id"]) != "", observation(o, i)).otherwise(F.array().cast(_PARTS)))),
    )
    return (
        workspaces.withColumn("case_id", _present(F.col("case_id"))).where(F.col("case_id").isNotNull())
        .select(F.concat(F.lit("record:"), F.col("record_id").cast("string")).alias("record_key"), "case_id", F.explode(parts).alias("_p"))
        .where(F.trim("_p.child_id") != "")
        .select("record_key", "case_id", *[f"_p.{c}" for c in _COLUMNS if c not in ("record_key", "case_id")], F.create_map().cast("map<string,string>").alias("extra"))
    )


_PARTS = f"array<struct<{', '.join(f'{k}:{v}' for k, v in _COLUMNS.items() if k not in ('record_key', 'case_id'))}>>"


def route(records: DataFrame, columns: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """The table of each subtype: supertype columns, its own columns, and extra; or of these only ``columns``, and only those are written.

    The parts are written once, a folder for each subtype, so a reader of one table
    reads no other, and several tables cost one pass over the records.
    """
    held = materialise(records if columns is None else records.select(*columns, "subtype"), "parts", partition_by=("subtype",))
    return {name: held.where(F.col("subtype") == name).select(*(columns or (*SUPERTYPE, *own, "extra"))) for name, own in SUBTYPES.items()}


def all_links(records: DataFrame) -> DataFrame:
    """Every distinct parent-child link: case_id, parent_id, child_kind, child_id: the supertype of all routed tables but the cases."""
    out = None
    for name, t in route(records, ("case_id", "parent_id", "child_kind", "child_id")).items():
        if name != "case":
            out = t if out is None else out.unionByName(t)
    return out.distinct()


def flatten(records: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of the parts, read from the routed subtypes.

    cases, task_scopes, classes, observations, metric_ids, supporting, counter,
    timed_segments, segment_references, and extra_fields, the fields that no subtype
    has. Every row has record_key and case_id; rows below an observation also have
    its evidence_id as parent_id. ``ordinal`` is the place in the parent's array.
    Null elements and null or blank ids give no row, nor does anything in an
    observation without an evidence_id or in a record without a case_id. Repeated
    elements stay repeated rows.
    """
    t = route(records)
    base = ["record_key", "case_id"]

    def below(name: str, own: str, *columns: str, kind: str | None = None) -> DataFrame:
        rows = t[name] if kind is None else t[name].where(F.col("child_kind") == kind)
        return rows.select(*base, "parent_id", "ordinal", F.col("child_id").alias(own), *columns)

    def readings(kind: str, *columns: str) -> DataFrame:
        return below("valued_reading", "metric_id", "value", *columns, kind=kind).unionByName(below("bare_reading", "metric_id", F.lit(None).cast("double").alias("value"), *columns, kind=kind))

    extra = None
    for name in ("case", "observation", "valued_reading", "bare_reading", "timed_segment", "segment_reference"):
        some = t[name].select(*base, "parent_id", "child_kind", "child_id", "ordinal", F.explode("extra").alias("field", "content"))
        extra = some if extra is None else extra.unionByName(some)
    return {
        "cases": t["case"].select(*base, "variant"),
        "task_scopes": t["task_scope"].select(*base, "ordinal", F.col("child_id").alias("task_scope")),
        "classes": t["class"].select(*base, F.col("child_id").alias("class"), F.col("value").alias("probability")),
        "observations": t["observation"].select(*base, "ordinal", F.col("child_id").alias("evidence_id"), *SUBTYPES["observation"], "variant"),
        "metric_ids": below("evidence_reference", "metric_evidence_id"),
        "supporting": readings("supporting", "description"),
        "counter": readings("counter"),
        "timed_segments": below("timed_segment", "segment_id", "start_sec", "end_sec", "text"),
        "segment_references": below("segment_reference", "segment_id"),
        "extra_fields": extra,
    }
