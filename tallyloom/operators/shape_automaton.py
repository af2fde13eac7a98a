"""A bottom-up tree automaton over JSON values.

A node's state follows from its kind, its field names and the states of its
children, and from nothing else, so one pass from the leaves up decides what every
part of a record is, whatever field it stands under and however it is wrapped.
The pass holds its own stack: depth costs no recursion. States:

    workspace    an object with a case_id
    observation  an object with state_observations' own fields
    segment      an object with a segment_id, or with both times
    reading      an object with a metric_id
    entry        an object with evidence_id and evidence_type
    envelope     an object that is none of these and holds a workspace
    scores       an object whose children are numbers or numeric texts
    keyed        an object whose children are all objects, by their ids
    list<S>      an array whose non-null elements are in the states S
    text, numeric_text, number, flag, nil, torn, other
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

_EDGES = re.compile(r'^[^\w{\["]+|[^\w}\]"]+$')
_NUMBER = re.compile(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*")
#: The same for the JVM, as a whole text.
NUMBER_TEXT = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"

SCALARS = frozenset({"text", "numeric_text", "number", "flag", "nil"})
NUMBERS = frozenset({"number", "numeric_text", "nil"})
HOLDERS = ("workspace", "envelope")


@dataclass(frozen=True)
class Rule:
    """An object is in ``state`` if all fields of ``all_of`` are there, one of ``any_of`` if any are named, and none of ``none_of``; named fields hold scalars if ``scalar``."""

    state: str
    all_of: frozenset[str] = frozenset()
    any_of: frozenset[str] = frozenset()
    none_of: frozenset[str] = frozenset()
    scalar: bool = False

    def names_fit(self, keys: frozenset[str]) -> bool:
        return self.all_of <= keys and not (self.any_of and not self.any_of & keys) and not self.none_of & keys


#: Transitions of objects by their fields, the first that fits. Field names are fixed values of the record format.
RULES = (
    Rule("workspace", all_of=frozenset({"case_id"}), none_of=frozenset({"evidence_id"}), scalar=True),
    Rule("observation", any_of=frozenset({"state_id", "state_z", "metric_evidence_ids", "supporting_metrics", "counter_evidence", "evidence_segments"})),
    Rule("segment", all_of=frozenset({"segment_id"})),
    Rule("segment", all_of=frozenset({"start_sec", "end_sec"}), scalar=True),
    Rule("reading", all_of=frozenset({"metric_id"})),
    Rule("entry", all_of=frozenset({"evidence_id", "evidence_type"})),
    Rule("observation", all_of=frozenset({"evidence_id"})),
)


@lru_cache(maxsize=65536)
def _rules_of(names: tuple[str, ...]) -> tuple[tuple[str, frozenset[str]], ...]:
    """The transitions that an object of these field names can make, in order: the state and the fields that must hold scalars."""
    keys = frozenset(names)
    return tuple((r.state, r.all_of if r.scalar else frozenset()) for r in RULES if r.names_fit(keys))


def parse(payload: str | None) -> Any:
    """The value of a payload, or None if it is not one complete JSON value.

    Marks, blanks and commas around the value do not count. A payload that is a
    JSON text of a JSON value gives that value. A value nested deeper than the JSON
    parser goes (many thousand levels) counts as incomplete.
    """
    value: Any = payload
    while isinstance(value, str):
        try:
            value = json.loads(value if _clean(value) else _EDGES.sub("", value), strict=False)
        except (ValueError, RecursionError):
            return None
    return value


def _clean(text: str) -> bool:
    """Whether nothing stands around a JSON value that would have to go."""
    a, b = text[:1], text[-1:]
    return (a in '{["' or a.isalnum()) and (b in '}]"' or b.isalnum())


def unwrap(value: Any) -> Any:
    """Text that holds a JSON array or object stands for it; other values for themselves."""
    if isinstance(value, str) and not value[:1].isalnum() and value.lstrip()[:1] in ("{", "["):
        inner = parse(value)
        return value if inner is None else inner
    return value


_OF_KIND = {type(None): "nil", bool: "flag", int: "number", float: "number"}


def _scalar_state(value: Any) -> str:
    kind = _OF_KIND.get(type(value))
    if kind is not None:
        return kind
    first = value[:1]
    if first.isalpha():
        return "text"
    if value.lstrip()[:1] in ("{", "["):
        return "torn"
    return "numeric_text" if _NUMBER.fullmatch(value) else "text"


def _object_state(node: dict[str, Any], children: dict[str, str]) -> str:
    for state_, scalars in _rules_of(tuple(children)):
        if all(children[k] in SCALARS for k in scalars):
            return state_
    states = set(children.values())
    if any(s in HOLDERS or (s.startswith("list<") and any(h in s for h in HOLDERS)) for s in states):
        return "envelope"
    if states and states <= NUMBERS:
        return "scores"
    return "keyed" if states and all(isinstance(v, dict) for v in node.values()) else "other"


class Tree:
    """A parsed value with the state of every part.

    Texts in it that hold JSON are replaced by what they hold, in place, so ``root``
    is the value the states belong to.
    """

    def __init__(self, value: Any) -> None:
        self.root = unwrap(value)
        self._states: dict[int, str] = {}
        self._fields: dict[int, dict[str, str]] = {}
        waiting, seen = [self.root], []
        while waiting:
            node = waiting.pop()
            if not isinstance(node, (dict, list)):
                continue
            seen.append(node)
            for k, child in node.items() if isinstance(node, dict) else enumerate(node):
                if isinstance(child, str):
                    inner = unwrap(child)
                    if inner is child:
                        continue
                    node[k] = child = inner
                if isinstance(child, (dict, list)):
                    waiting.append(child)
        states, fields = self._states, self._fields
        for node in reversed(seen):  # children stand behind their parents
            if isinstance(node, list):
                found = {states[id(v)] if isinstance(v, (dict, list)) else _scalar_state(v) for v in node}
                found.discard("nil")
                states[id(node)] = f"list<{'|'.join(sorted(found))}>"
            else:
                own = {k: states[id(v)] if isinstance(v, (dict, list)) else _scalar_state(v) for k, v in node.items()}
                fields[id(node)] = own
                states[id(node)] = _object_state(node, own)

    def state(self, value: Any) -> str:
        """The state of a part of this tree, or of any scalar."""
        return self._states[id(value)] if isinstance(value, (dict, list)) else _scalar_state(value)

    def signature(self, value: Any) -> str:
        """The variant of an object: its fields that are not null with their states, in order of name."""
        if not isinstance(value, dict):
            return self.state(value)
        own = self._fields[id(value)]
        return ",".join([f"{k}:{own[k]}" for k in sorted(own) if own[k] != "nil"])

    def workspaces(self) -> Iterator[dict[str, Any]]:
        """The workspaces, through envelopes and lists, in the order written; none inside another."""
        waiting = [self.root]
        while waiting:
            node = waiting.pop()
            if isinstance(node, dict) and self.state(node) == "workspace":
                yield node
            elif isinstance(node, (dict, list)):
                waiting += reversed(list(node.values() if isinstance(node, dict) else node))


def state(value: Any) -> str:
    """The state of a value."""
    tree = Tree(value)
    return tree.state(tree.root)
