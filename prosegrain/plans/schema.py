"""Checks of configuration documents against a subset of JSON Schema: a function a keyword. Errors name the path of the field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

KINDS = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "array": (list,), "object": (dict,)}


def is_kind(value: Any, kind: str) -> bool:
    """A truth value is no number here."""
    return isinstance(value, KINDS[kind]) and (kind == "boolean" or not isinstance(value, bool))


#: Keywords that look at a value alone: (kind they apply to or None, what must hold, what to say).
PLAIN = {
    "const": (None, lambda v, w: v == w, "must be {!r}"),
    "enum": (None, lambda v, w: v in w, "must be one of {}"),
    "minItems": ("array", lambda v, w: len(v) >= w, "has fewer entries than {}"),
    "maxItems": ("array", lambda v, w: len(v) <= w, "has more entries than {}"),
    "minLength": ("string", lambda v, w: len(v) >= w, "is shorter than {}"),
    "pattern": ("string", lambda v, w: re.match(w, v) is not None, "has another form than {}"),
}


class Checker:
    def __init__(self, schema: dict):
        self.schema = schema

    def errors(self, value: Any, path: str = "document") -> list[str]:
        return list(self._all(value, self.schema, path))

    def _target(self, node: dict) -> dict:
        """``node``, or the part of the schema its reference names."""
        if "$ref" not in node:
            return node
        found: Any = self.schema
        for step in filter(None, node["$ref"].lstrip("#").split("/")):
            found = found[step]
        return self._target(found)

    def _all(self, value: Any, node: dict, path: str) -> Iterator[str]:
        node = self._target(node)
        if "type" in node and not is_kind(value, node["type"]):
            yield f"{path}: must be of type {node['type']}"
            return  # nothing else can be said of it
        for keyword, (kind, holds, say) in PLAIN.items():
            if keyword in node and (kind is None or is_kind(value, kind)) and not holds(value, node[keyword]):
                yield f"{path}: " + say.format(node[keyword])
        if "oneOf" in node:  # the alternative that comes nearest is reported
            yield from min((list(self._all(value, choice, path)) for choice in node["oneOf"]), key=len)
        for item, below, at in self._parts(value, node, path):
            yield from [f"{at}: no such field here"] if below is False else self._all(item, below, at)
        if isinstance(value, dict):
            yield from (f"{path}.{name}: is required" for name in node.get("required", ()) if name not in value)

    @staticmethod
    def _parts(value: Any, node: dict, path: str) -> Iterator[tuple[Any, Any, str]]:
        """(part of the value, its schema or False, its path)"""
        if isinstance(value, list) and "items" in node:
            yield from ((item, node["items"], f"{path}[{k}]") for k, item in enumerate(value))
        if isinstance(value, dict):
            other = node.get("additionalProperties", True)
            schemas = ((k, v, node.get("properties", {}).get(k, other)) for k, v in value.items())
            yield from ((v, s, f"{path}.{k}") for k, v, s in schemas if s is not True)
