"""Band tables: JSON documents of reference rates by rule, found by name through scopes. Driver-side, a few rules each."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators.bands import BANDS
from . import settings
from .schema import Checker

# The fields of a table of bands.
_RANGE = {"type": "array", "minItems": 2, "maxItems": 2, "items": {"type": "number"}}
_COUNT, _RATE = {"type": "integer"}, {"type": "number"}
#: A field that is not named here may only hold a text.
SCHEMA = {
    "type": "object", "required": ["name", "rules"], "additionalProperties": {"type": "string"},
    "properties": {
        "name": {"type": "string", "pattern": settings.NAME.pattern}, "description": {"type": "string", "minLength": 1},
        "meta": {"type": "object", "properties": {"generated": {"type": "string"}, "script": {"type": "string"}, "unit": {"type": "string"}, "band_rule": {"type": "string"}, "min_words_guard": _COUNT, "excluded_format_artifacts": {"type": "array"}}},
        "rules": {"type": "object", "additionalProperties": {
            "type": "object", "required": ["direction"], "additionalProperties": False,
            "properties": {
                "direction": {"enum": ["ai-high", "human-high"]}, "human_universal": _RANGE, "human_internal": _RANGE, "ai_universal": _RATE, "ai_internal": _RATE,
                "human_universal_n": _COUNT, "human_internal_n": _COUNT, "ai_universal_n": _COUNT, "ai_internal_n": _COUNT,
            },
        }},
    },
}


def errors(doc: Any) -> list[str]:
    """What is wrong with a table, by field; nothing for a good one."""
    out = Checker(SCHEMA).errors(doc, "bands")
    rules = doc.get("rules") if isinstance(doc, dict) else None
    for rule, entry in rules.items() if isinstance(rules, dict) else ():
        if not settings.RULE_ID.match(rule):
            out.append(f"bands.rules.{rule}: the name is no rule's")
        for key in ("human_universal", "human_internal"):
            given = entry.get(key) if isinstance(entry, dict) else None
            if isinstance(given, list) and len(given) == 2 and all(type(x) in (int, float) for x in given) and given[0] > given[1]:
                out.append(f"bands.rules.{rule}.{key}: the low end is above the high one")
    return out


def load(path: Path) -> dict:
    try:
        doc = json.loads(path.read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ValueError(f"{path}: line {e.lineno} is not JSON") from e
    if found := errors(doc):
        raise ValueError("\n".join([f"{path} is no table of bands", *found]))
    return doc


def named(name: str, scopes: Mapping[str, Path]) -> tuple[dict, str]:
    """(table, scope) of a path or a name; earlier scopes come first."""
    path, scope = settings.first_found(name, scopes, "table of bands")
    return load(path), scope


def frame(spark: SparkSession, table: dict) -> DataFrame:
    """The table as rows that ``operators.bands.verdicts`` takes."""
    rows = []
    for rule, e in table["rules"].items():
        ends = [float(x) for key in ("human_universal", "human_internal") for x in (e.get(key) or ())[:2]] if e.get("human_universal") and e.get("human_internal") else None
        hu, hi = (e.get(k) or [None, None] for k in ("human_universal", "human_internal"))
        number = lambda x: None if x is None else float(x)
        rows.append((table["name"], rule, e["direction"], *(ends or map(number, [*hu[:2], *hi[:2]])), number(e.get("ai_universal")), number(e.get("ai_internal"))))
    return spark.createDataFrame(rows, BANDS)


def number(v: float) -> str:
    """A rate as it is shown: as ``functions.text.number_text`` does."""
    return "0" if v == 0 else f"{v:.2f}".rstrip("0").rstrip(".") if v < 10 else f"{v:.1f}"


def parts(entry: Mapping[str, Any]) -> list[str]:
    """The reference rates of a rule: human, internal, and that of machines where it counts."""
    out = [f"{word} {number(entry[key][0])}-{number(entry[key][1])}" for key, word in (("human_universal", "human"), ("human_internal", "int")) if entry.get(key)]
    machine = entry.get("ai_universal", entry.get("ai_internal"))
    return out + ([f"ai ~{number(machine)}"] if machine is not None and entry["direction"] != "human-high" else [])


def lines(table: dict, scope: str) -> list[str]:
    """A table as text: a head, its description, then a line a rule."""
    meta = table.get("meta") or {}
    head = [f"{table['name']} ({scope}): {len(table['rules'])} rules", *([f"generated {meta['generated']}"] if meta.get("generated") else []), *([meta["unit"]] if meta.get("unit") else [])]
    return [", ".join(head), *([table["description"]] if table.get("description") else []), *(" · ".join([f"  {rule:<6}{e['direction']:<11}", *parts(e)]) for rule, e in table["rules"].items())]


def listing(scopes: Mapping[str, Path]) -> list[str]:
    """Every table that can be found, in the order of the scopes, with its number of rules; ``?`` for one that is wrong."""
    out = []
    for scope, folder in scopes.items():
        for at in sorted(folder.glob("*.json")) if folder.is_dir() else ():
            try:
                rules = str(len(load(at)["rules"]))
            except ValueError:
                rules = "?"
            out.append(f"{at.stem:<16} {scope:<9} {rules:>2} rules  {at}")
    return out
