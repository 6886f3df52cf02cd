"""JSON schemas of a model's replies, worked on before a call; plain values on the driver."""

from __future__ import annotations

import json
from typing import Any

# The keys a reply's schema keeps at the top.
KEPT = ("type", "properties", "items", "required", "description", "title")
DEFINITIONS = "#/$defs/"


def inlined(value: Any, definitions: dict[str, Any], within: tuple[str, ...] = ()) -> Any:
    """value with what its references name in their place; unknown ones stay, and so does one inside of itself."""
    if isinstance(value, list):
        return [inlined(v, definitions, within) for v in value]
    if not isinstance(value, dict):
        return value
    if "$ref" not in value:
        return {k: inlined(v, definitions, within) for k, v in value.items() if k != "$defs"}
    place = str(value["$ref"])
    name = place.rsplit("/", 1)[-1]
    known = place.startswith(DEFINITIONS) and name in definitions and name not in within
    return inlined(definitions[name], definitions, (*within, name)) if known else value


def simplified(schema: dict[str, Any]) -> dict[str, Any]:
    """A schema without definitions, its top cut to the kept keys; all properties are required unless it says which."""
    flat = inlined(schema, schema.get("$defs", {}))
    out = {k: flat[k] for k in flat if k in KEPT}
    if "properties" in out:
        out.setdefault("required", list(out["properties"]))
    return out


def canonical(value: Any) -> Any:
    """A JSON value with the keys of all its objects in order; lists keep theirs."""
    return json.loads(json.dumps(value, sort_keys=True))
