"""JSON Schema (draft 2020-12) of the output document and of the options."""

from __future__ import annotations

from .. import constants as K

STRING, BOOLEAN, COUNT = {"type": "string"}, {"type": "boolean"}, {"type": "integer", "minimum": 0, "maximum": 2**53 - 1}
SEVERITY = {"type": "string", "enum": ["error", "warning"]}
KIND = {"type": "string", "enum": list(K.KINDS)}


def strict(optional: tuple[str, ...] = (), **fields) -> dict:
    """An object with these fields and no others."""
    return {"type": "object", "properties": fields, "required": [k for k in fields if k not in optional], "additionalProperties": False}


def many(item: dict) -> dict:
    return {"type": "array", "items": item}


def maybe(item: dict) -> dict:
    return {"anyOf": [item, {"type": "null"}]}


def record(value: dict, keys: dict | None = None) -> dict:
    return {"type": "object", "propertyNames": keys or STRING, "additionalProperties": value}


def json_schema() -> dict:
    """Of what `to_json` writes for a row of `analyze`."""
    text = maybe(STRING)
    frontmatter = strict(name=text, description=text, version=text, license=text, compatibility=text, allowedTools=maybe(many(STRING)), metadata=maybe(record(STRING)), extra=record({}))
    body = strict(text=STRING, lines=COUNT, headings=many(strict(depth={"type": "integer", "minimum": 1, "maximum": 6}, text=STRING)))
    file = strict(path=STRING, size=COUNT, sha256={"type": "string", "pattern": "^[0-9a-f]{64}$"}, kind=KIND, isText=BOOLEAN)
    diagnostic = strict(("field", "hint"), code=STRING, severity=SEVERITY, message=STRING, field=STRING, hint=STRING)
    return {"$schema": "https://json-schema.org/draft/2020-12/schema"} | strict(
        schemaVersion={"type": "string", "const": K.SCHEMA_VERSION}, analyzerVersion=STRING, specVersion=STRING, ok=BOOLEAN, dir=text, frontmatter=frontmatter, body=maybe(body),
        readme=maybe(strict(path=STRING, text=STRING)), license=strict(declared=text, spdx=text, file=text, source=maybe({"type": "string", "enum": ["frontmatter", "file"]})), files=many(file),
        tokens=strict(metadata=COUNT, body=COUNT, total=COUNT, tokenizer=STRING), references=strict(declared=many(STRING), resolved=many(STRING), broken=many(STRING), external=many(STRING), orphans=many(STRING)),
        size=strict(total=COUNT, byKind=record(COUNT, KIND)), digest={"type": "string", "pattern": "^sha256:[0-9a-f]{64}$"}, diagnostics=many(diagnostic),
    )


def options_schema() -> dict:
    """Of the options that are data; a tokenizer is a name and a function."""
    rule = {"type": "string", "enum": ["error", "warning", "off"]}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema"} | strict(("ignore", "max_file_bytes", "rules"), ignore=many(STRING), max_file_bytes={"type": "integer", "exclusiveMinimum": 0}, rules=record(rule))


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value departs from a schema of the kinds that this module makes."""
    if "anyOf" in schema:
        found = [faults(value, s, at) for s in schema["anyOf"]]
        return [] if any(not f for f in found) else found[0]
    kinds = {"string": str, "boolean": bool, "integer": int, "array": list, "object": dict, "null": type(None)}
    kind = schema.get("type")
    if kind and (not isinstance(value, kinds[kind]) or kind == "integer" and isinstance(value, bool)):
        return [f"{at}: not of type {kind}"]
    out = [f"{at}: {value!r}" for k, wrong in (("enum", lambda x: value not in x), ("const", lambda x: value != x), ("minimum", lambda x: value < x), ("maximum", lambda x: value > x)) if k in schema and wrong(schema[k])]
    if kind == "array":
        out += [f for i, v in enumerate(value) for f in faults(v, schema["items"], f"{at}[{i}]")]
    if kind == "object":
        fields, rest = schema.get("properties", {}), schema.get("additionalProperties")
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k, v in value.items():
            out += [f"{at}.{k}: unknown"] if rest is False and k not in fields else faults(v, fields.get(k, rest or {}), f"{at}.{k}")
    return out
