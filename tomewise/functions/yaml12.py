"""YAML 1.2 core schema on PyYAML, ECMAScript numbers and canonical JSON."""

from __future__ import annotations

import json
import math
import re

import yaml


#: Fixed value: an alias may be resolved as long as its uses times the aliases that one use resolves stay within this.
MAX_ALIASES = 100
_BREAKS = "\0\r\n\x85\u2028\u2029"


class CoreLoader(yaml.SafeLoader):
    """Scalars by the 1.2 core schema; duplicate keys are errors; `<<` is a key like any other; unknown tags are ignored.

    Tabs may stand between tokens and inside plain scalars, an anchor may be set again, and aliases that multiply are errors.
    """

    yaml_implicit_resolvers: dict = {}

    def __init__(self, stream):
        super().__init__(stream)
        self.parts: dict[int, list] = {}  # of each node, by id: (child, whether it is an alias)
        self.uses: dict[int, list[int]] = {}  # of each anchored node: how often it is used, and how many aliases one use resolves

    def scan_to_next_token(self):
        while True:
            super().scan_to_next_token()
            inline = self.flow_level or self.buffer[self.pointer - self.column : self.pointer].strip(" \t")
            length = 0
            while self.peek(length) in ("\t", " "):
                length += 1
            if not length or not (inline or self.peek(length) in _BREAKS):
                return
            self.forward(length)

    def scan_plain_spaces(self, indent, start_mark):
        length = 0
        while self.peek(length) in ("\t", " "):
            length += 1
        space = self.prefix(length)
        self.forward(length)
        rest = super().scan_plain_spaces(indent, start_mark)
        return rest if rest is None or rest or not space else [space]

    def compose_node(self, parent, index):
        event = self.peek_event()
        alias = isinstance(event, yaml.AliasEvent)
        if not alias and event.anchor in self.anchors:
            del self.anchors[event.anchor]
        node = super().compose_node(parent, index)
        if alias:
            use = self.uses.setdefault(id(node), [1, 0])
            use[0] += 1
            use[1] = use[1] or self._aliases(node)
            if use[0] * use[1] > MAX_ALIASES:
                raise yaml.composer.ComposerError(None, None, "Excessive alias count indicates a resource exhaustion attack", event.start_mark)
        self.parts.setdefault(id(parent), []).append((node, alias))
        return node

    def _aliases(self, node) -> int:
        if not isinstance(node, yaml.CollectionNode):
            return 1
        found = 0
        for child, alias in self.parts.get(id(node), ()):
            use = self.uses.get(id(child), (0, 0))
            found = max(found, use[0] * use[1] if alias else self._aliases(child))
        return found


_CORE = (
    ("null", r"~|null|Null|NULL|", ["~", "n", "N", ""]),
    ("bool", r"true|True|TRUE|false|False|FALSE", list("tTfF")),
    ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", list("-+0123456789")),
    ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", list("-+0123456789.")),
)
for _tag, _pattern, _first in _CORE:
    CoreLoader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(rf"(?:{_pattern})\Z"), _first)


def double(x: int | float) -> float:
    """As a double; what is too large is infinite."""
    try:
        return float(x)
    except OverflowError:
        return math.inf if x > 0 else -math.inf


def _int(loader, node):
    v = loader.construct_scalar(node)
    return int(v[2:], 8) if v.startswith("0o") else int(v[2:], 16) if v.startswith("0x") else int(v, 10) if len(v) < 300 else float(v)


def _float(loader, node):
    v = loader.construct_scalar(node).lower()
    return math.nan if "nan" in v else math.copysign(math.inf, -1 if v[0] == "-" else 1) if "inf" in v else float(v)


def flow(value) -> str:
    """A key that is a collection, as text."""
    if isinstance(value, dict):
        return "{ " + ", ".join(f"{k}: {flow(v)}" for k, v in value.items()) + " }" if value else "{}"
    if isinstance(value, list):
        return "[ " + ", ".join(map(flow, value)) + " ]" if value else "[]"
    return js_string(value)


def _mapping(loader, node):
    """Keys are unique by kind and value; as text, a null key is empty, and a later key of the same text replaces the value."""
    out, seen = {}, set()
    yield out
    for key_node, value_node in node.value:
        key = loader.construct_object(key_node, deep=True)
        if not isinstance(key, (dict, list)) and key == key:
            kind = type(key) if key is None or isinstance(key, (bool, str)) else float
            if (kind, key) in seen:
                raise yaml.constructor.ConstructorError(None, None, "Map keys must be unique", key_node.start_mark)
            seen.add((kind, key))
        text = "" if key is None else flow(key)
        out[text] = loader.construct_object(value_node)


def _unknown(loader, suffix, node):
    if isinstance(node, yaml.MappingNode):
        return _mapping(loader, node)
    return loader.construct_yaml_seq(node) if isinstance(node, yaml.SequenceNode) else loader.construct_scalar(node)


def _nothing(loader, node):
    """Sets and ordered maps are no plain objects: nothing of them is seen as JSON."""
    return {}


def _binary(loader, node):
    """Bytes, as an object of places."""
    return {str(i): b for i, b in enumerate(yaml.constructor.SafeConstructor.construct_yaml_binary(loader, node))}


_T = "tag:yaml.org,2002:"
CoreLoader.yaml_constructors = {k: f for k, f in yaml.SafeLoader.yaml_constructors.items() if k in {None, *(_T + x for x in ("null", "str", "seq"))}}
CoreLoader.add_constructor(_T + "int", _int)
CoreLoader.add_constructor(_T + "float", _float)
CoreLoader.add_constructor(_T + "bool", lambda loader, node: loader.construct_scalar(node).lower() == "true")
CoreLoader.add_constructor(_T + "map", _mapping)
CoreLoader.add_constructor(_T + "binary", _binary)
for _tag in ("set", "omap"):
    CoreLoader.add_constructor(_T + _tag, _nothing)
CoreLoader.add_multi_constructor("", _unknown)


def load(text: str):
    """One document; raises yaml.YAMLError."""
    try:
        return yaml.load(text, CoreLoader)
    except yaml.YAMLError:
        raise
    except (ValueError, RecursionError, TypeError, AttributeError, KeyError) as error:
        raise yaml.YAMLError(str(error)) from error


def key_order(s: str) -> bytes:
    return s.encode("utf-16-be", "surrogatepass")


def json_safe(value, above: tuple = ()):
    """A copy with sorted keys; a reference back to what holds it becomes null."""
    if isinstance(value, (dict, list)):
        if id(value) in above:
            return None
        above = (*above, id(value))
        if isinstance(value, list):
            return [json_safe(v, above) for v in value]
        return {k: json_safe(value[k], above) for k in sorted(value, key=key_order)}
    return value if isinstance(value, (str, bool, int, float)) or value is None else str(value)


def js_number(x: int | float) -> str:
    """As ECMAScript writes a double."""
    x = double(x)
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign = "-" if x < 0 else ""
    mantissa, _, exponent = repr(abs(x)).partition("e")
    whole, _, fraction = mantissa.partition(".")
    digits = (whole + fraction).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + fraction) - len((whole + fraction).lstrip("0")))
    digits = digits.rstrip("0")
    n, k = point, len(digits)
    if k <= n <= 21:
        return sign + digits + "0" * (n - k)
    if 0 < n <= 21:
        return f"{sign}{digits[:n]}.{digits[n:]}"
    if -6 < n <= 0:
        return f"{sign}0.{'0' * -n}{digits}"
    e = f"e{'+' if n > 0 else '-'}{abs(n - 1)}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if k > 1 else ''}{e}"


def js_string(value) -> str:
    if isinstance(value, str):
        return value
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else js_number(value)


def js_keys(keys) -> list[str]:
    """The order in which ECMAScript lists an object's keys: array indices by number, then the others as they came."""
    index = lambda k: k.isascii() and k.isdigit() and (k == "0" or k[0] != "0") and len(k) <= 10 and int(k) < 2**32 - 1
    return sorted(filter(index, keys), key=int) + [k for k in keys if not index(k)]


def json_text(value, order=js_keys) -> str:
    """Compact JSON as JSON.stringify writes it; numbers that are not finite become null."""
    if isinstance(value, str):
        return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m.group()):04x}", json.dumps(value, ensure_ascii=False))
    if isinstance(value, dict):
        return "{" + ",".join(f"{json_text(k)}:{json_text(value[k], order)}" for k in order(value)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(json_text(v, order) for v in value) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return js_number(value) if math.isfinite(double(value)) else "null"
    return js_string(value)


def canonical_json(value) -> str:
    """json_text with the keys of all objects in UTF-16 order."""
    return json_text(json_safe(value), lambda d: sorted(d, key=key_order))


def json_pretty(value, indent: str = "") -> str:
    """JSON.stringify with two spaces."""
    inner = indent + "  "
    if isinstance(value, dict) and value:
        return "{\n" + ",\n".join(f"{inner}{json_text(k)}: {json_pretty(value[k], inner)}" for k in js_keys(value)) + f"\n{indent}}}"
    if isinstance(value, (list, tuple)) and value:
        return "[\n" + ",\n".join(inner + json_pretty(v, inner) for v in value) + f"\n{indent}]"
    return json_text(value)
