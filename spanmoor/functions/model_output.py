"""What a model returns, turned into extraction entries."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import yaml_text

ENTRY = T.StructType([T.StructField(c, T.StringType()) for c in ("class", "text", "attributes")])
_PARSED = T.StructType([T.StructField("error", T.StringType()), T.StructField("dropped", T.IntegerType()), T.StructField("entries", T.ArrayType(ENTRY))])
#: White space at the ends, thoughts, the first fenced block.
_ENDS = r"(?U)\A\s+|\s+\z"
_THINK = r"(?s)<think>.*?(?:</think>|\z)"
_FENCE = r"(?s)```(?:json|yaml)?\s*(.*?)\s*```"


def strip_think(raw: Column) -> Column:
    """Without <think> blocks, an unclosed one to the end, and trimmed."""
    return F.regexp_replace(F.regexp_replace(raw, _THINK, ""), _ENDS, "")


def strip_fences(content: Column) -> Column:
    """The inside of the first fenced block, or all if there is none."""
    return F.when(F.rlike(content, F.lit(_FENCE)), F.regexp_extract(content, _FENCE, 1)).otherwise(content)


def _yaml_loader():
    """A loader with YAML's core schema: no dates, no sexagesimals, no yes/no.
    Without PyYAML, a reader of our own, which knows no anchors and no tags."""
    try:
        import yaml
    except ImportError:
        return yaml_text.load
    import re

    class Core(yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

    tag = "tag:yaml.org,2002:"
    Core.add_implicit_resolver(tag + "bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    Core.add_implicit_resolver(tag + "null", re.compile(r"^(?:~|null|Null|NULL|)$"), ["~", "n", "N", ""])
    Core.add_implicit_resolver(tag + "int", re.compile(r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$"), list("-+0123456789"))
    Core.add_implicit_resolver(tag + "float", re.compile(r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$"), list("-+.0123456789"))

    def integer(loader, node):
        v = loader.construct_scalar(node)
        return int(v[2:], 8) if v.startswith("0o") else int(v[2:], 16) if v.startswith("0x") else int(v)

    def floating(loader, node):
        v = loader.construct_scalar(node).lower()
        return float(v.replace(".inf", "inf").replace(".nan", "nan"))

    Core.add_constructor(tag + "int", integer)
    Core.add_constructor(tag + "float", floating)
    return lambda content: yaml.load(content, Core)  # noqa: S506


_LOADER: list = []


def decode(content: str) -> Any:
    """JSON if it is that, else YAML; raises ValueError for neither."""
    try:
        return json.loads(content)
    except ValueError:
        pass
    if not _LOADER:
        _LOADER.append(_yaml_loader())
    try:
        return _LOADER[0](content)
    except Exception as e:
        raise ValueError(str(e)) from e


def normalize_entry(entry: Any) -> Any:
    """An entry with one class key, {class: text, class_attributes: {...}},
    becomes {class, text, attributes}; any other is left as it is."""
    if not isinstance(entry, dict) or ("class" in entry and "text" in entry):
        return entry
    if not all(isinstance(k, str) for k in entry):
        raise ValueError("a key is no string")
    suffix = "_attributes"
    plain = {k for k in entry if not k.endswith(suffix)}
    classes = [k for k in entry if k in plain or k[: -len(suffix)] not in plain]
    if len(classes) != 1:
        return entry
    attributes = entry.get(classes[0] + suffix)
    return {"class": classes[0], "text": entry[classes[0]], "attributes": attributes if isinstance(attributes, dict) else {}}


def normalize_content(content: str) -> dict:
    """The decoded map with its entries normalised; ValueError if it is none."""
    value = decode(content)
    if not isinstance(value, dict) or not isinstance(value.get("extractions"), list):
        raise ValueError("no map with a list of extractions")
    return value | {"extractions": [normalize_entry(e) for e in value["extractions"]]}


def to_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)


def parse_entries(value: dict) -> list[dict[str, str]]:
    """The entries whose class and text are strings with something in them."""
    full = lambda v: isinstance(v, str) and v != ""
    out = []
    for e in value["extractions"]:
        if isinstance(e, dict) and full(e.get("class")) and full(e.get("text")):
            a = e.get("attributes")
            out.append({"class": e["class"], "text": e["text"], "attributes": to_json(a if isinstance(a, dict) else {})})
    return out


@F.arrow_udf(T.StringType())
def _normalized(content: pa.Array) -> pa.Array:
    def one(v):
        try:
            return None if v is None else to_json(normalize_content(v))
        except ValueError:
            return None

    return pa.array([one(v.as_py()) for v in content], pa.string())


@F.arrow_udf(_PARSED)
def _parsed(content: pa.Array) -> pa.Array:
    kind = pa.struct([("class", pa.string()), ("text", pa.string()), ("attributes", pa.string())])
    out = []
    for v in content:
        try:
            value = normalize_content(v.as_py() or "")
            entries = parse_entries(value)
            out.append({"error": None, "dropped": len(value["extractions"]) - len(entries), "entries": entries})
        except ValueError:
            out.append({"error": "invalid_format", "dropped": 0, "entries": []})
    return pa.array(out, pa.struct([("error", pa.string()), ("dropped", pa.int32()), ("entries", pa.list_(kind))]))


@F.arrow_udf(_PARSED)
def parse_decoded(content: pa.Array) -> pa.Array:
    """As ``parse``, of a map that is decoded and normalised already, as JSON. One
    without a list of extractions is ``missing_extractions``."""
    kind = pa.struct([("class", pa.string()), ("text", pa.string()), ("attributes", pa.string())])
    out = []
    for v in content:
        try:
            value = json.loads(v.as_py() or "null")
        except ValueError:
            value = None
        if isinstance(value, dict) and isinstance(value.get("extractions"), list):
            entries = parse_entries(value)
            out.append({"error": None, "dropped": len(value["extractions"]) - len(entries), "entries": entries})
        else:
            out.append({"error": "missing_extractions", "dropped": 0, "entries": []})
    return pa.array(out, pa.struct([("error", pa.string()), ("dropped", pa.int32()), ("entries", pa.list_(kind))]))


def normalize(raw: Column) -> Column:
    """The normalised map as JSON, or null for an invalid format."""
    return _normalized(strip_fences(strip_think(raw)))


def parse(raw: Column) -> Column:
    """struct<error, dropped, entries>: valid entries of raw model output."""
    return _parsed(strip_fences(strip_think(raw)))
