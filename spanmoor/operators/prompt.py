"""Few-shot prompts, and a check of their examples."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import FUZZY_THRESHOLD, align


@dataclass(frozen=True)
class Extraction:
    class_: str
    text: str
    attributes: Mapping[str, Any] | None = field(default_factory=dict)


@dataclass(frozen=True)
class Example:
    text: str
    extractions: Sequence[Extraction] = ()


@dataclass(frozen=True)
class Template:
    description: str
    examples: Sequence[Example] = ()


@dataclass(frozen=True)
class Issue:
    example_index: int
    extraction_index: int
    example_text: str
    extraction_text: str
    extraction_class: str
    status: str


class ValidationError(ValueError):
    def __init__(self, issues: Sequence[Issue]):
        self.issues = list(issues)
        super().__init__(f"prompt validation failed: {len(self.issues)} alignment issue(s) found")


_PLAIN = re.compile(r"[A-Za-zÀ-ɏ][\w .'/()+-]*")
_TAKEN = {"true", "false", "null", "yes", "no", "on", "off", "~"}


def _scalar(value: Any) -> str:
    if isinstance(value, str):
        plain = _PLAIN.fullmatch(value) and not value.endswith(" ") and value.lower() not in _TAKEN
        return value if plain else json.dumps(value, ensure_ascii=False)
    return json.dumps(value, ensure_ascii=False)


def _yaml(value: Any, indent: int) -> list[str]:
    """Block YAML of a map or list, a line each."""
    pad, out = "  " * indent, []
    if isinstance(value, Mapping):
        for k, v in value.items():
            if isinstance(v, (Mapping, list, tuple)) and v:
                out += [f"{pad}{_scalar(str(k))}:", *_yaml(v, indent + 1)]
            else:
                out.append(f"{pad}{_scalar(str(k))}: " + ("{}" if isinstance(v, Mapping) else "[]" if isinstance(v, (list, tuple)) else _scalar(v)))
    else:
        for v in value:
            if isinstance(v, (Mapping, list, tuple)) and v:
                lines = _yaml(v, indent + 1)
                out += [f"{pad}- {lines[0].lstrip()}", *lines[1:]]
            else:
                out.append(f"{pad}- " + ("{}" if isinstance(v, Mapping) else "[]" if isinstance(v, (list, tuple)) else _scalar(v)))
    return out


def format_extractions(extractions: Sequence[Extraction]) -> str:
    """Fenced YAML with keys <class> and <class>_attributes."""
    entries = [{e.class_: e.text, f"{e.class_}_attributes": e.attributes} for e in extractions]
    body = "\n".join(_yaml({"extractions": entries}, 0)) if entries else "extractions: []"
    return f"```yaml\n{body}\n```"


def head(template: Template) -> str | None:
    """What all prompts of a template begin with; rendered once, as a literal."""
    parts = [template.description] if template.description else []
    parts += [f"{e.text}\n{format_extractions(e.extractions)}" for e in template.examples or ()]
    return "\n\n".join(parts) if parts else None


def prompt(template: Template, chunk: Column, previous: Column | None = None, context_window_chars: int | None = None) -> Column:
    """Description, examples, the text before (all of it, or its last graphemes)
    and the chunk, parted by empty lines; what is missing is left out."""
    before = F.lit(None).cast("string") if previous is None else previous
    if context_window_chars is not None:
        before = F.regexp_extract(before, rf"\X{{0,{int(context_window_chars)}}}\z", 0)
    return F.concat_ws("\n\n", F.lit(head(template)).cast("string"), F.concat(F.lit("[Previous text]: ..."), before), chunk)


def validate(spark: SparkSession, template: Template, threshold: float = FUZZY_THRESHOLD) -> list[Issue]:
    """The examples' extractions that do not occur exactly in their text."""
    rows = [(i, j, x.text, e.text, e.class_) for i, x in enumerate(template.examples or ()) for j, e in enumerate(x.extractions)]
    if not rows:
        return []
    df = spark.createDataFrame(rows, "example_index int, extraction_index int, example_text string, extraction_text string, extraction_class string")
    return [Issue(**r.asDict()) for r in issues(df, threshold).orderBy("example_index", "extraction_index").collect()]


def issues(examples: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """As ``validate``, over rows."""
    found = align(examples, "example_text", "extraction_text", threshold).where("status <> 'exact'")
    return found.drop("byte_start", "byte_end")


def validate_or_raise(spark: SparkSession, template: Template, threshold: float = FUZZY_THRESHOLD) -> None:
    found = validate(spark, template, threshold)
    if found:
        raise ValidationError(found)
