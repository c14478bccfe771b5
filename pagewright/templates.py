"""Styles by name or from a file: how text is written in each format."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from pagewright.config import Config
from pagewright.operators.formatting import Style

PRESETS = Path(__file__).with_name("presets.yaml")
DEFAULT = "minimal"


class TemplateError(ValueError):
    """A template that cannot be used; the message names it and the key."""


@dataclass(frozen=True)
class Template:
    name: str
    description: str = ""
    style: Style = Style()
    fonts: dict[str, Any] = field(default_factory=dict)
    spacing: dict[str, Any] = field(default_factory=dict)
    colors: dict[str, Any] = field(default_factory=dict)


#: Keys of the Markdown part: the field of a style, what the value must be, and a test of that.
_MARKDOWN: dict[str, tuple[str, str, Callable[[Any], bool]]] = {
    "bullet_marker": ("bullet", "one of ['*', '+', '-']", lambda v: v in ("*", "+", "-")),
    "emphasis_marker": ("emphasis", "a marker", lambda v: isinstance(v, str)),
    "strong_marker": ("strong", "a marker", lambda v: isinstance(v, str)),
    "heading_style": ("setext", "one of ['atx', 'setext']", lambda v: v in ("atx", "setext")),
    "thematic_break": ("thematic_break", "a line", lambda v: isinstance(v, str)),
    "code_fence": ("fence", "a fence", lambda v: isinstance(v, str) and v != ""),
    "wrap_width": ("wrap", "a whole number of 0 or more", lambda v: type(v) is int and v >= 0),
}
_ROLE = ("a mapping with a 'family'", lambda v: isinstance(v, dict))
#: Keys of the fonts likewise.
_FONTS: dict[str, tuple[str, Callable[[Any], bool]]] = {
    "body": _ROLE,
    "heading": _ROLE,
    "mono": _ROLE,
    "fallback": ("a list of family names", lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)),
    "cjk": ("the name of a font", lambda v: isinstance(v, str)),
    "embed_cjk": ("true or false", lambda v: isinstance(v, bool)),
}


def from_dict(data: Any, name: str | None = None) -> Template:
    """A template of plain values, checked."""
    if not isinstance(data, dict):
        raise TemplateError(f"template {name!r}: a mapping is expected")
    name = name or data.get("name")
    if not name:
        raise TemplateError("a template needs a 'name'")
    parts = {key: {} if data.get(key) is None else data[key] for key in ("markdown", "fonts", "spacing", "colors")}
    for key, part in parts.items():
        if not isinstance(part, dict):
            raise TemplateError(f"template {name!r}: {key!r} must be a mapping")
    for part, known in (("markdown", _MARKDOWN), ("fonts", _FONTS)):
        if strange := sorted(set(parts[part]) - set(known)):
            raise TemplateError(f"template {name!r}: unknown keys {strange} in {part!r}; known are {sorted(known)}")
        for key, value in parts[part].items():
            *_, words, fits = known[key]
            if (value is not None or part == "markdown") and not fits(value):
                raise TemplateError(f"template {name!r}: {part}.{key} must be {words}, not {value!r}")
    style = Style(**{_MARKDOWN[key][0]: value == "setext" if key == "heading_style" else value for key, value in parts["markdown"].items()})
    return Template(name, data.get("description") or "", style, parts["fonts"], parts["spacing"], parts["colors"])


@cache
def _presets() -> dict[str, dict]:
    return yaml.safe_load(PRESETS.read_text("utf-8"))


def presets() -> list[str]:
    """Names of the presets in order."""
    return sorted(_presets())


def load(name: str) -> Template:
    """A preset, or a template from the YAML file of that path."""
    path = Path(name)
    if path.is_file():
        try:
            data = yaml.safe_load(path.read_text("utf-8")) or {}
        except (yaml.YAMLError, UnicodeDecodeError) as error:
            raise TemplateError(f"template {name!r} is not valid YAML: {error}") from error
        return from_dict(data, (data.get("name") if isinstance(data, dict) else None) or path.stem)
    if name not in _presets():
        raise TemplateError(f"unknown template {name!r}; presets are {', '.join(presets())}")
    return from_dict(_presets()[name], name)


def chosen(name: str | None = None, config: Config = Config()) -> Template:
    """The template that an argument names, else the configuration, else the default."""
    return load(name or config.template or DEFAULT)


def table(spark: SparkSession) -> DataFrame:
    """The presets as rows: name, description, the style's fields, families of the three roles."""
    rows = [(t.name, t.description, t.style.bullet, t.style.emphasis, t.style.strong, "setext" if t.style.setext else "atx", t.style.wrap, *(t.fonts[r]["family"] for r in ("body", "heading", "mono"))) for t in map(load, presets())]
    return spark.createDataFrame(rows, "name string, description string, bullet string, emphasis string, strong string, headings string, wrap int, body string, heading string, mono string")
