"""The rules that there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.config import Config
from pagewright.registry import FAMILIES, all_rules, registered_rules

#: Rules of fonts, which are about what a PDF writer can show and no family of expressions.
FONT_RULES = {
    "font-coverage": "characters that no font at hand can show",
    "font-unavailable": "no family that the template names is there",
    "font-embed-cjk-unavailable": "fonts to embed for CJK text are asked for and not there",
    "font-not-pinned": "a family that is used is not pinned to one version",
    "font-style-missing": "a family that is used has no face of a style",
}


def inventory(spark: SparkSession, config: Config = Config()) -> DataFrame:
    """(rule, family, about, enabled, severity, added): all rules, also those of plugins; severity only where it is replaced."""
    rows = [(r, family, (make.__doc__ or "").strip().split("\n")[0], r in registered_rules(family)) for family in FAMILIES for r, make in all_rules(family).items()]
    rows += [(r, "font", about, False) for r, about in FONT_RULES.items()]
    setting = lambda r: config.rules[r] if isinstance(config.rules.get(r), str) else None
    return spark.createDataFrame([(r, f, about, config.enabled(r), setting(r), added) for r, f, about, added in rows], "rule string, family string, about string, enabled boolean, severity string, added boolean")
