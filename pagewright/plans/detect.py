"""Detection: documents in, one row for each issue out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.config import Config
from pagewright.functions.text import code_flags, split_lines
from pagewright.operators.cv_rules import CV_RULES, looks_like_cv, with_cv
from pagewright.operators.source_rules import ISSUE, SOURCE_RULES
from pagewright.operators.structure_rules import STRUCTURE_RULES
from pagewright.registry import all_rules
from pagewright.sources.markdown import with_blocks

SEVERITIES = ["error", "warning", "info"]


def _none() -> Column:
    return F.array().cast(f"array<{ISSUE}>")


def source_issues(docs: DataFrame, rules: Iterable[str] = tuple(SOURCE_RULES), id_col: str = "doc_id") -> DataFrame:
    """Issues of the chosen rules over raw lines. Map only."""
    ready = docs.select(id_col, split_lines(F.col("source")).alias("lines")).withColumn("code", code_flags(F.col("lines")))
    found = F.concat(*[SOURCE_RULES[r](F.col("lines"), F.col("code")) for r in rules])
    return ready.select(id_col, F.explode(found).alias("x")).select(id_col, "x.*")


def structure_issues(docs: DataFrame, rules: Iterable[str] = tuple(STRUCTURE_RULES), id_col: str = "doc_id") -> DataFrame:
    """Issues of the chosen rules over blocks. One Arrow pass parses; the rules are expressions over its result."""
    ready = with_blocks(docs, id_col)
    found = F.concat(*[STRUCTURE_RULES[r](F.col("blocks")) for r in rules])
    return ready.select(id_col, F.explode(found).alias("x")).select(id_col, "x.*")


def cv_issues(docs: DataFrame, rules: Iterable[str] = tuple(CV_RULES), cv: bool | None = True, config: Config = Config(), id_col: str = "doc_id") -> DataFrame:
    """Issues of the chosen CV rules: of all documents, or if ``cv`` is None of those that look like a CV. Map only after the parse."""
    ready = with_cv(with_blocks(docs, id_col))
    if cv is None:
        ready = ready.filter(looks_like_cv(F.col("cv")))
    found = F.concat(*[CV_RULES[r](F.col("cv"), config) for r in rules])
    return ready.select(id_col, F.explode(found).alias("x")).select(id_col, "x.*")


def issue_arrays(docs: DataFrame, cv: bool | None = None, config: Config = Config(), id_col: str = "doc_id") -> DataFrame:
    """The id, ``issues`` of the document in their order, and ``error``: why it could not be read. Map only.

    The order is by line (none is 0), rule, and order of finding; then the issues of the CV
    rules by rule, for all documents (``cv`` True), for those that look like a CV (None) or
    for none. Rules that the configuration disables are left out of the plan, and documents
    that have ``blocks`` and ``error`` already, of whatever format, are not parsed. Line rules
    run before the parse, so that sources do not come back from Python.
    """
    lined = docs.withColumn("lines", split_lines(F.col("source"))).withColumn("code", code_flags(F.col("lines")))
    by_line = F.concat(_none(), *[f(F.col("lines"), F.col("code")) for r, f in all_rules("source").items() if config.enabled(r)])
    said = lined.withColumn("said", F.when(F.col("source").isNotNull(), by_line).otherwise(_none()))
    both = said.select(id_col, "said", "blocks", "error") if {"blocks", "error"} <= set(docs.columns) else with_blocks(said, id_col, keep=("said",), keep_error=True)
    parts = [f(F.col("blocks")) for r, f in all_rules("structure").items() if config.enabled(r)] + [F.col("said")]
    place = lambda x, i: F.struct(F.coalesce(x["line"], F.lit(0)).alias("at"), x["rule"].alias("by"), i.alias("found"), x.alias("x"))
    issues = F.transform(F.array_sort(F.transform(F.concat(_none(), *parts), place)), lambda y: y["x"])
    cv = config.cv if cv is None else cv
    rules = {r: f for r, f in all_rules("cv").items() if config.enabled(r)}
    if cv is not False and rules:
        both = with_cv(both)
        found = F.concat(_none(), *[rules[r](F.col("cv"), config) for r in sorted(rules)])
        issues = F.concat(issues, found if cv else F.when(looks_like_cv(F.col("cv")), found).otherwise(_none()))
    named = {r: v for r, v in config.rules.items() if isinstance(v, str)}
    if named:
        severity = F.create_map(*[F.lit(v) for kv in sorted(named.items()) for v in kv])
        issues = F.transform(issues, lambda x: x.withField("severity", F.coalesce(F.try_element_at(severity, x["rule"]), x["severity"])))
    return both.select(id_col, issues.alias("issues"), "error")


def detect(docs: DataFrame, cv: bool | None = None, config: Config = Config(), id_col: str = "doc_id") -> DataFrame:
    """All issues, one a row, with seq, their place in the document's list."""
    found = issue_arrays(docs, cv, config, id_col)
    return found.select(id_col, F.posexplode("issues").alias("p", "x")).select(id_col, (F.col("p") + 1).cast("int").alias("seq"), "x.*")


def _of(severity: str):
    return lambda x: x["severity"] == severity


def summary(docs: DataFrame, cv: bool | None = None, config: Config = Config(), id_col: str = "doc_id") -> DataFrame:
    """Issues of each document that has any, by severity, and how many are fixed by formatting. Counted in the row: no shuffle."""
    n = lambda wanted: F.size(F.filter("issues", wanted)).cast("long")
    counts = [n(_of(s)).alias(f"n_{s}") for s in SEVERITIES]
    found = issue_arrays(docs, cv, config, id_col).filter(F.size("issues") > 0)
    return found.select(id_col, *counts, n(lambda x: x["auto_fixable"]).alias("n_fixable"), F.size("issues").cast("long").alias("n_issues"))


def report_lines(issues: Column) -> Column:
    """The texts of issues, the worst first: by severity, line and rule."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, SEVERITIES)), x["severity"])
    place = lambda x: F.when(rank(x) == 0, len(SEVERITIES) + 1).otherwise(rank(x))
    where = lambda x: F.when(x["line"].isNull(), "document").otherwise(F.concat(F.lit("line "), x["line"].cast("string")))
    said = lambda x: F.concat(F.lit("["), x["severity"], F.lit("] "), x["rule"], F.lit(" ("), where(x), F.lit("): "), x["message"])
    ordered = F.array_sort(F.transform(issues, lambda x, i: F.struct(place(x).alias("r"), F.coalesce(x["line"], F.lit(0)).alias("l"), x["rule"].alias("by"), i.alias("i"), said(x).alias("line"))))
    return F.transform(ordered, lambda y: y["line"])


def report(docs: DataFrame, cv: bool | None = None, config: Config = Config(), id_col: str = "doc_id") -> DataFrame:
    """The id, ``place``, and ``line``, the text of each issue, the worst first."""
    found = issue_arrays(docs, cv, config, id_col).select(id_col, F.posexplode(report_lines(F.col("issues"))).alias("p", "line"))
    return found.select(id_col, (F.col("p") + 1).cast("int").alias("place"), "line")


def words(issues: Column) -> Column:
    """How many issues of each severity there are, in words."""
    n = {s: F.size(F.filter(issues, _of(s))) for s in SEVERITIES}
    some = [F.when(n[s] > 0, F.concat(n[s].cast("string"), F.lit(f" {s}"))) for s in SEVERITIES]
    said = F.array_join(F.filter(F.array(*some), lambda x: x.isNotNull()), ", ")
    return F.when(said == "", "no issues found").otherwise(said)


def outcomes(docs: DataFrame, cv: bool | None = None, config: Config = Config(), id_col: str = "doc_id") -> DataFrame:
    """The id, number of issues, the summary in words, ``error``, and the exit status that the document alone gives: 0 clean, 1 issues, 2 error."""
    status = F.when(F.col("error").isNotNull(), 2).when(F.size("issues") > 0, 1).otherwise(0)
    return issue_arrays(docs, cv, config, id_col).select(id_col, F.size("issues").alias("n_issues"), words(F.col("issues")).alias("summary"), "error", status.alias("status"))
