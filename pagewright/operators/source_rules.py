"""Rules over raw lines: each an expression that gives a document's issues.

All four read one array of lines and one of code flags, so a document table is read
once, without a shuffle, whatever the number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import WS, is_blank

ISSUE = "struct<rule:string,message:string,severity:string,line:int,auto_fixable:boolean>"


def issue(rule: str, message: Column | str, severity: str, line: Column | None = None, fixable: bool = False) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        F.lit(severity).alias("severity"),
        (F.lit(None) if line is None else line).cast("int").alias("line"),
        F.lit(fixable).alias("auto_fixable"),
    )


def _at_lines(lines: Column, wanted, rule: str, message: str) -> Column:
    found = F.filter(F.transform(lines, lambda x, i: F.when(wanted(x, i), i + 1)), lambda n: n.isNotNull())
    return F.transform(found, lambda n: issue(rule, message, "info", n, True))


def trailing_whitespace(lines: Column, code: Column) -> Column:
    return _at_lines(lines, lambda x, i: ~F.get(code, i) & x.rlike(rf"[{WS}]$"), "whitespace-trailing", "line has trailing whitespace")


def blank_run(lines: Column, code: Column) -> Column:
    """One issue for each run, at its second blank line; code ends a run."""
    blank = lambda i: F.coalesce(~F.get(code, i) & is_blank(F.get(lines, i)), F.lit(False))
    return _at_lines(lines, lambda x, i: blank(i) & blank(i - 1) & ~blank(i - 2), "whitespace-blank-run", "more than one consecutive blank line")


def tab_indent(lines: Column, code: Column) -> Column:
    return _at_lines(lines, lambda x, i: ~F.get(code, i) & x.startswith("\t"), "whitespace-tab-indent", "line is indented with a tab; spaces are expected")


def mixed_quotes(lines: Column, code: Column) -> Column:
    some = lambda pattern: F.exists(F.transform(lines, lambda x, i: ~F.get(code, i) & x.rlike(pattern)), lambda x: x)
    both = some("[‘’“”]") & some("[\"']")
    return F.when(both, F.array(issue("quotes-mixed", "document mixes straight and curly quotation marks", "info"))).otherwise(F.array().cast(f"array<{ISSUE}>"))


SOURCE_RULES = {"whitespace-trailing": trailing_whitespace, "whitespace-blank-run": blank_run, "whitespace-tab-indent": tab_indent, "quotes-mixed": mixed_quotes}
