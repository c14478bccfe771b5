"""Rules over a document's blocks: expressions that give arrays of issues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import is_blank, let, quoted
from pagewright.operators.source_rules import ISSUE, issue

#: The date styles that are told apart.
DATE_STYLES = {
    "iso": r"\b\d{4}-\d{2}-\d{2}\b",
    "slashed": r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    "month-first": r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},\s*\d{4}\b",
    "day-first": r"\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}\b",
}


def _none() -> Column:
    return F.array().cast(f"array<{ISSUE}>")


def _of_kind(blocks: Column, kind: str) -> Column:
    return F.filter(blocks, lambda b: b["kind"] == kind)


def multiple_h1(blocks: Column) -> Column:
    n = F.size(F.filter(blocks, lambda b: (b["kind"] == "heading") & (b["level"] == 1)))
    return F.when(n > 1, F.array(issue("heading-multiple-h1", F.concat(F.lit("document has "), n.cast("string"), F.lit(" level-1 headings; exactly one is expected")), "warning"))).otherwise(_none())


def heading_skip(blocks: Column) -> Column:
    def found(heads: Column) -> Column:
        # before the first heading the level counts as its own, so it never jumps
        before = lambda h, i: F.coalesce(F.get(heads, i - 1)["level"], h["level"])
        text = lambda h, i: F.concat(F.lit("heading level jumps from h"), before(h, i).cast("string"), F.lit(" to h"), h["level"].cast("string"), F.lit(" at "), quoted(F.left(h["text"], F.lit(40))))
        return F.filter(F.transform(heads, lambda h, i: F.when(h["level"] > before(h, i) + 1, issue("heading-skip", text(h, i), "warning"))), lambda x: x.isNotNull())

    return let(_of_kind(blocks, "heading"), found)


def heading_empty(blocks: Column) -> Column:
    return F.transform(F.filter(blocks, lambda b: (b["kind"] == "heading") & is_blank(b["text"])), lambda b: issue("heading-empty", "heading has no text", "error"))


def mixed_markers(blocks: Column) -> Column:
    """Bullet lists with several markers: a list that already has them, or a run of adjacent lists that differ.

    One pass over the siblings in order carries the open run. A list with several markers
    of its own is reported by itself and ends the run before it, of which nothing is said.
    """
    place = lambda b: F.struct(F.coalesce(b["parent_id"], F.lit(-1)).alias("parent"), b["seq"].alias("seq"), b["block_id"].alias("id"), F.array_distinct(F.filter(F.coalesce(b["markers"], F.array().cast("array<string>")), lambda m: m != "")).alias("markers"))
    lists = F.array_sort(F.transform(F.filter(blocks, lambda b: (b["kind"] == "list") & ~b["ordered"]), place))
    found_type, run_type = "array<struct<id:int,markers:array<string>>>", "struct<parent:int,seq:int,id:int,markers:array<string>>"
    none = F.lit(None).cast(run_type)
    report = lambda x: F.array(F.struct(x["id"].alias("id"), F.array_sort(x["markers"]).alias("markers")))
    closed = lambda acc: F.when(F.size(acc["run"]["markers"]) > 1, F.concat(acc["found"], report(acc["run"]))).otherwise(acc["found"])

    def step(acc: Column, x: Column) -> Column:
        goes_on = F.coalesce((acc["run"]["parent"] == x["parent"]) & (acc["run"]["seq"] + 1 == x["seq"]), F.lit(False))
        longer = F.struct(x["parent"].alias("parent"), x["seq"].alias("seq"), acc["run"]["id"].alias("id"), F.array_union(acc["run"]["markers"], x["markers"]).alias("markers"))
        several = F.size(x["markers"]) > 1
        dropped = F.when(goes_on, acc["found"]).otherwise(closed(acc))
        return F.struct(
            F.when(several, F.concat(dropped, report(x))).when(goes_on, acc["found"]).otherwise(closed(acc)).alias("found"),
            F.when(several, none).when(goes_on, longer).otherwise(x.cast(run_type)).alias("run"),
        )

    start = F.struct(F.array().cast(found_type).alias("found"), none.alias("run"))
    found = F.array_sort(F.aggregate(lists, start, step, closed))
    text = lambda m: F.concat(F.lit("bullet list mixes markers ["), F.array_join(F.transform(m, quoted), ", "), F.lit("]; the template's marker will be used throughout"))
    return F.transform(found, lambda x: issue("list-mixed-markers", text(x["markers"]), "warning", fixable=True))


def missing_alt(blocks: Column) -> Column:
    found = F.filter(blocks, lambda b: (b["kind"] == "image") & is_blank(F.coalesce(b["alt"], F.lit(""))))
    return F.transform(found, lambda b: issue("image-missing-alt", F.concat(F.lit("image "), quoted(b["src"]), F.lit(" has no alt text")), "warning"))


def ragged_rows(blocks: Column) -> Column:
    tables = F.filter(blocks, lambda b: (b["kind"] == "table") & (F.size(b["header"]) > 0))

    def of(b: Column) -> Column:
        width = F.size(b["header"])
        rows = F.transform(b["rows"], lambda r, i: F.when(F.size(r) != width, issue("table-ragged-row", F.concat(F.lit("row "), (i + 1).cast("string"), F.lit(" has "), F.size(r).cast("string"), F.lit(" cells but the header has "), width.cast("string")), "error")))
        return F.filter(rows, lambda x: x.isNotNull())

    return F.flatten(F.transform(tables, of))


def mixed_dates(blocks: Column) -> Column:
    runs = F.flatten(F.transform(F.filter(blocks, lambda b: b["runs"].isNotNull()), lambda b: b["runs"]))
    text = F.array_join(F.transform(F.filter(runs, lambda r: ~r["code"]), lambda r: r["text"]), " ")
    styles = F.array_sort(F.filter(F.array(*[F.when(text.rlike(f"(?U){p}"), F.lit(name)) for name, p in DATE_STYLES.items()]), lambda x: x.isNotNull()))
    message = F.concat(F.lit("document mixes date formats: "), F.array_join(styles, ", "))
    return F.when(F.size(styles) > 1, F.array(issue("date-inconsistent", message, "warning"))).otherwise(_none())


def empty_paragraph(blocks: Column) -> Column:
    return F.transform(F.filter(blocks, lambda b: (b["kind"] == "para") & is_blank(b["text"])), lambda b: issue("paragraph-empty", "paragraph contains no text", "info", fixable=True))


STRUCTURE_RULES = {
    "heading-multiple-h1": multiple_h1,
    "heading-skip": heading_skip,
    "heading-empty": heading_empty,
    "list-mixed-markers": mixed_markers,
    "image-missing-alt": missing_alt,
    "table-ragged-row": ragged_rows,
    "date-inconsistent": mixed_dates,
    "paragraph-empty": empty_paragraph,
}
