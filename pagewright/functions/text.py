"""Column helpers for text: line splitting, white space and quoted values in messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a regular expression class; the same characters count at line ends, in blank lines and in empty text.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: A line that opens or closes a fenced block.
FENCE = rf"^[{WS}]*(```|~~~)"


def split_lines(text: Column) -> Column:
    """The lines of a text; a final line end opens no further line, and an empty text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def is_blank(text: Column) -> Column:
    return text.rlike(rf"^[{WS}]*$")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+$", "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: what a lambda takes from outside is computed for each of its elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def code_flags(lines: Column) -> Column:
    """For each line whether it is a fence or stands after an odd number of fences.

    Fences toggle, whatever their kind and length, so code reaches from every odd fence to
    the next one. The flags are laid end to end from one pair of fences to the next: the
    work grows with the lines, and there is no shuffle.
    """

    def flags(marks: Column, n: Column) -> Column:
        until = lambda j: F.coalesce(F.get(marks, 2 * j + 1), n - 1)
        before = lambda j: F.when(j > 0, until(j - 1)).otherwise(-1)
        pairs = F.ceil(F.size(marks) / 2).cast("int")
        stretch = lambda j: F.concat(F.array_repeat(F.lit(False), F.get(marks, 2 * j) - before(j) - 1), F.array_repeat(F.lit(True), until(j) - F.get(marks, 2 * j) + 1))
        rest = F.array_repeat(F.lit(False), n - 1 - until(pairs - 1))
        made = F.concat(F.flatten(F.transform(F.sequence(F.lit(0), pairs - 1), stretch)), rest)
        return F.when(F.size(marks) == 0, F.array_repeat(F.lit(False), n)).otherwise(made)

    marks = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(FENCE), i)), lambda i: i.isNotNull())
    return let(F.struct(marks.alias("marks"), F.size(lines).alias("n")), lambda x: flags(x["marks"], x["n"]))


def quoted(text: Column) -> Column:
    """A text in quotes with escapes: single quotes, but double ones if only single ones occur in it."""
    escaped = text
    for plain, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(shown))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
