"""Line deduplication by site-relative frequency (operator 8). DataFrame functions only.

Method: the distinct texts of a host are its pages. A line (without white space at its
ends) counts once for each page that has it; its count divided by the host's page total
is its ratio, and lines of a ratio over the limit are boilerplate of that host and are
dropped from all its pages. Copies of a text are one page: a group of copies must not
make boilerplate of its own lines (``distinct_pages=False`` counts every row instead).
A line on fewer than ``least`` pages is not repeated, whatever the size of its host.

Lines are counted by a 64-bit hash together with the host; counts are pre-aggregated
before the shuffle, so a host with a third of all pages, or a line of every page, is
no hot key. Each host keeps at most (lines a page) / ratio boilerplate lines. If the
table of them is small (its size is counted first) it is broadcast and the texts stay
where they are; otherwise both sides are dealt by host and a salt.

Defined results for odd input: null text stays null and an empty text empty; a null
host is a host of its own; blank lines are neither counted nor dropped; repeated rows
are one page; an empty table gives an empty result; all other columns are kept as they
are, and ``counters`` come under the first free of their names (with underscores before).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm._scratch import dropped, fresh, written

#: Ratio over which a line is boilerplate, and pages that a repeated line has at least.
RATIO, LEAST = 0.1, 3
#: Boilerplate lines (8 bytes each) up to which their table is broadcast, and parts of a host beyond it.
BROADCAST_LINES, SALTS = 250_000, 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """Hash of a line without the white space at its ends."""
    return F.xxhash64(F.trim(F.translate(line, "\t\r\x0b\f", "    ")))


_BLANK = "xxhash64('')"


def boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST, distinct_pages: bool = True) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines."""
    rows = df.select(F.col(host_col).alias("host"), F.col(text_col).alias("text")).filter("text is not null")
    lines = F.array_distinct(F.transform(_lines(F.col("text")), _key))
    # each text of a host once, with how many pages it stands for
    pages = written(rows.select("host", F.xxhash64("text").alias("page"), lines.alias("lines")).groupBy("host", "page").agg(F.first("lines").alias("lines"), (F.lit(1) if distinct_pages else F.count("*")).cast("long").alias("n")), "pages")
    totals = pages.groupBy(F.col("host").alias("of")).agg(F.sum("n").alias("pages"))
    counts = pages.select("host", "n", F.explode("lines").alias("line")).filter(F.col("line") != F.expr(_BLANK)).groupBy("host", "line").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    found = written(counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("lines")), "boilerplate")
    dropped(pages)
    return found


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST, distinct_pages: bool = True, counters: bool = False, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The rows with boilerplate lines dropped from the text; with ``counters`` also n_lines, n_dropped."""
    host, known, salt, part, hit, n_lines, n_dropped = (fresh(x, df.columns) for x in ("__host", "__known", "__salt", "__part", "__hit", "n_lines", "n_dropped"))
    hosts = boilerplate(df, host_col, text_col, ratio, least, distinct_pages).withColumnsRenamed({"host": host, "lines": known})
    size = hosts.agg(F.sum(F.size(known)), F.count("*")).first()
    if (size[0] or 0) + 4 * size[1] <= broadcast_lines:
        joined = df.join(F.broadcast(hosts), df[host_col].eqNullSafe(F.col(host)), "left")
    else:
        salted = df.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in (host_col, text_col)], F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        spread = hosts.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, salted[host_col].eqNullSafe(F.col(host)) & (F.col(salt) == F.col(part)), "left")
    text = F.col(text_col)
    # the few known lines that a text has; most texts have none and stay untouched
    found = F.when(F.col(known).isNull() | text.isNull(), F.array().cast("array<bigint>")).otherwise(F.array_intersect(F.transform(_lines(text), _key), F.col(known)))
    held = joined.withColumn(hit, found)
    cleaned = F.when(F.size(hit) == 0, text).otherwise(F.array_join(F.filter(_lines(text), lambda x: ~F.array_contains(F.col(hit), _key(x))), "\n"))
    names = [F.col(c) if c != text_col else cleaned.alias(text_col) for c in df.columns]
    if not counters:
        return held.select(*names)
    n = F.coalesce(F.size(_lines(text)), F.lit(0))
    left = F.when(F.size(hit) == 0, n).otherwise(F.size(F.filter(_lines(text), lambda x: ~F.array_contains(F.col(hit), _key(x)))))
    return held.select(*names, n.cast("long").alias(n_lines), (n - left).cast("long").alias(n_dropped))
