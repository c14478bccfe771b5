"""Sections, dated entries and bullets of a curriculum vitae, and the rules over them.

All are expressions over a document's block rows: :func:`with_cv` adds one column
``cv`` to a table with ``blocks``, and each rule reads it. Map only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.config import Config
from pagewright.functions.text import quoted, strip
from pagewright.operators.source_rules import ISSUE, issue

#: What sections are called; a title is of the first kind that has an alias in it.
SECTION_ALIASES = {
    "experience": ["experience", "employment", "work history", "career", "positions"],
    "education": ["education", "academic", "qualifications", "degrees"],
    "skills": ["skills", "technical skills", "competencies", "technologies", "expertise"],
    "projects": ["projects", "portfolio", "selected work"],
    "summary": ["summary", "profile", "objective", "about", "personal statement"],
    "publications": ["publications", "papers", "research"],
    "awards": ["awards", "honours", "honors", "achievements"],
    "contact": ["contact", "details", "personal details"],
    "languages": ["languages"],
    "references": ["references", "referees"],
}
WEAK_OPENERS = ["responsible for", "duties included", "tasked with", "worked on", "helped with", "involved in", "assisted with", "in charge of"]
ONGOING = r"\b(present|current|now|ongoing|to date)\b"
YEAR = r"\b((?:19|20)\d{2})\b"
_MONTH = r"(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december)[a-z]*\.?\s+)?"
DATE_RANGE = rf"{_MONTH}((?:19|20)\d{{2}})\s*(?:[-–—]|to|until)\s*{_MONTH}((?:19|20)\d{{2}}|present|current|now|ongoing)"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
PHONE = r"(?:\+\d{1,3}[\s.-]?)?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}"
URL = r"(?i)https?://|www\.|\b(?:linkedin|github|gitlab)\b"
FIRST_PERSON = r"\b(I|I'm|I've|my|me|myself)\b"
LONG_BULLET = 220
_ANY_CASE = "(?iU)"


def classify(title: Column) -> Column:
    """The kind of section that a title names, or null."""
    name = F.regexp_replace(F.lower(strip(title)), "^:+|:+$", "")
    out = None
    for kind, aliases in SECTION_ALIASES.items():
        some = name.rlike("|".join(aliases))
        out = F.when(some, kind) if out is None else out.when(some, kind)
    return out


def date_range(text: Column) -> Column:
    """struct(start, end, ongoing) of a line: a range of years, else its least and greatest year."""
    part = lambda i: F.regexp_extract(text, _ANY_CASE + DATE_RANGE, i).try_cast("int")
    ranged, last = text.rlike(_ANY_CASE + DATE_RANGE), part(2)
    years = F.transform(F.regexp_extract_all(text, F.lit("(?U)" + YEAR), F.lit(1)), lambda y: y.try_cast("int"))
    return F.struct(
        F.when(ranged, part(1)).otherwise(F.array_min(years)).alias("start"),
        F.when(ranged, last).otherwise(F.array_max(years)).alias("end"),
        F.when(ranged, last.isNull()).otherwise(text.rlike(_ANY_CASE + ONGOING)).alias("ongoing"),
    )


def _section_level(top: Column) -> Column:
    """The second level if the first is 1, else the first; 0 without headings."""
    levels = F.array_sort(F.array_distinct(F.transform(F.filter(top, lambda b: b["kind"] == "heading"), lambda b: b["level"])))
    return F.when(F.size(levels) == 0, 0).when((F.size(levels) > 1) & (F.get(levels, F.lit(0)) == 1), F.get(levels, F.lit(1))).otherwise(F.get(levels, F.lit(0)))


def _entries(top: Column, at: Column, stop: Column) -> Column:
    """Dated entries of a section: of its headings with the paragraph near them, else of its paragraphs."""
    # blocks stay in ``top``: a copy of the section would be made anew for each of its blocks
    para = lambda i: F.when((i < stop) & (F.get(top, i)["kind"] == "para"), F.get(top, i)["text"])
    near = lambda i: F.coalesce(F.concat(F.lit(" "), F.coalesce(para(i + 1), para(i + 2))), F.lit(""))
    places = F.when(stop - at > 1, F.sequence(at + 1, stop - 1)).otherwise(F.array().cast("array<int>"))
    of_kind = lambda kind: F.filter(places, lambda i: F.get(top, i)["kind"] == kind)
    heads = F.transform(of_kind("heading"), lambda i: F.concat(F.get(top, i)["text"], near(i)))
    paras = F.transform(of_kind("para"), lambda i: F.get(top, i)["text"])
    dated = F.transform(F.when(F.size(heads) > 0, heads).otherwise(paras), lambda t: F.struct(strip(t).alias("text"), date_range(t).alias("d")))
    return F.transform(F.filter(dated, lambda e: e["d"]["start"].isNotNull() | e["d"]["ongoing"]), lambda e: F.struct(e["text"].alias("text"), e["d"]["start"].alias("start"), e["d"]["end"].alias("end"), e["d"]["ongoing"].alias("ongoing")))


def _bullets(blocks: Column) -> Column:
    """Texts of list items, list by list; those of a list inside an item count twice."""
    items = F.filter(blocks, lambda b: b["kind"] == "item")
    twice = lambda b: F.get(blocks, b["parent_id"])["parent_kind"].eqNullSafe("item")
    told = F.array_sort(F.transform(items, lambda b: F.struct(b["parent_id"].alias("list"), b["seq"].alias("seq"), strip(F.coalesce(b["text"], F.lit(""))).alias("text"), F.when(twice(b), 2).otherwise(1).alias("n"))))
    return F.flatten(F.transform(F.filter(told, lambda x: x["text"] != ""), lambda x: F.array_repeat(x["text"], x["n"])))


def with_cv(df: DataFrame) -> DataFrame:
    """The table with ``cv``: struct(header, links, sections, bullets) of its blocks.

    The blocks at the top, their section level and the starts of sections are put into
    one struct first, by one Generate over an array of one, so that the expressions after
    it read what is computed once a row.
    """
    at_top = F.filter("blocks", lambda b: b["parent_id"].isNull())
    pick = lambda top, level: F.filter(F.transform(top, lambda b, i: F.when((b["kind"] == "heading") & (b["level"] == level), i)), lambda i: i.isNotNull())
    leveled = F.transform(F.array(at_top), lambda top: F.struct(top.alias("top"), _section_level(top).alias("level")))
    made = F.transform(leveled, lambda x: F.struct(x["top"].alias("top"), x["level"].alias("level"), pick(x["top"], x["level"]).alias("starts")))
    df = df.withColumn("__cv", F.explode(made))
    top, level, starts = F.col("__cv.top"), F.col("__cv.level"), F.col("__cv.starts")
    stop = lambda k: F.coalesce(F.get(starts, k + 1), F.size(top))
    title = lambda s: strip(F.get(top, s)["text"])
    sections = F.transform(starts, lambda s, k: F.struct(title(s).alias("title"), classify(title(s)).alias("kind"), level.alias("level"), _entries(top, s, stop(k)).alias("entries")))
    first = F.get(top, F.get(starts, F.lit(0)))["block_id"]
    runs = F.flatten(F.transform(F.filter("blocks", lambda b: b["runs"].isNotNull() & (first.isNull() | (b["block_id"] < first))), lambda b: b["runs"]))
    cv = F.struct(
        F.array_join(F.transform(runs, lambda r: r["text"]), " ").alias("header"),
        F.size(F.filter(runs, lambda r: F.coalesce(r["link"], F.lit("")) != "")).alias("links"),
        sections.alias("sections"),
        _bullets(F.col("blocks")).alias("bullets"),
    )
    return df.withColumn("cv", F.explode(F.array(cv))).drop("__cv")


def _kinds(cv: Column) -> Column:
    return F.filter(F.transform(cv["sections"], lambda s: s["kind"]), lambda k: k.isNotNull())


def _main(cv: Column) -> Column:
    return F.arrays_overlap(_kinds(cv), F.array(F.lit("experience"), F.lit("education")))


def looks_like_cv(cv: Column) -> Column:
    """Two kinds of section or more, of which one is experience or education."""
    return (F.size(F.array_distinct(_kinds(cv))) >= 2) & _main(cv)


def _if(condition: Column, found: Column) -> Column:
    return F.when(condition, F.array(found)).otherwise(F.array().cast(f"array<{ISSUE}>"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def missing_section(cv: Column, config: Config = Config()) -> Column:
    return _if(~_main(cv), issue("cv-missing-section", "no Experience or Education section found; a CV is normally expected to have at least one", "warning"))


def missing_contact(cv: Column, config: Config = Config()) -> Column:
    some = cv["header"].rlike("(?U)" + EMAIL) | cv["header"].rlike("(?U)" + URL) | cv["header"].rlike("(?U)" + PHONE) | (cv["links"] > 0)
    return _if(~some, issue("cv-missing-contact", "no email address, phone number or link found near the top; a reader has no way to make contact", "warning"))


def not_reverse_chronological(cv: Column, config: Config = Config()) -> Column:
    key = lambda e: F.struct(F.when(e["ongoing"], 9999).otherwise(F.coalesce(e["end"], e["start"], F.lit(0))), F.coalesce(e["start"], F.lit(0)))
    later = lambda entries: F.exists(F.transform(entries, lambda e, i: F.coalesce(key(e) > F.when(i > 0, key(F.get(entries, i - 1))), F.lit(False))), lambda x: x)
    wrong = F.filter(cv["sections"], lambda s: s["kind"].isin("experience", "education", "projects") & later(s["entries"]))
    return F.transform(wrong, lambda s: issue("cv-not-reverse-chronological", _text("entries under ", quoted(s["title"]), " are not in reverse-chronological order; a CV normally lists the most recent first"), "warning"))


def bullet_punctuation(cv: Column, config: Config = Config()) -> Column:
    stops = F.size(F.filter(cv["bullets"], lambda t: t.endswith(".")))
    others = F.size(cv["bullets"]) - stops
    return _if((stops + others >= 3) & (stops > 0) & (others > 0), issue("cv-bullet-punctuation", _text(stops, " bullet(s) end with a full stop and ", others, " do not; pick one and use it throughout"), "info"))


def first_person(cv: Column, config: Config = Config()) -> Column:
    found = F.filter(cv["bullets"], lambda t: t.rlike(_ANY_CASE + FIRST_PERSON))
    return _if(F.size(found) > 0, issue("cv-first-person", _text(F.size(found), " bullet(s) use first-person pronouns (e.g. ", quoted(F.left(F.get(found, F.lit(0)), F.lit(60))), "); a CV conventionally omits them"), "info"))


def weak_opener(cv: Column, config: Config = Config()) -> Column:
    phrase = lambda t: F.coalesce(*[F.when(F.lower(t).startswith(p), F.lit(p)) for p in WEAK_OPENERS])
    found = F.filter(F.transform(cv["bullets"], phrase), lambda p: p.isNotNull())
    shown = F.array_join(F.transform(F.slice(F.array_sort(F.array_distinct(found)), 1, 3), quoted), ", ")
    return _if(F.size(found) > 0, issue("cv-weak-opener", _text(F.size(found), " bullet(s) open with a passive phrase (", shown, "); leading with an action verb reads stronger"), "info"))


def bullet_too_long(cv: Column, config: Config = Config()) -> Column:
    limit = config.int_option("cv-bullet-too-long", "max_length", LONG_BULLET)
    long = F.filter(F.transform(cv["bullets"], lambda t: F.length(t)), lambda n: n > limit)
    return _if(F.size(long) > 0, issue("cv-bullet-too-long", _text(F.size(long), f" bullet(s) run past {limit} characters (longest is ", F.array_max(long), "); long bullets stop being scannable"), "info"))


def summary_placement(cv: Column, config: Config = Config()) -> Column:
    place = lambda kind: F.array_position(_kinds(cv), kind)
    return _if((place("experience") > 0) & (place("summary") > place("experience")), issue("cv-summary-placement", "the summary appears after the experience section; it is normally the first thing a reader sees", "info"))


#: In the order of their names, which is the order of their issues.
CV_RULES = {
    "cv-bullet-punctuation": bullet_punctuation,
    "cv-bullet-too-long": bullet_too_long,
    "cv-first-person": first_person,
    "cv-missing-contact": missing_contact,
    "cv-missing-section": missing_section,
    "cv-not-reverse-chronological": not_reverse_chronological,
    "cv-summary-placement": summary_placement,
    "cv-weak-opener": weak_opener,
}
