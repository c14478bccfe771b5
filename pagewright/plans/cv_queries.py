"""Queries of the CV layer by name, and their SQL, which looks at lines of the source alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import cv_rules
from pagewright.operators.cv_rules import CV_RULES
from pagewright.plans import detect
from pagewright.plans.queries import _ALL, _COLUMNS, _LINES, Query, _row
from pagewright.sources.corpus import markdown_documents
from pagewright.sources.markdown import with_blocks


def _rule(rule: str) -> Query:
    return lambda spark, d: detect.cv_issues(markdown_documents(spark, d), [rule])


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv_rules.with_cv(with_blocks(markdown_documents(spark, sf_dir)))


def cv_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = _ready(spark, sf_dir).select("doc_id", F.posexplode("cv.sections").alias("p", "s"))
    return sections.select("doc_id", (F.col("p") + 1).alias("section_no"), "s.title", "s.kind", "s.level")


def cv_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ready(spark, sf_dir).select("doc_id", F.explode("cv.bullets").alias("bullet"))


def cv_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated entries of the sections that have a kind."""
    sections = _ready(spark, sf_dir).select("doc_id", F.explode(F.filter("cv.sections", lambda s: s["kind"].isNotNull())).alias("s"))
    return sections.select("doc_id", F.col("s.kind").alias("kind"), F.explode("s.entries").alias("e")).select("doc_id", "kind", "e.text", "e.start", "e.end", "e.ongoing")


def cv_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ready(spark, sf_dir).select("doc_id", cv_rules.looks_like_cv(F.col("cv")).alias("is_cv"))


def detect_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All CV issues of the documents that look like a CV."""
    return detect.cv_issues(markdown_documents(spark, sf_dir), cv=None)


QUERIES: dict[str, Query] = {
    "cv_sections": cv_sections,
    "cv_bullets": cv_bullets,
    "cv_entries": cv_entries,
    "cv_detect": cv_detect,
    "detect_cv": detect_cv,
} | {f"rule_{rule.replace('-', '_')}": _rule(rule) for rule in CV_RULES}

_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{'|'.join(a)}') THEN '{k}'" for k, a in cv_rules.SECTION_ALIASES.items()) + " END"
_YEARS = cv_rules.DATE_RANGE
_PERSON = cv_rules.FIRST_PERSON.replace("'", "''")
_OPENER = "CASE " + " ".join(f"WHEN starts_with(lower(bullet), '{p}') THEN '{p}'" for p in cv_rules.WEAK_OPENERS) + " END"

#: Sections, entries and bullets as lines show them; entries are those of sub-headings.
_CV = f"""{_LINES},
levels AS (SELECT doc_id, list_sort(list(DISTINCT level)) AS ls FROM heads GROUP BY doc_id),
level AS (SELECT doc_id, CASE WHEN len(ls) > 1 AND ls[1] = 1 THEN ls[2] ELSE ls[1] END AS level FROM levels),
secs AS (SELECT doc_id, n, title, level, {_KIND} AS kind, row_number() OVER w AS section_no, coalesce(lead(n) OVER w, 1000000000) AS stop
  FROM heads JOIN level USING (doc_id, level) WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
kinds AS (SELECT md.doc_id, coalesce(list(DISTINCT kind) FILTER (kind IS NOT NULL), []) AS ks, min(section_no) FILTER (kind = 'summary') AS s, min(section_no) FILTER (kind = 'experience') AS x, min(n) AS first
  FROM md LEFT JOIN secs USING (doc_id) GROUP BY md.doc_id),
cvs AS (SELECT doc_id, len(ks) >= 2 AND list_has_any(ks, ['experience', 'education']) AS is_cv FROM kinds),
bullets AS (SELECT doc_id, n, trim(regexp_extract(l, '^ *. (.*)$', 1)) AS bullet FROM items, range(CASE WHEN starts_with(l, ' ') THEN 2 ELSE 1 END)),
ranged AS (SELECT s.doc_id, s.section_no, s.title AS section, s.kind, h.n, h.title, regexp_extract(h.title, '(?i){_YEARS}', 1)::INT AS a, regexp_extract(h.title, '(?i){_YEARS}', 2) AS b
  FROM secs s JOIN heads h ON h.doc_id = s.doc_id AND h.n > s.n AND h.n < s.stop WHERE s.kind IS NOT NULL AND regexp_matches(h.title, '(?i){_YEARS}')),
entries AS (SELECT *, try_cast(b AS INT) AS e, try_cast(b AS INT) IS NULL AS ongoing FROM ranged),
header AS (SELECT k.doc_id, coalesce(string_agg(l, ' ' ORDER BY n) FILTER (NOT code AND (first IS NULL OR n < first)), '') AS h FROM kinds k LEFT JOIN lines USING (doc_id) GROUP BY k.doc_id)"""

_PARTS = {
    "cv-bullet-punctuation": f"""SELECT doc_id, {_row('cv-bullet-punctuation', "p || ' bullet(s) end with a full stop and ' || (c - p) || ' do not; pick one and use it throughout'", 'info')} FROM (
      SELECT doc_id, count(*) AS c, count(*) FILTER (bullet LIKE '%.') AS p FROM bullets GROUP BY doc_id) WHERE c >= 3 AND p BETWEEN 1 AND c - 1""",
    "cv-bullet-too-long": f"""SELECT doc_id, {_row('cv-bullet-too-long', f"count(*) || ' bullet(s) run past {cv_rules.LONG_BULLET} characters (longest is ' || max(length(bullet)) || '); long bullets stop being scannable'", 'info')}
      FROM bullets WHERE length(bullet) > {cv_rules.LONG_BULLET} GROUP BY doc_id""",
    "cv-first-person": f"""SELECT doc_id, {_row('cv-first-person', "count(*) || ' bullet(s) use first-person pronouns (e.g. ''' || min_by(bullet, n)[:60] || '''); a CV conventionally omits them'", 'info')}
      FROM bullets WHERE regexp_matches(bullet, '(?i){_PERSON}') GROUP BY doc_id""",
    "cv-missing-contact": f"""SELECT doc_id, {_row('cv-missing-contact', "'no email address, phone number or link found near the top; a reader has no way to make contact'", 'warning')}
      FROM header WHERE NOT regexp_matches(h, '{cv_rules.EMAIL}') AND NOT regexp_matches(h, '{cv_rules.URL}') AND NOT regexp_matches(h, '{cv_rules.PHONE}')""",
    "cv-missing-section": f"""SELECT doc_id, {_row('cv-missing-section', "'no Experience or Education section found; a CV is normally expected to have at least one'", 'warning')}
      FROM kinds WHERE NOT list_has_any(ks, ['experience', 'education'])""",
    "cv-not-reverse-chronological": f"""SELECT doc_id, {_row('cv-not-reverse-chronological', "'entries under ''' || section || ''' are not in reverse-chronological order; a CV normally lists the most recent first'", 'warning')} FROM (
      SELECT doc_id, section_no, section, k, lag(k) OVER (PARTITION BY doc_id, section_no ORDER BY n) AS p FROM (SELECT *, coalesce(e, 9999) * 10000 + a AS k FROM entries WHERE kind IN ('experience', 'education', 'projects')))
      GROUP BY doc_id, section_no, section HAVING bool_or(k > p)""",
    "cv-summary-placement": f"""SELECT doc_id, {_row('cv-summary-placement', "'the summary appears after the experience section; it is normally the first thing a reader sees'", 'info')} FROM kinds WHERE s > x""",
    "cv-weak-opener": f"""SELECT doc_id, {_row('cv-weak-opener', "count(*) || ' bullet(s) open with a passive phrase (' || array_to_string(list_transform(list_sort(list(DISTINCT o))[:3], lambda x: '''' || x || ''''), ', ') || '); leading with an action verb reads stronger'", 'info')}
      FROM (SELECT *, {_OPENER} AS o FROM bullets) WHERE o IS NOT NULL GROUP BY doc_id""",
}
assert set(_PARTS) == set(CV_RULES)

ORACLES: dict[str, str] = {
    "cv_sections": f"WITH {_CV} SELECT doc_id, section_no::INT AS section_no, title, kind, level::INT AS level FROM secs",
    "cv_bullets": f"WITH {_CV} SELECT doc_id, bullet FROM bullets",
    "cv_entries": f'WITH {_CV} SELECT doc_id, kind, title AS text, a AS start, e AS "end", ongoing FROM entries',
    "cv_detect": f"WITH {_CV} SELECT doc_id, is_cv FROM cvs",
    "detect_all": f"WITH {_CV}, plain AS ({_ALL}), vitae AS (SELECT * FROM ({' UNION ALL '.join(f'SELECT doc_id, {_COLUMNS} FROM ({q})' for q in _PARTS.values())}) JOIN cvs USING (doc_id) WHERE is_cv) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY late, coalesce(line, 0), rule))::INT AS seq, {_COLUMNS} FROM (SELECT doc_id, {_COLUMNS}, 0 AS late FROM plain UNION ALL SELECT doc_id, {_COLUMNS}, 1 FROM vitae)",
    "detect_cv": f"WITH {_CV} SELECT doc_id, {_COLUMNS} FROM ({' UNION ALL '.join(f'SELECT doc_id, {_COLUMNS} FROM ({q})' for q in _PARTS.values())}) JOIN cvs USING (doc_id) WHERE is_cv",
} | {f"rule_{rule.replace('-', '_')}": f"WITH {_CV} {sql}" for rule, sql in _PARTS.items()}
