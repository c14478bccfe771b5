"""Queries of the linting engine by name, and their SQL for DuckDB.

The SQL looks at lines of the source alone, so it shares nothing with the block parser
and the array expressions that it is held against.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.config import from_dict
from pagewright.functions.text import FENCE, LINE_END, WS, split_lines
from pagewright.operators.diff import diffs
from pagewright.operators.formatting import format_documents, with_markdown
from pagewright.operators.source_rules import SOURCE_RULES
from pagewright.operators.structure_rules import DATE_STYLES, STRUCTURE_RULES
from pagewright.plans import detect
from pagewright.plans.inventory import inventory
from pagewright.sources import docx, paths
from pagewright.sources.corpus import MARKDOWN, block, markdown_documents
from pagewright.sources.markdown import with_blocks
from pagewright.templates import table as template_table

Query = Callable[[SparkSession, str], DataFrame]

_COLUMNS = "rule, message, severity, line, auto_fixable"


def _source(rule: str) -> Query:
    return lambda spark, d: detect.source_issues(markdown_documents(spark, d), [rule])


def _structure(rule: str) -> Query:
    return lambda spark, d: detect.structure_issues(markdown_documents(spark, d), [rule])


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown_documents(spark, sf_dir)
    return docs.select("doc_id", F.length("source").cast("long").alias("n_chars"), F.size(split_lines(F.col("source"))).cast("long").alias("n_lines"), F.md5("source").alias("source_md5"))


def _blocks(spark: SparkSession, sf_dir: str, wanted) -> DataFrame:
    return with_blocks(markdown_documents(spark, sf_dir)).select("doc_id", F.explode(F.filter("blocks", wanted)).alias("b"))


def blocks_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level bullet lists of each document with their items."""
    blocks = _blocks(spark, sf_dir, lambda b: (b["kind"] == "list") & ~b["ordered"] & b["parent_id"].isNull())
    return blocks.groupBy("doc_id").agg(F.sum(F.size("b.markers")).cast("long").alias("n_items"), F.count("*").alias("n_lists"))


def blocks_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, lambda b: b["kind"] == "heading").select("doc_id", F.col("b.level").alias("level"), F.col("b.text").alias("text"))


def blocks_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, lambda b: (b["kind"] == "code") & b["language"].isNotNull()).select("doc_id", F.col("b.language").alias("language"), F.col("b.code").alias("code"))


def blocks_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, lambda b: b["kind"] == "image").select("doc_id", F.col("b.src").alias("src"), F.col("b.alt").alias("alt"))


def blocks_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.concat(F.array("b.header"), F.col("b.rows"))
    return _blocks(spark, sf_dir, lambda b: b["kind"] == "table").select("doc_id", F.array_join(F.transform(lines, lambda r: F.array_join(r, "|")), "/").alias("cells"))


def blocks_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, lambda b: (b["kind"] == "para") & (b["parent_kind"] == "quote")).select("doc_id", F.col("b.text").alias("text"))


def blocks_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of lists inside items."""
    return _blocks(spark, sf_dir, lambda b: (b["kind"] == "item") & (b["depth"] == 3)).select("doc_id", F.col("b.text").alias("text"))


def inline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and bold text."""
    runs = _blocks(spark, sf_dir, lambda b: b["kind"] == "para").select("doc_id", F.explode("b.runs").alias("r"))
    return runs.filter("r.link is not null or r.bold").select("doc_id", "r.text", "r.link", "r.bold")


def rule_table_ragged_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over tables that no Markdown gives: a header of two cells, and rows of 0 to 3 by the document's number."""
    row = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string"))
    rows = F.array(row(F.col("doc_id") % 3 + 1), F.array(F.lit("a"), F.lit("b")))
    table = block(kind=F.lit("table"), header=F.array(F.lit("x"), F.lit("y")), rows=rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array(table).alias("blocks"))
    return docs.select("doc_id", F.explode(STRUCTURE_RULES["table-ragged-row"](F.col("blocks"))).alias("x")).select("doc_id", "x.*")


def fix_drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many paragraphs each document loses by repair."""
    docs = markdown_documents(spark, sf_dir)
    paras = lambda repair: with_markdown(docs, repair=repair).select("doc_id", F.size(F.filter("tops", lambda t: t["kind"] == "para")).alias(f"n{int(repair)}"))
    return paras(False).join(paras(True), "doc_id").select("doc_id", (F.col("n0") - F.col("n1")).cast("long").alias("n_dropped"))


def _tops(spark: SparkSession, sf_dir: str, wanted) -> DataFrame:
    return with_markdown(markdown_documents(spark, sf_dir)).select("doc_id", F.explode(F.filter("tops", wanted)).alias("t"))


def fix_merge_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level bullet lists after repair, with their top-level items."""
    items = F.size(F.filter(F.split("t.markdown", "\n"), lambda x: x.startswith("- ")))
    return _tops(spark, sf_dir, lambda t: t["kind"] == "list").groupBy("doc_id").agg(F.count("*").alias("n_lists"), F.sum(items).alias("n_items"))


def _rendered(kind: str) -> Query:
    return lambda spark, d: _tops(spark, d, lambda t: (t["kind"] == kind) & (F.lit(kind != "code") | t["language"].isNotNull())).select("doc_id", F.col("t.markdown").alias("markdown"))


def format_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical Markdown of each document; beyond SQL, tests hold it against expected texts and itself."""
    return format_documents(markdown_documents(spark, sf_dir))


def format_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What formatting would change, as a unified diff; beyond SQL."""
    return diffs(markdown_documents(spark, sf_dir))


def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: issues of every rule, of the CV rules where a document looks like one."""
    return detect.detect(markdown_documents(spark, sf_dir))


def config_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection without CV rules, with one rule disabled and the severity of another replaced."""
    config = from_dict({"rules": {"whitespace-trailing": False, "heading-skip": "error"}, "cv": False})
    return detect.detect(markdown_documents(spark, sf_dir), config=config).drop("seq")


def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.summary(markdown_documents(spark, sf_dir), cv=False)


def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.report(markdown_documents(spark, sf_dir), cv=False)


def format_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that formatting fixes and those that remain."""
    found = detect.issue_arrays(markdown_documents(spark, sf_dir), cv=False)
    fixed = F.size(F.filter("issues", lambda x: x["auto_fixable"])).cast("long")
    return found.select("doc_id", fixed.alias("n_fixed"), (F.size("issues") - fixed).cast("long").alias("n_remaining"))


def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.outcomes(markdown_documents(spark, sf_dir), cv=False).select("doc_id", "n_issues", "summary", "status")


_PATH = "CASE WHEN doc_id % 2 = 0 THEN 'docs/' ELSE 'vendor/lib.v2/' END || source || '/' || CASE WHEN doc_id % 5 = 0 THEN '.hidden/' ELSE '' END || 'page' || doc_id || CASE doc_id % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.MARKDOWN' WHEN 2 THEN '.formatted.md' WHEN 3 THEN '.docx' WHEN 4 THEN '.txt' WHEN 5 THEN '' ELSE '.pdf' END"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path): a tree of file names made of the documents' numbers and sources."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(_PATH).alias("path"))


def scan_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", paths.format_of(F.col("path")).alias("format"), paths.unsupported(F.col("path")).isNotNull().alias("unsupported"))


def scan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.targets(_paths(spark, sf_dir), ["vendor/**", "**/page1?.md"], skip="docs/src3").select("doc_id", "path")


def exclude_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", paths.excluded(F.col("path"), ["**/src1/*", "page2*.md"]).alias("excluded"))


def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _paths(spark, sf_dir).select("doc_id", paths.default_output(path).alias("output"), paths.mirrored(path, "docs", "out/").alias("mirrored"), paths.extracted(path).alias("extracted"))


def read_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the documents, written to Word files and read again."""
    made = docx.write_docx(markdown_documents(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("path"), "content")
    found = docx.read_docx(made).select(F.col("path").cast("long").alias("doc_id"), F.explode(F.filter("blocks", lambda b: b["kind"] == "heading")).alias("b"))
    return found.select("doc_id", F.col("b.level").alias("level"), F.col("b.text").alias("text"))


def docx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of each kind Word files keep; beyond SQL."""
    made = docx.write_docx(markdown_documents(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("path"), "content")
    found = docx.read_docx(made).select(F.col("path").cast("long").alias("doc_id"), F.explode("blocks").alias("b"))
    return found.groupBy("doc_id", F.col("b.kind").alias("kind")).agg(F.count("*").alias("n"))


def rules_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark).drop("about")


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_table(spark).select("name", "bullet", "emphasis", "headings", "wrap")


QUERIES: dict[str, Query] = {
    "scan_documents": scan_documents,
    "scan_by_extension": scan_by_extension,
    "scan_targets": scan_targets,
    "exclude_globs": exclude_globs,
    "output_paths": output_paths,
    "rule_whitespace_trailing": _source("whitespace-trailing"),
    "rule_whitespace_blank_run": _source("whitespace-blank-run"),
    "rule_whitespace_tab_indent": _source("whitespace-tab-indent"),
    "rule_quotes_mixed": _source("quotes-mixed"),
    "blocks_headings": blocks_headings,
    "blocks_lists": blocks_lists,
    "blocks_code": blocks_code,
    "blocks_images": blocks_images,
    "blocks_tables": blocks_tables,
    "blocks_quotes": blocks_quotes,
    "blocks_nested": blocks_nested,
    "inline_runs": inline_runs,
    "rule_heading_multiple_h1": _structure("heading-multiple-h1"),
    "rule_heading_skip": _structure("heading-skip"),
    "rule_heading_empty": _structure("heading-empty"),
    "rule_list_mixed_markers": _structure("list-mixed-markers"),
    "rule_image_missing_alt": _structure("image-missing-alt"),
    "rule_date_inconsistent": _structure("date-inconsistent"),
    "rule_paragraph_empty": _structure("paragraph-empty"),
    "rule_table_ragged_row": rule_table_ragged_row,
    "detect_all": detect_all,
    "config_apply": config_apply,
    "issue_summary": issue_summary,
    "issue_report": issue_report,
    "format_result": format_result,
    "exit_codes": exit_codes,
    "fix_drop_empty": fix_drop_empty,
    "fix_merge_lists": fix_merge_lists,
    "render_headings": _rendered("heading"),
    "render_code": _rendered("code"),
    "render_tables": _rendered("table"),
    "render_quotes": _rendered("quote"),
    "format_markdown": format_markdown,
    "format_diff": format_diff,
    "read_docx": read_docx,
    "docx_blocks": docx_blocks,
    "rules_inventory": rules_inventory,
    "templates": templates,
}

#: Lines of the source with their numbers and whether they are code.
_LINES = f"""
md AS (SELECT doc_id, {MARKDOWN} AS source FROM documents),
split AS (SELECT doc_id, string_split_regex(source, '{LINE_END}') AS parts FROM md),
cut AS (SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:len(parts) - 1] ELSE parts END AS parts FROM split),
numbered AS (SELECT doc_id, unnest(parts) AS l, generate_subscripts(parts, 1) AS n FROM cut),
fenced AS (SELECT *, regexp_matches(l, '{FENCE}') AS fence FROM numbered),
lines AS (SELECT doc_id, n, l, fence OR sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS code FROM fenced),
heads AS (SELECT doc_id, n, length(regexp_extract(l, '^(#+)', 1)) AS level, trim(regexp_extract(l, '^#+(.*)$', 1)) AS title FROM lines WHERE NOT code AND regexp_matches(l, '^#{{1,6}}( |$)')
  UNION ALL SELECT doc_id, n, CASE WHEN starts_with(below, '=') THEN 1 ELSE 2 END, l FROM (SELECT *, lead(l) OVER (PARTITION BY doc_id ORDER BY n) AS below FROM lines) WHERE NOT code AND regexp_matches(l, '^[A-Za-z]') AND regexp_matches(below, '^(=+|-+)$')),
items AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM lines WHERE NOT code AND regexp_matches(l, '^(  )?[-*+] ')),
tops AS (SELECT doc_id, n, l, island FROM items WHERE regexp_matches(l, '^[-*+] ')),
full_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS m FROM lines WHERE NOT regexp_matches(l, '^[{WS}]*$')),
merged AS (SELECT doc_id, m, m - row_number() OVER (PARTITION BY doc_id ORDER BY m) AS island, regexp_matches(l, '^[-*+] ') AS top FROM full_lines WHERE NOT code AND regexp_matches(l, '^(  )?[-*+] '))"""


def _row(rule: str, message: str, severity: str, line: str = "NULL", fixable: bool = False) -> str:
    return f"'{rule}' AS rule, {message} AS message, '{severity}' AS severity, {line}::INT AS line, {str(fixable).lower()} AS auto_fixable"


_PARTS = {
    "whitespace-trailing": f"SELECT doc_id, {_row('whitespace-trailing', "'line has trailing whitespace'", 'info', 'n', True)} FROM lines WHERE NOT code AND regexp_matches(l, '[{WS}]$')",
    "whitespace-blank-run": f"""SELECT doc_id, {_row('whitespace-blank-run', "'more than one consecutive blank line'", 'info', 'n', True)} FROM (
      SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id, g ORDER BY n) AS k FROM (
        SELECT doc_id, n, blank, sum((NOT blank)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM (
          SELECT *, NOT code AND regexp_matches(l, '^[{WS}]*$') AS blank FROM lines)) WHERE blank) WHERE k = 2""",
    "whitespace-tab-indent": f"SELECT doc_id, {_row('whitespace-tab-indent', "'line is indented with a tab; spaces are expected'", 'info', 'n', True)} FROM lines WHERE NOT code AND starts_with(l, chr(9))",
    "quotes-mixed": f"""SELECT doc_id, {_row('quotes-mixed', "'document mixes straight and curly quotation marks'", 'info')} FROM lines WHERE NOT code
      GROUP BY doc_id HAVING bool_or(regexp_matches(l, '[‘’“”]')) AND bool_or(regexp_matches(l, '["'']'))""",
    "heading-multiple-h1": f"""SELECT doc_id, {_row('heading-multiple-h1', "'document has ' || count(*) || ' level-1 headings; exactly one is expected'", 'warning')} FROM heads WHERE level = 1 GROUP BY doc_id HAVING count(*) > 1""",
    "heading-skip": f"""SELECT doc_id, {_row('heading-skip', "'heading level jumps from h' || p || ' to h' || level || ' at ''' || title[:40] || ''''", 'warning')} FROM (
      SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY n) AS p FROM heads) WHERE level > p + 1""",
    "heading-empty": f"SELECT doc_id, {_row('heading-empty', "'heading has no text'", 'error')} FROM heads WHERE title = ''",
    "list-mixed-markers": f"""SELECT doc_id, {_row('list-mixed-markers', "'bullet list mixes markers [' || string_agg(DISTINCT '''' || l[1] || '''', ', ' ORDER BY '''' || l[1] || '''') || ']; the template''s marker will be used throughout'", 'warning', fixable=True)}
      FROM lines WHERE NOT code AND regexp_matches(l, '^[-*+] ') GROUP BY doc_id HAVING count(DISTINCT l[1]) > 1""",
    "image-missing-alt": f"SELECT doc_id, {_row('image-missing-alt', "'image ''' || regexp_extract(l, '^!\\[\\]\\((.*)\\)$', 1) || ''' has no alt text'", 'warning')} FROM lines WHERE NOT code AND regexp_matches(l, '^!\\[\\]\\(.*\\)$')",
    "date-inconsistent": f"""SELECT doc_id, {_row('date-inconsistent', "'document mixes date formats: ' || array_to_string(styles, ', ')", 'warning')} FROM (
      SELECT doc_id, list_filter([{', '.join(f"CASE WHEN bool_or(regexp_matches(l, '{DATE_STYLES[s]}')) THEN '{s}' END" for s in sorted(DATE_STYLES))}], lambda x: x IS NOT NULL) AS styles
      FROM lines WHERE NOT code GROUP BY doc_id) WHERE len(styles) > 1""",
}
_PARTS["paragraph-empty"] = f"SELECT doc_id, {_row('paragraph-empty', "'paragraph contains no text'", 'info', fixable=True)} FROM lines WHERE NOT code AND l = chr(160)"
assert set(_PARTS) <= set(SOURCE_RULES) | set(STRUCTURE_RULES)
_ALL = " UNION ALL ".join(f"SELECT doc_id, {_COLUMNS} FROM ({q})" for q in _PARTS.values())

ORACLES: dict[str, str] = {
    "scan_documents": f"WITH {_LINES} SELECT md.doc_id, length(source) AS n_chars, len(parts) AS n_lines, md5(source) AS source_md5 FROM md JOIN cut USING (doc_id)",
    "blocks_headings": f"WITH {_LINES} SELECT doc_id, level::INT AS level, title AS text FROM heads",
    "blocks_lists": f"WITH {_LINES} SELECT doc_id, count(*) AS n_items, count(DISTINCT g) AS n_lists FROM (SELECT doc_id, sum(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM (SELECT doc_id, n, CASE WHEN lag(island) OVER w = island AND lag(l[1]) OVER w = l[1] THEN 0 ELSE 1 END AS fresh FROM tops WINDOW w AS (PARTITION BY doc_id ORDER BY n))) GROUP BY doc_id",
    "blocks_images": f"WITH {_LINES} SELECT doc_id, regexp_extract(l, '^!\\[(.*)\\]\\((.*)\\)$', 2) AS src, regexp_extract(l, '^!\\[(.*)\\]\\((.*)\\)$', 1) AS alt FROM lines WHERE NOT code AND regexp_matches(l, '^!\\[.*\\]\\(.*\\)$')",
    "blocks_tables": f"WITH {_LINES} SELECT doc_id, string_agg(replace(trim(l, '| '), ' | ', '|'), '/' ORDER BY n) AS cells FROM lines WHERE NOT code AND starts_with(l, '|') AND NOT regexp_matches(l, '^[|:-]+$') GROUP BY doc_id",
    "blocks_quotes": f"WITH {_LINES} SELECT doc_id, string_agg(l[3:], ' ' ORDER BY n) AS text FROM lines WHERE NOT code AND starts_with(l, '> ') GROUP BY doc_id",
    "blocks_nested": f"WITH {_LINES} SELECT doc_id, l[5:] AS text FROM items WHERE starts_with(l, ' ')",
    "inline_runs": f"""WITH {_LINES}, marked AS (SELECT doc_id, l FROM lines WHERE NOT code AND starts_with(l, 'See ['))
      SELECT doc_id, regexp_extract(l, '\\[(.*?)\\]\\((.*?)\\)', 1) AS text, regexp_extract(l, '\\[(.*?)\\]\\((.*?)\\)', 2) AS link, false AS bold FROM marked
      UNION ALL SELECT doc_id, regexp_extract(l, '\\*\\*(.*?)\\*\\*', 1), NULL, true FROM marked""",
    "rule_table_ragged_row": f"SELECT doc_id, {_row('table-ragged-row', "'row 1 has ' || (doc_id % 3 + 1) || ' cells but the header has 2'", 'error')} FROM documents WHERE doc_id % 3 <> 1",
    "fix_drop_empty": f"WITH {_LINES}, gone AS (SELECT doc_id, count(*) AS n FROM lines WHERE NOT code AND l = chr(160) GROUP BY doc_id) SELECT md.doc_id, coalesce(n, 0) AS n_dropped FROM md LEFT JOIN gone USING (doc_id)",
    "fix_merge_lists": f"WITH {_LINES} SELECT doc_id, count(DISTINCT island) AS n_lists, count(*) FILTER (top)::BIGINT AS n_items FROM merged GROUP BY doc_id",
    "render_headings": f"WITH {_LINES} SELECT doc_id, repeat('#', level::INT) || ' ' || title AS markdown FROM heads",
    "render_code": f"WITH {_LINES}, opened AS (SELECT doc_id, n, l, sum(CASE WHEN regexp_matches(l, '{FENCE}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM lines WHERE code) SELECT doc_id, string_agg(l, chr(10) ORDER BY n) || chr(10) || '```' AS markdown FROM opened WHERE k % 2 = 1 GROUP BY doc_id, k",
    "render_tables": f"WITH {_LINES} SELECT DISTINCT doc_id, '| Item  | Count |' || chr(10) || '| ----- | ----: |' || chr(10) || '| nuts  | 12    |' || chr(10) || '| bolts | 7     |' AS markdown FROM lines WHERE NOT code AND l = '| Item | Count |'",
    "render_quotes": f"WITH {_LINES} SELECT doc_id, '> ' || string_agg(l[3:], ' ' ORDER BY n) AS markdown FROM lines WHERE NOT code AND starts_with(l, '> ') GROUP BY doc_id",
    "rules_inventory": """SELECT rule, family, true AS enabled, NULL::VARCHAR AS severity, false AS added FROM (
      SELECT unnest(['heading-multiple-h1', 'heading-skip', 'heading-empty', 'list-mixed-markers', 'image-missing-alt', 'table-ragged-row', 'date-inconsistent', 'paragraph-empty']) AS rule, 'structure' AS family
      UNION ALL SELECT unnest(['whitespace-trailing', 'whitespace-blank-run', 'whitespace-tab-indent', 'quotes-mixed']), 'source'
      UNION ALL SELECT unnest(['cv-missing-section', 'cv-missing-contact', 'cv-not-reverse-chronological', 'cv-bullet-punctuation', 'cv-first-person', 'cv-weak-opener', 'cv-bullet-too-long', 'cv-summary-placement']), 'cv'
      UNION ALL SELECT unnest(['font-coverage', 'font-unavailable', 'font-embed-cjk-unavailable', 'font-not-pinned', 'font-style-missing']), 'font')""",
    "templates": """SELECT name, '-' AS bullet, CASE name WHEN 'friendly' THEN '_' ELSE '*' END AS emphasis, 'atx' AS headings, CASE name WHEN 'technical' THEN 80 ELSE 0 END AS wrap
      FROM (SELECT unnest(['cv-classic', 'cv-compact', 'cv-modern', 'formal', 'friendly', 'minimal', 'reproducible', 'technical']) AS name)""",
    "read_docx": f"WITH {_LINES} SELECT doc_id, level::INT AS level, title AS text FROM heads",
    "scan_by_extension": f"SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'markdown' WHEN 1 THEN 'markdown' WHEN 2 THEN 'markdown' WHEN 3 THEN 'docx' WHEN 6 THEN 'pdf' END AS format, doc_id % 7 IN (4, 5) AS unsupported FROM documents",
    "scan_targets": f"SELECT doc_id, path FROM (SELECT doc_id, source, {_PATH} AS path FROM documents) WHERE doc_id % 7 IN (0, 1, 3, 6) AND doc_id % 5 <> 0 AND doc_id % 2 = 0 AND source <> 'src3' AND NOT (doc_id BETWEEN 10 AND 19 AND doc_id % 7 = 0)",
    "exclude_globs": f"SELECT doc_id, source = 'src1' OR (doc_id::VARCHAR LIKE '2%' AND doc_id % 7 IN (0, 2)) AS excluded FROM documents",
    "output_paths": f"""WITH p AS (SELECT doc_id, source, {_PATH} AS path FROM documents), q AS (SELECT *, CASE WHEN contains(regexp_extract(path, '[^/]*$'), '.') THEN regexp_extract(path, '[.][^./]*$') ELSE '' END AS e FROM p), r AS (SELECT *, path[:length(path) - length(e)] AS stem FROM q)
      SELECT doc_id, stem || '.formatted' || e AS output, 'out/' || CASE WHEN starts_with(path, 'docs/') THEN path[6:] ELSE regexp_extract(path, '[^/]*$') END AS mirrored, stem || '.extracted.md' AS extracted FROM r""",
    "issue_report": f"WITH {_LINES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, coalesce(line, 0), rule))::INT AS place, '[' || severity || '] ' || rule || ' (' || coalesce('line ' || line, 'document') || '): ' || message AS line FROM ({_ALL})",
    "format_result": f"WITH {_LINES}, found AS ({_ALL}) SELECT md.doc_id, count(rule) FILTER (auto_fixable) AS n_fixed, count(rule) FILTER (NOT auto_fixable) AS n_remaining FROM md LEFT JOIN found USING (doc_id) GROUP BY md.doc_id",
    "exit_codes": f"""WITH {_LINES}, found AS ({_ALL}), counted AS (SELECT md.doc_id, count(rule) AS n, count(rule) FILTER (severity = 'error') AS e, count(rule) FILTER (severity = 'warning') AS w, count(rule) FILTER (severity = 'info') AS i FROM md LEFT JOIN found USING (doc_id) GROUP BY md.doc_id)
      SELECT doc_id, n::INT AS n_issues, CASE WHEN n = 0 THEN 'no issues found' ELSE concat_ws(', ', CASE WHEN e > 0 THEN e || ' error' END, CASE WHEN w > 0 THEN w || ' warning' END, CASE WHEN i > 0 THEN i || ' info' END) END AS summary, least(n, 1)::INT AS status FROM counted""",
    "blocks_code": f"WITH {_LINES}, opened AS (SELECT doc_id, n, l, sum(CASE WHEN regexp_matches(l, '{FENCE}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM lines WHERE code) SELECT doc_id, replace(min_by(l, n), chr(96), '') AS language, coalesce(string_agg(CASE WHEN NOT regexp_matches(l, '{FENCE}') THEN l END, chr(10) ORDER BY n), '') AS code FROM opened WHERE k % 2 = 1 GROUP BY doc_id, k",
    "config_apply": f"WITH {_LINES} SELECT doc_id, rule, message, CASE WHEN rule = 'heading-skip' THEN 'error' ELSE severity END AS severity, line, auto_fixable FROM ({_ALL}) WHERE rule <> 'whitespace-trailing'",
    "issue_summary": f"WITH {_LINES} SELECT doc_id, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info, count(*) FILTER (auto_fixable) AS n_fixable, count(*) AS n_issues FROM ({_ALL}) GROUP BY doc_id",
} | {f"rule_{rule.replace('-', '_')}": f"WITH {_LINES} {sql}" for rule, sql in _PARTS.items()}
