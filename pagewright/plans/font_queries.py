"""Queries of the font layer, and their SQL. The machine's fonts are a small table of values that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import templates
from pagewright.operators import fonts
from pagewright.plans.queries import Query

#: Faces as a scan gives them: place, from the cache, path, family, subfamily, outlines, embedding, licence text and address, ranges.
FACES = [
    (1, True, "/cache/plain.ttf", "Plain Sans", "Regular", "truetype", 0, "SIL Open Font License", "", [(32, 126)]),
    (2, False, "/usr/plain-b.ttf", "Plain Sans", "Bold", "truetype", 0, "", "", [(32, 126)]),
    (3, False, "/usr/plain.ttf", "plain sans ", "Regular", "truetype", 0, "", "", [(32, 255)]),
    (4, True, "/cache/book.ttf", "Book Serif", "Bold Oblique", "truetype", None, "", "https://openfontlicense.org", [(32, 126), (160, 255)]),
    (5, False, "/usr/shut.ttf", "Shut", "Regular", "truetype", 2, "", "", [(32, 126)]),
    (6, False, "/usr/curve.otf", "Curve", "Regular", "postscript", 0, "", "", [(32, 126)]),
    (7, False, "/usr/dejavu.ttf", "DejaVu Sans", "Book", "truetype", 0, "Bitstream Vera Fonts Copyright", "", [(32, 126), (160, 591), (8192, 8303)]),
    (8, False, "/usr/own.ttf", "Own Code", "Italic", "truetype", 8, "GNU General Public License", "", [(48, 57)]),
]
_KIND = f"scan_ord int, from_cache boolean, path string, {fonts._INFO_SQL}, error string"


def faces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*f, None) for f in FACES], _KIND)


def _chain(spark: SparkSession) -> DataFrame:
    return fonts.chain(fonts.families(faces(spark)), ["Book Serif", "Nowhere"], ["Plain Sans"])


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def font_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.font_spans(_documents(spark, sf_dir), _chain(spark))


def rule_font_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule over every text, as if Plain Sans alone were there."""
    alone = _chain(spark).filter("font = 'Plain Sans'")
    texts = _documents(spark, sf_dir).select("doc_id", F.lit("body").alias("role"), F.lit("regular").alias("style"), "text")
    return fonts.coverage_issues(fonts.coverage(texts, {"body": alone})).filter("rule = 'font-coverage'")


def font_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five rules; beyond SQL. Headings are bold, code has its own chain."""
    docs = _documents(spark, sf_dir)
    of = lambda role, style: F.struct(F.lit(role).alias("role"), F.lit(style).alias("style"))
    texts = docs.select("doc_id", "text", F.explode(F.array(of("body", "regular"), of("heading", "bold"))).alias("r")).select("doc_id", "r.*", "text")
    pool, template = fonts.families(faces(spark)), templates.load("reproducible")
    wanted = {r: [n.strip() for n in template.fonts[r]["family"].split(",")] for r in ("body", "heading")}
    chains = {r: fonts.chain(pool, names, ["Plain Sans"]) for r, names in wanted.items()}
    lost = sorted({n for names in wanted.values() if fonts.unresolved(pool, names).count() == len(names) for n in names})
    return fonts.coverage_issues(fonts.coverage(texts, chains), lost, embed_cjk_missing=fonts.embeddable_cjk(pool).isEmpty())


def font_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark).select("ord", "font", "pinned")


def font_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.families(faces(spark)).select("name", "category", "licence", "open", F.array_join("styles", ",").alias("styles"), "pinned", "auto")


def font_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.skipped(faces(spark))


def font_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.covering(fonts.families(faces(spark)), "été 12").select("name", "size")


def font_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The face of every family for every style."""
    wanted = F.explode(F.array(*map(F.lit, fonts.STYLES))).alias("wanted")
    return fonts.families(faces(spark)).select("name", "styles", wanted).select("name", "wanted", fonts.face_name(F.col("name"), F.col("styles"), F.col("wanted")).alias("f")).select("name", "wanted", "f.*")


def fs_type_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("doc_id") % 17 > 0, (F.col("doc_id") % 1024).cast("int"))
    return _documents(spark, sf_dir).select("doc_id", fonts.describe_fs_type(code).alias("said"), fonts.embeddable(code).alias("embeddable"))


_TEXT = "CASE doc_id % 8 WHEN 0 THEN 'Under the SIL Open Font License' WHEN 1 THEN 'Bitstream Vera' WHEN 2 THEN 'GPL with FONT EMBEDDING EXCEPTION' WHEN 3 THEN 'GNU General Public License' WHEN 4 THEN 'Ubuntu Font Licence' WHEN 5 THEN 'CC0 1.0' WHEN 6 THEN '' END"
_URL = "CASE WHEN doc_id % 5 = 0 THEN 'http://www.Apache.org/licenses/LICENSE-2.0' END"
_NAME = "CASE doc_id % 6 WHEN 0 THEN 'Merriweather' WHEN 1 THEN 'Fira Code' WHEN 2 THEN 'Some Mono' WHEN 3 THEN 'Any Serif' WHEN 4 THEN 'Serif of Sans' ELSE 'Courier New' END"
_SUB = "CASE doc_id % 5 WHEN 0 THEN 'Semi Bold Italic' WHEN 1 THEN 'BOLD' WHEN 2 THEN 'Oblique' WHEN 3 THEN 'Book' END"


def font_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", fonts.licence(F.expr(_TEXT), F.expr(_URL)).alias("l"), fonts.category(F.expr(_NAME)).alias("category"), fonts.style(F.expr(_SUB)).alias("style"))
    return rows.select("doc_id", F.col("l.id").alias("licence"), "l.open", "category", "style")


def codepoint_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("doc_id") * 97 % 0x10000).cast("int")
    return _documents(spark, sf_dir).select("doc_id", fonts.script(code).alias("script"))


def font_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned files against their sums: every third is as it should be, every third changed, every third missing."""
    docs = _documents(spark, sf_dir)
    manifest = docs.select(F.format_string("f%d.ttf", "doc_id").alias("file"), F.upper(F.sha2(F.col("doc_id").cast("string"), 256)).alias("sha256"))
    files = docs.filter("doc_id % 3 < 2").select(F.format_string("/cache/f%d.ttf", "doc_id").alias("path"), F.encode(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).otherwise("x"), "UTF-8").alias("content"))
    return fonts.verified(files, manifest)


QUERIES: dict[str, Query] = {f.__name__: f for f in (font_spans, rule_font_coverage, font_issues, font_chain, font_families, font_skipped, font_covering, font_faces, fs_type_describe, font_licence, codepoint_script, font_verify)}

#: The chain: Book Serif, Plain Sans, DejaVu Sans, then collections for CJK.
_FONT_OF = "CASE WHEN c BETWEEN 32 AND 126 OR c BETWEEN 160 AND 255 THEN 'Book Serif' WHEN c BETWEEN 160 AND 591 OR c BETWEEN 8192 AND 8303 THEN 'DejaVu Sans' WHEN c BETWEEN 11904 AND 12031 OR c BETWEEN 12288 AND 12591 OR c BETWEEN 13312 AND 19903 OR c BETWEEN 19968 AND 40959 OR c BETWEEN 63744 AND 64255 OR c BETWEEN 65280 AND 65519 THEN 'HeiseiKakuGo-W5' WHEN c BETWEEN 4352 AND 4607 OR c BETWEEN 12592 AND 12687 OR c BETWEEN 44032 AND 55215 THEN 'HYSMyeongJo-Medium' END"
_SPACE = "(c BETWEEN 9 AND 13 OR c BETWEEN 28 AND 32 OR c IN (133, 160, 5760, 8232, 8233, 8239, 8287, 12288) OR c BETWEEN 8192 AND 8202)"

ORACLES: dict[str, str] = {
    "font_spans": f"""WITH chars AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS pos FROM documents WHERE text <> ''),
      told AS (SELECT *, {_FONT_OF} AS f, {_SPACE} AS sp FROM (SELECT *, unicode(ch) AS c FROM chars)),
      run AS (SELECT *, coalesce(last_value(CASE WHEN NOT sp THEN f END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Book Serif') AS font FROM told),
      cut AS (SELECT *, CASE WHEN font <> lag(font) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM run),
      spans AS (SELECT *, 1 + sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM cut)
      SELECT doc_id, span::INT AS span, any_value(font) AS font, string_agg(ch, '' ORDER BY pos) AS text, coalesce(array_to_string(list_sort(list(DISTINCT ch) FILTER (f IS NULL AND NOT sp)), ''), '') AS missing FROM spans GROUP BY doc_id, span""",
    "rule_font_coverage": f"""WITH chars AS (SELECT DISTINCT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''), gone AS (SELECT doc_id, ch FROM (SELECT *, unicode(ch) AS c FROM chars) WHERE NOT (c BETWEEN 32 AND 126) AND NOT {_SPACE}),
      per AS (SELECT doc_id, list_sort(list(ch)) AS cs FROM gone GROUP BY doc_id)
      SELECT doc_id, 'font-coverage' AS rule, len(cs) || ' character(s) cannot be rendered by any available font and will be missing from the PDF: ' || array_to_string(cs[:20], '') AS message, 'error' AS severity, NULL::INT AS line, false AS auto_fixable FROM per""",
    "font_chain": "SELECT * FROM (VALUES (1, 'Book Serif', true), (2, 'Plain Sans', false), (3, 'DejaVu Sans', false), (4, 'HeiseiKakuGo-W5', true), (5, 'HYSMyeongJo-Medium', true)) t(ord, font, pinned)",
    "font_families": "SELECT * FROM (VALUES ('Plain Sans', 'sans', 'OFL-1.1', true, 'regular,bold', false, true), ('Book Serif', 'serif', 'OFL-1.1', true, 'bolditalic', true, true), ('DejaVu Sans', 'sans', 'Bitstream-Vera', true, 'regular', false, true), ('Own Code', 'mono', 'GPL', false, 'italic', false, false)) t(name, category, licence, open, styles, pinned, auto)",
    "font_skipped": "SELECT * FROM (VALUES ('/usr/shut.ttf', 'embedding not permitted (fsType 2)'), ('/usr/curve.otf', 'postscript outlines cannot be rendered')) t(path, reason)",
    "font_covering": "SELECT * FROM (VALUES ('DejaVu Sans', 639), ('Book Serif', 191)) t(name, size)",
    "font_faces": """SELECT f.name, w.wanted, replace(f.name, ' ', '') || CASE WHEN got = 'regular' THEN '' ELSE '-' || got END AS face, got = w.wanted AS exact FROM (VALUES ('Plain Sans', ['regular', 'bold']), ('Book Serif', ['bolditalic']), ('DejaVu Sans', ['regular']), ('Own Code', ['italic'])) f(name, styles),
      (VALUES ('regular', ['regular', 'bold', 'italic', 'bolditalic']), ('bold', ['bold', 'bolditalic', 'regular']), ('italic', ['italic', 'bolditalic', 'regular']), ('bolditalic', ['bolditalic', 'bold', 'italic', 'regular'])) w(wanted, subs), LATERAL (SELECT coalesce(list_filter(subs, lambda s: list_contains(styles, s))[1], 'regular') AS got)""",
    "fs_type_describe": """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 17 > 0 THEN (doc_id % 1024)::INT END AS f FROM documents) SELECT doc_id, CASE WHEN f IS NULL THEN 'unspecified (no OS/2 table)' WHEN f & 2 <> 0 THEN 'restricted - embedding not permitted'
      ELSE CASE WHEN f & 8 <> 0 THEN 'editable embedding' WHEN f & 4 <> 0 THEN 'preview & print' ELSE 'installable (unrestricted)' END || CASE WHEN f & 256 <> 0 THEN ', no subsetting' ELSE '' END || CASE WHEN f & 512 <> 0 THEN ', bitmap only' ELSE '' END END AS said, f IS NULL OR f & 2 = 0 AS embeddable FROM t""",
    "font_licence": f"""WITH t AS (SELECT doc_id, coalesce({_TEXT}, '') AS t, coalesce({_URL}, '') AS u FROM documents), l AS (SELECT doc_id, CASE WHEN t LIKE '%SIL%' THEN 'OFL-1.1' WHEN t LIKE 'Bitstream%' THEN 'Bitstream-Vera' WHEN t LIKE 'GPL with%' THEN 'GPL-font-exception' WHEN u <> '' THEN 'Apache-2.0' WHEN t LIKE 'Ubuntu%' THEN 'UFL-1.0' WHEN t LIKE 'CC0%' THEN 'Public-Domain' WHEN t LIKE 'GNU%' THEN 'GPL' ELSE 'unknown' END AS licence FROM t)
      SELECT doc_id, licence, licence NOT IN ('GPL', 'unknown') AS open, CASE doc_id % 6 WHEN 0 THEN 'serif' WHEN 1 THEN 'mono' WHEN 2 THEN 'mono' WHEN 3 THEN 'serif' WHEN 4 THEN 'sans' ELSE 'mono' END AS category, CASE doc_id % 5 WHEN 0 THEN 'bolditalic' WHEN 1 THEN 'bold' WHEN 2 THEN 'italic' ELSE 'regular' END AS style FROM l""",
    "codepoint_script": "WITH t AS (SELECT doc_id, doc_id * 97 % 65536 AS c FROM documents) SELECT doc_id, CASE WHEN c BETWEEN 11904 AND 12031 OR c BETWEEN 13312 AND 19903 OR c BETWEEN 19968 AND 40959 OR c BETWEEN 63744 AND 64255 THEN 'han' WHEN c BETWEEN 12288 AND 12591 OR c BETWEEN 65280 AND 65519 THEN 'kana' WHEN c BETWEEN 4352 AND 4607 OR c BETWEEN 12592 AND 12687 OR c BETWEEN 44032 AND 55215 THEN 'hangul' END AS script FROM t",
    "font_verify": "SELECT 'f' || doc_id || '.ttf' AS file, ['ok', 'changed', 'missing'][doc_id % 3 + 1] AS state FROM documents",
}
