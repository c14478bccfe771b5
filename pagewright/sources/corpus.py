"""Document tables: one row for each document, with its Markdown source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources.markdown import BLOCK

_N = "chr(10)"


def _when(condition: str, *parts: str) -> str:
    return f"CASE WHEN {condition} THEN {' || '.join(parts)} ELSE '' END"


def _text(*lines: str) -> list[str]:
    """SQL of lines, each with a line end."""
    return [p for line in lines for p in ([f"'{line}'", _N] if line else [_N])]


CV_GOOD = ["# Mira Solano", "", "mira.solano@mail.example", "", "## Profile", "", "Builds water models.", "", "## Employment", "", "### Lead hydrologist, 2020 to present", "", "- Ran a river survey", "- Wrote the flood plan", "", "### Hydrologist, 2013 to 2020", "", "- Mapped the delta", "", "## Degrees", "", "### Diploma, 2009 to 2013", "", "## Technologies", "", "Python", "", "## Notes", ""]
CV_BAD = ["# Tobias Renn", "", "## Work history", "", "### Clerk, 2011 to 2014", "", "- Tasked with sorting parcels.", "- My route was the longest", "", "### Manager, 2015 to 2021", "", "- Opened two depots", "", "## Objective", "", "A steady post.", "", "## Competencies", "", "Routing", "", "## Notes", ""]

#: Markdown put before a document's own text, as an expression that Spark SQL and DuckDB read alike:
#: fragments that call for each rule and show each kind of block, by the document's number.
MARKDOWN = f"""CASE WHEN doc_id % 13 = 0 THEN {' || '.join(_text(*CV_GOOD))}
 WHEN doc_id % 13 = 1 THEN {' || '.join(_text(*CV_BAD))}
 ELSE {' || '.join(_text('# Field notes', ''))}
 || {_when('doc_id % 16 = 0', *_text('## Checklist', '', '- outer', '  - inner one', '  - inner two', '- last', ''))}
 || {_when('doc_id % 3 = 0', *_text('#### Fine print', ''))}
 || {_when('doc_id % 19 = 0', *_text('## Long list', ''), "'- '", "repeat('very long ', 30)", _N, _N)}
 || {_when('doc_id % 4 = 0', *_text('# Another title', ''))}
 || {_when('doc_id % 14 = 0', *_text('Second part', '-----------', ''))}
 || {_when('doc_id % 5 = 0', *_text('* maple', '+ birch', '- alder', ''))}
 || {_when('doc_id % 7 = 0', *_text('![](chart.png)', ''))}
 || {_when('doc_id % 7 = 1', *_text('![A chart](plot.svg)', ''))}
 || {_when('doc_id % 15 = 0', *_text('> as they said', '> in the hall', ''))}
 || {_when('doc_id % 17 = 0', *_text('| Item | Count |', '|------|------:|', '| nuts | 12 |', '| bolts | 7 |', ''))}
 || {_when('doc_id % 18 = 0', *_text('See [the guide](https://guide.example/start) for **all** parts.', ''))}
 || {_when('doc_id % 6 = 0', *_text('Filed 2023-11-05, due 12/06/2024.', ''))}
 || {_when('doc_id % 8 = 0', *_text('They wrote “soon” and "later".', ''))}
 || {_when('doc_id % 9 = 0', *_text('loose end   ', '', '', ''))}
 || {_when('doc_id % 20 = 0', "'a line of another system'", 'chr(13)', _N, 'chr(13)', _N)}
 || {_when('doc_id % 21 = 0', "'odd'", 'chr(160)', _N, _N)}
 || {_when('doc_id % 10 = 0', "'```sql'", _N, "'SELECT 1   '", _N, _N, _N, 'chr(9)', "'FROM t'", _N, "'```'", _N, _N)}
 || {_when('doc_id % 11 = 0', 'chr(9)', "'set off'", _N, _N)}
 || {_when('doc_id % 12 = 0', *_text('## ', ''))}
 || {_when('doc_id % 22 = 0', 'chr(160)', _N, _N)} END || coalesce(text, '')"""


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source): the documents table, every whole text after its fragments of Markdown."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(MARKDOWN).alias("source"))


def block(**fields: Column) -> Column:
    """A block row with the given fields, the others null: for frames that no file gives."""
    names = [part.split(":")[0] for part in _parts(BLOCK[len("struct<") : -1])]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(BLOCK)


def _parts(text: str) -> list[str]:
    """The fields of a type's text."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
