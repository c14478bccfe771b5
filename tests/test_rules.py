"""Each rule fires on its case and is silent on the others."""

import time

import pytest
from pyspark.sql import functions as F

from pagewright.config import Config
from pagewright.operators.structure_rules import STRUCTURE_RULES
from pagewright.plans.detect import detect, outcomes, report, summary
from pagewright.sources.corpus import block

FIRES = {
    "heading-skip": ["Intro\n=====\n\n### Details of it\n", "## a\n\n#### b\n\n## c\n"],
    "heading-multiple-h1": ["Alpha\n=====\n\nwords\n\n# Beta\n"],
    "heading-empty": ["##\n\nwords\n", "> ###   ###\n"],
    "list-mixed-markers": ["+ oak\n\n- elm\n", "> * x\n> - y\n", "1. one\n\n   + a\n   - b\n"],
    "image-missing-alt": ["words\n\n![  ](maps/north.jpg)\n", "- ![](a)\n"],
    "date-inconsistent": ["From 1999-12-31 to January 4, 2000.\n", "- 3 May 2001\n- 5/6/01\n"],
    "whitespace-trailing": ["words \t\n", "~~~\na\n~~~\nwords \n"],
    "whitespace-blank-run": ["up\n\n \n\ndown\n", "\n\nwords\n"],
    "whitespace-tab-indent": ["words\n\n\t- deep\n"],
    "quotes-mixed": ["It’s \"so\"\n", "a ‘b’\n\nc 'd'\n"],
    "paragraph-empty": ["words\n\n\u00a0\n\nwords\n"],
}
SILENT = {
    "heading-skip": ["### Start deep\n\n#### Then deeper\n\n# Up\n"],
    "heading-multiple-h1": ["# Only\n\n## Sub\n\n## Sub\n"],
    "list-mixed-markers": ["+ oak\n\nwords\n\n- elm\n", "- a\n  * b\n- c\n", "1. a\n2. b\n", "- a\n\n1) b\n\n* c\n"],
    "image-missing-alt": ["![north](maps/north.jpg)\n", "See ![](inline.png) here\n"],
    "date-inconsistent": ["1999-12-31, 2000-01-01\n", "1999-12-31 `5/6/01`\n", "    5/6/01\n\n1999-12-31\n"],
    "whitespace-trailing": ["words\n", "~~~\nx  \n~~~\n"],
    "whitespace-blank-run": ["up\n\ndown\n", "words\n\n", "~~~\n\n\n~~~\n", "up\n\n~~~\n~~~\n\ndown\n"],
    "whitespace-tab-indent": ["~~~\n\tx\n~~~\n", "a\tb\n"],
    "quotes-mixed": ["‘a’ “b”\n", "'a' \"b\"\n", "“a”\n\n~~~\n'b'\n~~~\n"],
    "paragraph-empty": ["words\n\n\nwords\n"],
}
CLEAN = "Notes\n=====\n\nSome words.\n\n* first\n* second\n\n![a map](map.png)\n"


@pytest.fixture(scope="module")
def found(spark):
    cases = [("clean", CLEAN), ("null", None), ("empty", "")]
    cases += [(f"{kind} {r} {i}", t) for kind, table in (("fires", FIRES), ("silent", SILENT)) for r, texts in table.items() for i, t in enumerate(texts)]
    issues = detect(spark.createDataFrame(cases, "doc_id string, source string"), cv=False).collect()
    out = {name: [] for name, _ in cases}
    for x in sorted(issues, key=lambda x: x["seq"]):
        out[x["doc_id"]].append(x)
    return out


@pytest.mark.parametrize("kind", ["fires", "silent"])
def test_cases(found, kind):
    for name, issues in found.items():
        if name.startswith(kind):
            rule = name.split(" ")[1]
            assert (rule in {x["rule"] for x in issues}) == (kind == "fires"), name


def test_clean_null_and_empty_have_no_issues(found):
    assert found["clean"] == found["null"] == found["empty"] == []


def test_lines_and_messages(found):
    only = lambda name, rule: [x for x in found[name] if x["rule"] == rule]
    assert [x["line"] for x in only("fires whitespace-blank-run 0", "whitespace-blank-run")] == [3]
    assert [x["line"] for x in only("fires whitespace-trailing 1", "whitespace-trailing")] == [4]
    message = lambda rule, i=0: only(f"fires {rule} {i}", rule)[0]["message"]
    assert message("heading-skip") == "heading level jumps from h1 to h3 at 'Details of it'"
    assert message("list-mixed-markers") == "bullet list mixes markers ['+', '-']; the template's marker will be used throughout"
    assert message("image-missing-alt") == "image 'maps/north.jpg' has no alt text"
    assert message("date-inconsistent") == "document mixes date formats: iso, month-first"
    assert message("heading-multiple-h1") == "document has 2 level-1 headings; exactly one is expected"


def test_configuration(spark):
    docs = spark.createDataFrame([(1, "# Oak\n\n#### Elm  \n"), (2, None), (3, "fine\n")], "doc_id long, source string")
    config = Config(rules={"whitespace-trailing": False, "heading-skip": "error", "quotes-mixed": True})
    rows = detect(docs, config=config).collect()
    assert [(x["doc_id"], x["rule"], x["severity"]) for x in rows] == [(1, "heading-skip", "error")]
    (row,) = summary(docs).collect()
    assert (row["n_error"], row["n_warning"], row["n_info"], row["n_fixable"], row["n_issues"]) == (0, 1, 1, 1, 2)
    assert [r["line"] for r in report(docs).orderBy("place").collect()] == ["[warning] heading-skip (document): heading level jumps from h1 to h4 at 'Elm'", "[info] whitespace-trailing (line 3): line has trailing whitespace"]
    assert {r["doc_id"]: (r["summary"], r["status"]) for r in outcomes(docs).collect()} == {1: ("1 warning, 1 info", 1), 2: ("no issues found", 0), 3: ("no issues found", 0)}
    off = Config(rules={r: False for r in ("heading-skip", "whitespace-trailing")})
    assert detect(docs, config=off).count() == 0 and detect(docs.limit(0)).count() == 0


def test_rows_that_no_markdown_gives(spark):
    text = lambda *x: F.array(*map(F.lit, x))
    table = lambda *rows: block(kind=F.lit("table"), header=text("a", "b"), rows=F.array(*rows))
    lists = lambda seq, *markers: block(kind=F.lit("list"), ordered=F.lit(False), seq=F.lit(seq), block_id=F.lit(seq), markers=text(*markers))
    frame = spark.range(1).select(
        F.array(table(text("1"), text("1", "2"), text("1", "2", "3"))).alias("ragged"),
        # a list with markers of its own ends the run before it, of which nothing is said
        F.array(lists(0, "*"), lists(1, "+"), lists(2, "-", "*"), lists(3, "+"), lists(4, "-"), lists(6, "*")).alias("merged"),
        F.array(block(kind=F.lit("para"), text=F.lit(" \u00a0")), block(kind=F.lit("para"), text=F.lit("x"))).alias("paras"),
    )
    said = lambda rule, c: [x["message"] for x in frame.select(STRUCTURE_RULES[rule](F.col(c))).first()[0]]
    assert said("table-ragged-row", "ragged") == ["row 1 has 1 cells but the header has 2", "row 3 has 3 cells but the header has 2"]
    assert [m.split("[")[1].split("]")[0] for m in said("list-mixed-markers", "merged")] == ["'*', '-'", "'+', '-'"]
    assert len(said("paragraph-empty", "paras")) == 1


def test_long_documents_take_seconds(spark):
    texts = ["~~~\nx\n~~~\n" * 5000, "* a\n\n+ b\n\n" * 2500, "[" * 100_000, ">" * 5000 + " deep", "![a " * 3000 + "](u)" * 3000, "a <!--" * 20_000, "*a _b " * 20_000, "words \n\n\n" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, source string").repartition(len(texts))
    began = time.time()
    found = {r["doc_id"]: (r["n"], r["error"]) for r in outcomes(docs).selectExpr("doc_id", "n_issues n", "error").collect()}
    assert time.time() - began < 60
    assert all(error is None for _, error in found.values()) and found[1][0] == 1 and found[7][0] == 40_000


def test_a_document_that_cannot_be_read_stops_no_other(spark, monkeypatch):
    from pagewright.sources import markdown

    read, error = markdown.safely(lambda t: 1 / 0, "x")
    assert read is None and error == "ZeroDivisionError: division by zero"
    assert markdown.safely(len, "abc") == (3, None)
