"""Word files: written and read again."""

import zipfile
from io import BytesIO

from pagewright.operators.formatting import joined, repaired, written
from pagewright.sources import docx
from pagewright.sources.markdown import flatten, parse

TEXT = """# River **survey**

Words with *marks*, ~~gone~~ and [a link](http://a.example/x?y=1&z=2).

- one
  - two
    - three
- four

1. first
2. second

> said once

```sql
SELECT 1

FROM t
```

```
plain <&>
```

| a | b |
|---|---|
| 1 |   |

---

###

end
"""


def markdown(data):
    tree, _ = docx.parse(data)
    return joined(part for _, part in written(repaired(flatten(tree))))


def test_round_trip():
    rows = repaired(flatten(parse(TEXT)))
    data = docx.write(rows, {"body": {"family": "Lato, sans", "size": 10}}, "River")
    assert data == docx.write(rows, {"body": {"family": "Lato, sans", "size": 10}}, "River")
    assert markdown(data) == joined(part for _, part in written(rows))
    assert docx.parse(data)[1] == "River"
    kinds = [b["kind"] for b in flatten(docx.parse(data)[0])]
    assert kinds == [b["kind"] for b in rows]
    assert zipfile.ZipFile(BytesIO(data)).testzip() is None


def test_what_word_cannot_hold_is_lost():
    deep = docx.write(flatten(parse("- a\n  - b\n    - c\n      - d\n\n![x](y.png)\n\n7. n\n\n`c\u0001`\n")))
    assert markdown(deep) == "- a\n\n  - b\n\n    - c\n    - d\n\n1. n\n\nc\n"


def paragraph(style, text, more=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/>{more}</w:pPr><w:r><w:rPr><w:b w:val="0"/></w:rPr><w:t>{text}</w:t></w:r></w:p>'


def file_of(body):
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {docx._NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_styles_of_other_writers():
    body = paragraph("Title", "T") + paragraph("List Paragraph", "p") + paragraph("List Bullet 2", "q") + paragraph("List Number 2", "r") + paragraph("Intense Quote", "s") + paragraph("Macro Text", "x") + paragraph("HTML Code", "y") + paragraph("Heading 9", "z") + paragraph("Normal", " ") + paragraph("Own", "w")
    tree, title = docx.parse(file_of(body))
    assert [(b["depth"], b["kind"], b.get("text")) for b in flatten(tree) if b["kind"] != "list"] == [(0, "heading", "T"), (1, "item", "p"), (3, "item", "q"), (3, "item", "r"), (0, "quote", None), (1, "para", "s"), (0, "code", None), (0, "heading", "z"), (0, "para", "w")]
    assert [b["code"] for b in tree if b["kind"] == "code"] == ["x\ny"] and tree[-2]["level"] == 6 and title == ""


def test_files(spark):
    good = docx.write(flatten(parse("# A\n")))
    files = spark.createDataFrame([("a.docx", good), ("b.docx", b"junk"), ("c.docx", None), ("d.docx", file_of("")[:-30])], "path string, content binary")
    rows = {r["path"]: r for r in docx.read_docx(files).collect()}
    assert [b["text"] for b in rows["a.docx"]["blocks"]] == ["A"] and rows["a.docx"]["error"] is None
    assert all(rows[p]["error"] and rows[p]["blocks"] == [] for p in ("b.docx", "c.docx", "d.docx"))
    assert docx.read_docx(files.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, source string")
    made = {r["doc_id"]: bytes(r["content"]) for r in docx.write_docx(docs).collect()}
    assert "River" in markdown(made[1]) and markdown(made[2]) == ""
