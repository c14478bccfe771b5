"""Word documents: block rows from files, and files from block rows, with the standard library alone.

A paragraph's style says what it is; nothing else in the file does. Reading makes one
entry of each paragraph or table and then joins neighbours of one class: lines of code,
items of lists. Writing is the reverse. What has no style of its own in Word is lost:
images, the start of numbered lists, alignments, inline code.

Defined results for odd input: null or empty files, and those that are no Word documents
or hold a body of more than LARGEST bytes, have no blocks and an ``error``; paragraphs
without text are left out, but for headings, lines of code and horizontal rules.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import groupby
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.sources.markdown import _BLOCK, BLOCK, flatten, safely

#: Most bytes of a body's text that are read.
LARGEST = 512 << 20
_W, _R = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_OFF = ("0", "false", "off", "none")
#: Classes of styles by their names, in order: a pattern, and the class.
STYLES = [
    (re.compile(r"^(?:html code|macro text|code)(?: ([\w+#.-]+))?$", re.I), "code"),
    (re.compile(r"^heading (\d)$", re.I), "heading"),
    (re.compile(r"^title$", re.I), "heading"),
    (re.compile(r"^list number", re.I), "number"),
    (re.compile(r"^list (?:bullet|paragraph$)", re.I), "bullet"),
    (re.compile(r"quote", re.I), "quote"),
]
#: Deepest list that has a style.
DEEPEST = 3


def _on(properties, name: str) -> bool:
    """Whether a mark is set."""
    mark = None if properties is None else properties.find(_W + name)
    return mark is not None and (mark.get(_W + "val") or "true") not in _OFF


_SIGNS = {_W + "t": lambda e: e.text or "", _W + "tab": lambda e: "\t", _W + "br": lambda e: "\n", _W + "cr": lambda e: "\n", _W + "noBreakHyphen": lambda e: "-"}


def _runs(paragraph, targets: dict[str, str]) -> list[dict]:
    """The runs of a paragraph and of the links in it; neighbours of equal marks are one."""
    out: list[dict] = []
    parts = [(e, None) for e in paragraph]
    parts = [x for e, _ in parts for x in ([(r, targets.get(e.get(_R + "id"))) for r in e.iter(_W + "r")] if e.tag == _W + "hyperlink" else [(e, None)] if e.tag == _W + "r" else [])]
    for run, link in parts:
        text = "".join(_SIGNS[e.tag](e) for e in run if e.tag in _SIGNS)
        marks = run.find(_W + "rPr")
        own = {"text": text, "bold": _on(marks, "b"), "italic": _on(marks, "i"), "code": False, "strike": _on(marks, "strike"), "link": link, "raw": False}
        if out and all(own[m] == out[-1][m] for m in ("bold", "italic", "strike", "link")):
            out[-1]["text"] += text
        elif text:
            out.append(own)
    return out


def _entry(paragraph, names: dict[str, str], targets: dict[str, str]) -> tuple | None:
    """(class, detail, runs) of a paragraph; none for spacing."""
    properties = paragraph.find(_W + "pPr")
    style = None if properties is None else properties.find(_W + "pStyle")
    name = "Normal" if style is None else names.get(style.get(_W + "val"), style.get(_W + "val") or "Normal")
    runs = _runs(paragraph, targets)
    kind, match = next(((k, m) for pattern, k in STYLES if (m := pattern.search(name))), ("para", None))
    if kind == "code":
        return "code", match[1], runs
    level = match[1] if match and match.lastindex else None
    if not "".join(r["text"] for r in runs).strip():
        border = None if properties is None else properties.find(f"{_W}pBdr/{_W}bottom")
        if border is not None:
            return "hr", None, []
        return ("heading", min(6, max(1, int(level))), []) if kind == "heading" and level else None
    if kind == "heading":
        return "heading", min(6, max(1, int(level or 1))), runs
    if kind in ("number", "bullet"):
        depth = re.search(r"\s(\d)$", name)
        return "list", (int(depth[1]) if depth else 1, kind == "number"), runs
    return kind, None, runs


def _nested(entries: list[tuple]) -> list[dict]:
    """Lists from items with levels. An item closes deeper lists and one of its level of the other kind."""
    top: list[dict] = []
    lists: dict[int, dict] = {}  # the open one of each level
    for _, (level, ordered), runs in entries:
        lists = {n: x for n, x in lists.items() if n < level or (n == level and x["ordered"] is ordered)}
        if level not in lists:
            holder = lists[max(lists)]["children"][-1]["children"] if lists else top
            lists[level] = {"kind": "list", "ordered": ordered, "start": 1, "markers": [], "children": []}
            holder.append(lists[level])
        lists[level]["children"].append({"kind": "item", "runs": runs, "children": []})
    return top


def _table(element) -> list[dict]:
    text = lambda cell: "\n".join("".join(t.text or "" for t in p.iter(_W + "t")) for p in cell.iter(_W + "p")).strip()
    rows = [[text(c) for c in row.findall(_W + "tc")] for row in element.findall(_W + "tr")]
    rows = [r for r in rows if any(r)]
    if not rows:
        return []
    wide = max(map(len, rows))
    plain = lambda t: [{"text": t, "bold": False, "italic": False, "code": False, "strike": False, "link": None, "raw": False}] if t else []
    cells = [[plain(t) for t in [*r, *[""] * (wide - len(r))]] for r in rows]
    return [{"kind": "table", "header": cells[0], "rows": cells[1:], "alignments": [None] * wide}]


def parse(data: bytes) -> tuple[list[dict], str]:
    """The block tree of a file, and its title."""
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        held = set(file.namelist())

        def part(name: str):
            if name not in held:
                return ElementTree.Element("none")
            if file.getinfo(name).file_size > LARGEST:
                raise ValueError(f"{name} is larger than {LARGEST} bytes")
            return ElementTree.fromstring(file.read(name))

        body = part("word/document.xml").find(_W + "body")
        names = {s.get(_W + "styleId"): s.find(_W + "name").get(_W + "val") for s in part("word/styles.xml").iter(_W + "style") if s.find(_W + "name") is not None}
        targets = {r.get("Id"): r.get("Target") for r in part("word/_rels/document.xml.rels")}
        title = next((e.text or "" for e in part("docProps/core.xml").iter() if e.tag.endswith("}title")), "")
    if body is None:
        raise ValueError("the file has no document")
    entries = [("table", None, e) if e.tag == _W + "tbl" else _entry(e, names, targets) for e in body if e.tag in (_W + "p", _W + "tbl")]
    out: list[dict] = []
    blank = False
    joined = ("code", "list")
    at = 0
    # spacing ends code, and nothing else
    marked = []
    for e in entries:
        if e is None:
            blank = True
            continue
        marked.append((at := at + (blank and e[0] == "code"), e))
        blank = False
    for (_, kind, detail, _), group in groupby(enumerate(marked), key=lambda x: (x[1][0], x[1][1][0], x[1][1][1] if x[1][1][0] == "code" else None, None if x[1][1][0] in joined else x[0])):
        own = [e for _, (_, e) in group]
        if kind == "code":
            out.append({"kind": "code", "code": "\n".join("".join(r["text"] for r in runs) for _, _, runs in own), "language": detail})
        elif kind == "list":
            out += _nested(own)
        elif kind == "table":
            out += _table(own[0][2])
        elif kind == "quote":
            out.append({"kind": "quote", "children": [{"kind": "para", "runs": own[0][2]}]})
        elif kind == "hr":
            out.append({"kind": "hr"})
        else:
            out.append({"kind": kind, "level": own[0][1], "runs": own[0][2]})
    return out, title.strip()


def read_docx(files: DataFrame) -> DataFrame:
    """(path, blocks, title, error) of files (path, content). One file is one row, as in a folder of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [safely(parse, d.as_py() or b"") for d in batch.column(1)]
            trees = [m or ([], None) for m, _ in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flatten(t) for t, _ in trees], pa.list_(_BLOCK)), pa.array([t for _, t in trees], pa.string()), pa.array([e for _, e in made], pa.string())], names=["path", "blocks", "title", "error"])

    return files.select("path", "content").mapInArrow(run, f"path string, blocks array<{BLOCK}>, title string, error string")


# --- writing -----------------------------------------------------------------------

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _id(style: str) -> str:
    return re.sub(r"[^\w]", "", style) or "Normal"


class _Body:
    """The paragraphs of a document, with the styles and links they use."""

    def __init__(self):
        self.parts, self.links, self.used = [], {}, set()

    def text(self, runs: list[dict]) -> str:
        out = []
        for r in runs:
            marks = "".join(f"<w:{tag}/>" for name, tag in (("bold", "b"), ("italic", "i"), ("strike", "strike")) if r[name])
            said = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(_clean(t))}</w:t>' for t in r["text"].split("\n"))
            run = f"<w:r>{f'<w:rPr>{marks}</w:rPr>' if marks else ''}{said}</w:r>"
            if r["link"]:
                number = self.links.setdefault(r["link"], f"rId{len(self.links) + 10}")
                run = f'<w:hyperlink r:id="{number}">{run}</w:hyperlink>'
            out.append(run)
        return "".join(out)

    def add(self, style: str | None, runs: list[dict], more: str = "") -> None:
        if style:
            self.used.add(style)
        named = f'<w:pStyle w:val="{_id(style)}"/>' if style else ""
        self.parts.append(f"<w:p><w:pPr>{named}{more}</w:pPr>{self.text(runs)}</w:p>")


def _clean(text: str) -> str:
    """The text without characters that XML cannot hold."""
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text)


def write(rows: list[dict], fonts: dict | None = None, title: str = "") -> bytes:
    """A file of block rows; equal rows give equal bytes."""
    body, depth, plain = _Body(), {}, lambda t: [{"text": t, "bold": False, "italic": False, "strike": False, "link": None}]
    kinds = {r["block_id"]: r for r in rows}
    for r in rows:
        above = kinds.get(r["parent_id"])
        quoted = above is not None and above["kind"] == "quote"
        if r["kind"] == "heading":
            body.add(f"Heading {r['level']}", r["runs"])
        elif r["kind"] == "para":
            body.add("Quote" if quoted else None, r["runs"])
        elif r["kind"] == "list":
            depth[r["block_id"]] = 1 + (depth.get(above["parent_id"], 0) if above is not None and above["kind"] == "item" else 0)
        elif r["kind"] == "item":
            level = min(DEEPEST, depth[r["parent_id"]])
            body.add(("List Number" if above["ordered"] else "List Bullet") + (f" {level}" if level > 1 else ""), r["runs"])
        elif r["kind"] == "code":
            language = r["language"] if r["language"] and re.fullmatch(r"[\w+#.-]{1,20}", r["language"]) else None
            for line in r["code"].split("\n"):
                body.add(f"Code {language}" if language else "Code", plain(line))
            body.parts.append("<w:p/>")
        elif r["kind"] == "hr":
            body.add(None, [], '<w:pBdr><w:bottom w:val="single" w:sz="6" w:space="1" w:color="auto"/></w:pBdr>')
        elif r["kind"] == "table":
            grid = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{body.text(cell)}</w:p></w:tc>" for cell in cells) + "</w:tr>" for cells in r["cells"])
            body.parts.append(f"<w:tbl>{grid}</w:tbl>")
    role = lambda style: "heading" if style.startswith("Heading") else "mono" if style.startswith("Code") else "body"
    face = lambda style: ((fonts or {}).get(role(style)) or {}).get("family", "").split(",")[0].strip()
    size = lambda style: int(2 * float(((fonts or {}).get(role(style)) or {}).get("size", 11)))
    styles = "".join(
        f'<w:style w:type="paragraph" w:styleId="{_id(s)}"><w:name w:val={quoteattr(s)}/><w:rPr>{f"<w:rFonts w:ascii={quoteattr(face(s))} w:hAnsi={quoteattr(face(s))}/>" if face(s) else ""}<w:sz w:val="{size(s)}"/></w:rPr></w:style>' for s in ["Normal", *sorted(body.used)]
    )
    links = "".join(f'<Relationship Id="{n}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink" Target={quoteattr(t)} TargetMode="External"/>' for t, n in body.links.items())
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    rel = "http://schemas.openxmlformats.org/package/2006/relationships"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{kind}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{kind}.styles+xml"/><Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{rel}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="word/document.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>',
        "docProps/core.xml": f'{_HEAD}<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(_clean(title))}</dc:title></cp:coreProperties>',
        "word/document.xml": f"{_HEAD}<w:document {_NS}><w:body>{''.join(body.parts)}<w:sectPr/></w:body></w:document>",
        "word/styles.xml": f"{_HEAD}<w:styles {_NS}>{styles}</w:styles>",
        "word/_rels/document.xml.rels": f'{_HEAD}<Relationships xmlns="{rel}"><Relationship Id="rId1" Type="{office}/styles" Target="styles.xml"/>{links}</Relationships>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        for name, text in parts.items():
            file.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text.encode())
    return out.getvalue()


def write_docx(docs: DataFrame, fonts: dict | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, content, error): Word files of Markdown sources, repaired. Map only."""
    from pagewright.operators.formatting import repaired
    from pagewright.sources.markdown import parse as parse_markdown

    def made(text: str | None) -> bytes:
        return write(repaired(flatten(parse_markdown(text or ""))), fonts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [safely(made, t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r for r, _ in rows], pa.binary()), pa.array([e for _, e in rows], pa.string())], names=[id_col, "content", "error"])

    return docs.select(F.col(id_col), F.col("source")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, content binary, error string")
