"""Markdown parsing: one Arrow pass from source text to an array of block rows.

Block grammar and inline grammar are not regular, so this is the one place where a
document goes through Python. HTML blocks and inline HTML are left out of the result.
Containers are read from a list of work and not by recursion, and inline text in one
pass with a stack of brackets and one of delimiters, so that neither depth nor odd text
makes a document fail or cost more than its length.

Defined results for odd input: null and empty texts have no blocks; a document that
cannot be read has none either, and says why in ``error``.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = "struct<text:string,bold:boolean,italic:boolean,code:boolean,strike:boolean,link:string,raw:boolean>"
BLOCK = f"struct<block_id:int,parent_id:int,seq:int,depth:int,kind:string,parent_kind:string,level:int,ordered:boolean,start:int,markers:array<string>,runs:array<{RUN}>,text:string,code:string,language:string,src:string,alt:string,header:array<string>,rows:array<array<string>>>"
_RUN = pa.struct([("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("code", pa.bool_()), ("strike", pa.bool_()), ("link", pa.string()), ("raw", pa.bool_())])
_BLOCK = pa.struct([("block_id", pa.int32()), ("parent_id", pa.int32()), ("seq", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("parent_kind", pa.string()), ("level", pa.int32()), ("ordered", pa.bool_()), ("start", pa.int32()), ("markers", pa.list_(pa.string())), ("runs", pa.list_(_RUN)), ("text", pa.string()), ("code", pa.string()), ("language", pa.string()), ("src", pa.string()), ("alt", pa.string()), ("header", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCED = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*(.*?)[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})[.)])(?:( +)(?=\S)|[ ]*$|( +))")
_HTML = re.compile(r" {0,3}<(?:[A-Za-z][A-Za-z0-9-]*[\s/>]|/[A-Za-z]|!--|\?|![A-Z])")
_DELIMITERS = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r""" {0,3}\[((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)""", re.S)
_PLAIN_DEFINITION = re.compile(r""" {0,3}\[((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)[ \t]*(?:\n|$)""", re.S)
_TAIL = re.compile(r"""\(\s*(<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\([^()]*\)))?\s*\)""", re.S)
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
_SPECIAL = re.compile(r"[\\`\n<&!\[\]*_~]")
_ESCAPABLE = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def parse(text: str) -> list[dict]:
    """The block tree of a text: nodes with kind, own fields, and children."""
    root: dict = {"kind": "document", "inside": re.split("\r\n|\n|\r", text or "")}
    work, texts, links = [root], [], {}
    while work:  # containers, the outer ones first
        node = work.pop()
        found = _blocks(node.pop("inside")) if "inside" in node else node["children"]
        kept = []
        for block in found:
            if block["kind"] in ("para", "heading") and block["inline"].startswith("["):
                block["inline"] = _defined(block["inline"], links)
                if not block["inline"].strip():
                    continue
            kept.append(block)
            if "inside" in block or "children" in block:
                work.append(block)
            elif "inline" in block or "grid" in block:
                texts.append(block)
        node["children"] = kept
        if node["kind"] == "item":
            texts.append(node)
    # definitions hold for the whole text, so what is inline is read when all are known
    for block in texts:
        if "grid" in block:
            block["header"], *block["rows"] = [[inline(c, links) for c in row] for row in block.pop("grid")]
        elif "inline" in block:
            runs = inline(block.pop("inline"), links)
            if block["kind"] == "para" and len(runs) == 1 and runs[0].get("image"):
                block |= {"kind": "image", **runs[0]["image"]}
            else:
                block["runs"] = runs
    for item in texts:
        if item["kind"] == "item":  # its first paragraph is its own text
            first = item["children"][0] if item["children"] and item["children"][0]["kind"] == "para" else None
            item["runs"] = first["runs"] if first else []
            item["children"] = item["children"][1:] if first else item["children"]
    return root["children"]


def _defined(text: str, links: dict) -> str:
    """The text after the link definitions at its start, which go to ``links`` (the first of a label counts)."""
    at = 0
    while at < len(text) and text[at : at + 4].lstrip(" ").startswith("["):
        m = _DEFINITION.match(text, at) or _PLAIN_DEFINITION.match(text, at)
        if not m or not m[1].strip():
            break
        links.setdefault(_label(m[1]), (_target(m[2]), html.unescape(m[3][1:-1]) if m.lastindex == 3 and m[3] else None))
        at = m.end()
    return text[at:]


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _target(text: str) -> str:
    return html.unescape(re.sub(r"\\([^\w\s])", r"\1", text[1:-1] if text.startswith("<") else text))


def _tabs(line: str) -> str:
    """The line with tabs before its text as spaces."""
    body = line.lstrip(" \t")
    lead = line[: len(line) - len(body)]
    return lead.expandtabs(4) + body if "\t" in lead else line


def _interrupts(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    if _ATX.match(line) or _FENCED.match(line) or _RULE.match(line) or _QUOTE.match(line) or _HTML.match(line):
        return True
    item = _ITEM.match(line)
    return bool(item and item[4] and item[3] in (None, "1"))


def _blank(line: str) -> bool:
    """Spaces and tabs alone; other white space is text of a paragraph."""
    return not line.strip(" \t")


def _blocks(lines: list[str]) -> list[dict]:
    """The blocks of some lines: containers with their own lines under ``inside``, inline text as it stands."""
    out, i, n = [], 0, len(lines)
    while i < n:
        line = _tabs(lines[i])
        if _blank(line):
            i += 1
        elif line.startswith("    "):
            j = i
            while j < n and (_tabs(lines[j]).startswith("    ") or _blank(lines[j])):
                j += 1
            out.append({"kind": "code", "code": "\n".join(_tabs(x)[4:] for x in lines[i:j]).rstrip("\n ") , "language": None})
            i = j
        elif (m := _FENCED.match(line)) and not (m[2][0] == "`" and "`" in m[3]):
            j, close = i + 1, re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
            while j < n and not close.match(lines[j]):
                j += 1
            cut = len(m[1])
            body = [x[min(cut, len(x) - len(x.lstrip(" "))) :] for x in lines[i + 1 : j]]
            out.append({"kind": "code", "code": "\n".join(body).rstrip("\n"), "language": html.unescape(m[3]) or None})
            i = j + 1
        elif m := _ATX.match(line):
            content = m[2] or ""
            out.append({"kind": "heading", "level": len(m[1]), "inline": "" if re.fullmatch("#+", content) else content})
            i += 1
        elif _RULE.match(line):
            out.append({"kind": "hr"})
            i += 1
        elif _QUOTE.match(line):
            inner, j = [], i
            while j < n and not _blank(lines[j]) and (_QUOTE.match(lines[j]) or (inner and not _blank(inner[-1]) and not _interrupts(lines[j]))):
                inner.append(_QUOTE.sub("", lines[j], count=1) if _QUOTE.match(lines[j]) else lines[j])
                j += 1
            out.append({"kind": "quote", "inside": inner})
            i = j
        elif _ITEM.match(line):
            i = _list(lines, i, out)
        elif _HTML.match(line):
            while i < n and not _blank(lines[i]):
                i += 1
        elif "|" in line and i + 1 < n and _DELIMITERS.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            header, j, rows = _cells(line), i + 2, []
            while j < n and not _blank(lines[j]) and not _interrupts(lines[j]):
                rows.append((_cells(lines[j]) + [""] * len(header))[: len(header)])
                j += 1
            out.append({"kind": "table", "grid": [header, *rows], "alignments": [_side(c) for c in _cells(lines[i + 1])]})
            i = j
        else:
            j, level = i + 1, None
            while j < n and not _blank(lines[j]):
                if m := _SETEXT.match(lines[j]):
                    level = 1 if m[1][0] == "=" else 2
                    break
                if _interrupts(lines[j]):
                    break
                j += 1
            out.append({"kind": "heading" if level else "para", "level": level, "inline": "\n".join(x.lstrip() for x in lines[i:j]).rstrip()})
            j += 1 if level else 0
            i = j
    return out


def _list(lines: list[str], i: int, out: list[dict]) -> int:
    """Read a list from line i on; returns the line after it."""
    first = _ITEM.match(lines[i])
    node = {"kind": "list", "ordered": first[3] is not None, "start": int(first[3] or 1) or 1, "markers": [], "children": []}
    sign, n = first[2][-1], len(lines)
    while i < n and (m := _ITEM.match(lines[i])) and m[2][-1] == sign and not (_RULE.match(lines[i]) and not node["ordered"]):
        gap = len(m[4]) if m[4] and len(m[4]) <= 4 else 1
        width = len(m[1]) + len(m[2]) + gap
        body, j = [lines[i][width:]], i + 1
        while j < n:
            line = _tabs(lines[j])
            if _blank(line):
                if len(body) == 1 and _blank(body[0]):
                    break
                body.append("")
            elif line.startswith(" " * width):
                body.append(line[width:])
            elif not _blank(body[-1]) and not _interrupts(line) and not _ITEM.match(line):
                body.append(line)  # a paragraph goes on
            else:
                break
            j += 1
        node["markers"].append(m[2] if not node["ordered"] else sign)
        node["children"].append({"kind": "item", "inside": body})
        i = j
    out.append(node)
    return i


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    parts = re.split(r"(?<!\\)\|", line)
    if parts and not parts[-1].strip():
        parts.pop()
    return [p.strip().replace("\\|", "|") for p in parts]


def _side(cell: str) -> str | None:
    """The alignment that a delimiter cell names."""
    return {(True, True): "center", (True, False): "left", (False, True): "right"}.get((cell.startswith(":"), cell.endswith(":")))


class _Ends:
    """Where a mark next ends; each is looked for once, however often it is asked."""

    def __init__(self, text: str):
        self.text, self.found = text, {}

    def after(self, mark: str, at: int) -> int:
        held = self.found.get(mark)
        if held is None or 0 <= held < at:
            held = self.found[mark] = self.text.find(mark, at)
        return held


def _tick_runs(text: str) -> dict[int, list[int]]:
    """Starts of the runs of back quotes by their length."""
    out: dict[int, list[int]] = {}
    for m in re.finditer("`+", text):
        out.setdefault(m.end() - m.start(), []).append(m.start())
    return out


def inline(text: str, links: dict | None = None) -> list[dict]:
    """The runs of inline text; neighbours of equal marks are one run. ``links``: (target, title) of defined labels."""
    links = links or {}
    pieces: list = []  # strings, finished runs, or delimiters
    brackets: list[list] = []  # opening ones: place in pieces, place in text, whether of an image, whether a link may start
    ends, ticks, i, n = _Ends(text), None, 0, len(text)
    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n and (text[i + 1] == "\n" or text[i + 1] in _ESCAPABLE):
            pieces.append({"text": "  \n", "raw": True} if text[i + 1] == "\n" else text[i + 1])
            i += 2
        elif c == "`":
            ticks = _tick_runs(text) if ticks is None else ticks
            size = len(_same(text, i))
            starts = ticks.get(size, [])
            at = bisect_right(starts, i)
            if at < len(starts):
                code = text[i + size : starts[at]].replace("\n", " ")
                pieces.append({"text": code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip() else code, "code": True})
                i = starts[at] + size
            else:
                pieces.append("`" * size)
                i += size
        elif c == "\n":
            hard = text[max(0, i - 2) : i] == "  "
            while pieces and isinstance(pieces[-1], str):
                pieces[-1] = pieces[-1].rstrip(" ")
                if pieces[-1]:
                    break
                pieces.pop()
            pieces.append({"text": "  \n", "raw": True} if hard else " ")
            i += 1
        elif c == "<":
            end = -1
            if m := _AUTOLINK.match(text, i):
                pieces.append({"text": m[1], "link": m[1] if ":" in m[1] else f"mailto:{m[1]}"})
                end = m.end()
            elif m := _TAG.match(text, i):
                end = m.end()
            else:
                for start, mark in (("<!--", "-->"), ("<?", "?>"), ("<!", ">")):
                    if text.startswith(start, i) and (start != "<!" or text[i + 2 : i + 3].isalpha()):
                        at = ends.after(mark, i + len(start))
                        end = at + len(mark) if at >= 0 else -1
                        break
            if end < 0:
                pieces.append("<")
            i = end if end >= 0 else i + 1
        elif c == "&" and (m := _ENTITY.match(text, i)):
            pieces.append(html.unescape(m[0]))
            i = m.end()
        elif c == "[" or text.startswith("![", i):
            brackets.append([len(pieces), i + (c == "!"), c == "!", True])
            pieces.append("![" if c == "!" else "[")
            i += 2 if c == "!" else 1
        elif c == "]":
            i = _close(text, i, pieces, brackets, links)
        elif c in "*_~":
            run = _same(text, i)
            before, after = text[i - 1 : i] or " ", text[i + len(run) : i + len(run) + 1] or " "
            space_b, space_a = before.isspace(), after.isspace()
            punct_b, punct_a = not (before.isalnum() or space_b), not (after.isalnum() or space_a)
            left = not space_a and (not punct_a or space_b or punct_b)
            right = not space_b and (not punct_b or space_a or punct_a)
            opens, closes = (left and (not right or punct_b), right and (not left or punct_a)) if c == "_" else (left, right)
            if c == "~" and len(run) != 2:
                opens = closes = False
            pieces.append([c, len(run), opens, closes, len(run)])
            i += len(run)
        else:
            end = _SPECIAL.search(text, i + 1)
            stop = end.start() if end else n
            pieces.append(text[i:stop])
            i = stop
    return _runs(pieces)


def _same(text: str, i: int) -> str:
    """The run of one character at i."""
    j = i
    while j < len(text) and text[j] == text[i]:
        j += 1
    return text[i:j]


def _close(text: str, i: int, pieces: list, brackets: list[list], links: dict) -> int:
    """Handle the closing bracket at i: what it closes becomes a link or image, or it is text. Returns the place after it."""
    if not brackets:
        pieces.append("]")
        return i + 1
    at, start, image, may = brackets.pop()
    found = None
    if may:
        if m := _TAIL.match(text, i + 1):
            found = (_target(m[1]), m[2][1:-1] if m[2] else None, m.end())
        elif links:
            m = _LABEL.match(text, i + 1)
            label = text[start + 1 : i] if not m or not m[1].strip() else m[1]
            if len(label) < 1000 and (known := links.get(_label(label))):
                found = (*known, m.end() if m else i + 1)
    if not found:
        pieces.append("]")
        return i + 1
    target, title, end = found
    runs = _runs(pieces[at + 1 :])
    del pieces[at:]
    if image:
        alt = "".join(r["text"] for r in runs)
        quoted_ = f' "{title}"' if title else ""
        pieces.append({"text": f"![{alt}]({target}{quoted_})", "raw": True, "image": {"src": target, "alt": alt, "title": title}})
    else:
        pieces.extend({**r, "link": target} for r in runs)
        for other in brackets:  # a link holds no link
            if not other[2]:
                other[3] = False
    return end


def _paired(pieces: list) -> list[tuple[int, int, str]]:
    """What the delimiters mark: (opening piece, closing piece, mark). Each closing one takes the nearest opening one that fits."""
    spans: list[tuple[int, int, str]] = []
    openers: dict[str, list[int]] = {"*": [], "_": [], "~": []}
    floor: dict[tuple, int] = {}  # below which place in the list no fitting one was found
    for at, d in enumerate(pieces):
        if not isinstance(d, list):
            continue
        c, _, opens, closes, size = d
        held = openers[c]
        while closes and d[1]:
            kind = (c, opens, size % 3)
            place = len(held) - 1
            low = min(floor.get(kind, 0), len(held))
            while place >= low:
                o = pieces[held[place]]
                odd = c != "~" and (o[3] or opens) and (o[4] + size) % 3 == 0 and (o[4] % 3 or size % 3)
                if not odd:
                    break
                place -= 1
            if place < low:
                floor[kind] = len(held)
                break
            match = held[place]
            use = 2 if min(d[1], pieces[match][1]) >= 2 else 1
            spans.append((match, at, "strike" if c == "~" else "bold" if use == 2 else "italic"))
            d[1] -= use
            pieces[match][1] -= use
            for other in openers.values():  # those between the two pair no more
                while other and other[-1] > match:
                    other.pop()
            if not pieces[match][1]:
                held.pop()
        if opens and d[1]:
            held.append(at)
    return spans


def _runs(pieces: list) -> list[dict]:
    """Pair the delimiters and give the runs their marks."""
    depth: dict[str, list[int]] = {mark: [0] * (len(pieces) + 1) for mark in ("bold", "italic", "strike")}
    for s, e, mark in _paired(pieces):
        depth[mark][s + 1] += 1
        depth[mark][e] -= 1
    out: list[dict] = []
    texts: list[list[str]] = []
    now = dict.fromkeys(depth, 0)
    for k, piece in enumerate(pieces):
        for mark in now:
            now[mark] += depth[mark][k]
        run = {"text": piece} if isinstance(piece, str) else {"text": piece[0] * piece[1]} if isinstance(piece, list) else piece
        if not run["text"]:
            continue
        full = {"bold": False, "italic": False, "code": False, "strike": False, "link": None, "raw": False} | run
        for mark, n in now.items():
            full[mark] = full[mark] or n > 0
        if out and not full["raw"] and not out[-1]["raw"] and all(full[m] == out[-1][m] for m in ("bold", "italic", "code", "strike", "link")):
            texts[-1].append(full["text"])
        else:
            out.append(full)
            texts.append([full["text"]])
    for run, parts in zip(out, texts, strict=True):
        run["text"] = "".join(parts)
    return out


def flatten(tree: list[dict]) -> list[dict]:
    """Block rows in document order."""
    rows: list[dict] = []
    work = [(seq, node, None) for seq, node in reversed(list(enumerate(tree)))]
    while work:
        seq, node, parent = work.pop()
        row = {k: v for k, v in node.items() if k not in ("children", "header", "rows")}
        row |= {"block_id": len(rows), "parent_id": parent and parent["block_id"], "parent_kind": parent and parent["kind"], "seq": seq, "depth": parent["depth"] + 1 if parent else 0}
        cells = [node["header"], *node["rows"]] if node["kind"] == "table" else []
        if cells:
            row["cells"] = cells
            texts = [["".join(r["text"] for r in c) for c in row_] for row_ in cells]
            row["header"], row["rows"] = texts[0], texts[1:]
            row["runs"] = [r for row_ in cells for c in row_ for r in c]
        if "runs" in row:
            row["text"] = "".join(r["text"] for r in row["runs"])
        rows.append(row)
        work.extend((k, child, row) for k, child in reversed(list(enumerate(node.get("children", ())))))
    return rows


def safely(read, text: str | None) -> tuple[object, str | None]:
    """What ``read`` makes of a text and no error, or nothing and the error: no document stops a job."""
    try:
        return read(text), None
    except Exception as error:  # noqa: BLE001 - reported in the row
        return None, f"{type(error).__name__}: {error}"


def with_blocks(docs: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = (), keep_error: bool = False) -> DataFrame:
    """The id, the columns of ``keep``, and ``blocks``: the block rows of the document; also what could not be read if asked.

    Sources go to Python and do not come back unless they are kept: what needs lines is best computed before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [safely(lambda t: flatten(parse(t)), t) for t in part.column(0).to_pylist()]
                columns = [*(part.column(places[c]) for c in shown), pa.array([b or [] for b, _ in made], pa.list_(_BLOCK))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array([e for _, e in made], pa.string())] if keep_error else [])], names=names)

    shown = [id_col, *keep]
    sent = ["source", *(c for c in shown if c != "source")]
    places = {c: i for i, c in enumerate(sent)}
    names = [*shown, "blocks", *(["error"] if keep_error else [])]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in shown]
    return docs.select(*[F.col(c) for c in sent]).mapInArrow(run, ", ".join([*kinds, f"blocks array<{BLOCK}>", *(["error string"] if keep_error else [])]))
