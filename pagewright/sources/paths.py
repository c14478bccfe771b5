"""Which files a run takes and where its results go: expressions over paths."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before the extension of a formatted file.
INFIX = "formatted"
#: Extensions that are read, and what reads them.
FORMATS = {".md": "markdown", ".markdown": "markdown", ".mdown": "markdown", ".docx": "docx", ".pdf": "pdf"}


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The extension in lower case with its dot; empty for names without one or that only start with a dot."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1))


def format_of(path: Column, formats: dict[str, str] = FORMATS) -> Column:
    """The format that reads a path, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in formats.items() for x in kv]), extension(path))


def unsupported(path: Column, formats: dict[str, str] = FORMATS) -> Column:
    """Why a path is not read, or null."""
    said = F.concat(F.lit("unsupported format '"), extension(path), F.lit(f"'; supported are {', '.join(sorted(formats))}"))
    return F.when(format_of(path, formats).isNull(), said)


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression over a whole path; a star goes over slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close]
            out.append(("[^" if body.startswith("!") else "[") + re.sub(r"([\[\]\\&^])", r"\\\1", body.removeprefix("!")) + "]")
            i = close
        else:
            out.append(c if c.isalnum() or c in "/_ " else "\\" + c)
        i += 1
    return f"^(?s:{''.join(out)})$"


def excluded(path: Column, patterns: Iterable[str]) -> Column:
    """Whether one of the globs takes a path out: by the whole path, below any folder, or by its name."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^(?:file:/*(?=/)|\./+)", ""), r"/\.(?=/)", "")
    out = F.lit(False)
    for pattern in patterns:
        inner = pattern.removeprefix("**/")
        for regex in dict.fromkeys(map(glob_regex, (pattern, inner, f"*/{inner}"))):
            out = out | bare.rlike(regex)
        out = out | name_of(bare).rlike(glob_regex(inner))
    return out


def targets(files: DataFrame, exclude: Iterable[str] = (), skip: str | None = None, formats: dict[str, str] = FORMATS, base: str = "") -> DataFrame:
    """Of the files (path) of a folder those that a run takes.

    Hidden folders, formats that are not read, earlier results, excluded paths and the
    folder of results go. A file that is named itself need not pass here.
    """
    path = F.col("path")
    below = F.substring(path, len(base) + 1, 1 << 30) if base else path
    kept = files.filter(~below.rlike(r"(^|/)\.[^/]+/") & format_of(path, formats).isNotNull() & ~F.contains(name_of(path), F.lit(f".{INFIX}.")) & ~excluded(path, exclude))
    return kept.filter(~path.startswith(skip.rstrip("/") + "/")) if skip else kept


def default_output(path: Column) -> Column:
    """The path of the formatted file beside its source."""
    name = name_of(path)
    folder = F.left(path, F.length(path) - F.length(name))
    end = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.concat(folder, F.left(name, F.length(name) - F.length(end)), F.lit(f".{INFIX}"), end)


def mirrored(path: Column, base: str, out_dir: str) -> Column:
    """The place of a file under the folder of results: as under its own base, or its name alone if it lies elsewhere."""
    root = base.rstrip("/") + "/"
    below = F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(name_of(path))
    return F.concat(F.lit(out_dir.rstrip("/") + "/"), below)


def extracted(path: Column) -> Column:
    """The path of the Markdown that is kept between reading and writing another format."""
    return F.concat(F.regexp_replace(default_output(path), rf"\.{INFIX}(\.[^./]+)?$", ""), F.lit(".extracted.md"))
