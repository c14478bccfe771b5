"""Fonts: what files say of themselves, families, licences, and which font shows which character.

Fonts of a machine are few (files in thousands at most), texts are not: tables of fonts
are small sides that Spark may broadcast by their size. For coverage only the distinct
characters of texts are looked up, by block of 256 code points, so that a range is an
equal key and a condition. Spans keep texts in their rows: the chain becomes a table of
all code points, and one Arrow pass finds the spans in the bytes of many texts at once.

Defined results for odd input: null and empty texts have no spans; a character that no
font shows stays in the span it stands in and is reported; a family without faces, or a
file that is no font, is left out with a reason; empty tables give empty results.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.text import WS
from pagewright.operators.source_rules import issue

# --- fixed values ------------------------------------------------------------------

#: Licences by what a font declares, specific ones first: name, whether it permits embedding and sharing, marks in its address and its text.
LICENCES = [
    ("OFL-1.1", True, ["scripts.sil.org/ofl", "openfontlicense.org", "sil.org/ofl"], ["sil open font license", "open font license"]),
    ("Bitstream-Vera", True, ["dejavu-fonts.github.io", "dejavu.sourceforge.net"], ["bitstream vera fonts copyright", "bitstream vera"]),
    ("GPL-font-exception", True, [], ["font embedding exception", "as a special exception, if you create a document", "gnu freefont"]),
    ("Apache-2.0", True, ["apache.org/licenses/license-2.0"], ["apache license"]),
    ("UFL-1.0", True, ["font.ubuntu.com/ufl"], ["ubuntu font licence", "ubuntu font license"]),
    ("Public-Domain", True, ["creativecommons.org/publicdomain"], ["public domain", "cc0 1.0"]),
    ("GPL", False, [], ["gnu general public license", "gnu lesser general public"]),
]
#: Families of a known kind; others are known by their name.
SERIF = ["DejaVu Serif", "Liberation Serif", "FreeSerif", "Bitstream Vera Serif", "Noto Serif", "Source Serif 4", "IBM Plex Serif", "EB Garamond", "Merriweather"]
MONO = ["DejaVu Sans Mono", "Liberation Mono", "FreeMono", "Bitstream Vera Sans Mono", "Noto Sans Mono", "Roboto Mono", "Source Code Pro", "IBM Plex Mono", "Fira Code", "JetBrains Mono", "Ubuntu Mono"]
#: Families that fill gaps, the widest first.
FALLBACK = ["DejaVu Sans", "FreeSerif", "FreeSans", "Noto Sans", "Liberation Sans", "DejaVu Serif", "Bitstream Vera Sans"]
#: Code points of scripts.
SCRIPTS = {
    "han": [(0x2E80, 0x2EFF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)],
    "kana": [(0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x3100, 0x312F), (0xFF00, 0xFFEF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
}
#: Characters that a font has to show to stand for a script.
PROBES = {"han": "日本世界字", "kana": "ぁあアーン", "hangul": "한국어글"}
#: Collections that readers of PDF bring, with the scripts they serve; the fonts of every reader, and up to where those go.
COLLECTIONS = [("HeiseiKakuGo-W5", ["han", "kana"]), ("HYSMyeongJo-Medium", ["hangul"])]
BASE = {"serif": "Times-Roman", "mono": "Courier", "sans": "Helvetica"}
BASE_LIMIT = 0x100
STYLES = ["regular", "bold", "italic", "bolditalic"]
#: What stands for a style that a family lacks, the nearest first.
SUBSTITUTES = {"regular": ["bold", "italic", "bolditalic"], "bold": ["bolditalic", "regular"], "italic": ["bolditalic", "regular"], "bolditalic": ["bold", "italic", "regular"]}
RESTRICTED, PREVIEW, EDITABLE, NO_SUBSET, BITMAP_ONLY = 0x2, 0x4, 0x8, 0x100, 0x200


# --- files -------------------------------------------------------------------------


class FontError(ValueError):
    """Bytes that are no font that can be read."""


def _tables(data: bytes) -> dict[str, bytes]:
    """The tables of a file, of a collection those of its first font; tables that reach past the end are cut there."""
    at = 0
    if data[:4] == b"ttcf":
        (at,) = struct.unpack_from(">I", data, 12)
    if data[at : at + 4] not in (b"\x00\x01\x00\x00", b"true", b"OTTO", b"typ1"):
        raise FontError("the file does not start like a font")
    (n,) = struct.unpack_from(">H", data, at + 4)
    rows = [struct.unpack_from(">4s4xII", data, at + 12 + 16 * i) for i in range(n)]
    return {tag.decode("latin-1"): data[start : start + size] for tag, start, size in rows}


def _names(table: bytes) -> dict[int, str]:
    """Names by number, the first that can be read."""
    out: dict[int, str] = {}
    if len(table) < 6:
        return out
    n, base = struct.unpack_from(">HH", table, 2)
    for i in range(n):
        if 6 + 12 * (i + 1) > len(table):
            break
        platform, _, _, number, size, start = struct.unpack_from(">6H", table, 6 + 12 * i)
        raw = table[base + start : base + start + size]
        try:
            text = raw.decode("utf-16-be" if platform in (0, 3) else "mac-roman").strip("\0 ")
        except UnicodeDecodeError:
            continue
        if text:
            out.setdefault(number, text)
    return out


def _segments(table: bytes) -> np.ndarray:
    """Code points of a table of segments (format 4) that have a glyph."""
    if len(table) < 16:
        return np.zeros(0, np.int64)
    n = struct.unpack_from(">H", table, 6)[0] // 2
    room = (len(table) - 16) // 8
    n = min(n, room)
    words = np.frombuffer(table[: len(table) // 2 * 2], ">u2").astype(np.int64)
    end, start, delta, jump = words[7 : 7 + n], words[8 + n : 8 + 2 * n], words[8 + 2 * n : 8 + 3 * n], words[8 + 3 * n : 8 + 4 * n]
    out = []
    for i in range(n):
        codes = np.arange(start[i], min(end[i], 0xFFFE) + 1)
        glyphs = codes
        if jump[i]:
            places = (8 + 3 * n + i) + jump[i] // 2 + (codes - start[i])
            inside = places < len(words)
            codes, places = codes[inside], places[inside]
            glyphs = words[places]
            codes, glyphs = codes[glyphs != 0], glyphs[glyphs != 0]
        out.append(codes[(glyphs + delta[i]) & 0xFFFF != 0])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _groups(table: bytes) -> np.ndarray:
    """Code points of a table of groups (format 12) that have a glyph."""
    if len(table) < 16:
        return np.zeros(0, np.int64)
    n = min(struct.unpack_from(">I", table, 12)[0], (len(table) - 16) // 12)
    rows = np.frombuffer(table, ">u4", n * 3, 16).reshape(n, 3).astype(np.int64)
    rows = rows[(rows[:, 0] <= rows[:, 1]) & (rows[:, 1] <= 0x10FFFF)]
    return np.concatenate([np.zeros(0, np.int64), *[np.arange(a + (g == 0), b + 1) for a, b, g in rows]])


#: Places of character maps, full ones before those of the first plane.
_PLACES = [(3, 10), (0, 4), (0, 6), (3, 1), (0, 3), (0, 0)]


def _code_points(table: bytes) -> np.ndarray:
    if len(table) < 4:
        return np.zeros(0, np.int64)
    n = min(struct.unpack_from(">H", table, 2)[0], (len(table) - 4) // 8)
    rows = [struct.unpack_from(">HHI", table, 4 + 8 * i) for i in range(n)]
    for start in [at for place in _PLACES for p, e, at in rows if (p, e) == place]:
        part = table[start:]
        if len(part) < 8:
            continue
        kind = struct.unpack_from(">H", part)[0]
        found = _segments(part[: struct.unpack_from(">H", part, 2)[0]]) if kind == 4 else _groups(part[: struct.unpack_from(">I", part, 4)[0]]) if kind == 12 else ()
        if len(found):
            return np.unique(found)
    return np.zeros(0, np.int64)


def _ranges(codes: np.ndarray) -> list[dict]:
    """Neighbouring numbers as ranges."""
    cuts = np.flatnonzero(np.diff(codes) != 1) + 1
    return [{"low": int(part[0]), "high": int(part[-1])} for part in np.split(codes, cuts) if len(part)]


def read_font(data: bytes, coverage: bool = True) -> dict:
    """What a font file says: family, subfamily, outlines, fs_type, licence text and address, and the ranges it shows."""
    try:
        tables = _tables(data)
        names = _names(tables.get("name", b""))
        os2 = tables.get("OS/2", b"")
        fs_type = struct.unpack_from(">H", os2, 8)[0] if len(os2) >= 10 else None
        ranges = _ranges(_code_points(tables.get("cmap", b""))) if coverage else []
    except (struct.error, IndexError) as error:
        raise FontError(f"the font is cut short: {error}") from error
    if not (family := names.get(16) or names.get(1)):
        raise FontError("the font has no name")
    outlines = "truetype" if {"glyf", "loca"} <= set(tables) else "postscript" if "CFF " in tables else "bitmap"
    return {"family": family, "subfamily": names.get(17) or names.get(2) or "Regular", "outlines": outlines, "fs_type": fs_type, "licence_text": names.get(13, ""), "licence_url": names.get(14, ""), "ranges": ranges}


_INFO = [("family", pa.string()), ("subfamily", pa.string()), ("outlines", pa.string()), ("fs_type", pa.int32()), ("licence_text", pa.string()), ("licence_url", pa.string()), ("ranges", pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))]
_INFO_SQL = "family string, subfamily string, outlines string, fs_type int, licence_text string, licence_url string, ranges array<struct<low:int,high:int>>"


def with_font_info(files: DataFrame, coverage: bool = True) -> DataFrame:
    """The path, what each font file (path, content) says, and ``error`` if it is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, errors = [], []
            for data in batch.column(1):
                try:
                    rows.append(read_font(data.as_py() or b"", coverage))
                    errors.append(None)
                except FontError as error:
                    rows.append({})
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r.get(n) for r in rows], kind) for n, kind in _INFO], pa.array(errors, pa.string())], names=["path", *[n for n, _ in _INFO], "error"])

    return files.select("path", "content").mapInArrow(run, f"path string, {_INFO_SQL}, error string")


#: Most files that a scan considers: there are no more on a machine that is in order.
MOST_FILES = 4000


def scan_fonts(spark: SparkSession, folders: list[str], cache: str | None = None, coverage: bool = True) -> DataFrame:
    """The fonts under folders, in order of folders and paths: (scan_ord, from_cache, path, ..., error)."""
    out = None
    for at, folder in enumerate(([cache] if cache else []) + folders):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ttf,ttc,otf,TTF,TTC,OTF}").load(folder)
        part = files.select("path", "content", F.lit(at).alias("folder"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"scan_ord int, from_cache boolean, path string, {_INFO_SQL}, error string")
    first = out.orderBy("folder", "path").limit(MOST_FILES)
    info = with_font_info(first, coverage)
    place = first.select("path", F.row_number().over(Window.orderBy("folder", "path")).alias("scan_ord"), (F.lit(cache is not None) & (F.col("folder") == 0)).alias("from_cache"))  # MOST_FILES rows at most
    return place.join(info, "path").select("scan_ord", "from_cache", *info.columns)


# --- what is said of a font ---------------------------------------------------------


def style(subfamily: Column) -> Column:
    """regular, bold, italic or bolditalic."""
    low = F.lower(F.coalesce(subfamily, F.lit("")))
    bold, italic = F.contains(low, F.lit("bold")), F.contains(low, F.lit("italic")) | F.contains(low, F.lit("oblique"))
    return F.when(bold & italic, "bolditalic").when(bold, "bold").when(italic, "italic").otherwise("regular")


def embeddable(fs_type: Column) -> Column:
    return fs_type.isNull() | (fs_type.bitwiseAND(RESTRICTED) == 0)


def describe_fs_type(fs_type: Column) -> Column:
    """What a font lets be done with it, in words."""
    has = lambda bit: fs_type.bitwiseAND(bit) != 0
    parts = F.array(F.when(has(EDITABLE), "editable embedding").when(has(PREVIEW), "preview & print").otherwise("installable (unrestricted)"), F.when(has(NO_SUBSET), "no subsetting"), F.when(has(BITMAP_ONLY), "bitmap only"))
    return F.when(fs_type.isNull(), "unspecified (no OS/2 table)").when(has(RESTRICTED), "restricted - embedding not permitted").otherwise(F.array_join(F.filter(parts, lambda p: p.isNotNull()), ", "))


def licence(text: Column, url: Column) -> Column:
    """struct(id, open): the first licence of which the font bears a mark."""
    low_text, low_url = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    out = F.when(F.lit(False), F.struct(F.lit("").alias("id"), F.lit(False).alias("open")))
    for name, open_, urls, texts in LICENCES:
        some = F.lit(False)
        for column, marks in ((low_url, urls), (low_text, texts)):
            for mark in marks:
                some = some | F.contains(column, F.lit(mark))
        out = out.when(some, F.struct(F.lit(name).alias("id"), F.lit(open_).alias("open")))
    return out.otherwise(F.struct(F.lit("unknown").alias("id"), F.lit(False).alias("open")))


def category(family: Column) -> Column:
    """serif, mono or sans: of known families as listed, of others by their names."""
    low = F.lower(family)
    mono = low.rlike("mono|code|courier")
    known = {f.lower(): kind for kind, fs in (("serif", SERIF), ("mono", MONO)) for f in fs}
    listed = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), low)
    return F.coalesce(listed, F.when(mono, "mono").when(F.contains(low, F.lit("serif")) & ~F.contains(low, F.lit("sans")), "serif").otherwise("sans"))


def families(fonts: DataFrame) -> DataFrame:
    """One row for each family: name, key, category, licence, open, styles, pinned, ranges of its regular face, embeddable, usable, auto.

    Files that are no outlines or may not be embedded take no part; of a style the first
    face in the order of the scan counts; a family is pinned if all faces that count are.
    """
    fine = fonts.filter(F.col("family").isNotNull() & (F.col("outlines") == "truetype") & embeddable(F.col("fs_type")))
    faces = fine.withColumn("key", F.lower(F.trim("family"))).withColumn("style", style(F.col("subfamily")))
    kept = faces.withColumn("n", F.row_number().over(Window.partitionBy("key", "style").orderBy("scan_ord"))).filter("n = 1")
    rank = F.array_position(F.array(*map(F.lit, STYLES)), F.col("style"))
    own = kept.groupBy("key").agg(F.min_by("family", "scan_ord").alias("name"), F.min_by(F.struct("licence_text", "licence_url"), "scan_ord").alias("said"), F.min_by("ranges", rank).alias("ranges"), F.array_sort(F.collect_list(F.struct(rank.alias("r"), "style"))).alias("s"), F.bool_and("from_cache").alias("pinned"))
    own = own.withColumn("l", licence(F.col("said.licence_text"), F.col("said.licence_url")))
    return own.select("name", "key", category(F.col("name")).alias("category"), F.col("l.id").alias("licence"), F.col("l.open").alias("open"), F.transform("s", lambda x: x["style"]).alias("styles"), "pinned", "ranges", F.lit(True).alias("usable"), F.col("l.open").alias("auto"))


def skipped(fonts: DataFrame) -> DataFrame:
    """(path, reason) of the files that take no part."""
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("outlines") != "truetype", F.concat("outlines", F.lit(" outlines cannot be rendered"))).when(~embeddable(F.col("fs_type")), F.concat(F.lit("embedding not permitted (fsType "), F.col("fs_type").cast("string"), F.lit(")")))
    return fonts.select("path", reason.alias("reason")).filter("reason is not null")


def face_name(name: Column, styles: Column, wanted: Column) -> Column:
    """struct(face, exact): the face of a family for a style, or what stands for it."""
    base = F.replace(name, F.lit(" "), F.lit(""))
    of = lambda s: base if s == "regular" else F.concat(base, F.lit(f"-{s}"))
    out = F.when(F.lit(False), F.struct(F.lit("").alias("face"), F.lit(False).alias("exact")))
    for style_ in STYLES:
        for at, s in enumerate([style_, *SUBSTITUTES[style_]]):
            out = out.when((wanted == style_) & F.array_contains(styles, s), F.struct(of(s).alias("face"), F.lit(at == 0).alias("exact")))
    return out.otherwise(F.struct(base.alias("face"), F.lit(False).alias("exact")))


def covering(pool: DataFrame, probe: str, auto_only: bool = True) -> DataFrame:
    """The families that show every character of a text, the widest first: (name, key, size)."""
    codes = sorted({ord(c) for c in probe if not c.isspace()})
    all_ = F.forall(F.array(*map(F.lit, codes)), lambda c: F.exists("ranges", lambda r: c.between(r["low"], r["high"]))) if codes else F.lit(True)
    size = F.aggregate("ranges", F.lit(0), lambda s, r: s + r["high"] - r["low"] + 1)
    return pool.filter(F.col("auto") | F.lit(not auto_only)).filter(all_).select("name", "key", size.alias("size")).orderBy(F.desc("size"), "name")


def embeddable_cjk(pool: DataFrame) -> DataFrame:
    """(key, scripts): for each script the widest family that can be embedded."""
    out = None
    for i, (script, probe) in enumerate(PROBES.items()):
        one = covering(pool, probe).limit(1).select("key", F.struct(F.lit(i).alias("i"), F.lit(script).alias("script")).alias("s"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("s")).select("key", F.transform("s", lambda x: x["script"]).alias("scripts"))


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, state) of the pinned files (file, sha256): ok, missing or changed."""
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("own"))
    state = F.when(F.col("own").isNull(), "missing").when(F.col("own") == F.lower("sha256"), "ok").otherwise("changed")
    return manifest.join(found, "file", "left").select("file", state.alias("state"))


# --- characters --------------------------------------------------------------------


def script(code: Column) -> Column:
    """The script of a code point, or null."""
    out = F.when(F.lit(False), "")
    for name, ranges in SCRIPTS.items():
        some = F.lit(False)
        for low, high in ranges:
            some = some | code.between(low, high)
        out = out.when(some, name)
    return out


def chain(pool: DataFrame, wanted: list[str], fallback: list[str] = (), cid: str | None = None, embed_cjk: bool = False, base: str | None = None) -> DataFrame:
    """(ord, font, key, ranges, pinned, styles): which fonts show text, the first that can: families asked for, fallbacks,
    those of the list, embedded ones for CJK, then collections; ``base`` a font of every reader if there is no family at all."""
    spark = pool.sparkSession
    names = [(i, n.strip().lower()) for i, n in enumerate([*wanted, *fallback])]
    asked = spark.createDataFrame(names, "at int, key string")
    pick = lambda order, n: pool.join(order, "key").select(F.lit(n).alias("step"), "at", F.col("name").alias("font"), "key", "ranges", "pinned", "styles")
    listed = spark.createDataFrame([(i, n.lower()) for i, n in enumerate(FALLBACK)], "at int, key string")
    parts = [pick(asked, 0), pick(listed, 1).join(pool.filter("auto").select("key"), "key", "left_semi")]
    if embed_cjk:
        parts.append(pick(embeddable_cjk(pool).select(F.lit(0).alias("at"), "key"), 2))
    every = [(c, s) for c, s in COLLECTIONS if c == cid] or ([(cid, list(SCRIPTS))] if cid else [])
    every += [(c, s) for c, s in COLLECTIONS if c != cid]
    rows = [(3, i, c, c.lower(), [(low, high) for x in s for low, high in SCRIPTS[x]], True, ["regular"]) for i, (c, s) in enumerate(every)]
    if base:
        rows.append((1, len(FALLBACK), BASE[base], BASE[base].lower(), [(0, BASE_LIMIT - 1)], True, list(STYLES)))
    kind = "step int, at int, font string, key string, ranges array<struct<low:int,high:int>>, pinned boolean, styles array<string>"
    parts.append(spark.createDataFrame(rows, kind))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    once = out.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("step", "at"))).filter("n = 1")  # a machine's families
    return once.select(F.row_number().over(Window.orderBy("step", "at", "key")).alias("ord"), "font", "key", "ranges", "pinned", "styles")


def unresolved(pool: DataFrame, wanted: list[str]) -> DataFrame:
    """(at, name) of the families asked for that are not there."""
    asked = pool.sparkSession.createDataFrame(list(enumerate(wanted)), "at int, name string")
    return asked.join(pool.select("key"), F.lower(F.trim("name")) == F.col("key"), "left_anti")


def _blocks(fonts: DataFrame) -> DataFrame:
    """The ranges of a chain, cut at blocks of 256 code points: (block, low, high, ord, font)."""
    each = fonts.select("ord", "font", F.explode("ranges").alias("r"))
    return each.select("ord", "font", F.col("r.low").alias("low"), F.col("r.high").alias("high"), F.explode(F.sequence(F.shiftright("r.low", 8), F.shiftright("r.high", 8))).alias("block"))


def first_font(characters: DataFrame, fonts: DataFrame) -> DataFrame:
    """(char, ord, font) of distinct characters: the first font of the chain that shows it; characters that none shows are left out."""
    coded = characters.select("char").distinct().select("char", F.ascii("char").alias("code"))
    met = coded.withColumn("block", F.shiftright("code", 8)).join(_blocks(fonts), "block").filter(F.col("code").between(F.col("low"), F.col("high")))
    return met.groupBy("char").agg(F.min(F.struct("ord", "font")).alias("f")).select("char", "f.ord", "f.font")


#: In the table of code points: shown by no font, and white space.
_GONE, _BLANK = -1, -2
#: Bytes of whole texts that become one batch, and bytes that are read at once.
SLICE, PIECE = 1 << 22, 1 << 20
_CODES = 0x110000
_SPACES = [c for c in range(0x3001) if chr(c).isspace()]  # those of WS


def _codes(raw: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The code points of the characters that begin at ``lead`` in UTF-8."""
    code = raw[lead].astype(np.int32)
    long = np.flatnonzero(code >= 0x80)
    first, more = code[long], 1 + (code[long] >= 0xE0) + (code[long] >= 0xF0)
    value = first & (0x3F >> more)
    for i in (1, 2, 3):
        follows = raw[np.minimum(lead[long] + i, raw.size - 1)].astype(np.int32) & 0x3F
        value = np.where(more >= i, value << 6 | follows, value)
    code[long] = np.minimum(value, _CODES - 1)
    return code


def _runs(data: np.ndarray, ends: np.ndarray, table: np.ndarray, primary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the texts between ``ends``: where they begin, their fonts; and by span the characters that no font shows: span, place, length.

    Bytes are read in pieces, so that one long text takes no more memory than many short ones; the font is carried from piece to piece.
    """
    begins, shown, keys, places, lengths = [], [], [], [], []
    n, at, font = 0, int(ends[0]), -1
    while at < ends[-1]:
        to = min(at + PIECE, int(ends[-1]))
        while to < ends[-1] and data[to] & 0xC0 == 0x80:
            to += 1
        raw, heads = data[at:to], ends[np.searchsorted(ends, at) : np.searchsorted(ends, to)] - at
        is_lead = (raw & 0xC0) != 0x80
        is_lead[heads] = True
        is_lead[0] = True
        lead = np.flatnonzero(is_lead)
        heads, code = np.searchsorted(lead, heads), _codes(raw, lead)
        own = table[code]
        known = own.copy()
        known[heads] = np.where(own[heads] < 0, primary, own[heads])
        known[0] = font if known[0] < 0 else known[0]
        known = known[np.maximum.accumulate(np.where(known >= 0, np.arange(known.size), 0))]
        cut = np.append(known[0] != font, known[1:] != known[:-1])
        cut[heads] = True
        gone, width = np.flatnonzero(own == _GONE), np.diff(np.append(lead, raw.size))
        key, met = np.unique((n - 1 + np.cumsum(cut)[gone]) * _CODES + code[gone], return_index=True)
        for out, part in ((begins, lead[cut] + at), (shown, known[cut]), (keys, key), (places, lead[gone[met]] + at), (lengths, width[gone[met]])):
            out.append(part)
        n, at, font = n + int(cut.sum()), to, int(known[-1])
    key, met = np.unique(np.concatenate(keys), return_index=True)
    return np.concatenate(begins), np.concatenate(shown), key // _CODES, np.concatenate(places)[met], np.concatenate(lengths)[met]


def _texts(kind: pa.DataType, ends: np.ndarray, data: np.ndarray) -> pa.Array:
    wide = np.int64 if pa.types.is_large_string(kind) else np.int32
    return pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends.astype(wide)), pa.py_buffer(np.ascontiguousarray(data))])


def font_spans(df: DataFrame, fonts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, span, font, text, missing): each text as spans of one font. White space and what no font shows stay where they stand.

    The chain, a few rows, is read at once. Texts stay in their rows, each a text of its own: there is no shuffle.
    """
    chain = sorted(((r["ord"], r["font"], [(x["low"], x["high"]) for x in r["ranges"] or []]) for r in fonts.select("ord", "font", "ranges").collect()), key=lambda r: (r[0], r[1] or ""))
    primary = next((font for at, font, _ in chain if at == 1 and font is not None), BASE["sans"])
    names = sorted({font for _, font, _ in chain if font is not None} | {primary})
    place = {font: i for i, font in enumerate(names)} | {None: _GONE}
    ranges = [(place[font], max(low, 0), high + 1) for _, font, own in reversed(chain) for low, high in own if high >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(_CODES, _GONE, np.int32)
        for font, low, end in ranges:
            table[low:end] = font
        table[_SPACES] = _BLANK
        fonts = pa.array(names, pa.string())
        for batch in batches:
            kind, column = batch.column(1).type, batch.column(1).cast(pa.large_binary())
            if not len(column):
                continue
            _, ends, data = column.buffers()
            ends, data = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1], np.frombuffer(data, np.uint8)
            at = 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
                own = ends[at : to + 1]
                begins, shown, span, places, lengths = _runs(data, own, table, place[primary])
                text = np.searchsorted(own, begins, "right") - 1
                number = np.arange(1, len(text) + 1) - np.searchsorted(text, text)
                held = np.cumsum(lengths)
                spots = np.repeat(places - (held - lengths), lengths) + np.arange(held[-1] if len(held) else 0)
                missing = np.append(0, np.cumsum(np.bincount(span, lengths, len(text)))).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text + at)), pa.array(number, pa.int32()), fonts.take(pa.array(shown)), _texts(kind, np.append(begins, own[-1]) - own[0], data[own[0] : own[-1]]), _texts(kind, missing, data[spots])],
                    names=[id_col, "span", "font", "text", "missing"],
                )
                at = to

    texts = df.select(id_col, F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    return texts.mapInArrow(run, f"`{id_col}` {id_type}, span int, font string, text string, missing string")


def coverage(df: DataFrame, chains: dict[str, DataFrame], id_col: str = "doc_id") -> DataFrame:
    """(id, missing, used, degraded, unpinned) of texts (id, role, style, text): characters that no font shows, families that
    are used, those without the face asked for, and those not pinned. Only the distinct characters of a text leave its row."""
    out = None
    for role, fonts in chains.items():
        texts = df.filter(F.col("role") == role)
        chars = texts.select(id_col, "style", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), ""))).alias("char")).filter(~F.col("char").rlike(f"^[{WS}]?$")).distinct()
        met = chars.join(first_font(chars, fonts), "char", "left").join(fonts.select("ord", "pinned", "styles"), "ord", "left")
        lacks = ~F.array_contains("styles", F.col("style"))
        part = met.select(id_col, F.when(F.col("font").isNull(), F.col("char")).alias("missing"), F.col("font").alias("used"), F.when(lacks, F.col("font")).alias("degraded"), F.when(~F.col("pinned"), F.col("font")).alias("unpinned"))
        out = part if out is None else out.unionByName(part)
    names = ["missing", "used", "degraded", "unpinned"]
    return out.groupBy(id_col).agg(*[F.array_sort(F.collect_set(n)).alias(n) for n in names])


def coverage_issues(found: DataFrame, unavailable: list[str] = (), embed_cjk_missing: bool = False, id_col: str = "doc_id") -> DataFrame:
    """The issues of the five font rules, a row each, of what :func:`coverage` found."""
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    n = F.size("missing").cast("string")
    all_ = [
        F.when(F.size("missing") > 0, issue("font-coverage", said(n, " character(s) cannot be rendered by any available font and will be missing from the PDF: ", F.array_join(F.slice("missing", 1, 20), "")), "error")),
        F.when(F.lit(bool(unavailable)), issue("font-unavailable", f"none of the template's fonts are installed here ({', '.join(unavailable)}); a substitute is used, so the output will not look as intended", "warning")),
        F.when(F.lit(embed_cjk_missing), issue("font-embed-cjk-unavailable", "embedding a CJK font was requested but no installed font with an open licence covers CJK; falling back to the built-in CID collections, so the PDF will rely on the reader's own fonts", "warning")),
        F.when(F.size("unpinned") > 0, issue("font-not-pinned", said("output used font(s) installed on this machine rather than the pinned set, so it may render differently elsewhere: ", F.array_join("unpinned", ", "), "; install the pinned fonts for reproducible output"), "info")),
        F.when(F.size("degraded") > 0, issue("font-style-missing", said("no bold or italic face for: ", F.array_join("degraded", ", "), "; the regular face is used instead"), "info")),
    ]
    issues = F.filter(F.array(*all_), lambda x: x.isNotNull())
    return found.select(id_col, F.explode(issues).alias("x")).select(id_col, "x.*")
