"""Fonts: files built by hand, families, and which font shows which character."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import fonts


def name_table(names):
    raw, rows = b"", b""
    for number, text in names.items():
        data = text.encode("utf-16-be")
        rows += struct.pack(">6H", 3, 1, 0x409, number, len(data), len(raw))
        raw += data
    return struct.pack(">3H", 0, len(names), 6 + len(rows)) + rows + raw


def segments(parts, glyphs=()):
    """Parts: start, end, delta, and whether glyphs come from the list."""
    parts = [*parts, (0xFFFF, 0xFFFF, 1, False)]
    n = len(parts)
    jumps = [(2 * (n - i) if listed else 0) for i, (*_, listed) in enumerate(parts)]
    body = struct.pack(f">{n}H", *[e for _, e, _, _ in parts]) + b"\0\0" + struct.pack(f">{n}H", *[s for s, _, _, _ in parts]) + struct.pack(f">{n}H", *[d & 0xFFFF for _, _, d, _ in parts]) + struct.pack(f">{n}H", *jumps) + struct.pack(f">{len(glyphs)}H", *glyphs)
    return struct.pack(">7H", 4, 14 + len(body), 0, 2 * n, 0, 0, 0) + body


def groups(parts):
    return struct.pack(">HHIII", 12, 0, 16 + 12 * len(parts), 0, len(parts)) + b"".join(struct.pack(">III", *p) for p in parts)


def cmap(tables):
    start, head, body = 4 + 8 * len(tables), struct.pack(">HH", 0, len(tables)), b""
    for (platform, encoding), data in tables.items():
        head += struct.pack(">HHI", platform, encoding, start + len(body))
        body += data
    return head + body


def font(tables, signature=b"\0\1\0\0"):
    start, head, body = 12 + 16 * len(tables), signature + struct.pack(">4H", len(tables), 0, 0, 0), b""
    for tag, data in tables.items():
        head += struct.pack(">4sIII", tag.encode(), 0, start + len(body), len(data))
        body += data
    return head + body


def plain(family="Own Face", fs_type=0, sub="Regular", maps=None, **more):
    names = {1: family, 2: sub, 13: more.get("text", ""), 14: ""}
    return font({"name": name_table({k: v for k, v in names.items() if v}), "OS/2": struct.pack(">5H", 4, 0, 400, 5, fs_type), "cmap": cmap(maps or {(3, 1): segments([(65, 70, 1, False)])}), "glyf": b"x", "loca": b"x"})


def shown(data):
    return [(r["low"], r["high"]) for r in fonts.read_font(data)["ranges"]]


def test_files():
    info = fonts.read_font(plain(fs_type=8, text="SIL Open Font License"))
    assert (info["family"], info["subfamily"], info["outlines"], info["fs_type"], info["licence_text"]) == ("Own Face", "Regular", "truetype", 8, "SIL Open Font License")
    assert shown(plain()) == [(65, 70)]
    assert shown(plain(maps={(3, 1): segments([(65, 70, -67, False)])})) == [(65, 66), (68, 70)]  # the first glyph shows nothing
    assert shown(plain(maps={(3, 1): segments([(65, 68, 0, True)], [5, 0, 7, 9])})) == [(65, 65), (67, 68)]
    assert shown(plain(maps={(3, 10): groups([(0x1F600, 0x1F605, 3), (90, 80, 1), (97, 99, 0)]), (3, 1): segments([(65, 70, 1, False)])})) == [(98, 99), (0x1F600, 0x1F605)]
    assert shown(plain(maps={(3, 10): groups([]), (1, 0): b"\0" * 20, (0, 3): segments([(48, 57, 1, False)])})) == [(48, 57)]
    whole = plain()
    rows = [struct.unpack_from(">4sIII", whole, 12 + 16 * i) for i in range(5)]
    moved = whole[:12] + b"".join(struct.pack(">4sIII", tag, check, at + 16, size) for tag, check, at, size in rows) + whole[92:]
    assert shown(b"ttcf" + struct.pack(">III", 0x10000, 1, 16) + moved) == [(65, 70)]
    for bad in (b"", b"GIF8", whole[:30], font({"glyf": b""}), b"ttcf\0\0"):
        with pytest.raises(fonts.FontError):
            fonts.read_font(bad)
    for cut in range(40, len(whole), 7):  # cut files are read as far as they go, or refused
        try:
            fonts.read_font(whole[:cut])
        except fonts.FontError:
            pass
    assert fonts.read_font(font({"name": name_table({16: "New", 1: "Old"}), "CFF ": b""}, b"OTTO"))["outlines"] == "postscript"
    assert fonts.read_font(font({"name": name_table({1: "Bits"})}))["fs_type"] is None


def test_scan(spark, tmp_path):
    (tmp_path / "cache").mkdir()
    (tmp_path / "more" / "deep").mkdir(parents=True)
    (tmp_path / "cache" / "a.ttf").write_bytes(plain("Alpha", text="SIL Open Font License"))
    (tmp_path / "more" / "a.TTF").write_bytes(plain("Alpha", sub="Bold"))
    (tmp_path / "more" / "deep" / "b.otf").write_bytes(b"junk")
    (tmp_path / "more" / "x.txt").write_bytes(plain("Text"))
    (tmp_path / "more" / "s.ttf").write_bytes(plain("Shut", fs_type=2))
    found = fonts.scan_fonts(spark, [str(tmp_path / "more")], str(tmp_path / "cache")).cache()
    (own,) = fonts.families(found).collect()
    assert (own["name"], own["styles"], own["pinned"], own["licence"], own["auto"]) == ("Alpha", ["regular", "bold"], False, "OFL-1.1", True)
    assert sorted(r["reason"] for r in fonts.skipped(found).collect()) == ["embedding not permitted (fsType 2)", "the file does not start like a font"]
    assert fonts.scan_fonts(spark, []).count() == 0


CHAIN = "ord int, font string, key string, ranges array<struct<low:int,high:int>>, pinned boolean, styles array<string>"


@pytest.fixture
def chain(spark):
    return spark.createDataFrame([(1, "Latin", "latin", [(32, 126)], True, ["regular", "bold"]), (2, "Greek", "greek", [(913, 969), (128512, 128512)], False, ["regular"]), (3, "Han", "han", [(19968, 40959)], True, ["regular"])], CHAIN)


def test_spans(spark, chain):
    docs = spark.createDataFrame([(1, "ab αβ c日"), (2, ""), (3, None), (4, "α aЖb"), (5, "\U0001f600!"), (6, "\t α")], "doc_id long, text string")
    got = {}
    for r in fonts.font_spans(docs, chain).orderBy("doc_id", "span").collect():
        got.setdefault(r["doc_id"], []).append((r["font"], r["text"], r["missing"]))
    assert got == {1: [("Latin", "ab ", ""), ("Greek", "αβ ", ""), ("Latin", "c", ""), ("Han", "日", "")], 4: [("Greek", "α ", ""), ("Latin", "aЖb", "Ж")], 5: [("Greek", "\U0001f600", ""), ("Latin", "!", "")], 6: [("Latin", "\t ", ""), ("Greek", "α", "")]}
    (lone,) = fonts.font_spans(docs.filter("doc_id = 1"), chain.limit(0)).collect()
    assert lone["font"] == "Helvetica"


def test_spans_stay_in_their_rows(spark, chain, capsys):
    fonts.font_spans(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), chain).explain()
    assert not {"Exchange", "Generate", "Window"} & set(capsys.readouterr().out.replace("(", " ").split())  # no character leaves its text


@pytest.mark.parametrize("piece", [1, 2, 3, 5, 1 << 20])
def test_spans_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(fonts, "PIECE", piece)
    table = np.full(0x110000, fonts._GONE, np.int32)
    for font, low, high in ((0, 32, 126), (1, 913, 969), (1, 128512, 128512)):
        table[low : high + 1] = font
    table[fonts._SPACES] = fonts._BLANK
    texts = ["αЖ Жb", "ЖЖ", "b\U0001f600\U0001f601\u2003日 α", "\0", "β"]
    raw = [t.encode() for t in texts]
    begins, shown, span, places, lengths = fonts._runs(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), table, 0)
    want, gone, at, n = [], [], 0, -1
    for text in texts:
        font, last = 0, None
        for c in text:
            font = table[ord(c)] if table[ord(c)] >= 0 else font
            if font != last:
                want.append((at, font))
                n, last = n + 1, font
            if table[ord(c)] == fonts._GONE:
                gone.append((n, c))
            at += len(c.encode())
    assert list(zip(begins, shown)) == want
    assert [(s, b"".join(raw)[p : p + k].decode()) for s, p, k in zip(span, places, lengths)] == sorted(set(gone))


def test_issues(spark, chain):
    texts = spark.createDataFrame([(1, "body", "regular", "ab ЖЗ"), (1, "heading", "bold", "α"), (2, "body", "bold", "plain")], "doc_id long, role string, style string, text string")
    found = fonts.coverage(texts, {"body": chain, "heading": chain})
    rows = {}
    for r in fonts.coverage_issues(found, ["Nowhere"], embed_cjk_missing=True).collect():
        rows.setdefault(r["doc_id"], {})[r["rule"]] = (r["severity"], r["message"])
    assert set(rows[1]) == {"font-coverage", "font-unavailable", "font-embed-cjk-unavailable", "font-not-pinned", "font-style-missing"} and set(rows[2]) == {"font-unavailable", "font-embed-cjk-unavailable"}
    assert rows[1]["font-coverage"] == ("error", "2 character(s) cannot be rendered by any available font and will be missing from the PDF: ЖЗ")
    assert "Greek" in rows[1]["font-not-pinned"][1] and "Greek" in rows[1]["font-style-missing"][1]


def test_chain(spark):
    from pagewright.plans.font_queries import faces

    pool = fonts.families(faces(spark)).cache()
    names = lambda *a, **k: [r["font"] for r in fonts.chain(pool, *a, **k).orderBy("ord").collect()]
    assert names(["Plain Sans", "plain sans", "Shut"], cid="HYSMyeongJo-Medium") == ["Plain Sans", "DejaVu Sans", "HYSMyeongJo-Medium", "HeiseiKakuGo-W5"]
    assert names(["None"], base="mono")[:2] == ["DejaVu Sans", "Courier"]
    assert [r["name"] for r in fonts.unresolved(pool, ["Book Serif", "Shut", "X"]).orderBy("at").collect()] == ["Shut", "X"]
    assert fonts.embeddable_cjk(pool).count() == 0
    asian = pool.limit(1).withColumn("key", F.lit("asia")).withColumn("name", F.lit("Asia")).withColumn("auto", F.lit(True)).withColumn("ranges", F.array(F.struct(F.lit(0x3000).alias("low"), F.lit(0xFFFF).alias("high"))))
    assert fonts.embeddable_cjk(pool.unionByName(asian)).collect() == [("asia", ["han", "kana", "hangul"])]


@pytest.mark.parametrize(("bits", "want"), [(None, True), (0, True), (4, True), (8, True), (2, False), (6, False)])
def test_embedding(spark, bits, want):
    assert spark.range(1).select(fonts.embeddable(F.lit(bits).cast("int"))).first()[0] == want
