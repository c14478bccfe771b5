"""The block and inline grammar."""

from pagewright.sources.markdown import flatten, inline, parse


def kinds(text):
    return [(b["depth"], b["kind"]) for b in flatten(parse(text))]


def test_blocks():
    assert kinds("# A\n\ntext\nmore\n\n---\n\n> q\n> r\n\n```py\nx\n```\n\n    code\n") == [(0, "heading"), (0, "para"), (0, "hr"), (0, "quote"), (1, "para"), (0, "code"), (0, "code")]
    assert kinds("- a\n  - b\n- c\n\n  d\n") == [(0, "list"), (1, "item"), (2, "list"), (3, "item"), (1, "item"), (2, "para")]
    assert kinds("| a | b |\n|---|:-:|\n| 1 | 2 |\n\n<div>x</div>\n") == [(0, "table")]
    assert kinds("") == [] == kinds("\n\n")


def test_fields():
    heading, setext = flatten(parse("## Two ##\n\nOne\n===\n"))
    assert (heading["level"], heading["text"], setext["level"], setext["text"]) == (2, "Two", 1, "One")
    (code,) = flatten(parse("~~~ python x\n\ta\n\n~~~\n"))
    assert (code["language"], code["code"]) == ("python x", "\ta")
    (image,) = flatten(parse("![an *alt*](p.png)\n"))
    assert (image["kind"], image["src"], image["alt"]) == ("image", "p.png", "an alt")
    (first, _, second, _) = flatten(parse("3. a\n* b\n"))
    assert (first["ordered"], first["start"], second["ordered"], second["markers"]) == (True, 3, False, ["*"])


def marks(text):
    return [(r["text"], "".join(m[0] for m in ("bold", "italic", "code", "strike") if r[m]), r["link"]) for r in inline(text)]


def test_inline():
    assert marks("a **b _c_** ~~d~~ `e`") == [("a ", "", None), ("b ", "b", None), ("c", "bi", None), (" ", "", None), ("d", "s", None), (" ", "", None), ("e", "c", None)]
    assert marks("[x *y*](u) <https://e.test> \\*z\\* &amp;") == [("x ", "", "u"), ("y", "i", "u"), (" ", "", None), ("https://e.test", "", "https://e.test"), (" *z* &", "", None)]
    assert marks("snake_case_name * 2") == [("snake_case_name * 2", "", None)]
    assert marks("a\nb") == [("a b", "", None)]
