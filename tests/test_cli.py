"""The command line over folders of files."""

import pytest

from pagewright.cli import main
from pagewright.sources import docx
from pagewright.sources.markdown import flatten, parse

FILES = {"a.md": "+ oak\n* elm\n", "sub/b.markdown": "fine words\n", "sub/.hid/c.md": "x  \n", "old.formatted.md": "x  \n", "skip/d.md": "x  \n", "e.txt": "x"}


@pytest.fixture
def tree(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "w.docx").write_bytes(docx.write(flatten(parse("# T\n\n### U\n"))))
    (tmp_path / "pagewright.toml").write_text('exclude = ["**/skip/*"]\n')
    return tmp_path


def test_check(spark, tree, capsys):
    own = ["--config", str(tree / "pagewright.toml")]
    assert main(["check", str(tree), *own], spark) == 1
    out = capsys.readouterr().out
    assert "3 file(s), 2 issue(s)" in out and "a.md: 1 warning\n  [warning] list-mixed-markers (document)" in out and "b.markdown: no issues found" in out and "heading-skip" in out
    assert main(["check", str(tree / "sub" / "b.markdown"), "--no-config"], spark) == 0
    (tree / "bad.md").write_bytes(b"\xff\xfe\xfa")
    assert main(["check", str(tree), str(tree / "e.txt"), *own], spark) == 2
    said = capsys.readouterr()
    assert "bad.md: the file is not valid UTF-8" in said.err and "e.txt: unsupported format" in said.err and "a.md" in said.out
    (tree / "pagewright.toml").write_text("rules = 1\n")
    assert main(["check", str(tree), *own], spark) == 2 and "'rules'" in capsys.readouterr().err


def test_format(spark, tree, capsys):
    own = ["--config", str(tree / "pagewright.toml")]
    before = {p: p.read_bytes() for p in tree.rglob("*") if p.is_file()}
    assert main(["format", str(tree), "--diff", *own], spark) == 1
    out = capsys.readouterr().out
    assert "2 of 3 file(s) would change" in out and "-+ oak\n-* elm\n+- oak\n+- elm" in out and "would rewrite" in out
    assert before == {p: p.read_bytes() for p in tree.rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    for _ in range(2):  # results are not picked up again
        assert main(["format", str(tree), "--out-dir", str(tree / "out"), "-t", "technical", *own], spark) == 0
    assert "3 fixed" not in capsys.readouterr().out
    assert (tree / "out" / "a.md").read_text() == "- oak\n- elm\n" and (tree / "out" / "sub" / "b.markdown").exists()
    assert [b["text"] for b in flatten(docx.parse((tree / "out" / "w.docx").read_bytes())[0])] == ["T", "U"]
    assert main(["format", str(tree / "a.md"), "--no-config"], spark) == 0 and (tree / "a.formatted.md").read_text() == "- oak\n- elm\n"
    assert main(["format", str(tree / "a.md"), "-o", str(tree / "a.md"), "--no-config"], spark) == 2
    assert main(["format", str(tree), "-o", "x", *own], spark) == 2
    assert main(["format", str(tree / "w.docx"), "-o", str(tree / "w.md"), "--keep-intermediate", "--no-config"], spark) == 0
    assert (tree / "w.md").read_text() == "# T\n\n### U\n" == (tree / "w.extracted.md").read_text()
    assert all(before[p] == p.read_bytes() for p in before)
    assert main(["format", str(tree / "a.md"), "-t", "nothing", "--no-config"], spark) == 2


def test_lists(spark, tree, capsys):
    assert main(["rules", "--no-config"], spark) == 0 and main(["templates"], spark) == 0
    out = capsys.readouterr().out
    assert "quotes-mixed" in out and "font-coverage" in out and "technical" in out
    assert main(["fonts", str(tree)], spark) == 1
