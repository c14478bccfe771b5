"""Configuration files, templates, paths, and what users register."""

import fnmatch

import pytest
from pyspark.sql import functions as F

from pagewright import config, registry, templates
from pagewright.operators.formatting import Style
from pagewright.operators.source_rules import issue
from pagewright.plans.detect import detect
from pagewright.plans.inventory import inventory
from pagewright.sources import paths

BAD_CONFIGS = [
    ({"colour": 1}, "unknown keys"),
    ({"template": 3}, "template"),
    ({"exclude": "a"}, "exclude"),
    ({"exclude": ["a", 1]}, "exclude"),
    ({"cv": "yes"}, "cv"),
    ({"rules": ["x"]}, "rules"),
    ({"rules": {"x": "loud"}}, "loud"),
    ({"rules": {"x": 1}}, "true, false"),
    ({"options": {"x": 1}}, "options"),
    ({"options": {"x": {"y": {"z": 1}}}}, "dict"),
    ({"options": {"x": {"y": [[1]]}}}, "list"),
]


@pytest.mark.parametrize(("data", "said"), BAD_CONFIGS)
def test_bad_configurations_are_named(data, said):
    with pytest.raises(config.ConfigError, match=said) as error:
        config.from_dict(data, "here.toml")
    assert str(error.value).startswith("here.toml")


def test_the_nearest_configuration_is_found(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert config.discover(str(deep), use=False) == config.Config()
    (tmp_path / "pyproject.toml").write_text('[tool.pagewright]\ntemplate = "formal"\n[tool.pagewright.rules]\nx = false\n')
    assert config.discover(str(deep)).template == "formal" and not config.discover(str(deep)).enabled("x")
    (tmp_path / "a" / "pyproject.toml").write_text("[tool.other]\n")
    (deep / "pyproject.toml").write_text("not toml")
    assert config.find(str(deep)) == str(tmp_path / "pyproject.toml")
    (tmp_path / "pagewright.toml").write_text('exclude = ["x/**"]\n[options.r]\nn = [1, "a"]\n')
    assert config.discover(str(deep)).exclude == ("x/**",) and config.discover(str(deep)).option("r", "n", None) == [1, "a"]
    for text, said in (("[tool.other]", "no table"), ("= 1", "cannot be read")):
        (tmp_path / "a" / "pyproject.toml").write_text(text)
        with pytest.raises(config.ConfigError, match=said):
            config.load(str(tmp_path / "a" / "pyproject.toml"))
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "none.toml"))


BAD_TEMPLATES = [[], {}, {"name": "x", "markdown": 1}, {"name": "x", "markdown": {"bullet": "-"}}, {"name": "x", "markdown": {"bullet_marker": "o"}}, {"name": "x", "markdown": {"heading_style": "big"}}, {"name": "x", "markdown": {"wrap_width": -1}}, {"name": "x", "markdown": {"wrap_width": "80"}}, {"name": "x", "fonts": []}, {"name": "x", "fonts": {"title": {}}}, {"name": "x", "fonts": {"body": "Lato"}}, {"name": "x", "fonts": {"fallback": "Lato"}}, {"name": "x", "fonts": {"cjk": 1}}, {"name": "x", "fonts": {"embed_cjk": "no"}}, {"name": "x", "spacing": 2}]


@pytest.mark.parametrize("data", BAD_TEMPLATES)
def test_bad_templates_are_refused(data):
    with pytest.raises(templates.TemplateError):
        templates.from_dict(data)


def test_templates(tmp_path, spark):
    assert len(templates.presets()) == 8 and templates.table(spark).count() == 8
    assert templates.load("technical").style.wrap == 80 and templates.load("friendly").style.emphasis == "_"
    own = tmp_path / "mine.yaml"
    own.write_text('markdown: {heading_style: setext, bullet_marker: "*"}\nfonts: {body: {family: A}, cjk: null}\n')
    assert templates.load(str(own)).name == "mine" and templates.load(str(own)).style == Style(setext=True, bullet="*")
    own.write_text("a: [")
    for name in (str(own), "nothing"):
        with pytest.raises(templates.TemplateError):
            templates.load(name)
    chosen = lambda name, c: templates.chosen(name, config.Config(template=c)).name
    assert (chosen("formal", "friendly"), chosen(None, "friendly"), chosen(None, None)) == ("formal", "friendly", "minimal")


def test_globs_are_those_of_file_names(spark):
    names = ["a.md", "vendor/a.md", "x/vendor/b/a.md", "docs/[x].md", "docs/ab.md", "docs/a?.md", "A.MD", "docs/-.md"]
    for pattern in ("*.md", "vendor/**", "**/a.md", "docs/[[]x].md", "docs/a?.md", "docs/[!a]*", "docs/[a-z]b.md", "[", "docs/[-a].md"):
        frame = spark.createDataFrame([(n,) for n in names], "path string")
        got = {r[0]: r[1] for r in frame.select("path", frame.path.rlike(paths.glob_regex(pattern))).collect()}
        assert got == {n: fnmatch.fnmatchcase(n, pattern) for n in names}, pattern


def test_paths(spark):
    rows = ["/d/a.md", "/d/.h/a.md", "/d/b.formatted.md", "/d/c.txt", "/d/x.y/noend", "/d/out/a.md", "/d/e/F.Markdown", "/d/.md", "/d/v.docx"]
    frame = spark.createDataFrame([(p,) for p in rows], "path string")
    kept = {r["path"] for r in paths.targets(frame, ["**/v.*"], skip="/d/out", base="/d").collect()}
    assert kept == {"/d/a.md", "/d/e/F.Markdown"}
    out = {r["path"]: (r["o"], r["m"], r["e"]) for r in frame.select("path", paths.default_output(frame.path).alias("o"), paths.mirrored(frame.path, "/d/e", "r").alias("m"), paths.extracted(frame.path).alias("e")).collect()}
    assert out["/d/a.md"] == ("/d/a.formatted.md", "r/a.md", "/d/a.extracted.md") and out["/d/e/F.Markdown"][1] == "r/F.Markdown"
    assert out["/d/x.y/noend"] == ("/d/x.y/noend.formatted", "r/noend", "/d/x.y/noend.extracted.md")
    said = frame.filter("path = '/d/c.txt'").select(paths.unsupported(frame.path)).first()[0]
    assert "'.txt'" in said and ".docx" in said


def shouting(lines, code):
    """Lines in capitals."""
    return F.transform(F.filter(lines, lambda x: x.rlike("^[A-Z ]+$")), lambda x: issue("no-shouting", "line is in capitals", "warning"))


def test_added_rules_run(spark):
    docs = spark.createDataFrame([(1, "WHY SO LOUD\n")], "doc_id long, source string")
    registry.register_rule("no-shouting", "source", shouting)
    try:
        registry.register_rule("no-shouting", "source", shouting)  # again: nothing
        assert [r["rule"] for r in detect(docs).collect()] == ["no-shouting"]
        assert detect(docs, config=config.Config(rules={"no-shouting": False})).count() == 0
        assert inventory(spark).filter("added").select("rule", "about").collect() == [("no-shouting", "Lines in capitals.")]
        for args in (("no-shouting", "source", len), ("heading-skip", "source", shouting), ("x", "colour", shouting), ("", "cv", shouting), ("x", "cv", None)):
            with pytest.raises(registry.RegistryError):
                registry.register_rule(*args)
    finally:
        assert registry.unregister_rule("no-shouting") and not registry.unregister_rule("no-shouting")
    assert detect(docs).count() == 0


def test_every_issue_is_of_a_listed_rule(spark):
    from pagewright.sources.corpus import markdown_documents

    listed = {r["rule"] for r in inventory(spark).collect()}
    found = {r["rule"] for r in detect(markdown_documents(spark, "/root/testdata/sf0.001"), cv=True).select("rule").distinct().collect()}
    assert len(listed) == 25 and found <= listed and len(found) > 15


def test_adapters_and_plugins(monkeypatch):
    adapter = registry.Adapter("log", (".log",), lambda files: files)
    registry.register_adapter(adapter)
    try:
        with pytest.raises(registry.RegistryError):
            registry.register_adapter(registry.Adapter("log", (".lg",), len))
        registry.register_adapter(registry.Adapter("log", (".lg",), len), replace=True)
        assert [a.extensions for a in registry.registered_adapters()] == [(".lg",)]
        for bad in (registry.Adapter("x", ("log",), len), registry.Adapter("x", (".LOG",), len), registry.Adapter("x", (), len), registry.Adapter("x", (".x",), None)):
            with pytest.raises(registry.RegistryError):
                registry.register_adapter(bad)
    finally:
        assert registry.unregister_adapter("log") and not registry.unregister_adapter("log")

    class Point:
        def __init__(self, name, load):
            self.name, self.load = name, load

    called = []
    monkeypatch.setattr(registry, "entry_points", lambda group: [Point("good", lambda: lambda: called.append(1)), Point("bad", lambda: 1 / 0)])
    assert registry.load_plugins(reload=True) == ["good"] == registry.load_plugins() and called == [1]
    assert registry.plugin_errors() == ["bad: ZeroDivisionError: division by zero"]
