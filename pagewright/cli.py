"""Command line: python -m pagewright check | format | rules | templates | fonts.

Reading, rules and writing run in Spark, one file a row; the driver prints and writes
results one after the other. Status: 0 nothing to say, 1 issues or changes, 2 an error
in a file or in what was asked.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import __version__, config, registry, templates
from pagewright.operators.diff import unified
from pagewright.operators.fonts import families, scan_fonts, skipped
from pagewright.operators.formatting import format_blocks, format_documents
from pagewright.plans import detect
from pagewright.plans.inventory import inventory
from pagewright.sources import files, paths
from pagewright.sources.docx import write_docx

CLEAN, ISSUES, ERROR = 0, 1, 2


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="pagewright", description=__doc__.split("\n")[0])
    out.add_argument("--version", action="version", version=__version__)
    commands = out.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--config")
    shared.add_argument("--no-config", action="store_true")
    over = argparse.ArgumentParser(add_help=False, parents=[shared])
    over.add_argument("entries", nargs="+", help="files and folders")
    over.add_argument("--cv", action=argparse.BooleanOptionalAction, help="apply the CV rules to all documents or to none")
    commands.add_parser("check", parents=[over], help="report what is wrong")
    write = commands.add_parser("format", parents=[over], help="write repaired copies")
    write.add_argument("-t", "--template")
    write.add_argument("-o", "--output")
    write.add_argument("--out-dir")
    write.add_argument("--diff", action="store_true", help="show changes and write nothing")
    write.add_argument("-q", "--quiet", action="store_true")
    write.add_argument("--keep-intermediate", action="store_true", help="keep the Markdown between reading and writing")
    commands.add_parser("rules", parents=[shared], help="list the rules")
    commands.add_parser("templates", help="list the presets")
    fonts = commands.add_parser("fonts", help="list the font families of folders")
    fonts.add_argument("folders", nargs="+")
    fonts.add_argument("--cache")
    fonts.add_argument("--family")
    fonts.add_argument("--skipped", action="store_true")
    return out


def _documents(spark: SparkSession, args, own: config.Config) -> DataFrame:
    return files.read_files(files.listed(spark, args.entries, own.exclude, getattr(args, "out_dir", None)))


def check(spark: SparkSession, args) -> int:
    own = config.discover(explicit=args.config, use=not args.no_config)
    docs = _documents(spark, args, own).withColumnRenamed("path", "doc_id").drop("base")
    told = detect.issue_arrays(docs, args.cv, own)
    n = total = failed = 0
    lines = detect.report_lines(F.col("issues"))
    for row in told.select("doc_id", "error", lines.alias("lines"), detect.words(F.col("issues")).alias("summary")).orderBy("doc_id").toLocalIterator():
        n += 1
        if row["error"]:
            failed += 1
            print(f"pagewright: {row['doc_id']}: {row['error']}", file=sys.stderr)
            continue
        total += len(row["lines"])
        print("\n".join([f"{row['doc_id']}: {row['summary']}", *(f"  {line}" for line in row["lines"])]))
    if not n:
        print("pagewright: nothing to check", file=sys.stderr)
    if n > 1:
        print(f"\n{n} file(s), {total} issue(s)")
    return ERROR if failed else ISSUES if total else CLEAN


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one file where Spark's paths lead."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(data))
    stream.close()


def format_files(spark: SparkSession, args) -> int:
    own = config.discover(explicit=args.config, use=not args.no_config)
    template = templates.chosen(args.template, own)
    docs = _documents(spark, args, own).withColumnRenamed("path", "doc_id")
    if (args.output or args.keep_intermediate) and docs.limit(2).count() > 1:
        print("pagewright: -o and --keep-intermediate take a single file; use --out-dir for several", file=sys.stderr)
        return ERROR
    marked = format_documents(docs.filter("source is not null"), template.style).select("doc_id", "formatted", "error")
    made = marked.unionByName(format_blocks(docs.filter("source is null"), template.style))
    path = F.col("doc_id")
    below = F.when(path.startswith(F.concat("base", F.lit("/"))), F.expr("substring(doc_id, length(base) + 2)")).otherwise(paths.name_of(path))
    goal = F.lit(args.output) if args.output else F.concat(F.lit((args.out_dir or "").rstrip("/") + "/"), below) if args.out_dir else paths.default_output(path)
    issues = detect.issue_arrays(docs, args.cv, own).select("doc_id", "issues")
    fixed = F.size(F.filter("issues", lambda x: x["auto_fixable"]))
    rest = detect.report_lines(F.filter("issues", lambda x: ~x["auto_fixable"]))
    rows = docs.select("doc_id", "base", "source", F.col("error").alias("unread")).join(made, "doc_id").join(issues, "doc_id")
    shown = rows.select("doc_id", "source", "formatted", F.coalesce("unread", "error").alias("error"), goal.alias("goal"), paths.extracted(path).alias("kept"), fixed.alias("fixed"), rest.alias("rest"))
    n = changed = failed = 0
    for row in shown.orderBy("doc_id").toLocalIterator():
        n += 1
        if row["error"] or row["goal"] == row["doc_id"]:
            failed += 1
            print(f"pagewright: {row['doc_id']}: {row['error'] or 'the result would replace its source'}", file=sys.stderr)
        elif args.diff:
            word = row["source"] is None
            text = f"would rewrite {row['doc_id']}\n" if word else unified(row["source"], row["formatted"], row["doc_id"])
            changed += bool(text)
            print(text, end="")
        else:
            data = row["formatted"].encode()
            if row["goal"].lower().endswith(".docx"):
                one = spark.createDataFrame([(0, row["formatted"])], "doc_id int, source string")
                data = bytes(write_docx(one, template.fonts).first()["content"])
            _put(spark, row["goal"], data)
            print(f"{row['doc_id']} -> {row['goal']}  [template: {template.name}]\n  {row['fixed']} fixed automatically, {len(row['rest'])} to review")
            if args.keep_intermediate and row["source"] is None:
                _put(spark, row["kept"], row["formatted"].encode())
                print(f"  Markdown kept at {row['kept']}")
            if row["rest"] and not args.quiet:
                print("Needs a look:\n" + "\n".join(f"  {line}" for line in row["rest"]))
    if not n:
        print("pagewright: nothing to format", file=sys.stderr)
    if args.diff:
        print(f"\n{changed} of {n} file(s) would change")
    return ERROR if failed else ISSUES if changed else CLEAN


def rules(spark: SparkSession, args) -> int:
    own = config.discover(explicit=args.config, use=not args.no_config)
    registry.load_plugins()
    print(f"config: {own.source}" if own.source else "no configuration found")
    for r in inventory(spark, own).collect():  # a row for each rule
        print(f"  {' ' if r['enabled'] else '-'} {r['family']:10} {r['rule']:30} {r['about']}{' [' + r['severity'] + ']' if r['severity'] else ''}{' [added]' if r['added'] else ''}")
    for error in registry.plugin_errors():
        print(f"  ! {error}")
    return CLEAN


def list_templates(spark: SparkSession, args) -> int:
    for name in templates.presets():
        print(f"{name:14} {templates.load(name).description}")
    return CLEAN


def list_fonts(spark: SparkSession, args) -> int:
    found = scan_fonts(spark, args.folders, args.cache, coverage=False)
    if args.skipped:
        for r in skipped(found).orderBy("path").collect():
            print(f"{r['path']}: {r['reason']}")
        return CLEAN
    pool = families(found).orderBy("name").collect()
    for r in pool:
        if not args.family or args.family.lower() == r["key"]:
            print(f"{r['name']:30} {r['category']:6} {r['licence']:20} {','.join(r['styles'])}{' pinned' if r['pinned'] else ''}")
    return CLEAN if pool else ISSUES


COMMANDS = {"check": check, "format": format_files, "rules": rules, "templates": list_templates, "fonts": list_fonts}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pagewright").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    registry.load_plugins()
    try:
        return COMMANDS[args.command](spark, args)
    except (config.ConfigError, templates.TemplateError) as error:
        print(f"pagewright: {error}", file=sys.stderr)
        return ERROR
