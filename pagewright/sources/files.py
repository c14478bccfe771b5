"""Files of all formats as documents: one row for each file, whatever becomes of it."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.registry import registered_adapters
from pagewright.sources import paths
from pagewright.sources.docx import read_docx
from pagewright.sources.markdown import BLOCK, with_blocks

#: A result row: the folder it was found under, its text if the format has one, its blocks, and why it could not be read.
COLUMNS = f"path string, base string, source string, blocks array<{BLOCK}>, error string"


def formats() -> dict[str, str]:
    """Extensions that are read: those of added formats come before built-in ones."""
    added = {e: a.name for a in reversed(registered_adapters()) for e in a.extensions}
    return paths.FORMATS | added


def listed(spark: SparkSession, entries: Iterable[str], exclude: Iterable[str] = (), skip: str | None = None) -> DataFrame:
    """(path, base, content) of the files that folders and file names stand for.

    Of a folder those files that a run takes; a file that is named is taken as it is, unless
    it is excluded. A file found twice comes once, under the first entry.
    """
    exclude, out = list(exclude), None
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for at, entry in enumerate(entries):
        target = spark._jvm.org.apache.hadoop.fs.Path(entry)
        files = target.getFileSystem(hadoop)
        folder = files.exists(target) and files.getFileStatus(target).isDirectory()
        read = spark.read.format("binaryFile")
        found = (read.option("recursiveFileLookup", "true") if folder else read).load(entry).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
        base = entry.rstrip("/") if folder else str(PurePosixPath(entry).parent)
        base = base.removeprefix("file:") if base.startswith("file:/") else base
        kept = paths.targets(found, exclude, skip, formats(), base) if folder else found.filter(~paths.excluded(F.col("path"), exclude))
        part = kept.select(F.lit(at).alias("at"), "path", F.lit(base).alias("base"), "content")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "path string, base string, content binary")
    several = out.select("path").groupBy("path").count() if at else None
    if several is None:
        return out.drop("at")
    first = out.select("at", "path").groupBy("path").agg(F.min("at").alias("at"))  # names alone are dealt, not contents
    return out.join(first, ["path", "at"], "left_semi").drop("at")


def read_files(files: DataFrame) -> DataFrame:
    """Documents of files (path, base, content): each format by its reader, what has none as an error of its own."""
    own = files.withColumn("format", paths.format_of(F.col("path"), formats()))
    text = F.expr("try_validate_utf8(CAST(content AS STRING))")
    marked = own.filter("format = 'markdown'").select("path", "base", text.alias("source"), F.when(text.isNull(), "the file is not valid UTF-8").alias("bad"))
    blocks = with_blocks(marked.select(F.struct("path", "base", "bad").alias("id"), "source"), "id", keep=("source",), keep_error=True)
    parts = [blocks.select("id.path", "id.base", "source", "blocks", F.coalesce("id.bad", "error").alias("error"))]
    none = F.lit(None).cast("string").alias("source")
    word = own.filter("format = 'docx'")
    parts.append(read_docx(word).join(word.select("path", "base"), "path").select("path", "base", none, "blocks", "error"))
    for adapter in registered_adapters():
        mine = own.filter(F.col("format") == adapter.name)
        made = adapter.read(mine.select("path", "content")).join(mine.select("path", "base"), "path")
        parts.append(made.select("path", "base", "source" if "source" in made.columns else none, "blocks", "error" if "error" in made.columns else F.lit(None).cast("string").alias("error")))
    empty = F.array().cast(f"array<{BLOCK}>").alias("blocks")
    pdf = F.when(F.col("format") == "pdf", "PDF files are read from the tables of an extractor (operators.pdf)")
    rest = own.filter("format is null or format = 'pdf'").select("path", "base", none, empty, F.coalesce(pdf, paths.unsupported(F.col("path"), formats())).alias("error"))
    out = rest
    for part in parts:
        out = out.unionByName(part)
    return out
