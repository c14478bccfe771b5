"""What formatting would change: a unified diff of each document."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.formatting import Style, format_documents


def unified(before: str, after: str, name: str) -> str:
    """The diff of two texts; empty if they are equal."""
    return "".join(difflib.unified_diff(before.splitlines(keepends=True), after.splitlines(keepends=True), name, f"{name} (formatted)"))


def diffs(docs: DataFrame, style: Style = Style(), id_col: str = "doc_id") -> DataFrame:
    """The id and ``diff`` of the documents that formatting changes. Map only; unchanged ones go before Python sees them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [unified(a or "", b, str(i)) for i, a, b in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.string())], names=[id_col, "diff"])

    kind = docs.schema[id_col].dataType.simpleString()
    changed = format_documents(docs, style, id_col, keep_source=True).filter(F.col("changed") & F.col("formatted").isNotNull())
    return changed.select(id_col, "source", "formatted").mapInArrow(run, f"`{id_col}` {kind}, diff string")
