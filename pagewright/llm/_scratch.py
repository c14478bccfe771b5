"""Shared helpers of the llm operators: scratch tables, Arrow slicing, byte units."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where it is unset and there are no other machines."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = f"file://{tempfile.mkdtemp(prefix='pagewright-')}"
        spark.sparkContext.setCheckpointDir(conf)
        conf = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return conf


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and survives lost executors.

    What :func:`dropped` does not delete before, as results still read it, goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/pw-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, files = _file_system(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._pw_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    target, files = _file_system(df.sparkSession, df._pw_path)
    files.delete(target, True)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh(name: str, columns: Iterable[str]) -> str:
    """The name, with underscores before it until no column has it (whatever the case of its letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def position(value: Column, points: list, kind: str) -> Column:
    """How many of the points, given in order, are below the value: a binary search, whose plan does not grow with them.

    kind: the type of a point as SQL; points of structs are dictionaries.
    """
    table = F.from_json(F.lit(json.dumps(points)), f"array<{kind}>")  # folded to one literal
    ends = lambda low, high: F.struct(low.alias("low"), high.alias("high"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        halved = F.when(value > F.get(table, mid), ends(mid + 1, acc["high"])).otherwise(ends(acc["low"], mid))
        return F.when(acc["low"] >= acc["high"], acc).otherwise(halved)

    start = ends(F.lit(0), F.lit(len(points)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(points).bit_length())), start, step, lambda acc: acc["low"])


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make):
    """What a worker keeps from one task to the next: of one operator at a time, so memory stays bounded by that one."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def as_binary(column: pa.Array) -> pa.Array:
    """String (or large string) column as binary without copying the bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def slices(batch: pa.RecordBatch, text_at: int, limit: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch into runs of rows of about ``limit`` text bytes (one row at least); null text is empty."""
    column = as_binary(batch.column(text_at))
    start = size = 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start), [x or b"" for x in column.slice(start, i - start).to_pylist()]
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start), [x or b"" for x in column.slice(start).to_pylist()]
