"""WARC records, and resolution of not-modified revisits (operator 3).

Method: an as-of join by canonical URL. A revisit takes the latest earlier full
response of its URL; its validators are checked against that response's (entity tags
weakly, else the modification date), and the stored response's headers are updated by
those that a not-modified reply may carry.

The join is two windows: within ranges of time of one URL, and over one row for each
URL and range that carries the last response of the ranges before. So a URL with a third
of all records is spread over as many tasks as there are ranges. Payloads take no part.

Defined results for odd input: records without URL or time, and revisits without a
validator, are not resolved but reported; a time given as text is read as a time, and one
that cannot be read counts as none; of records of one time the lower id is the
earlier; equal ids and times: neither is earlier than the other for a repeated row, which
is reported again; a null header map is empty; an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm._scratch import position

#: Header fields that a not-modified reply may update (RFC 9110, section 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: Column) -> Column:
    """Lower-case host without "www.", no scheme, default port, fragment, tracking parameters or final slash."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*(.*)$", 1), "([?&])(utm_[a-z]+|ref|gclid|fbclid)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "[?]&+", "?"), "&+", "&"), "[?&]$", "")
    return F.concat(F.regexp_replace(host, "^www[.]", ""), F.regexp_replace(rest, "/$", ""))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row for each revisit: record_id, canonical_url, refers_to, status, headers.

    records: (record_id, warc_type, url, ts, etag, last_modified, headers map), other
    columns are ignored. status: resolved, no_original, no_validator, validator_mismatch
    or incomplete (no URL or time). headers: the merged map if resolved, else null.
    """
    spark = records.sparkSession
    if isinstance(records.schema["ts"].dataType, T.StringType):
        records = records.withColumn("ts", F.try_to_timestamp("ts"))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = records.filter(F.col("warc_type").isin("response", "revisit")).select("record_id", "warc_type", canonical_url(F.col("url")).alias("canonical_url"), "ts", "etag", "last_modified", "headers")
    # ranges need the order of times alone, which numbers keep
    at = F.unix_micros("ts") if isinstance(records.schema["ts"].dataType, T.TimestampType) else F.col("ts")
    splits = records.agg(F.percentile_approx(at.cast("double"), [i / ranges for i in range(1, ranges)] or [0.5], 10_000).alias("q")).first()["q"] or []
    full = F.when(F.col("warc_type") == "response", F.struct("record_id", "etag", "last_modified", "headers"))
    placed = rows.withColumn("part", position(at.cast("double"), sorted(set(splits)), "double")).withColumn("full", full)
    good = placed.filter("canonical_url is not null and ts is not null")
    order = Window.partitionBy("canonical_url", "part").orderBy("ts", "record_id")
    own = good.withColumn("near", F.last("full", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).filter("warc_type = 'revisit'")
    ends = good.groupBy("canonical_url", "part").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.struct("ts", "record_id"))).alias("end"))
    before = ends.withColumn("carried", F.last("end", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("end").filter("carried is not null")
    met = own.join(before, ["canonical_url", "part"], "left").withColumn("original", F.coalesce("near", "carried"))
    lost = placed.filter("warc_type = 'revisit' and (canonical_url is null or ts is null)").select("record_id", "canonical_url", F.lit(None).cast(records.schema["record_id"].dataType).alias("refers_to"), F.lit("incomplete").alias("status"), F.lit(None).cast("map<string,string>").alias("headers"))
    by_tag = F.col("etag").isNotNull() & F.col("original.etag").isNotNull()
    by_date = F.col("last_modified").isNotNull() & F.col("original.last_modified").isNotNull()
    status = (
        F.when(F.col("original").isNull(), "no_original")
        .when(by_tag, F.when(_tag(F.col("etag")) == _tag(F.col("original.etag")), "resolved").otherwise("validator_mismatch"))
        .when(by_date, F.when(F.col("last_modified") == F.col("original.last_modified"), "resolved").otherwise("validator_mismatch"))
        .otherwise("no_validator")
    )
    empty = F.create_map().cast("map<string,string>")
    news = F.map_filter(F.coalesce("headers", empty), lambda k, v: F.lower(k).isin(PERMITTED) & v.isNotNull())
    names = F.transform(F.map_keys(news), F.lower)
    stored = F.map_filter(F.coalesce("original.headers", empty), lambda k, v: ~F.array_contains(names, F.lower(k)))
    merged = F.map_concat(stored, news)
    out = met.withColumn("status", status)
    return out.select("record_id", "canonical_url", F.col("original.record_id").alias("refers_to"), "status", F.when(F.col("status") == "resolved", merged).alias("headers")).unionByName(lost)


def header_text(headers: Column) -> Column:
    """A header map as sorted lines "name: value", joined by "|"; names in lower case."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(F.lower(e["key"]), F.lit(": "), e["value"]))), "|")


# --- WARC files --------------------------------------------------------------------


def write_record(warc_type: str, url: str, date: str, record_id: str, body: bytes, extra: dict[str, str] | None = None, compress: bool = True) -> bytes:
    """One record of a WARC 1.1 file, as a gzip member of its own unless compress is off."""
    kind = "application/http; msgtype=response"
    head = {"WARC-Type": warc_type, "WARC-Target-URI": url, "WARC-Date": date, "WARC-Record-ID": record_id, "Content-Type": kind, **(extra or {}), "Content-Length": str(len(body))}
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"
    return gzip.compress(raw, mtime=0) if compress else raw


def _fields(stream: io.BufferedIOBase) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    while (line := stream.readline()).strip():
        if line[:1] in b" \t" and last:  # folded
            out[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, _, value = line.decode("utf-8", "replace").partition(":")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def _record(head: dict[str, str], body: bytes) -> dict:
    http, status = {}, None
    if head.get("content-type", "").startswith("application/http"):
        inner = io.BytesIO(body)
        first = inner.readline().split(None, 2)
        status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
        http = _fields(inner)
        body = inner.read()
    return {"record_id": head.get("warc-record-id"), "warc_type": head.get("warc-type"), "url": head.get("warc-target-uri"), "ts": head.get("warc-date"), "status_code": status, "etag": http.get("etag"), "last_modified": http.get("last-modified"), "headers": http, "payload": body}


def _plain_records(data: bytes) -> Iterator[dict]:
    """The records of uncompressed data; after a broken one reading goes on at the next line that starts a record."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        stream = io.BytesIO(data)
        stream.seek(at)
        good = data[at : at + 5] == b"WARC/"
        if good:
            stream.readline()
            head = _fields(stream)
            size = head.get("content-length", "")
            good = size.isdigit() and stream.tell() + int(size) <= len(data)
        if not good:
            yield {"warc_type": "broken"}
            following = data.find(b"\nWARC/", at + 1)
            at = following + 1 if following >= 0 else len(data)
            continue
        yield _record(head, stream.read(int(size)))
        at = stream.tell()


_MEMBER = b"\x1f\x8b\x08"


def read_records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file. A broken one is reported as type ``broken``, and reading goes on at the next
    record or gzip member that can be read."""
    if data[:2] != _MEMBER[:2]:
        yield from _plain_records(data)
        return
    at = 0
    while 0 <= at < len(data):
        inflate = zlib.decompressobj(31)
        try:
            plain = inflate.decompress(data[at:] if at else data)
            whole = inflate.eof
        except zlib.error:
            plain, whole = b"", False
        if whole:
            yield from _plain_records(plain)
            at = data.find(_MEMBER, len(data) - len(inflate.unused_data)) if inflate.unused_data else len(data)
        else:
            yield {"warc_type": "broken"}
            at = data.find(_MEMBER, at + 1)


_FIELDS = "record_id string, warc_type string, url string, ts string, status_code int, etag string, last_modified string, headers map<string,string>, payload binary"
RECORD_SCHEMA = _FIELDS.replace("ts string", "ts timestamp")
_NAMES = [f.strip().split(" ")[0] for f in _FIELDS.split(", ")]
#: What ends a record and starts the next; a reader of lines that end so cuts files of any size into records.
_BETWEEN = "\r\n\r\nWARC/"


def _batches(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about 8 MB of payload."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r.get("payload") or b"") + 200
        if size > 8 << 20:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(held: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int32() if n == "status_code" else pa.binary() if n == "payload" else pa.map_(pa.string(), pa.string()) if n == "headers" else pa.string() for n in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "headers" and r.get(n) is not None else r.get(n) for r in held], kind) for n, kind in zip(_NAMES, kinds, strict=True)], names=_NAMES)


def _joined(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of pieces: one that is shorter than it says goes on in the next piece, unless that starts a record."""
    held, need = b"", 0
    for piece in pieces:
        piece = piece if piece.startswith(b"WARC/") else b"WARC/" + piece  # the reader takes the mark away
        start = _START.match(piece)
        if held and not start and len(held) < need:
            held += b"\r\n\r\n" + piece
            continue
        if held:
            yield held
        size = _LENGTH.search(piece[: start.end()]) if start else None
        held, need = piece, start.end() + int(size[1]) if size else 0
    if held:
        yield held


#: The head of a record, and its length.
_START = re.compile(rb"WARC/\d[\d.]*\r\n(?:[^\r\n]+\r\n)*?WARC-Type:(?:[^\r\n]+\r\n)+\r\n", re.I)
_LENGTH = re.compile(rb"\r\nContent-Length:\s*(\d+)\s*\r\n", re.I)


def read_warc(spark: SparkSession, path: str, recover: bool = False) -> DataFrame:
    """The records of WARC files, with times as timestamps. Broken records come as type ``broken``.

    Files are read as a stream of records: a plain file in as many ranges as Spark cuts
    it into, a gzip file by one task, of whatever size. (A payload that itself holds whole
    WARC records is taken apart, and its own record comes as broken.) A damaged gzip member fails the
    job, as nothing may be dropped in silence; with ``recover`` files are read whole (so
    up to 2 GB each) and reading goes on at the next member.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield from _batches(read_records(data.as_py()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (value.as_py() for batch in batches for value in batch.column(0))
        yield from _batches(r for data in _joined(pieces) for r in _plain_records(data + b"\r\n\r\n"))

    if recover:
        found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(whole, _FIELDS)
    else:
        found = spark.read.text(path, lineSep=_BETWEEN).select(F.col("value").cast("binary")).filter("octet_length(value) > 0").mapInArrow(cut, _FIELDS)
    return found.withColumn("ts", F.try_to_timestamp("ts"))
