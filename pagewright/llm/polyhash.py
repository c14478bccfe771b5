"""Document fingerprints from prefix polynomial hashes (operator 2).

Method: modular prefix arrays of a text answer the hash of any span, so equality of
any two spans, and the longest common extension of two positions by binary search.
The fingerprint of a text has its length, the hash of the whole, and for windows
(spans) of two fixed lengths the least hash in each of a number of bins. Two texts'
likeness is the share of text in common that the agreeing bins show (Dice).

Defined results for odd input: null text counts as empty; a text shorter than a
window is one window; documents of equal id follow one another by a hash of the text, null ids
come last; a single row is followed by itself; an empty table gives an empty result;
repeated rows each give a row; other columns are ignored; texts of any length are
taken whole, in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm._scratch import position, slices

#: Two primes under 2**28 and a base for each.
MODULI = ((268435399, 91648253), (268435367, 203746621))
#: Code points whose prefix array is kept together.
BLOCK = 1 << 16
#: Window lengths in code points and their bins. Two texts are compared by the long one
#: if both have LONG_FROM code points, or one has FINE_TO (and so no bins of the short one).
COARSE, FINE = (24, 96), (6, 32)
LONG_FROM, FINE_TO = 200, 800
EMPTY = 0xFFFF


def _mod(x: np.ndarray, p: int) -> np.ndarray:
    p = np.uint64(p)
    return x - (x // p) * p


def _powers(base: int, p: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, power = 1, base
    while done < n:  # doubles the known part
        take = min(done, n - done)
        out[done : done + take] = _mod(out[:take] * np.uint64(power), p)
        done, power = done + take, power * power % p
    return out


class _Tables:
    """Powers of each base and of its inverse."""

    def __init__(self):
        n = BLOCK + 64
        self.up = [_powers(b, p, n) for p, b in MODULI]
        self.down = [_powers(pow(b, -1, p), p, n) for p, b in MODULI]
        self.step = [pow(b, BLOCK, p) for p, b in MODULI]


_TABLES: list[_Tables] = []


def _tables() -> _Tables:
    if not _TABLES:
        _TABLES.append(_Tables())
    return _TABLES[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class PrefixHash:
    """Prefix arrays of one text, in blocks, for each modulus."""

    def __init__(self, text: str):
        t, points = _tables(), code_points(text)
        self.n = len(points)
        self.local: list[list[np.ndarray]] = [[], []]
        self.base: list[list[int]] = [[0], [0]]
        self.points = points
        for m, (p, _) in enumerate(MODULI):
            scale = 1
            for at in range(0, self.n, BLOCK):
                part = points[at : at + BLOCK].astype(np.uint64) + np.uint64(1)
                sums = np.empty(len(part) + 1, np.uint64)
                sums[0] = 0
                np.cumsum(_mod(part * t.up[m][: len(part)], p), out=sums[1:])
                self.local[m].append(sums)
                self.base[m].append((self.base[m][-1] + int(sums[-1]) % p * scale) % p)
                scale = scale * t.step[m] % p

    def prefix(self, i: int, m: int = 0) -> int:
        """Hash of the first i code points under one modulus."""
        k, r = divmod(i, BLOCK)
        if not r:
            return self.base[m][k]
        p = MODULI[m][0]
        return (self.base[m][k] + int(self.local[m][k][r]) % p * pow(_tables().step[m], k, p)) % p

    def span(self, i: int, j: int) -> int:
        """Hash of the code points from i to j, the same wherever the span stands."""
        out = 0
        for m, (p, b) in enumerate(MODULI):
            out = out << 28 | (self.prefix(j, m) - self.prefix(i, m)) * pow(b, -i, p) % p
        return out

    def whole(self) -> int:
        return self.base[0][-1] << 28 | self.base[1][-1]

    def common(self, other: "PrefixHash", i: int = 0, j: int = 0) -> int:
        """Length of the longest common extension of position i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        equal = (lambda k: all(self.prefix(k, m) == other.prefix(k, m) for m in (0, 1))) if i == j == 0 else (lambda k: self.span(i, i + k) == other.span(j, j + k))
        while low < high:
            mid = (low + high + 1) // 2
            if equal(mid):
                low = mid
            else:
                high = mid - 1
        return low

    def windows(self, width: int) -> Iterator[np.ndarray]:
        """Hashes of all spans of a width, block by block (one span if the text is shorter)."""
        if self.n <= width:
            yield np.array([self.whole()], np.uint64)
            return
        t = _tables()
        for k in range(len(self.local[0])):
            out = None
            for m, (p, _) in enumerate(MODULI):
                sums = self.local[m][k]
                if k + 1 < len(self.local[m]):  # windows that reach into the next block
                    more = self.points[(k + 1) * BLOCK : (k + 1) * BLOCK + width - 1].astype(np.uint64) + np.uint64(1)
                    tail = np.cumsum(_mod(more * t.up[m][BLOCK : BLOCK + len(more)], p))
                    sums = np.concatenate((sums, sums[-1] + tail))
                if len(sums) <= width:
                    break
                h = _mod((sums[width:] - sums[:-width]) * t.down[m][: len(sums) - width], p)
                out = h if out is None else out << np.uint64(28) | h
            if out is not None:
                yield out

    def sketch(self) -> np.ndarray:
        """The least hash of each bin, 16 bits, for both window lengths."""
        parts = []
        for width, bins in (COARSE, FINE):
            least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
            for h in self.windows(width) if width == COARSE[0] or self.n < FINE_TO else ():
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
                bin_ = ((h & np.uint64(0xFFFF)) * np.uint64(bins) >> np.uint64(16)).astype(np.intp)
                np.minimum.at(least, bin_, h >> np.uint64(16))
            parts.append(least)
        return np.concatenate(parts)


def fingerprint(prefixes: PrefixHash) -> str:
    """Length, whole hash and sketch as hexadecimal digits."""
    least = prefixes.sketch()
    top = np.iinfo(np.uint64).max
    kept = np.where(least == top, np.uint64(EMPTY), (least * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)) % np.uint64(EMPTY)).astype(">u2")
    return f"{prefixes.n:08x}{prefixes.whole():014x}{kept.tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Share of text that two fingerprints' texts have in common, from 0 to 1; 1 for equal ones."""
    if a == b:
        return 1.0
    short, long = sorted((int(a[:8], 16), int(b[:8], 16)))
    x, y = (np.frombuffer(bytes.fromhex(s[22:]), ">u2") for s in (a, b))
    part = slice(0, COARSE[1]) if short >= LONG_FROM or long >= FINE_TO else slice(COARSE[1], None)
    x, y = x[part], y[part]
    some = (x != EMPTY) | (y != EMPTY)
    jaccard = np.count_nonzero(some & (x == y)) / max(1, np.count_nonzero(some))
    return 2 * jaccard / (1 + jaccard)


def edited(text: str, other: str) -> str:
    """The text with its last half (rounded down) replaced by the start of the other, as long or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


#: Rows of the sample from which split points come, for each partition.
SAMPLED = 50


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, ghost), each partition in descending order of id and closed by the row that follows its last.

    Rows are ordered by id, then by a hash of the text, then by where they stand in the
    input (which only rows of equal id and text need), and cut into ranges of about
    equally many rows, one for each shuffle partition: neither rows without id nor those
    of one id or text come to one range. Each range gets a copy of the first row of the
    range after it (the last range: of the first one). One shuffle of the texts; only a
    bounded sample of keys, and one for each partition, come to the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the same in every job over the same input; nulls are least, so they come last
    rows = rows.withColumn("key", F.struct(F.col("id").alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("n")))
    n = df.count()
    share = min(1.0, SAMPLED * parts / max(1, n))
    sample = sorted((tuple(r["key"]) for r in rows.select("key").filter(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1_000_000)) / 1e6 < share).collect()), key=_nulls_first)
    splits = [sample[i * len(sample) // parts] for i in range(1, parts)] if sample else []
    splits = [k for at, k in enumerate(splits) if not at or k != splits[at - 1]]
    points = [{"i": i, "h": h, "n": n} for i, h, n in splits]
    bucket = (F.lit(len(splits)) - position(F.col("key"), points, f"struct<i:{kind},h:bigint,n:bigint>")).cast("int")
    firsts = sorted((r["bucket"], tuple(r["key"])) for r in rows.select("key", bucket.alias("bucket")).groupBy("bucket").agg(F.max("key").alias("key")).collect())
    ghosts = [(*first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    # a row for each partition
    ghost = F.broadcast(spark.createDataFrame(ghosts, f"gi {kind}, gh long, gn long, target int"))
    row = lambda b, ghost: F.struct(b.alias("b"), F.lit(ghost).alias("ghost"))
    same = (F.col("key.n") == F.col("gn")) & (F.col("key.h") == F.col("gh")) & F.col("key.i").eqNullSafe(F.col("gi"))
    return (
        rows.withColumn("bucket", bucket)
        .join(ghost, same, "left")
        .select("id", "text", "key", F.explode(F.when(F.col("target").isNull(), F.array(row(F.col("bucket"), False))).otherwise(F.array(row(F.col("bucket"), False), row(F.col("target"), True)))).alias("x"))
        .select("id", "text", "key", F.col("x.ghost").alias("ghost"), F.col("x.b").alias("b"))
        .repartitionById(len(splits) + 1, F.col("b"))
        .sortWithinPartitions("ghost", F.col("key").desc())
        .select("id", "text", "ghost")
    )


def _nulls_first(key: tuple) -> tuple:
    return (key[0] is not None, *key) if key[0] is not None else (False, 0, *key[1:])


def edit_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses (also to the next document's).

    shared_prefix is the longest common extension of both texts' starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part, texts in slices(batch, 1):
                ids, closed = part.column(0).to_pylist(), part.column(2).to_pylist()
                out = []
                for id_, raw, ghost in zip(ids, texts, closed, strict=True):
                    if ghost and held is None:
                        continue
                    text = raw.decode()
                    own = PrefixHash(text)
                    print_ = fingerprint(own)
                    if held is not None:
                        before, its, its_hash, its_print = held
                        new = edited(its, text)
                        new_hash = PrefixHash(new)
                        new_print = fingerprint(new_hash)
                        out.append((before, len(its), hashlib.sha256(new.encode()).hexdigest(), its_print, new_print, likeness(its_print, new_print), likeness(its_print, print_), its_hash.common(new_hash)))
                    held = None if ghost else (id_, text, own, print_)
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, [part.schema.field(0), *_FIELDS], strict=True)], schema=pa.schema([part.schema.field(0).with_name(id_col), *_FIELDS]))

    kind = df.schema[id_col].dataType.simpleString()
    return with_next(df, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_prefix long")


_FIELDS = [
    pa.field("n_chars", pa.int64()),
    pa.field("edited_sha256", pa.string()),
    pa.field("fingerprint", pa.string()),
    pa.field("edited_fingerprint", pa.string()),
    pa.field("near_edited", pa.float64()),
    pa.field("near_next", pa.float64()),
    pa.field("shared_prefix", pa.int64()),
]
