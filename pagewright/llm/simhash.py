"""SimHash fingerprints and near duplicates by tiled exact comparison (operator 7).

Method: each bit of a fingerprint is the majority of that bit over the hashes of all
word shingles. Distinct fingerprints are dealt into tiles by population count. First
each tile is compared with itself, which gives every fingerprint the root of its group
there; then each pair of tiles whose counts come within the radius. Both compare cells
(fingerprints of equal counts in each half) by numpy exclusive-or and bit counts, and
skip cell pairs whose counts differ beyond the radius. The comparison is exact and has
no cap. A pair of tiles returns links between roots alone, as trees of bounded fan-out:
no group of copies is expanded into pairs or repeated for every pair of tiles, and no
node becomes hot. Components follow by contraction of those trees, in rounds that grow
with the logarithm of the longest path, each written to the shared folder.

The work of the comparison grows with the square of the number of distinct
fingerprints (less what counts exclude); all other parts grow with the rows.

Defined results for odd input: null and blank texts have the fingerprint zero, linked
like any other; null ids take part, but a component's id is the least id that is not
null; equal rows share a component; an empty table gives an empty result; other columns
are ignored; texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm._scratch import dropped, kept, slices, written

#: Shingles hashed at once.
CHUNK = 1 << 16
#: Most and fewest fingerprints of a tile.
TILE, LEAST_TILE, TILES = 32768, 1024, 8
#: Radius up to which rows are compared by cells of equal counts.
CELL_RADIUS = 8
#: Children of a node in the trees of links.
FAN_OUT = 16
SEED = 42


_SHIFTS = np.arange(8, dtype=np.uint64)[:, None]
_LANES = np.uint64(0x0101010101010101)


def _mixed(h: np.ndarray, w: int) -> np.ndarray:
    """Further 64 bits of a hash; the hash itself for the word 0."""
    if not w:
        return h
    h = h + np.uint64(w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(text: bytes, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, CHUNK at once; the whole of a text of fewer words is one shingle."""
    parts = text.lower().split()  # of bytes: A-Z alone, and ASCII white space
    if not parts:
        return
    data = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - shingle + 1)
    starts, ends, hash_ = starts[:n], ends[-n:], xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        yield np.array([hash_(data[s:e], seed) for s, e in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)], np.uint64)


def shingle_set(text: bytes, shingle: int, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_hashes(text, shingle, seed)]))


def _counts(chunks: Iterable[np.ndarray], words: int) -> tuple[np.ndarray, int]:
    """How often each bit, the highest first, is set over the hashes, for each 64-bit word; and how many hashes there are."""
    total, n = np.zeros((words, 8, 8), np.int64), 0  # word, byte from the lowest, bit from the lowest
    for h in chunks:
        n += len(h)
        cuts = np.arange(0, len(h), 255)  # so many ones fit the eight counters of a number
        for w in range(words):
            sums = np.add.reduceat((_mixed(h, w) >> _SHIFTS) & _LANES, cuts, axis=1)
            total[w] += sums.astype("<u8", copy=False).view(np.uint8).reshape(8, -1, 8).sum(1, dtype=np.int64).T
    return total[:, ::-1, ::-1].reshape(-1), n


def fingerprint(text: bytes, shingle: int = 4, words: int = 1, seed: int = SEED, distinct: bool = False) -> np.ndarray:
    """The fingerprint of a text as 64-bit words, the highest bit first; with ``distinct`` repeated shingles count once."""
    chunks = _hashes(text, shingle, seed)
    if distinct:
        own = shingle_set(text, shingle, seed)
        chunks = (own[at : at + CHUNK] for at in range(0, len(own), CHUNK))
    counts, n = _counts(chunks, words)
    bits = counts * 2 > n
    return np.packbits(bits.reshape(words, 64), axis=1).view(">u8").reshape(words).astype(np.uint64)


def fingerprints(df: DataFrame, shingle: int = 4, words: int = 1, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """The id and fp (array of long, as signed numbers) of every whole text. Map only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("simhash",), dict)  # frees what other operators have left in this worker
        for batch in batches:
            for part, texts in slices(batch, 1):
                found = np.array([fingerprint(t, shingle, words, distinct=distinct) for t in texts], np.uint64).view(np.int64)
                fp = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, words), pa.int32()), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), fp], names=[id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fp array<bigint>")


class Forest:
    """Connected nodes 0 to n - 1, joined by arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def trees(self) -> tuple[np.ndarray, np.ndarray]:
        """Each component as a tree of FAN_OUT children a node: pairs of nodes."""
        order = np.argsort(self.root, kind="stable")
        root = self.root[order]
        first = np.concatenate(([True], root[1:] != root[:-1])) if len(root) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(root)), 0))
        place = np.arange(len(root)) - start
        child = place > 0
        return order[child], order[(start + (place - 1) // FAN_OUT)[child]]


def link_tiles(a: np.ndarray, b: np.ndarray | None, radius: int, forest: Forest) -> int:
    """Join fingerprints within the radius: rows of a (nodes from 0 on) with rows of b (the nodes after), or of a among themselves.

    Both have shape (n, words). Returns how many pairs were compared.
    """
    if not len(a) or (b is not None and not len(b)):  # a tile by hash may be empty
        return 0
    ours, theirs = _Cells(a), _Cells(a if b is None else b)
    base, compared = 0 if b is None else len(a), 0
    for lo, hi, ranges in ours.blocks(theirs, radius) if radius > CELL_RADIUS else ours.cells(theirs, radius):
        for s, e in ranges:
            if b is None:
                s = max(s, lo)  # each pair once
            for at in range(lo, hi, 64):
                end = min(hi, at + 64)
                for s0 in range(s, e, 4096):  # so much fits a processor's cache
                    e0 = min(e, s0 + 4096)
                    x, y = _near(ours.rows[at:end], theirs.rows[s0:e0], radius)
                    compared += (end - at) * (e0 - s0)
                    if len(x):
                        forest.join(ours.order[at + x], theirs.order[s0 + y] + base)
    return compared


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs within the radius.

    The first words alone exclude most pairs: as many of them are compared for all pairs
    as make a distance over the radius likely; the rest is looked at where those leave a chance.
    """
    first = min(a.shape[1], radius // 24 + 1)
    apart = np.bitwise_count(a[:, 0, None] ^ b[None, :, 0])
    if first > 3:
        apart = apart.astype(np.uint16)
    for w in range(1, first):
        apart = apart + np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    x, y = np.nonzero(apart <= radius)
    if a.shape[1] > first and len(x):
        far = np.bitwise_count(a[x] ^ b[y]).sum(1, dtype=np.int64)
        x, y = x[far <= radius], y[far <= radius]
    return x, y


class _Cells:
    """Fingerprints in order of the population counts of both halves."""

    def __init__(self, rows: np.ndarray):
        half = rows.shape[1] * 32
        if rows.shape[1] == 1:
            self.low = np.bitwise_count(rows[:, 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            self.high = np.bitwise_count(rows[:, 0] >> np.uint64(32)).astype(np.int64)
        else:
            counts = np.bitwise_count(rows).astype(np.int64)
            self.low, self.high = counts[:, : rows.shape[1] // 2].sum(1), counts[:, rows.shape[1] // 2 :].sum(1)
        self.wide = half * 2 + 1
        key = self.low * self.wide + self.high
        self.order = np.argsort(key, kind="stable")
        self.rows, self.key = rows[self.order], key[self.order]

    def cells(self, other: "_Cells", radius: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """Rows of equal counts, and the rows of the other whose counts come within the radius."""
        keys, starts = np.unique(self.key, return_index=True)
        for key, s, e in zip(keys.tolist(), starts.tolist(), [*starts[1:].tolist(), len(self.key)], strict=True):
            low, high = divmod(key, self.wide)
            left = [(there, radius - abs(there - low)) for there in range(max(0, low - radius), low + radius + 1)]
            yield s, e, [other.range(there, high - n, high + n) for there, n in left]

    def blocks(self, other: "_Cells", radius: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """The same for a wide radius: blocks of rows, and the others by the count of the low half alone."""
        for s in range(0, len(self.key), 256):
            e = min(len(self.key), s + 256)
            low, high = int(self.key[s] // self.wide), int(self.key[e - 1] // self.wide)
            yield s, e, [(other.range(max(0, low - radius), 0, 0)[0], other.range(high + radius, 0, self.wide)[1])]

    def range(self, low: int, high: int, upto: int) -> tuple[int, int]:
        """Rows of a low count whose high count lies between two."""
        s = np.searchsorted(self.key, low * self.wide + max(0, high), "left")
        return int(s), int(np.searchsorted(self.key, low * self.wide + min(upto, self.wide - 1), "right"))


def _dealt(nodes: DataFrame, radius: int) -> DataFrame:
    """Each distinct fingerprint with its tile, how many tiles there are, and the ranges of tiles whose counts come within the radius.

    Tiles are numbered by count, so the later ones that a tile meets are those up to
    ``last``, and the earlier ones those from ``first``. All are looked up by count: no
    table of tiles or of their pairs is made.
    """
    weight = F.aggregate("fp", F.lit(0), lambda s, x: s + F.bit_count(x))
    counted = nodes.withColumn("weight", weight)
    histogram = sorted((r["weight"], r["count"]) for r in counted.groupBy("weight").count().collect())  # bits + 1 rows at most
    total = sum(n for _, n in histogram)
    size = min(TILE, max(LEAST_TILE, -(-total // TILES)))
    # ranges of counts of about one tile, or several tiles (by hash) of a single count
    ranges: list[list[int]] = []  # least and most count, tiles, rows
    for weight_, n in histogram:
        if ranges and ranges[-1][3] + n <= size:
            ranges[-1][1], ranges[-1][3] = weight_, ranges[-1][3] + n
        else:
            ranges.append([weight_, weight_, max(1, -(-n // size)), n])
    starts = [0]
    for _, _, k, _ in ranges:
        starts.append(starts[-1] + k)
    tables: dict[str, list] = {"at": [], "of": [], "first": [], "last": []}
    for w, _ in histogram:
        own = next(i for i, (lo, hi, _, _) in enumerate(ranges) if lo <= w <= hi)
        lo, hi, k, _ = ranges[own]
        met = [i for i, (l, h, _, _) in enumerate(ranges) if l - hi <= radius and lo - h <= radius]
        for name, value in (("at", starts[own]), ("of", k), ("first", starts[met[0]]), ("last", starts[met[-1] + 1] - 1)):
            tables[name] += [F.lit(w), F.lit(value)]
    pick = lambda name: F.element_at(F.create_map(*(tables[name] or [F.lit(0), F.lit(0)])), F.col("weight"))
    tile = (pick("at") + F.pmod(F.xxhash64("fp"), pick("of"))).cast("int")
    return counted.select(*nodes.columns, tile.alias("tile"), F.lit(max(1, starts[-1])).alias("tiles"), pick("first").alias("first"), pick("last").alias("last"))


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """Fingerprints of a column, of shape (n, words)."""
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1).view(np.uint64)


def _within(dealt: DataFrame, radius: int) -> DataFrame:
    """The dealt fingerprints, each with the root of its group: one of those that links inside its tile connect."""

    def compare(tile: pa.Table) -> pa.Table:
        forest = Forest(len(tile))
        link_tiles(_words(tile["fp"]), None, radius, forest)
        return tile.append_column("root", tile["fp"].take(pa.array(forest.root)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.groupBy("tile").applyInArrow(compare, f"{schema}, root array<bigint>")


def _between(groups: DataFrame, radius: int) -> DataFrame:
    """Trees of links (a, b) between roots, for each pair of tiles: a group comes once, however many of its members link."""

    def compare(pair: pa.Table) -> pa.Table:
        pair = pair.sort_by("side")
        _, first, group = np.unique(_words(pair["root"]), axis=0, return_index=True, return_inverse=True)
        forest, cut = Forest(len(pair)), int((pair["side"].to_numpy() == 0).sum())
        forest.root = first[group.reshape(-1)]
        rows = _words(pair["fp"])
        link_tiles(rows[:cut], rows[cut:], radius, forest)
        joined = Forest(len(first))
        _, least, of = np.unique(forest.root[first], return_index=True, return_inverse=True)
        joined.root = least[of]
        x, y = joined.trees()
        return pa.table({"a": pair["root"].take(pa.array(first[x])), "b": pair["root"].take(pa.array(first[y]))})

    pair = lambda i, j, side: F.struct((i.cast("long") * F.col("tiles") + j).alias("pair"), F.lit(side).alias("side"))
    none = F.array().cast("array<struct<pair:bigint,side:int>>")
    later = F.when(F.col("last") > F.col("tile"), F.transform(F.sequence(F.col("tile") + 1, "last"), lambda j: pair(F.col("tile"), j, 0))).otherwise(none)
    earlier = F.when(F.col("first") < F.col("tile"), F.transform(F.sequence("first", F.col("tile") - 1), lambda i: pair(i, F.col("tile"), 1))).otherwise(none)
    spread = groups.select("fp", "root", F.explode(F.concat(later, earlier)).alias("p")).select("fp", "root", "p.*")
    return spread.groupBy("pair").applyInArrow(compare, "a array<bigint>, b array<bigint>")


def components(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(fp, component): the least value among the fingerprints that the edges connect, for those with edges.

    edges: (a, b), any number and order; values: (fp, value). In each round every node
    takes the least of its neighbours and then that one's own, all edges move to what
    their ends have taken, and those within one node go. Paths shrink by a constant share
    a round, so rounds grow with the logarithm of the longest one.
    """
    links = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels = written(links.select(F.col("a").alias("fp")).unionByName(links.select(F.col("b").alias("fp"))).distinct().select("fp", F.col("fp").alias("root")), "labels")
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = written(both.groupBy("node").agg(F.min("other").alias("heard")).select("node", F.least("node", "heard").alias("to")), "least")
        taken = written(least.select("node", F.col("to").alias("via")).join(least.select(F.col("node").alias("via"), "to"), "via").select("node", "to"), "taken")
        named = taken.select(F.col("node").alias("root"), F.col("to"))
        moved = links.join(taken.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(taken.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        new_links = written(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        new_labels = written(labels.join(named, "root", "left").select("fp", F.coalesce("to", "root").alias("root")), "labels")
        for done in (links, labels, least, taken):
            dropped(done)
        links, labels = new_links, new_labels
    dropped(links)
    valued = written(labels.join(values, "fp"), "valued")
    ends = written(valued.groupBy("root").agg(F.min("value").alias("component")), "ends")
    out = written(valued.join(ends, "root").select("fp", "component"), "labels")
    for done in (labels, valued, ends):
        dropped(done)
    return out


def near_duplicates(df: DataFrame, shingle: int = 4, radius: int = 4, words: int = 1, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """Every row's id, fp and component_id, the least id reachable over links within the radius."""
    marks = written(fingerprints(df, shingle, words, id_col, text_col, distinct), "marks")
    groups = written(_within(_dealt(marks.groupBy("fp").agg(F.min(id_col).alias("value")), radius), radius), "groups")
    edges = written(_between(groups, radius), "links")
    roots = written(groups.groupBy(F.col("root").alias("fp")).agg(F.min("value").alias("value")), "roots")
    labels = components(edges, roots)
    # tables are written so that both sides of a join are dealt anew and skew can be split
    ends = written(roots.join(labels, "fp", "left").select(F.col("fp").alias("root"), F.coalesce("component", "value").alias("component_id")), "ends")
    named = written(groups.select("fp", "root").join(ends, "root").select("fp", "component_id"), "named")
    for done in (edges, labels, roots, groups, ends):
        dropped(done)
    return marks.join(named, "fp").select(F.col(id_col), "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """A one-word fingerprint as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.element_at(fp, 1))), 16, "0")
