"""Nearest neighbours by inner product with an adaptive dimension scan (operator 6).

Method: vectors are lifted by one coordinate so that the largest inner product is the
least distance (the lift of x is the root of M^2 - |x|^2, M the greatest norm; that of a
query is 0), and rotated by a random orthogonal matrix. Every row goes to the list of its
nearest centroid; centroids come from a bounded sample. A query probes the lists of its
nearest centroids, as many as the sample shows to hold ``TARGET`` of the nearest; a query
for which fewer than k are found there is put to all lists, without tests. Within a probed list the scan reads the rotated
vectors in blocks of columns: after each block the partial distance, scaled to all
dimensions, is tested against the distance of the best found so far, and candidates that
fail are abandoned. The best so far are at first those of the sample, then those of the
list. What is left is scored by its original vectors in double precision.

A task has one part of one list and one block of the queries that probe it, both of at
most GROUP_BYTES: a list of a third of all rows, or a list that every query probes, is
many tasks. Equal vectors of a part share one scan. What a task finds for a query are its
best k, and the best k of those is the result.

Defined results for odd input: null and zero vectors and those with null or non-finite
components take no part, neither as query nor as candidate; null ids neither; a query's
candidates are the rows of as many dimensions as it has; rows with the query's own id are
no candidates of it; of rows with one id and unequal vectors each is a query or candidate
of its own, best score first, while a repeated row is one query, and a candidate each
time; fewer candidates than k give them all; ties go to the smaller id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm._scratch import dropped, written

#: Rows from which centroids and bounds are learned (chosen by a hash), rounds of k-means.
SAMPLE, ROUNDS = 20_000, 8
#: Aimed rows of a list, most lists, and the share of the sample's nearest that probed lists have to hold.
LIST_ROWS, MAX_LISTS, TARGET, ASKED = 512, 4096, 0.96, 400
#: Bytes of the vectors of a task, of either side; columns of a step of the scan, and how strict the test is.
GROUP_BYTES, COLUMNS, EPSILON = 8 << 20, 16, 2.1
#: Groups of lists whose results for a query are merged first.
PARTS = 64
SEED = 7


@dataclass
class Index:
    """What the workers need: rotation, the greatest norm, centroids (in rotated, lifted space), and the sample."""

    rotation: np.ndarray
    greatest: float
    centroids: np.ndarray
    ids: np.ndarray
    sample: np.ndarray
    probes: int = 1

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.greatest**2 - (x * x).sum(1)))
        return (np.column_stack((x, last)) @ self.rotation).astype(np.float32)

    def order(self, lifted: np.ndarray) -> np.ndarray:
        """The lists of each row, the nearest centroid first."""
        return ((self.centroids**2).sum(1) - 2 * lifted @ self.centroids.T).argsort(1, kind="stable")

    def own(self, lifted: np.ndarray) -> np.ndarray:
        """The nearest centroid of each row."""
        return np.concatenate([((self.centroids**2).sum(1) - 2 * lifted[i : i + 4096] @ self.centroids.T).argmin(1) for i in range(0, len(lifted), 4096)] or [np.zeros(0, np.intp)])

    def bounds(self, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """For each query an inner product that its k best reach: that of the k-th of the sample."""
        if len(self.ids) < k:
            return np.full(len(x), -np.inf)
        ip = x @ self.sample.T
        ip[ids[:, None] == self.ids[None, :]] = -np.inf
        return np.partition(ip, -k, axis=1)[:, -k]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id long, v array of float or double): rows that take part."""
    kind = df.schema[vector_col].dataType
    element = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{element}>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(fine)


def _matrix(column: pa.ChunkedArray, dtype=float) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1).astype(dtype, copy=False)


def build(rows: DataFrame, n: int, greatest: float, k: int, sample: int = SAMPLE) -> Index:
    """Fit the index to n rows of one length on a bounded sample."""
    key = F.xxhash64(F.lit(SEED), "vec_id", "v")
    chosen = rows.withColumn("key", key).filter(F.pmod("key", F.lit(1_000_000)) < int(min(1.0, 1.2 * sample / n) * 1_000_000) + 1).orderBy("key", "vec_id").limit(sample).select("vec_id", "v").toArrow()
    x, ids = _matrix(chosen["v"]), chosen["vec_id"].to_numpy()
    d = x.shape[1]
    rng = np.random.default_rng(SEED)
    # the lift is spread evenly over all columns, as rows of one vector differ in it alone
    rotation = np.roll(np.linalg.qr(np.column_stack((np.ones(d + 1), rng.standard_normal((d + 1, d)))))[0].T, -1, axis=0)
    lists = max(1, min(MAX_LISTS, n // LIST_ROWS, len(x) // 8))
    index = Index(rotation, greatest, np.zeros((1, d + 1), np.float32), ids, x)
    lifted = index.lift(x, False)
    distinct = np.unique(lifted, axis=0)
    index.centroids = distinct[rng.choice(len(distinct), min(lists, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        own = index.own(lifted)
        sums = np.zeros_like(index.centroids, dtype=float)
        np.add.at(sums, own, lifted)
        counts = np.bincount(own, minlength=len(sums))
        filled = counts > 0
        index.centroids[filled] = (sums[filled] / counts[filled, None]).astype(np.float32)
    index.probes = _probes(index, lifted, k)
    return index


def _probes(index: Index, lifted: np.ndarray, k: int) -> int:
    """How many lists hold TARGET of the k nearest of the sample, over some of its rows as queries.

    The nearest of all rows are nearer than those of a sample, so lists near a query hold more of them.
    """
    x, lists = index.sample, len(index.centroids)
    asked = np.arange(len(x))[:: max(1, len(x) // ASKED)]
    if len(x) <= k:
        return lists
    ip = x[asked] @ x.T
    ip[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(ip, -k, axis=1)[:, -k:]
    place = np.empty((len(asked), lists), np.int64)
    np.put_along_axis(place, index.order(index.lift(x[asked], True)), np.arange(lists)[None, :].repeat(len(asked), 0), 1)
    ranks = np.take_along_axis(place, index.own(lifted)[best], 1)
    return int(np.quantile(ranks, TARGET, method="higher")) + 1


def slack(done: int, d: int, epsilon: float = EPSILON) -> float:
    """Share of a squared distance over which a partial one, over so many of d dimensions, is too large to be chance."""
    return (1 + epsilon / np.sqrt(done)) ** 2 * done / d if done < d else 1.0


def scan(queries: np.ndarray, rows: np.ndarray, bounds: np.ndarray, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that no test abandons, by blocks of columns.

    While most pairs are left a block is computed for all of them as a product of matrices, later for those left alone.
    """
    d = rows.shape[1]
    partial, done = np.zeros((len(queries), len(rows)), np.float32), 0
    while True:
        q, r = queries[:, done : done + columns], rows[:, done : done + columns]
        partial += (q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2 * q @ r.T
        done = min(d, done + columns)
        alive = partial <= (bounds * slack(done, d) * (1 + 1e-4) + 1e-5)[:, None]
        if done == d or alive.mean() < 0.1:
            break
    at, of = np.nonzero(alive)
    left = partial[at, of]
    while done < d and len(at):
        step = rows[of, done : done + columns] - queries[at, done : done + columns]
        left = left + (step * step).sum(1)
        done = min(d, done + columns)
        keep = left <= bounds[at] * slack(done, d) * (1 + 1e-4) + 1e-5
        at, of, left = at[keep], of[keep], left[keep]
    return at, of


#: An inner product that any vector reaches.
_ANY = -1e300


def search(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The k nearest rows of each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    rows = usable(df, id_col, vector_col)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    kinds = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("m")).collect()  # a row for each length
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = [_search(rows.filter(F.size("v") == kind["d"]), kind["d"], kind["n"], float(np.sqrt(kind["m"])), k, every, group_bytes) for kind in kinds]
    for at, part in enumerate(parts):
        out = part if not at else out.unionByName(part)
    return out


def _search(rows: DataFrame, d: int, n: int, greatest: float, k: int, every: int, group_bytes: int) -> DataFrame:
    """The result over rows of d dimensions."""
    spark = rows.sparkSession
    index = build(rows, n, greatest, k)
    sent = spark.sparkContext.broadcast(index)  # SAMPLE vectors and MAX_LISTS centroids at most
    held = written(_assigned(rows, sent), "lists")
    sizes = {r["list"]: r["count"] for r in held.groupBy("list").count().collect()}  # MAX_LISTS rows at most
    queries = held.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    asked = written(_asked(queries, sent, k), "asked")
    best = written(_best(held, asked, sent, sizes, k, group_bytes // (8 * (d + 1))), "best")
    full = best.filter(F.size("x") >= k).select(F.col("query_id").alias("vec_id"), "v")
    short = written(asked.join(full, ["vec_id", "v"], "left_anti").withColumn("bound", F.lit(_ANY)).withColumn("lists", F.sequence(F.lit(0), F.lit(len(index.centroids) - 1))), "short")
    if not short.isEmpty():
        best = best.filter(F.size("x") >= k).unionByName(written(_best(held, short, sent, sizes, k, group_bytes // (8 * (d + 1))), "best"))
    for done in (asked, short, held):
        dropped(done)
    ranked = best.select("query_id", F.posexplode("x").alias("p", "y"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("y.i").alias("vec_id"), (-F.col("y.s")).alias("score"))


def _best(held: DataFrame, asked: DataFrame, sent, sizes: dict[int, int], k: int, most: int) -> DataFrame:
    """(query_id, v, x): the best k of each query in the lists it probes; a task has ``most`` rows of either side."""
    load = {r["list"]: r["count"] for r in asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect()}  # MAX_LISTS rows at most
    parts = lambda counts: F.element_at(F.array(*[F.lit(-(-counts.get(i, 0) // max(1, most)) or 1) for i in range(max(sizes) + 1)]), F.col("list") + 1)
    spread = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
    ours, theirs = F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.xxhash64("vec_id", "v")
    placed = held.select("vec_id", "v", "list", F.pmod(ours, parts(sizes)).cast("int").alias("shelf"), spread(parts(load)).alias("block")).withColumn("bound", F.lit(None).cast("double"))
    asks = asked.select("vec_id", "v", "bound", F.explode("lists").alias("list")).filter(F.col("list") <= max(sizes))
    asks = asks.select("vec_id", "v", "bound", "list", F.pmod(theirs, parts(load)).cast("int").alias("block"), spread(parts(sizes)).alias("shelf"))
    kind = held.schema["v"].dataType.simpleString()
    found = placed.unionByName(asks).groupBy("list", "shelf", "block").applyInArrow(lambda group: _answer(sent.value, group, k), f"query_id long, v {kind}, part int, x array<struct<s:double,i:bigint>>")
    # queries of one id and unequal vectors stay apart; in two steps, so that neither meets many times k rows
    for keys in (("query_id", "v", "part"), ("query_id", "v")):
        found = found.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("x"))), 1, k).alias("x"))
    return found


def _top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's best k, by query and then best first, ties by the smaller id."""
    order = np.lexsort((ids, -score, query))
    first = np.searchsorted(query[order], query[order], "left")
    return order[np.arange(len(order)) - first < k]


def _answer(index: Index, group: pa.Table, k: int) -> pa.Table:
    """The best k of one part of a list for each query of a block; queries are the rows with a bound."""
    v, bound = _matrix(group["v"]), group["bound"].to_numpy()
    ids, asks = group["vec_id"].to_numpy(), ~np.isnan(bound)
    order = np.flatnonzero(~asks)[np.argsort(ids[~asks], kind="stable")]  # ties go to the smaller id
    row_ids, rows, queries, query_ids, reach = ids[order], v[order], v[asks], ids[asks], bound[asks]
    found: list[tuple[np.ndarray, ...]] = []
    if len(rows) and len(queries):
        # equal vectors are scanned once; of each the first k by id, but for the query's own, may be among the best
        distinct, same = np.unique(rows, axis=0, return_inverse=True)
        members = np.argsort(same.reshape(-1), kind="stable")
        ends = np.cumsum(np.bincount(same.reshape(-1)))
        starts = np.concatenate(([0], ends[:-1]))
        there = index.lift(distinct, False)
        here, step = index.lift(queries, True), max(1, min(len(queries), (4 << 20) // len(distinct)))
        norms = (queries * queries).sum(1)
        for lo in range(0, len(queries), step):
            hi = min(len(queries), lo + step)
            at, of = scan(here[lo:hi], there, index.greatest**2 + norms[lo:hi] - 2 * reach[lo:hi])
            for part in range(0, max(1, len(at)), 1 << 18):
                a, o = at[part : part + (1 << 18)] + lo, of[part : part + (1 << 18)]
                score = np.einsum("ij,ij->i", distinct[o], queries[a])
                single = ends[o] - starts[o] == 1
                cand = [(a[single], row_ids[members[starts[o[single]]]], score[single])]
                for q, g, s in zip(a[~single].tolist(), o[~single].tolist(), score[~single].tolist(), strict=True):
                    some = row_ids[members[starts[g] : ends[g]]]
                    low, high = np.searchsorted(some, query_ids[q], "left"), np.searchsorted(some, query_ids[q], "right")
                    some = np.concatenate((some[: min(low, k)], some[high : high + k]))[:k]
                    cand.append((np.full(len(some), q), some, np.full(len(some), s)))
                q, i, s = (np.concatenate(c) for c in zip(*cand, strict=True))
                other = i != query_ids[q]
                q, i, s = q[other], i[other], s[other]
                best = _top(q, i, s, k)
                found.append((q[best], i[best], s[best]))
    q, i, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    best = _top(q, i, s, k)
    q, i, s = q[best], i[best], s[best]
    some, counts = np.unique(q, return_counts=True)
    kind = group.schema.field("v").type.value_type
    own = queries[some].astype(kind.to_pandas_dtype())
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * queries.shape[1]), pa.array(own.reshape(-1), kind))
    pairs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(-s, pa.float64()), pa.array(i)], ["s", "i"]))
    part = (group["list"].to_numpy()[:1] % PARTS).repeat(len(some)).astype(np.int32)
    return pa.table({"query_id": query_ids[some], "v": vectors, "part": part, "x": pairs})


def _by_batch(rows: DataFrame, schema: str, make: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """The rows (vec_id, v) with further columns made of ids and vectors. Map only."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                column = part.column("v")
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(float)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), column, *make(part.column("vec_id").to_numpy(zero_copy_only=False), x)], names=names)

    return rows.select("vec_id", "v").mapInArrow(run, schema)


def _assigned(rows: DataFrame, sent) -> DataFrame:
    """The rows with the number of their list."""
    kind = rows.schema["v"].dataType.simpleString()
    return _by_batch(rows, f"vec_id long, v {kind}, list int", lambda ids, x: [pa.array(sent.value.own(sent.value.lift(x, False)).astype(np.int32))])


def _asked(queries: DataFrame, sent, k: int) -> DataFrame:
    """The queries with the lists they probe, and an inner product that their best reach."""
    kind = queries.schema["v"].dataType.simpleString()

    def make(ids: np.ndarray, x: np.ndarray) -> list[pa.Array]:
        index, bounds, lists = sent.value, [], []
        for at in range(0, len(x), 256):
            lists += list(index.order(index.lift(x[at : at + 256], True))[:, : index.probes].astype(np.int32))
            bounds.append(index.bounds(ids[at : at + 256], x[at : at + 256], k))
        return [pa.array(np.maximum(np.concatenate(bounds), _ANY)), pa.array(lists, pa.list_(pa.int32()))]

    return _by_batch(queries, f"vec_id long, v {kind}, bound double, lists array<int>", make)
