"""Approximate nearest neighbours by cross-polytope hashing.

A vector is put on the unit sphere and turned by pseudo-rotations (three rounds of random
signs and a fast Hadamard transform). Its code in a table is the nearest signed axis of two
rotations, and of the first axes of a third where the vectors are so many that buckets
would fill; so buckets stay small as the table grows. TABLES independent tables hold every
vector. A query probes the codes whose axes it is nearest to (the largest sums of its
coordinates), over all tables in one order, and candidates get exact distances.

How many codes are probed is fitted: up to SAMPLE queries are compared with every vector
(one pass over the vectors), and probes go as far as it takes to meet RECALL of their true
neighbours. So near neighbours that stand out cost few probes, and the share of candidates
met falls as the table grows.

Buckets are searched where they lie, never as pairs of vectors: a cell is the buckets of
one part of a table, about CELL vectors; a query goes to a cell once, with the codes that
it probes there. A task holds the vectors of one cell and lets the queries pass. A bucket
of more than CELL vectors is dealt out in blocks, and its queries to each of them; nothing
is cut. Vectors travel once a table: to fetch them by candidate would move more as soon as
a query (one row in a hundred) meets more than 100 * TABLES candidates.

Equal vectors are one candidate with its smallest ids, as many as a query can return.
A query that finds too few is compared with all cells of one table, which is exact.

Null, zero and non-finite vectors, vectors with null components and rows without id
take no part. Vectors of different lengths are never neighbours. Repeated rows count
once; for an id with several vectors the nearest counts. Fewer candidates than asked
for give all of them; an empty table gives an empty result. Other columns do not
matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, work_dir, worker_cache, written

TABLES, SEED = 16, 11
#: Vectors of a cell; hot buckets are told apart from the others up to this share of all vectors, so they are few.
CELL, HOT_BUCKETS = 20_000, 4000
#: Queries on which the number of probes is fitted, and the share of their neighbours that probes should meet.
SAMPLE, RECALL = 64, 0.93
#: Axes of each rotation that probes may take where there are three.
NEAREST_AXES = 48


class CrossPolytope:
    """Codes of vectors of one length in all tables; n: how many vectors there are."""

    def __init__(self, length: int, n: int):
        self.width = max(2, 1 << (length - 1).bit_length())
        third = n // (8 * self.width**2)  # leaves about two vectors a bucket
        self.axes = min(self.width, 1 << (third.bit_length() - 1)) if third else 0
        self.signs = np.random.default_rng([SEED, length]).choice([-1.0, 1.0], (TABLES, 2 + (self.axes > 0), 3, self.width))

    def _turned(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            x, h = x * s, 1
            while h < self.width:  # fast Hadamard transform
                x = x.reshape(len(x), -1, 2, h)
                x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2)
                h *= 2
            x = x.reshape(len(x), self.width) / np.sqrt(self.width)
        return x

    def _signed_axes(self, x: np.ndarray) -> Iterator[list[np.ndarray]]:
        """Of each table: the coordinates on the signed axes of each rotation."""
        x = x.astype(np.float64)
        unit = np.zeros((len(x), self.width))
        unit[:, : x.shape[1]] = x / np.abs(x).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
        for rotations in self.signs:
            turned = [self._turned(unit, s) for s in rotations]
            if self.axes:
                turned[2] = turned[2][:, : self.axes]
            yield [np.concatenate((a, -a), axis=1) for a in turned]

    def index(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables) codes."""
        out = []
        for axes in self._signed_axes(x):
            code = np.zeros(len(x), np.int64)
            for a in axes:
                code = code * a.shape[1] + a.argmax(axis=1)
            out.append(code)
        return np.array(out).T

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one vector, per table: codes in reach, and their sums of coordinates."""
        codes, sums = [], []
        for axes in self._signed_axes(x[None]):
            code, total = np.zeros(1, np.int64), np.zeros(1)
            for a in axes:
                near = np.argsort(-a[0], kind="stable")[:NEAREST_AXES] if self.axes else np.arange(a.shape[1])
                code = (code[:, None] * a.shape[1] + near[None, :]).reshape(-1)
                total = (total[:, None] + a[0][near][None, :]).reshape(-1)
            codes.append(code)
            sums.append(total)
        return np.array(codes), np.array(sums)

    def probes(self, x: np.ndarray, share: float) -> list[np.ndarray]:
        """Per table: the codes that a vector probes, of this share of all codes in reach."""
        codes, sums = self.scores(x)
        n = min(sums.size, max(1, round(share * sums.size)))
        least = np.partition(sums, sums.size - n, axis=None)[sums.size - n]
        return [c[s >= least] for c, s in zip(codes, sums, strict=True)]

    def needed(self, x: np.ndarray, neighbours: np.ndarray) -> list[float]:
        """The share of codes to probe until each neighbour, given by its codes, is met."""
        codes, sums = self.scores(x)
        order = np.sort(sums, axis=None)
        out = []
        for own in neighbours:
            best = max((s[c == k].max(initial=-np.inf) for c, s, k in zip(codes, sums, own, strict=True)), default=-np.inf)
            out.append((order.size - np.searchsorted(order, best)) / order.size if best > -np.inf else 1.0)
        return out


def _matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) per vector length."""
    v = batch.column(column)
    flat, length = v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy(zero_copy_only=False)
    start = np.concatenate(([0], np.cumsum(length)))[:-1]
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        yield rows, flat[start[rows][:, None] + np.arange(n)[None, :]]


def _indexed(n: int):
    """(ids, vec) -> (size, ids, vec, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("cross_polytope")
        made: dict[int, CrossPolytope] = {}
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                for rows, x in _matrices(batch, 1):
                    size = x.shape[1]
                    if size not in made:
                        made[size] = CrossPolytope(size, n)
                    taken = [batch.column(i).take(pa.array(rows)) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), size, np.int32)), *taken, pa.array(list(made[size].index(x)), pa.list_(pa.int64()))], names=["size", "ids", "vec", "codes"])

    return run


def _compared(asked: list[tuple[int, np.ndarray]], k: int):
    """(size, ids, vec, codes) -> the best k of each sample query in this task, with their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for batch in batches:
            for rows, x in _matrices(batch, 2):
                for q, (own, y) in enumerate(asked):
                    if len(y) == x.shape[1]:
                        d = ((x.astype(np.float64) - y) ** 2).sum(axis=1)
                        near = np.argpartition(d, min(k, len(d) - 1))[: k + 1]
                        found = [(float(d[i]), batch.column(3)[int(rows[i])].as_py()) for i in near if own not in batch.column(1)[int(rows[i])].as_py()]
                        best[q] = sorted(best.get(q, []) + found)[:k]
        out = [(q, d, codes) for q, found in best.items() for d, codes in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.float64(), pa.list_(pa.int64())))], names=["q", "d", "codes"])

    return run


def fitted_share(asked: DataFrame, coded: DataFrame, n: int, k: int) -> float:
    """The share of codes that queries probe, from at most SAMPLE of them and their true neighbours."""
    sample = [(r.ids[0], np.array(r.vec, np.float64)) for r in asked.orderBy(F.xxhash64("ids")).limit(SAMPLE).collect()]
    found = coded.mapInArrow(_compared(sample, k), "q int, d double, codes array<long>")
    nearest_first = Window.partitionBy("q").orderBy("d", "codes")
    rows = found.withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= k).collect()  # SAMPLE * k rows
    needed = []
    for q, (_, y) in enumerate(sample):
        own = np.array([r.codes for r in rows if r.q == q])
        if len(own):
            needed += CrossPolytope(len(y), n).needed(y, own)
    return float(np.quantile(needed, RECALL, method="higher")) if needed else 1.0


def _probing(n: int, share: float | None, parts: int, hot: dict[tuple[int, int, int], int]):
    """Queries (ids, vec) -> one row a cell with the codes probed there; share None: all cells of one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("cross_polytope")
        made: dict[int, CrossPolytope] = {}
        names = ["size", "tbl", "part", "block", "kind", "code", "codes", "ids", "vec"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        for whole in batches:
            for batch in (whole.slice(i, 20) for i in range(0, whole.num_rows, 20)):
                out: list[tuple] = []
                at: list[int] = []
                for rows, x in _matrices(batch, 1):
                    size = x.shape[1]
                    if size not in made:
                        made[size] = CrossPolytope(size, n)
                    of_size = {key: blocks for key, blocks in hot.items() if key[0] == size}
                    for i, y in zip(rows, x, strict=True):
                        cells: list[tuple] = []
                        if share is None:
                            cells = [(0, part, 0, None) for part in range(parts)] + [(0, -1 - code, b, None) for (_, t, code), blocks in of_size.items() if t == 0 for b in range(blocks)]
                        else:
                            for t, codes in enumerate(made[size].probes(y, share)):
                                own = [c for c in codes.tolist() if (size, t, c) in of_size] if of_size else []
                                cells += [(t, -1 - c, b, [c]) for c in own for b in range(of_size[size, t, c])]
                                codes = np.sort(codes[~np.isin(codes, own)] if own else codes)
                                part = codes % parts
                                cells += [(t, int(p), 0, codes[part == p].tolist()) for p in np.unique(part)]
                        out += [(size, t, part, block, 1, 0, codes) for t, part, block, codes in cells]
                        at += [int(i)] * len(cells)
                made_of = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)] + [batch.column(i).take(pa.array(at, pa.int64())) for i in (0, 1)], names=names)
                yield from (made_of.slice(i, 5000) for i in range(0, made_of.num_rows, 5000))

    return run


def _searched(k: int):
    """Rows ordered by cell, vectors first -> the best k of each query in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("cross_polytope")
        best: dict[int, dict[int, float]] = {}
        held: list[tuple] = []
        at, cell = None, None

        def emit():
            rows = [(q, v, d) for q, found in best.items() for v, d in sorted(found.items(), key=lambda x: (x[1], x[0]))[:k]]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

        def search(q: int, y: np.ndarray, codes: np.ndarray | None):
            code, ids, x = cell
            if codes is None:
                at_rows = np.arange(len(code))
            else:
                low, high = np.searchsorted(code, codes), np.searchsorted(code, codes, "right")
                n = high - low
                at_rows = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            if not len(at_rows):
                return
            d = np.sqrt(((x[at_rows].astype(np.float64) - y) ** 2).sum(axis=1))
            near = np.arange(len(d)) if len(d) <= k + 1 else np.flatnonzero(d <= np.partition(d, k)[k])
            found = best.setdefault(q, {})
            for i in near:
                for v in ids[at_rows[i]].as_py():
                    if v != q and not found.get(v, np.inf) <= d[i]:
                        found[v] = float(d[i])
            if len(found) > 8 * k:
                best[q] = dict(sorted(found.items(), key=lambda p: (p[1], p[0]))[:k])

        for batch in batches:
            keys = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(starts, starts[1:]):
                if i == j:
                    continue
                if (here := tuple(keys[:4, i].tolist())) != at:
                    at, cell = here, None
                    held.clear()
                part = batch.slice(i, j - i)
                if not keys[4, i]:
                    held.append((part.column(5).to_numpy(), part.column(7), part.column(8).flatten().to_numpy(zero_copy_only=False).reshape(j - i, -1)))
                    continue
                if cell is None and held:
                    cell = np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held])
                    held.clear()
                if cell is not None:
                    for q, codes, y in zip(part.column(7), part.column(6), part.column(8), strict=True):
                        search(q[0].as_py(), y.values.to_numpy(zero_copy_only=False).astype(np.float64), codes.values.to_numpy() if codes.is_valid else None)
                if len(best) > 20_000:
                    yield emit()
        yield emit()

    return run


def _found(asked: DataFrame, coded: DataFrame, n: int, k: int, share: float | None, folder: str) -> DataFrame:
    """The best candidates of each query (ids, vec) among coded vectors."""
    cell, parts = ["size", "tbl", "part", "block"], max(1, n // CELL)
    each = coded.select("size", "ids", "vec", F.posexplode("codes" if share is not None else F.slice("codes", 1, 1)).alias("tbl", "code"))
    block = max(CELL, n // HOT_BUCKETS)
    large = each.groupBy("size", "tbl", "code").count().filter(F.col("count") > block).select("size", "tbl", "code", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    large = written(large, f"hot-{share is None}", folder)  # TABLES * HOT_BUCKETS rows at most
    hot = {(r["size"], r.tbl, r.code): r.blocks for r in large.collect()}
    dealt = each.join(F.broadcast(large), ["size", "tbl", "code"], "left")
    own = F.pmod(F.xxhash64(F.col("ids")[0]), F.col("blocks")).cast("int")
    part = F.when(F.col("blocks").isNull(), F.pmod("code", F.lit(parts))).otherwise(-1 - F.col("code"))
    dealt = dealt.select("size", "tbl", part.alias("part"), F.coalesce(own, F.lit(0)).alias("block"), F.lit(0).alias("kind"), "code", F.lit(None).cast("array<long>").alias("codes"), "ids", "vec")
    queries = asked.mapInArrow(_probing(n, share, parts, hot), dealt.schema)
    both = dealt.unionByName(queries).repartition(*cell).sortWithinPartitions(*cell, "kind", "code")
    return both.mapInArrow(_searched(k), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """vectors, queries: (vec_id, embedding) -> query_id, rank, vec_id, score (Euclidean distance)."""

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding") if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else F.col("embedding").cast("array<double>")
        df = df.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec"))
        finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        return df.filter(finite & F.exists("vec", lambda x: x != 0))

    folder = work_dir(vectors.sparkSession)
    first = Window.partitionBy("vec").orderBy("vec_id")
    few = usable(vectors).distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    candidates = written(few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "vec"), "candidates", folder)
    asked = written(usable(queries).distinct().select(F.array("vec_id").alias("ids"), "vec"), "queries", folder)
    n, kind = candidates.count(), candidates.schema["vec"].dataType.simpleString()
    coded = written(candidates.mapInArrow(_indexed(n), f"size int, ids array<long>, vec {kind}, codes array<long>"), "coded", folder)
    found = written(_found(asked, coded, n, k, fitted_share(asked, coded, n, k), folder), "found", folder)
    short = asked.join(found.groupBy("query_id").count().filter(F.col("count") >= k), F.col("ids")[0] == F.col("query_id"), "left_anti")
    if short.limit(1).count():
        rest = _found(written(short, "short", folder), coded, n, k, None, folder)
        found = found.union(rest).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
