"""Approximate nearest neighbours by inner product: query-aware collision counting over single-projection hashes.

Vectors are dealt into blocks of about BLOCK rows, every row into one. A block projects its vectors on PROJECTIONS random
lines and keeps each line's values sorted. A query's window on each line is centred on its own projection; virtual
rehashing widens all windows together, by STEP a time, reading on in the sorted arrays from where the last window ended.
A vector whose windows have caught it THRESHOLD times is verified: its exact inner product is taken in double precision.
A query ends in a block when K + 1 verified vectors lie within the radius that the windows stand for (one may be its own),
or all are verified.

Inner products become distances by a further component that gives all vectors of a block one length, and none to the query.
THRESHOLD lies two standard deviations below the catches expected of a vector at the radius, for a recall of over 0.97
a block, whatever the number of blocks; the tests measure it against brute force.

A stated query set meets all rows, in blocks: one row leaves for each query and block, with at most K neighbours. Where there
are fewer blocks than the cluster can work on, a block's queries are cut into slices, each with the block's vectors.

Every (query, block) pair is needed: on vectors without clusters, such as the tables here, the nearest twenty of a query lie
in three quarters of the cells of a partition by centroids before recall reaches 0.9, so ranges of projections rule out
too little to be worth their shuffle. Work is queries times rows, in blocks; memory is one block and QUERIES queries.

Projections and radii are taken of vectors divided by their largest component, so none overflows or vanishes; a search
ends when its windows cover a block at the latest. Scores are products of the original components, added up in their order,
so equal vectors have equal scores wherever they lie. Equal vectors of a block are one entry with all their ids.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids;
rows equal in id and vector are different candidates and one query, whose own row is one of them; rows with one id and
different vectors are different candidates and different queries; vectors are compared with those of their own dimension; equal products go by the smaller id; a product that overflows is infinite, and one that is no number comes last;
an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, BLOCK, QUERIES = 20, 16384, 128
PROJECTIONS, STEP = 32, 1.06
NEAR = math.erf(1 / math.sqrt(2))  # chance that a line's window of half-width R catches a vector at distance R
THRESHOLD = math.floor(PROJECTIONS * NEAR - 2 * math.sqrt(PROJECTIONS * NEAR * (1 - NEAR)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, component after component: no blocking or alignment can change the order of additions."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(a.shape[1]):
            total = total + a[:, j] * b[:, j]
    return total


class Index:
    """One block's sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        # Equal vectors are one entry; ids of entry e are ids[first[e] : first[e + 1]], smallest first.
        self.vectors, entry = np.unique(vectors, axis=0, return_inverse=True)
        entry = entry.ravel()
        order = np.lexsort((ids, entry))
        self.ids = ids[order]
        self.first = np.searchsorted(entry[order], np.arange(len(self.vectors) + 1))
        scaled = self.vectors / np.abs(self.vectors).max()
        n, d = scaled.shape
        squares = (scaled**2).sum(axis=1)
        self.scaled, self.length = scaled, math.sqrt(squares.max())
        rest = np.sqrt(np.maximum(squares.max() - squares, 0))
        self.lines = np.random.default_rng(d).standard_normal((d + 1, PROJECTIONS))
        values = np.c_[scaled, rest] @ self.lines
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(values.T, self.order, axis=1)

        # The first radius: the least tenth of how far the k-th nearest is, over some vectors of the block.
        some = scaled[:: max(1, n // 64)][:64]
        some = some[np.abs(some).max(axis=1) > 1e-100]
        if len(some):
            some = some / np.abs(some).max(axis=1)[:, None]
            unit = some / np.sqrt((some**2).sum(axis=1))[:, None] * self.length
            far = np.sqrt(np.maximum(2 * self.length**2 - 2 * unit @ scaled.T, 0))
            radius = float(np.quantile(np.partition(far, min(K, n - 1), axis=1)[:, min(K, n - 1)], 0.1))
        else:
            radius = self.length / 4
        self.radius = max(radius, self.length / 100)

    def search(self, own: list[int], queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, ids and products of the k best rows that are not the query's own."""
        n, m = len(self.vectors), len(queries)
        scaled = queries / np.abs(queries).max(axis=1)[:, None]
        scaled = scaled / np.sqrt((scaled**2).sum(axis=1))[:, None]
        centres = (scaled * self.length) @ self.lines[:-1]
        caught, done = np.zeros((m, n), np.int16), np.zeros((m, n), bool)
        copies = np.diff(self.first)
        got, product, rows_got = [np.zeros(0, np.int64)] * m, [np.zeros(0)] * m, [0] * m
        low = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, centres.T)])
        high, radius, open_ = low, self.radius, list(range(m))
        while open_:
            new_low = np.array([np.searchsorted(s, c, "left") for s, c in zip(self.sorted, centres.T - radius)])
            new_high = np.array([np.searchsorted(s, c, "right") for s, c in zip(self.sorted, centres.T + radius)])
            still = []
            for i in open_:
                parts = [p for o, a, b, c, d in zip(self.order, new_low[:, i].tolist(), low[:, i].tolist(), high[:, i].tolist(), new_high[:, i].tolist()) for p in (o[a:b], o[c:d])]
                caught[i] += np.bincount(np.concatenate(parts), minlength=n).astype(np.int16)
                everything = not new_low[:, i].any() and (new_high[:, i] == n).all()
                fresh = np.flatnonzero(~done[i]) if everything else np.flatnonzero((caught[i] >= THRESHOLD) & ~done[i])
                done[i, fresh] = True
                got[i], product[i] = np.r_[got[i], fresh], np.r_[product[i], self.scaled[fresh] @ scaled[i]]
                rows_got[i] += int(copies[fresh].sum())
                if len(got[i]) == n:
                    continue
                if rows_got[i] > k:  # one of them may be the query's own
                    at = min(k, len(got[i]) - 1)
                    best = np.partition(product[i], len(got[i]) - 1 - at)[len(got[i]) - 1 - at]
                    if 2 * self.length**2 - 2 * self.length * best <= radius**2:
                        continue
                still.append(i)
            open_, low, high, radius = still, new_low, new_high, radius * STEP
        # Entries that can be among the k best, by products that rounding may have moved; then rows of these, scored again.
        near = []
        for g, p in zip(got, product):
            if len(g) > k + 1:
                g = g[p >= np.partition(p, len(p) - k - 1)[len(p) - k - 1] - 1e-9 * self.length]
            near.append(g)
        exact = products(self.vectors[np.concatenate(near)], np.repeat(queries, [len(g) for g in near], axis=0))
        out, at = [], 0
        for i, g in enumerate(near):
            score, at = exact[at : at + len(g)], at + len(g)
            mine = (self.vectors[g] == queries[i]).all(axis=1)
            ids, scores = [], []
            for e, s, same in zip(g.tolist(), score.tolist(), mine.tolist()):
                a = self.ids[self.first[e] : self.first[e + 1]][: k + 1]  # smaller ids win, so k + 1 of them tell all
                if same:
                    own_at = np.flatnonzero(a == own[i])
                    a = np.delete(a, own_at[0]) if len(own_at) else a[:k]
                ids.append(a)
                scores.append(np.full(len(a), s))
            ids, scores = np.concatenate(ids), np.concatenate(scores)
            best = np.lexsort((ids, -np.nan_to_num(scores, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.isnan(scores)))[:k]
            out.append((ids[best], scores[best]))
        return out


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by dimension and block, vectors (kind 0) before queries (kind 1)."""
        now, ids, vectors, index, asked, again = None, [], [], None, [], 0

        def answer() -> pa.RecordBatch:
            nonlocal asked
            rows = index.search([a for a, _, _ in asked], np.array([v for _, v, _ in asked], np.float64), k)
            rows = [(a, key, near.tolist(), score.tolist()) for (a, _, key), (near, score) in zip(asked, rows) if len(near)]
            asked = []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.float64()))], names=["query_id", "key", "ids", "scores"])

        for batch in batches:
            dims, blocks, kinds, names, keys = (batch.column(i).to_pylist() for i in range(5))  # a block here is one with a slice
            flat, offsets = batch.column(5).flatten().to_numpy(zero_copy_only=False), batch.column(5).offsets.to_numpy()
            offsets = offsets - offsets[0]
            for i, (d, b, kind, name, key) in enumerate(zip(dims, blocks, kinds, names, keys)):
                v = flat[offsets[i] : offsets[i + 1]]
                if (d, b) != now:
                    if asked:
                        yield answer()
                    now, ids, vectors, index = (d, b), [], [], None
                if kind == 0:
                    again = again + 1 if ids and ids[-1] == name and (vectors[-1] == v).all() else 0
                    if again > k:
                        continue  # k + 1 of a row repeated are all that a query can find
                    ids.append(name)
                    vectors.append(v)
                elif ids:
                    if index is None:
                        index = Index(np.array(ids, np.int64), np.array(vectors, np.float64))
                    asked.append((name, v, key))
                    if len(asked) == QUERIES:
                        yield answer()
        if asked:
            yield answer()

    return run


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the k nearest found of each query."""
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    # Adding 0.0 turns -0.0 into 0.0, which are equal.
    rows = (
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), is_query.alias("q"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .where(sound)
        .select(F.size("v").alias("dim"), "id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"), "q")
        .withColumn("key", F.xxhash64("v"))
    )
    blocks = max(1, -(-vectors.count() // block))
    # Tasks of one size: block and slice make the number of a task, with no hash that would put two into one and none into another.
    slices = max(1, -(-2 * spark.sparkContext.defaultParallelism // blocks))
    stored = rows.withColumn("block", F.pmod(F.xxhash64("id", "key"), F.lit(blocks)) * slices)
    stored = stored.select("dim", F.explode(F.sequence("block", F.col("block") + slices - 1)).alias("block"), F.lit(0).alias("kind"), "id", "key", "v")
    asked = rows.where("q").dropDuplicates(["id", "v"]).withColumn("slice", F.pmod(F.xxhash64("key", "id"), F.lit(slices)))
    asked = asked.select("dim", F.explode(F.sequence("slice", F.lit(slices * (blocks - 1)) + F.col("slice"), F.lit(slices).cast("long"))).alias("block"), F.lit(1).alias("kind"), "id", "key", "v")
    parts = min(blocks * slices, int(spark.conf.get("spark.sql.shuffle.partitions")) * 8)
    dealt = stored.unionByName(asked).repartitionById(parts, (F.col("block") % parts).cast("int")).sortWithinPartitions("dim", "block", "kind", "id", "key")
    found = dealt.mapInArrow(_search(k), "query_id long, key long, ids array<long>, scores array<double>")
    # No number sorts before all others once its sign is turned, so it is told apart first.
    pairs = F.flatten(F.collect_list(F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct(F.isnan(x["scores"]).alias("none"), (-x["scores"]).alias("less"), x["ids"].alias("id"), x["scores"].alias("score")))))
    best = found.groupBy("query_id", "key").agg(F.slice(F.array_sort(pairs), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))
