"""Compression of vectors to short codes: Lloyd's algorithm on each part of the vectors, kept up by differences.

Components become integers, so that sums are exact and do not hang on the order of rows. A table holds each vector with its last codes (the entry
that each part is assigned to). A round reads it with the codebooks, at most ENTRIES rows a part, and writes it again with the new codes; beside
them each task writes, for each entry, what parts whose code changed add and take away: sums of components and counts. Only these are
shuffled. They are added to the running sums, which are a table of one row an entry, and the codebooks follow from that.

Defined results: rows whose vector is null, empty, or holds a null or non-finite component are dropped; so are those whose length is another
than that of the first seed, or not a multiple of the parts. The seeds are the ENTRIES smallest vec_ids, ties by components, null ids last; with fewer rows there
are fewer entries. Rows repeated count each time. An empty table gives an empty result. Distances, sums and counts are exact: in floating point
as long as every number stays under 2 ** 53, else in integers of any length; a component is a non-finite one if SCALE times it is. Errors over
2 ** 63 - 1 are given as that. Labels that are null are one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .heavy import join_counted
from .scratch import column_or_null, drop, stash

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
EXACT = 2**53
LARGEST = 2**63 - 1


class Codebook:
    """Entries of one part: exact nearest entry, ties to the lower index."""

    def __init__(self, entries: list[list[int]]):
        self.entries = np.array(entries, object).reshape(len(entries), -1)
        self.most = max((abs(x) for e in entries for x in e), default=0)
        self.plain = self.entries.astype(float) if self.most < EXACT else None
        self.norms = (self.plain**2).sum(1) if self.plain is not None else None

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance, for rows of whole numbers kept as floats."""
        far = max(self.most, float(np.abs(points).max(initial=0)))
        if self.plain is not None and 4 * far * far * max(1, points.shape[1]) < EXACT:
            # Without the points' own norms, which are the same for all entries.
            score = self.norms - 2 * (points @ self.plain.T)
            at = score.argmin(1)
            return at, (score[np.arange(len(at)), at] + (points**2).sum(1)).astype(object)
        best, error = np.zeros(len(points), int), np.zeros(len(points), object)
        for i, p in enumerate(points):
            own = [int(x) for x in p]
            error[i], best[i] = min((sum((a - b) ** 2 for a, b in zip(own, e)), k) for k, e in enumerate(self.entries))
        return best, error


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), float)
    return flat.reshape(len(column), -1)


def _round(books: list[Codebook]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Assign all parts anew. Rows of the table (part is null), and what changed for each entry (part, entry, count, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changed: dict[tuple[int, int], list] = {}

        def add(part: int, codes: np.ndarray, points: np.ndarray, sign: int) -> None:
            exact = float(np.abs(points).max(initial=0)) * max(1, len(points)) < EXACT
            for entry in np.unique(codes):
                own = points[codes == entry]
                total = own.sum(0) if exact else np.array([[int(x) for x in p] for p in own], object).sum(0)
                got = changed.setdefault((part, int(entry)), [0, [0] * points.shape[1]])
                got[0] += sign * len(own)
                got[1] = [a + sign * int(b) for a, b in zip(got[1], total)]

        for b in batches:
            if not b.num_rows:
                continue
            vectors = _matrix(b.column("ints"))
            old = b.column("codes").to_pylist()
            new = np.zeros((len(vectors), len(books)), np.uint8)
            for part, (book, points) in enumerate(zip(books, np.split(vectors, len(books), 1))):
                new[:, part], _ = book.nearest(points)
                last = np.array([-1 if o is None else o[part] for o in old])
                moved = last != new[:, part]
                add(part, new[moved, part], points[moved], 1)
                gone = moved & (last >= 0)
                add(part, last[gone], points[gone], -1)
            none = lambda t: pa.nulls(b.num_rows, t)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("ints"), pa.array([r.tobytes() for r in new], pa.binary()), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.string()))], names=NAMES)
        rows = [(p, e, n, [str(x) for x in s]) for (p, e), (n, s) in sorted(changed.items())]
        if rows:
            none = lambda t: pa.nulls(len(rows), t)
            p, e, n, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([none(pa.int64()), none(LABEL), none(pa.list_(pa.float64())), none(pa.binary()), pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.string()))], names=NAMES)

    return run


NAMES = ["vec_id", "label", "ints", "codes", "part", "entry", "count", "sums"]
LABEL = pa.string()
TABLE = "vec_id long, label string, ints array<double>, codes binary"
SUMS = "part int, entry int, count long, sums array<string>"


def _summed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The rows of one entry, added: one from each task at most. Numbers of any length, so texts."""
    sums = [sum(map(int, c)) for c in zip(*rows["sums"].to_pylist())]
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([sum(rows["count"].to_pylist())], pa.int64()), pa.array([[str(x) for x in sums]], pa.list_(pa.string()))], names=["part", "entry", "count", "sums"])


def _coded(books: list[Codebook]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            found = [book.nearest(points) for book, points in zip(books, np.split(_matrix(b.column("ints")), len(books), 1))]
            codes = np.stack([c for c, _ in found], 1).astype(np.uint8)
            errors = sum(e for _, e in found)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes().hex() for r in codes]), pa.array([min(int(e), LARGEST) for e in errors], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def integers(vector: str, scale: int = SCALE) -> Column:
    """Components times scale, rounded down, as doubles, which hold them exactly; null where the vector takes no part."""
    scaled = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double") * scale)
    odd = F.exists(scaled, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    whole = F.transform(scaled, lambda y: F.when(F.abs(y) >= EXACT, y).otherwise(F.floor(y).cast("double")))  # from 2 ** 53 on, doubles are whole
    return F.when((F.size(scaled) > 0) & ~odd, whole)


def prepared(vectors: DataFrame, parts: int = PARTS, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and ints of the rows that take part, but for their length."""
    table = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), column_or_null(vectors, label, "string").alias("label"), integers(vector).alias("ints"))
    return table.where(F.col("ints").isNotNull() & (F.size("ints") % parts == 0))


def _cut(ints: list[float], parts: int) -> list[list[int]]:
    width = len(ints) // parts
    return [[int(x) for x in ints[p * width : (p + 1) * width]] for p in range(parts)]


def train(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, list[list[list[int]]]]:
    """table: as prepared() gives. A table of the rows with vectors of the seeds' length and their codes, as of the last round; and the codebooks,
    integers by part, entry and position. None and no codebooks if there is no vector."""
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries: a code is a byte")
    seeds = table.orderBy(F.asc_nulls_last("vec_id"), "ints").select("ints").limit(entries).collect()
    if not seeds:
        return None, []
    width = len(seeds[0]["ints"])
    cut = [_cut(s["ints"], parts) for s in seeds if len(s["ints"]) == width]
    if len(cut) < min(len(seeds), entries):
        cut = [_cut(s["ints"], parts) for s in table.where(F.size("ints") == width).orderBy(F.asc_nulls_last("vec_id"), "ints").select("ints").limit(entries).collect()]
    books = [[c[p] for c in cut] for p in range(parts)]
    now = stash(table.where(F.size("ints") == width).select("*", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("int").alias("part")), "vectors")
    running = table.sparkSession.createDataFrame([], SUMS)
    for _ in range(rounds):
        told = stash(now.where("part is null").mapInArrow(_round([Codebook(b) for b in books]), f"{TABLE}, {SUMS}"), "round")
        changes = told.where("part is not null").select("part", "entry", "count", "sums")
        summed = stash(running.unionByName(changes).groupBy("part", "entry").applyInArrow(_summed, SUMS), "sums")
        drop(now, running)
        now, running = told, summed
        rows = {(r["part"], r["entry"]): r for r in summed.collect()}  # parts * entries at most
        for p, book in enumerate(books):
            for e in range(len(book)):
                r = rows.get((p, e))
                if r is not None and r["count"]:
                    book[e] = [int(s) // r["count"] for s in r["sums"]]
    return now, books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[list[list[int]]]]:
    """vec_id, label (as text), code and error of each vector that takes part, by the final codebooks; and these."""
    table, books = train(prepared(vectors, parts, vec_id=vec_id, vector=vector, label=label), parts, entries, rounds)
    kind = "vec_id long, label string, code string, error long"
    if table is None:
        return vectors.sparkSession.createDataFrame([], kind), []
    coded = stash(table.where("part is null").select("vec_id", "label", "ints").mapInArrow(_coded([Codebook(b) for b in books]), kind), "codes")
    drop(table)
    return coded, books


def books_digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def with_label_errors(coded: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """vec_id, code, error, label_error (of all rows of the label), codebooks_sha256."""
    key = F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))
    keyed = coded.select("vec_id", "code", "error", key.alias("_label"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    labels = stash(keyed.groupBy("_label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("rows")), "labels")
    n = labels.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return join_counted(keyed, labels, ["_label"], "rows", n).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
