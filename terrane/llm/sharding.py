"""Sharding: groups of equal texts are packed, whole, into a given number of shards of nearly equal bytes.

Best-fit-decreasing: groups, the largest first, each enter the bin whose remaining capacity is the least that still takes them; the bins stand
in a balanced tree by what remains. One pass of that over all groups would be one task's work, so it is done in levels. Each level deals
its items to blocks of about BLOCK by a hash, and each block packs its own into bins of FINE-th shares of a shard; the bins are the items
of the next level. A bin is less than half full at most once in a block, so a level leaves 2 * shards * FINE bins and one for each block,
whatever the number of groups. When so few are left, one task packs them into the shards, with the least capacity (by bisection) for
which best-fit-decreasing needs no more shards than there are. A group over a fair share gets a shard of its own first.

Defined results: a null text is an empty one, of size 1, in the group of the empty texts. Rows repeated are rows of one group. Ties in size
go by the group's hashes, ties in a doc_id by the place of the row in the table. Very long texts are hashed whole where they are read, and no
text is shuffled. An empty table gives an empty result; shards may be empty where there are fewer groups than shards. A null doc_id is a row
like others. Groups are told apart by size, CRC-32 and a 64-bit hash; two texts that agree in all three share a shard, which breaks no law.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .heavy import join_counted
from .scratch import drop, stash

FINE = 1024
BLOCK = 1000
SLOT_CHUNKS = 4096
KEY = ["size", "text_crc32", "_hash"]


class Bins:
    """Bins by remaining capacity in a balanced (AA) tree. A node is [remaining, bin, level, left, right]."""

    def __init__(self):
        self.root: list | None = None

    @staticmethod
    def _skew(t: list) -> list:
        left = t[3]
        if left is not None and left[2] == t[2]:
            t[3], left[4] = left[4], t
            return left
        return t

    @staticmethod
    def _split(t: list) -> list:
        right = t[4]
        if right is not None and right[4] is not None and right[4][2] == t[2]:
            t[4], right[3] = right[3], t
            right[2] += 1
            return right
        return t

    def add(self, remaining: int, number: int) -> None:
        self.root = self._add(self.root, (remaining, number))

    def _add(self, t: list | None, key: tuple[int, int]) -> list:
        if t is None:
            return [*key, 1, None, None]
        side = 3 if key < (t[0], t[1]) else 4
        t[side] = self._add(t[side], key)
        return self._split(self._skew(t))

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that takes size; None if there is none."""
        t, best = self.root, None
        while t is not None:
            if t[0] >= size:
                best, t = (t[0], t[1]), t[3]
            else:
                t = t[4]
        if best is not None:
            self.root = self._drop(self.root, best)
        return best

    def _drop(self, t: list | None, key: tuple[int, int]) -> list | None:
        if t is None:
            return None
        own = (t[0], t[1])
        if key != own:
            side = 3 if key < own else 4
            t[side] = self._drop(t[side], key)
        elif t[3] is None:
            return t[4]
        else:
            heir = t[3]
            while heir[4] is not None:
                heir = heir[4]
            t[0], t[1] = heir[0], heir[1]
            t[3] = self._drop(t[3], (heir[0], heir[1]))
        low = min(t[3][2] if t[3] else 0, t[4][2] if t[4] else 0) + 1
        if low < t[2]:
            t[2] = low
            if t[4] is not None and t[4][2] > low:
                t[4][2] = low
        t = self._skew(t)
        if t[4] is not None:
            t[4] = self._skew(t[4])
            if t[4][4] is not None:
                t[4][4] = self._skew(t[4][4])
        t = self._split(t)
        if t[4] is not None:
            t[4] = self._split(t[4])
        return t


def best_fit(sizes: Iterable[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bins of sizes that descend, by best fit; None if it takes over `most` bins. A size over the capacity has a bin of its own."""
    bins, out, n = Bins(), [], 0
    for size in sizes:
        got = bins.take(size)
        if got is None:
            if n == most:
                return None
            got, n = (max(capacity, size), n), n + 1
        bins.add(got[0] - size, got[1])
        out.append(got[1])
    return out


def into_shards(sizes: list[int], shards: int) -> list[int]:
    """Shards of sizes that descend: those over a fair share of what is left alone, the others by best fit at the least capacity found."""
    left, alone = sum(sizes), 0
    while alone < min(shards - 1, len(sizes)) and sizes[alone] * (shards - alone) > left:
        left -= sizes[alone]
        alone += 1
    rest, k = sizes[alone:], shards - alone
    if not rest:
        return list(range(alone))
    low = max(rest[0], -(-left // k))
    high = low + rest[0]  # enough: if all k bins lacked room for a size, they would hold more than there is
    found = best_fit(rest, high, k)
    while low < high:
        mid = (low + high) // 2
        tried = best_fit(rest, mid, k)
        if tried is None:
            low = mid + 1
        else:
            high, found = mid, tried
    return [*range(alone), *(alone + b for b in found)]


def _pack_block(capacity: int, keys: list[str]):
    def run(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        block = block.sort_by([("bytes", "descending"), *((k, "ascending") for k in keys)])
        bins = best_fit(block["bytes"].to_pylist(), capacity)
        base = key[0].as_py() * (1 << 20)  # a block has BLOCK items or so, and no more bins
        return pa.table([*(block[k] for k in keys), block["bytes"], pa.array([base + b for b in bins], pa.int64())], names=[*keys, "bytes", "bin"])

    return run


def _pack_last(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = pa.Table.from_batches(list(batches), pa.schema([("bin", pa.int64()), ("bytes", pa.int64())])).sort_by([("bytes", "descending"), ("bin", "ascending")])
        yield from pa.table([all_["bin"], pa.array(into_shards(all_["bytes"].to_pylist(), shards), pa.int32())], names=["bin", "shard"]).to_batches()

    return run


def _packed(groups: DataFrame, n: int, total: int, shards: int) -> DataFrame:
    """groups: KEY, bytes, rows. The same with the shard of each."""
    capacity = max(1, total // (shards * FINE))
    few = 4 * shards * FINE
    levels, items, keys = [], groups.select(*KEY, "bytes"), KEY
    while True:
        blocks = -(-n // BLOCK)
        dealt = items.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(max(1, blocks))))
        types = ", ".join(f"{k} {t}" for k, t in dealt.select(*keys).dtypes)
        level = stash(dealt.groupBy("block").applyInArrow(_pack_block(capacity, keys), f"{types}, bytes long, bin long"), "bins")
        levels.append((level, keys))
        bins = level.groupBy("bin").agg(F.sum("bytes").alias("bytes"))
        n = bins.count()
        if n <= few:
            break
        items, keys = bins.select(F.col("bin").alias("item"), "bytes"), ["item"]
    told = bins.repartition(1).mapInArrow(_pack_last(shards), "bin long, shard int")
    for level, keys in reversed(levels):
        told = level.join(told, "bin").select(*(F.col(k).alias("bin") if k == "item" else k for k in keys), "shard")
    return groups.join(told, KEY)


def _keyed(docs: DataFrame, text: str) -> list:
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return [(F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole).alias("_hash")]


def _shards_of(keyed: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """KEY, rows, shard of each group, and the number of rows."""
    groups = stash(keyed.groupBy(*KEY).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "groups")
    n, total, rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    told = stash(_packed(groups, n, total, shards).select(*KEY, "rows", "shard"), "shards")
    drop(groups)
    return told, rows


def assign(docs: DataFrame, shards: int = 8, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, law, shard, slot (place in the shard, without gaps from 0), grown_shard (null under this law)."""
    if not 1 <= shards <= 1 << 15:
        raise ValueError("between 1 and 32768 shards")
    # Written first, so that a row keeps its number when a task runs again.
    keyed = stash(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *_keyed(docs, text), F.monotonically_increasing_id().alias("_row")), "sizes")
    told, rows = _shards_of(keyed, shards)
    chunks = max(1, min(SLOT_CHUNKS * 8 // shards, rows // 1000))
    placed = join_counted(keyed, told, KEY, "rows", rows).withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.lit(chunks)).cast("int"))
    placed = stash(placed.select("doc_id", "size", "text_crc32", "shard", "_row", "_chunk"), "placed")
    counts = placed.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # 8 * SLOT_CHUNKS rows at most
    place = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy("doc_id", "_row")) - 1
    return placed.join(F.broadcast(starts), ["shard", "_chunk"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + place).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, *, text: str = "text") -> None:
    """All columns of docs as Parquet under path, in a folder shard=k for each shard; a text's rows are in one shard."""
    name = "_" * (1 + max(map(len, docs.columns)))  # clashes with no column of docs
    keys = [f"{name}{k}" for k in KEY]
    keyed = docs.select("*", *(c.alias(k) for c, k in zip(_keyed(docs, text), keys)))
    told, rows = _shards_of(docs.select(*_keyed(docs, text)), shards)
    told = told.select(*(F.col(k).alias(t) for k, t in zip(KEY, keys)), F.col("rows").alias(f"{name}rows"), F.col("shard").alias(f"{name}shard"))
    out = join_counted(keyed, told, keys, f"{name}rows", rows)
    out.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard"), F.col(f"{name}shard").alias("shard")).write.partitionBy("shard").parquet(path)
