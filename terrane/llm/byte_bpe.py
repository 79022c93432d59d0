"""Byte-level BPE encoding and decoding with public rank files, as the tiktoken library does it.

A segment tree over the byte positions of a piece stores the leftmost minimum pair rank. The root names the next
merge; a merge unlinks one position and makes point updates for the live neighbours, each logarithmic. Short pieces
run side by side: one numpy row is one piece's tree, so each step advances every piece of a batch. Long pieces have
a tree of their own. Pieces recur, so each worker keeps a bounded table of pieces already encoded.

Defined results: null text is empty text: no ids, digests of the empty string; repeated rows are each encoded; an
empty table gives an empty result; extra columns are ignored. There are no special tokens: their strings are text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int64(1) << 40  # a rank that no pair has
SHORT = 64  # bytes; longer pieces have a tree of their own
KEPT = 400_000  # pieces that a worker keeps

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.known: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def _long(self, piece: bytes) -> list[int]:
        """One piece with its own tree; leaves and nodes hold rank and position in one integer."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        shift, none = size.bit_length(), int(NONE)
        ids = self.first[np.frombuffer(piece, np.uint8)]
        leaves = np.full(size, none, np.int64)
        leaves[: n - 1] = self._rank(ids[:-1], ids[1:])
        tree = np.zeros(2 * size, np.int64)
        tree[size:] = leaves << shift | np.arange(size)
        half = size
        while half > 1:
            tree[half // 2 : half] = np.minimum(tree[half : 2 * half : 2], tree[half + 1 : 2 * half : 2])
            half //= 2
        tree, ids = tree.tolist(), ids.tolist()
        after, before, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs

        def put(i: int, rank: int) -> None:
            node = i + size
            tree[node] = rank << shift | i
            while node > 1:
                node >>= 1
                left, right = tree[2 * node], tree[2 * node + 1]
                tree[node] = left if left < right else right

        while (low := tree[1]) >> shift < none:
            i = low & ((1 << shift) - 1)
            gone = after[i]
            ids[i], after[i] = low >> shift, after[gone]
            ids[gone] = -1
            if after[i] < n:
                before[after[i]] = i
                put(i, pairs.get(ids[i] << 20 | ids[after[i]], none))
            else:
                put(i, none)
            put(gone, none)
            if before[i] >= 0:
                put(before[i], pairs.get(ids[before[i]] << 20 | ids[i], none))
        return [x for x in ids if x >= 0]

    def _short(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces of 2 to SHORT bytes, each a row of one array of trees."""
        out: list[bytes] = [b""] * len(pieces)
        lens = np.array([len(p) for p in pieces])
        for size in (4, 8, 16, 32, 64):
            mine = np.flatnonzero((lens <= size) & (lens > (size // 2 if size > 4 else 0)))
            if not len(mine):
                continue
            n, m = lens[mine], len(mine)
            width = size + 2  # a slot on each side stands for no neighbour
            ids = np.full((m, width), -1, np.int64)
            flat = np.frombuffer(b"".join(pieces[i] for i in mine), np.uint8)
            inside = np.arange(size)[None, :] < n[:, None]
            ids[:, 1:-1][inside] = self.first[flat]
            shift = 7
            tree = np.empty((m, 2 * size), np.int64)
            ranks = np.full((m, size), NONE, np.int64)
            paired = inside[:, 1:]
            ranks[:, :-1][paired] = self._rank(ids[:, 1:-2][paired], ids[:, 2:-1][paired])
            tree[:, size:] = ranks << shift | np.arange(size)
            half = size
            while half > 1:
                tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
                half //= 2
            after = np.tile(np.arange(1, size + 1, dtype=np.int64), (m, 1))
            after = np.minimum(after, n[:, None])  # n: past the end
            before = np.tile(np.arange(-1, size - 1, dtype=np.int64), (m, 1))
            before = np.concatenate([before, np.full((m, 1), size - 1)], axis=1)

            def put(rows, i, rank):
                node = i + size
                tree[rows, node] = rank << shift | i
                while node[0] > 1:
                    node = node >> 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

            rows = np.flatnonzero(tree[:, 1] >> shift < NONE)
            while len(rows):
                low = tree[rows, 1]
                i, merged = low & 127, low >> shift
                gone = after[rows, i]
                then = after[rows, gone]
                ids[rows, i + 1] = merged
                ids[rows, gone + 1] = -1
                after[rows, i] = then
                before[rows, then] = i
                last = then >= n[rows]
                right = np.where(last, 0, ids[rows, then + 1])
                put(rows, i, np.where(last, NONE, self._rank(merged, right)))
                put(rows, gone, np.full(len(rows), NONE))
                prev = before[rows, i]
                has = prev >= 0
                if has.any():
                    r, p = rows[has], prev[has]
                    put(r, p, self._rank(ids[r, p + 1], merged[has]))
                rows = rows[tree[rows, 1] >> shift < NONE]
            live = ids >= 0
            packed, ends = ids[live].astype("<u4").tobytes(), np.cumsum(live.sum(axis=1)) * 4
            start = 0
            for k, end in zip(mine.tolist(), ends.tolist()):
                out[k] = packed[start:end]
                start = end
        return out

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of each piece, as little-endian 32-bit integers."""
        if len(self.known) > KEPT:
            self.known = {}
        new, short = {}, []
        for p in pieces:
            if p in self.known:
                continue
            raw = p.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                new[p] = whole.to_bytes(4, "little")
            elif len(raw) <= SHORT:
                short.append((p, raw))
            else:
                new[p] = np.array(self._long(raw), "<u4").tobytes()
        new.update(zip((p for p, _ in short), self._short([r for _, r in short])))
        self.known.update(new)
        return self.known

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text. Texts go in groups of some megabytes, so that few tree steps serve many pieces."""
        group, size = [], 0
        for text in [*texts, None]:
            if text is not None:
                group.append(pieces := self.find(text))
                size += len(pieces)
            if text is None or size > 300_000:
                need = set().union(*group)
                known = self.known if need <= self.known.keys() and len(self.known) <= KEPT else self.learn(need)
                if not need <= known.keys():
                    known = self.learn(need)
                for pieces in group:
                    yield b"".join(map(known.__getitem__, pieces))
                group, size = [], 0

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """One row for each document: number of ids, digest of the ids, digest of what they decode to. rank_path: a file that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(read_ranks(rank_path), pattern)
        for batch in batches:
            n, ids_of, back = [], [], []
            for ids in bpe.encode([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(ids) // 4)
                ids_of.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_of, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
