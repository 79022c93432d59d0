"""Suffix-array dedup of byte substrings: remove each byte covered by a WINDOW-byte string that an earlier document has.

Suffixes are compared by hashes of their prefixes: a polynomial hash gives the hash of any substring in constant
time, and binary search over lengths finds where two suffixes part, so a comparison takes logarithmically many steps.
Suffixes are sorted by merging, runs of neighbours with a common prefix of a length are its intervals, and common
prefixes between neighbours are verified on the bytes, with an exact sort where a hash collided.

Only some suffixes need sorting. Every window holds an anchor, the SEED-byte string of least hash in it; equal windows
hold it at the same place. An anchor with all that windows around it can reach is its context (WINDOW - SEED bytes to
the left, WINDOW from its start on). Documents travel in blocks:

1. Blocks find their anchors, once: their places are kept. Of equal contexts in a block, compared byte by byte, only
   the first in the least document goes on (the others are resolved there), as 80 bits of hash, dealt by the anchor's hash.
2. Where anchors meet, a context that a smaller document has too is resolved: all its windows are covered. Anchors
   with several contexts are sent for, each context once.
3. Blocks send these contexts, some in a hundred bytes of the input.
4. Contexts with one anchor are sorted both ways, to the right and, mirrored, to the left. A window is an interval to
   the right and one to the left; it is covered if the least document with both is smaller than its own.
5. Blocks gather what is covered.

So a hot passage costs one row a block, and texts move three times, compressed. Contexts in different blocks are held
equal by their 80 bits, which two different ones share about once in 10**24 pairs.

Defined results: null text is empty text; texts shorter than WINDOW keep all bytes; a null doc_id counts as larger
than any other, and rows of one doc_id (null too) are not earlier than each other, so repeated rows keep what no
smaller doc_id has; an empty table gives an empty result; a very long text is one row of a block of its own size, hashed
a SEGMENT at a time. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, stash

WINDOW, SEED = 50, 20
LEFT = WINDOW - SEED
BLOCK, SEGMENT = 8 << 20, 1 << 18  # bytes of text in a block; bytes hashed at a time
COMPARED = 1 << 15  # contexts compared at a time
BUCKET = 4 << 20  # bytes of text for each bucket of anchors
LAST = np.iinfo(np.int64).max
LOW40 = np.uint64((1 << 40) - 1)

SCHEMA = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"

_rng = np.random.default_rng(20)
_value = _rng.integers(1, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # of each byte, and of a place past an end
_base, _size = 0x9E3779B97F4A7C15, SEGMENT + 4 * WINDOW
_inverse = pow(_base, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Anchors:
    """Finds anchors; keeps the tables of powers."""

    def __init__(self):
        self.up, self.down = _powers(_base, _size), _powers(_inverse, _size)

    def _segment(self, data: np.ndarray, doc_from: np.ndarray, doc_until: np.ndarray, lo: int, hi: int):
        """Anchors of the windows that start in lo..hi of data, with their hashes and their contexts' hashes."""
        a, b = max(0, lo - LEFT), min(len(data), hi + 2 * WINDOW)
        part = data[a:b]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_value[part] * self.down[: len(part)], out=total[1:])
        up = self.up

        def hashed(i, j):
            return (total[j] - total[i]) * up[i]

        n = len(part) - SEED + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        seeds = _mix((total[SEED:] - total[:-SEED]) * up[:n])
        first, last = lo - a, min(hi - a, len(part) - WINDOW + 1)
        ok = np.zeros(max(0, last - first), bool)
        for s, e in zip(doc_from, doc_until):
            ok[max(0, s - lo) : max(0, e - WINDOW + 1 - lo)] = True
        if not ok.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        wide, span = LEFT + 1, 1  # seeds in a window
        least = seeds[first : last + LEFT]
        while span * 2 <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = wide - span
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        least = np.where(ok, least, np.uint64(0))
        mark = np.zeros(last - first + LEFT, bool)
        for j in range(wide):
            mark[j : j + len(least)] |= seeds[first + j : first + j + len(least)] == least
        at = np.flatnonzero(mark) + first
        d = np.searchsorted(doc_until, at + a, side="right")
        begin = np.maximum(at - LEFT, doc_from[d] - a)
        end = np.minimum(at + WINDOW, doc_until[d] - a)
        fits = at + SEED <= doc_until[d] - a
        at, begin, end = at[fits], begin[fits], end[fits]
        around = _mix(hashed(begin, end) ^ _mix(((at - begin) * 64 + end - at).astype(np.uint64)))
        return at + a, seeds[at], around

    def find(self, data: np.ndarray, bounds: np.ndarray):
        """Places, hashes and context hashes of all anchors of a block; bounds: where documents end."""
        out = []
        for lo in range(0, max(0, len(data) - WINDOW + 1), SEGMENT):
            hi = min(lo + SEGMENT, len(data))
            d0, d1 = np.searchsorted(bounds[1:], max(0, lo - LEFT), side="right"), np.searchsorted(bounds[:-1], min(len(data), hi + 2 * WINDOW), side="left")
            out.append(self._segment(data, bounds[:-1][d0:d1], bounds[1:][d0:d1], lo, hi))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        at, seed, around = (np.concatenate(x) for x in zip(*out))
        at, one = np.unique(at, return_index=True)
        return at, seed[one], around[one]


def _ranks(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Numbers in the order of ids; a null id, which is LAST here, comes after a real one of that value."""
    return np.unique(ids, return_inverse=True)[1] + null if null.any() else ids


class Block:
    """A block's documents."""

    def __init__(self, payload: bytes):
        table = pa.ipc.open_stream(payload).read_all().combine_chunks()
        self.ids, self.null, text = table["id"].combine_chunks().to_numpy(), table["null"].combine_chunks().to_numpy(), table["text"].combine_chunks()
        self.rank = _ranks(self.ids, self.null)
        self.bounds = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1]
        self.data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[: self.bounds[-1]]

    def documents(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds[1:], at, side="right")

    def reach(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that contexts have to the left of their anchors' places, and from there on."""
        return np.minimum(at - self.bounds[:-1][doc], LEFT), np.minimum(self.bounds[1:][doc] - at, WINDOW)

    def contexts(self, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Bytes of contexts, zeros where they end."""
        padded = np.pad(self.data, (LEFT, WINDOW))
        text = np.lib.stride_tricks.sliding_window_view(padded, LEFT + WINDOW)[at]
        cut = np.flatnonzero((left < LEFT) | (right < WINDOW))
        reach = np.arange(-LEFT, WINDOW)
        text[cut] *= (reach >= -left[cut, None]) & (reach < right[cut, None])
        return text

    def stand_ins(self, at: np.ndarray, seed: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Of equal contexts, the first in the least document stands for the others; where only the hash is equal, each for itself."""
        doc = self.documents(at)
        key = seed * np.uint64(_base) ^ around
        order = np.lexsort((at, self.rank[doc], key))
        new = np.r_[True, key[order][1:] != key[order][:-1]] if len(order) else np.zeros(0, bool)
        stands = np.arange(len(order))
        if len(order):
            stands[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        others = np.flatnonzero(stands != np.arange(len(stands)))
        for lo in range(0, len(others), COMPARED):
            some = others[lo : lo + COMPARED]
            left, right = self.reach(at[some], doc[some])
            left_, right_ = self.reach(at[stands[some]], doc[stands[some]])
            same = (left == left_) & (right == right_) & (self.contexts(at[some], left, right) == self.contexts(at[stands[some]], left_, right_)).all(axis=1)
            stands[some[~same]] = some[~same]
        return stands


def _seed_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the seeds at places, as Anchors has them."""
    powers, total = _powers(_inverse, SEED), np.zeros(len(at), np.uint64)
    for j in range(SEED):
        total += _value[data[at + j]] * powers[j]
    return _mix(total)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0

    def flush():
        nonlocal n, ids, texts, size
        table = pa.table({"id": pa.array([LAST if i is None else i for i in ids], pa.int64()), "null": pa.array([int(i is None) for i in ids], pa.int8()), "text": pa.array(texts, pa.large_binary())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
            out.write_table(table)
        row = pa.RecordBatch.from_arrays([pa.array([part << 24 | n], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "size", "payload"])
        n, ids, texts, size = n + 1, [], [], 0
        return row

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            ids.append(i)
            texts.append(raw)
            size += len(raw)
            if size >= BLOCK:
                yield flush()
    if ids:
        yield flush()


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).view(np.uint8).tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // sum(w for _, w in kinds)
    out, at = [], 0
    for kind, width in kinds:
        piece = np.frombuffer(raw, np.uint8, n * width, at)
        at += n * width
        out.append(piece.reshape(n, width) if kind == "bytes" else piece.view(kind))
    return out


def _forty(h: np.ndarray) -> np.ndarray:
    """40 bits in 5 bytes each."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def _wide(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b), 8), np.uint8)
    out[:, :5] = b
    return out.view("<u8").ravel()


def _bucket(seed: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors are seeds of small hashes, so the hash is mixed again before it deals them."""
    return ((_mix(seed + np.uint64(_base)) >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _rows(block: int, which: np.ndarray, buckets: np.ndarray, make) -> pa.RecordBatch:
    """One row a bucket, for the given anchors."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.r_[True, buckets[order][1:] != buckets[order][:-1]]) if len(order) else []
    names, blobs = [], []
    for s, e in zip(cuts, [*cuts[1:], len(order)]):
        names.append(int(buckets[order[s]]))
        blobs.append(make(which[order[s:e]]))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([block] * len(names), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "block", "blob"])


def _find_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of anchors by bucket; one row more for each block, numbered -1 - block, with the places of all and who stands for whom."""
        anchors = Anchors()
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = Block(payload.as_buffer().to_pybytes())
                at, seed, around = anchors.find(b.data, b.bounds)
                stands = b.stand_ins(at, seed, around)
                doc, own = b.documents(at), np.arange(len(at))

                def make(w, b=b, seed=seed, around=around, doc=doc):
                    return _pack(_forty(seed[w] & LOW40), _forty(around[w] >> np.uint64(24)), w.astype("<u4"), np.diff(b.ids[doc[w]], prepend=0).astype("<i8"), b.null[doc[w]])

                chosen = np.flatnonzero(stands == own)
                yield _rows(block, chosen, _bucket(seed[chosen], buckets), make)
                places = _pack(np.diff(at, prepend=0).astype("<u4"), (own - stands).astype("<i4"))
                yield pa.RecordBatch.from_arrays([pa.array([block % buckets], pa.int64()), pa.array([-1 - block], pa.int64()), pa.array([places], pa.binary())], names=["bucket", "block", "blob"])

    return run


def _places(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of a block's anchors, and who stands for whom."""
    gaps, back = _unpack(blob, ("<u4", 4), ("<i4", 4))
    return np.cumsum(gaps, dtype=np.int64), np.arange(len(back)) - back


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows come sorted by bucket."""
    now, rows = None, []
    for batch in batches:
        for bucket, block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if bucket != now and rows:
                yield now, rows
                rows = []
            now = bucket
            rows.append((block, blob))
    if rows:
        yield now, rows


def _answers(parts: list[int], counts: list[int], hold: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """One row a block with what was found for its anchors."""
    blocks, blobs, at = [], [], 0
    for block, n in zip(parts, counts):
        mine = np.flatnonzero(hold[at : at + n]) + at
        at += n
        if len(mine):
            blocks.append(block)
            blobs.append(_pack(*(v[mine] for v in values)))
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary())], names=["block", "blob"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For anchors: 1 if a smaller document has the context, 2 if the context is wanted. Rows of places pass through."""
    for _, rows in _by_bucket(batches):
        kept = [(block, blob) for block, blob in rows if block < 0]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.binary())], names=["block", "blob"])
        rows = rows[len(kept) :]  # sorted by block
        if not rows:
            continue
        got = [_unpack(blob, ("bytes", 5), ("bytes", 5), ("<u4", 4), ("<i8", 8), ("|i1", 1)) for _, blob in rows]
        counts = [len(g[2]) for g in got]
        seed, around = _wide(np.concatenate([g[0] for g in got])), _wide(np.concatenate([g[1] for g in got]))
        place = np.concatenate([g[2] for g in got])
        doc = _ranks(np.concatenate([np.cumsum(g[3]) for g in got]), np.concatenate([g[4] for g in got]))
        order = np.lexsort((doc, around, seed))
        s, c, d = seed[order], around[order], doc[order]
        new_seed = np.r_[True, s[1:] != s[:-1]]
        new = new_seed | np.r_[True, c[1:] != c[:-1]]
        group, context = np.cumsum(new_seed) - 1, np.cumsum(new) - 1
        least = d[np.flatnonzero(new)][context]
        several = np.bincount(group, weights=new)[group] > 1
        start = np.flatnonzero(new_seed)
        differ = (np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start))[group]
        said = np.zeros(len(order), np.uint8)
        said[order] = np.where(d > least, 1, np.where(new & several & differ, 2, 0))
        # A context in two blocks with one doc_id (repeated rows): each needs its answer.
        same = ~new & (d == least) & several & differ
        said[order[same]] = 2
        yield _answers([b for b, _ in rows], counts, said > 0, place, said)


def _send_contexts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, places, answers in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3))):
                wanted = [_unpack(a.as_buffer().to_pybytes(), ("<u4", 4), ("|u1", 1)) for a in answers.values]
                which = np.concatenate([p[s == 2] for p, s in wanted]).astype(np.int64)
                if not len(which):
                    continue
                b = Block(payload.as_buffer().to_pybytes())
                at, _ = _places(places.as_buffer().to_pybytes())
                which.sort()
                at = at[which]
                doc = b.documents(at)
                left, right = b.reach(at, doc)
                text = b.contexts(at, left, right)

                def make(i, b=b, doc=doc, left=left, right=right, text=text, which=which):
                    return _pack(text[i], left[i].astype("|u1"), right[i].astype("|u1"), which[i].astype("<u4"), np.diff(b.ids[doc[i]], prepend=0).astype("<i8"), b.null[doc[i]])

                yield _rows(block, np.arange(len(which)), _bucket(_seed_hashes(b.data, at), buckets), make)

    return run


class Suffixes:
    """Rows of symbols, each a suffix cut at its width, sorted within groups of rows; common prefixes of neighbours, -1 between groups."""

    def __init__(self, rows: np.ndarray, group: np.ndarray | None = None):
        self.rows, n, self.width = rows, len(rows), rows.shape[1]
        group = np.zeros(n, np.int64) if group is None else group
        total = np.zeros((n, self.width + 1), np.uint64)
        np.cumsum(_value[rows] * _powers(_inverse, self.width), axis=1, out=total[:, 1:])
        self.total = total
        self.order = self._mergesort(group)
        self.common = self.extent(self.order[:-1], self.order[1:])
        equal = self._equal()
        if (equal != self.common).any():  # a hash collided: sort by the symbols themselves
            self.order = np.lexsort((*rows.T[::-1], group))
            self.common = self._equal()
        self.common = np.where(group[self.order[1:]] == group[self.order[:-1]], self.common, -1)

    def _equal(self) -> np.ndarray:
        """Symbols that neighbours have in common, by the symbols themselves."""
        differ = self.rows[self.order[:-1]] != self.rows[self.order[1:]]
        return np.where(differ.any(axis=1), differ.argmax(axis=1), self.width)

    def extent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows a and b, by binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.width, np.int64)
        for _ in range(self.width.bit_length()):
            mid = (low + high + 1) >> 1
            same = self.total[a, mid] == self.total[b, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether row a sorts before row b; equal rows don't."""
        n = self.extent(a, b)
        at = np.minimum(n, self.width - 1)
        return (n < self.width) & (self.rows[a, at] < self.rows[b, at])

    def _mergesort(self, group: np.ndarray) -> np.ndarray:
        """Runs of doubling length are merged, all pairs of runs at once: a row's place is its own plus its rank in the other run."""
        n, run = len(self.rows), 1
        order = np.argsort(group, kind="stable")
        new = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if n else np.zeros(0, np.int64)
        size = np.diff(new, append=n)
        first, until = np.repeat(new, size), np.repeat(new + size, size)
        index = np.arange(n)
        while (index := index[until[index] - first[index] > run]).size:
            pair = first[index] + (index - first[index]) // (2 * run) * (2 * run)
            second = index - pair >= run
            low = np.where(second, pair, np.minimum(pair + run, until[index]))
            high = np.where(second, pair + run, np.minimum(pair + 2 * run, until[index]))
            start = low.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) >> 1
                mine, other, behind = order[index[open_]], order[mid], second[open_]
                # From the first run, go before equals of the second; from the second, behind equals of the first.
                less = self.before(np.where(behind, mine, other), np.where(behind, other, mine))
                further = less != behind
                low[open_] = np.where(further, mid + 1, low[open_])
                high[open_] = np.where(further, high[open_], mid)
            place = np.where(second, index - run, index) + low - start
            order[place] = order[index]
            run *= 2
        return order

    def intervals(self, depth: int) -> np.ndarray:
        """For each row the number of its interval: rows with one prefix of that length."""
        out = np.empty(len(self.rows), np.int64)
        out[self.order] = np.r_[0, np.cumsum(self.common < depth)] if len(self.rows) else []
        return out

    def longest(self) -> np.ndarray:
        """For each row the longest prefix that it has in common with another of its group."""
        out = np.empty(len(self.rows), np.int64)
        out[self.order] = np.maximum(np.r_[-1, self.common], np.r_[self.common, -1]) if len(self.rows) else []
        return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For contexts: which of the windows around the anchor a smaller document has; bit i is the window i bytes to its left."""
    for _, rows in _by_bucket(batches):
        got = [_unpack(blob, ("bytes", LEFT + WINDOW), ("|u1", 1), ("|u1", 1), ("<u4", 4), ("<i8", 8), ("|i1", 1)) for _, blob in rows]
        counts = [len(g[3]) for g in got]
        text = np.concatenate([g[0] for g in got]).astype(np.int16)
        left, right = (np.concatenate([g[i] for g in got]).astype(np.int64) for i in (1, 2))
        place = np.concatenate([g[3] for g in got])
        doc = _ranks(np.concatenate([np.cumsum(g[4]) for g in got]), np.concatenate([g[5] for g in got]))
        reach = np.arange(-LEFT, WINDOW)
        text[(reach < -left[:, None]) | (reach >= right[:, None])] = 256
        # Only contexts of one anchor have windows in common at its place.
        _, anchor = np.unique((_value[text[:, LEFT : LEFT + SEED]] * _powers(_inverse, SEED)).sum(axis=1), return_inverse=True)
        forward, backward = Suffixes(text[:, LEFT:], anchor), Suffixes(text[:, :LEFT][:, ::-1], anchor)
        ahead, behind = np.minimum(forward.longest(), right), np.minimum(backward.longest(), left)
        mask = np.zeros(len(doc), np.uint64)
        for i in range(LEFT + 1):
            there = forward.order[(behind >= i)[forward.order] & (ahead >= WINDOW - i)[forward.order]]
            if not len(there):
                continue
            key = forward.intervals(WINDOW - i)[there] * len(doc) + backward.intervals(i)[there]
            order = np.argsort(key, kind="stable")  # in order already, but for the second part
            start = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            d = doc[there[order]]
            least = np.repeat(np.minimum.reduceat(d, start), np.diff(start, append=len(d)))
            mask[there[order[d > least]]] |= np.uint64(1 << i)
        yield _answers([b for b, _ in rows], counts, mask > 0, place, mask)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload, places, answers, masks in zip(*(batch.column(i) for i in (1, 2, 3, 4))):
            b = Block(payload.as_buffer().to_pybytes())
            at, stands = _places(places.as_buffer().to_pybytes())
            d = b.documents(at)
            full = b.rank[d] > b.rank[d[stands]]
            mask = np.zeros(len(at), np.uint64)
            for a in answers.values or []:
                p, s = _unpack(a.as_buffer().to_pybytes(), ("<u4", 4), ("|u1", 1))
                full[p[s == 1]] = True
            for a in masks.values or []:
                p, m = _unpack(a.as_buffer().to_pybytes(), ("<u4", 4), ("<u8", 8))
                mask[p] = m
            full |= full[stands]
            mask = mask[stands]
            left, right = b.reach(at, d)
            full &= left + right >= WINDOW
            step = np.zeros(len(b.data) + 1, np.int32)
            np.add.at(step, (at - left)[full], 1)
            np.add.at(step, (at + right)[full], -1)
            some = np.flatnonzero((mask > 0) & ~full)
            for i in range(LEFT + 1):
                mine = at[some[(mask[some] >> np.uint64(i)) & np.uint64(1) > 0]] - i
                np.add.at(step, mine, 1)
                np.add.at(step, mine + WINDOW, -1)
            gone = np.cumsum(step[:-1]) > 0
            out = []
            for doc, null, s, e in zip(b.ids.tolist(), b.null.tolist(), b.bounds[:-1].tolist(), b.bounds[1:].tolist()):
                g = gone[s:e]
                edge = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0))
                out.append((None if null else doc, e - s, [{"start": x, "end": y} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())], b.data[s:e][~g].tobytes()))
                if len(out) == 2000:
                    yield _result(out)
                    out = []
            yield _result(out)


def _result(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "spans", "kept"])


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_bytes, spans (removed runs of bytes, end exclusive) and kept (the other bytes)."""
    spark = docs.sparkSession
    # Rows are large here, so fewer of them go to a worker at a time.
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(BLOCK))
    try:
        return _remove_repeats(docs)
    finally:
        spark.conf.set(BATCH, before)


def _remove_repeats(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    blocks = stash(text.mapInArrow(_blocks, "block long, size long, payload binary"), "text-blocks")
    buckets = int((blocks.agg(F.sum("size")).first()[0] or 0) // BUCKET) + 1
    row = "bucket long, block long, blob binary"

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(min(parts, buckets) if buckets > 1 else 1, "bucket").sortWithinPartitions("bucket", "block")

    def answered(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("block").agg(F.collect_list("blob").alias(name))

    met = stash(dealt(blocks.select("block", "payload").mapInArrow(_find_anchors(buckets), row)).mapInArrow(_meet, "block long, blob binary"), "anchor-answers")
    places, said = met.where("block < 0").select((-1 - F.col("block")).alias("block"), F.col("blob").alias("places")), met.where("block >= 0")
    held = blocks.select("block", "payload").join(places, "block")
    wanted = held.join(answered(said, "answers"), "block").select("block", "payload", "places", "answers")
    masks = stash(dealt(wanted.mapInArrow(_send_contexts(buckets), row)).mapInArrow(_compare, "block long, blob binary"), "context-answers")
    told = held.join(answered(said, "answers"), "block", "left").join(answered(masks, "masks"), "block", "left")
    out = stash(told.select("block", "payload", "places", "answers", "masks").mapInArrow(_remove, SCHEMA), "kept-bytes")
    drop(blocks, met, masks)
    return out
