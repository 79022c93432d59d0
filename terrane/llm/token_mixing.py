"""The model of op3's token stream: a binary code of tokens, count tables by hashed contexts, and the mixer of their predictions.

Log odds are added up with weights from a set that is gated by how much the contexts have seen. A table keyed by mixed odds and
evidence refines the result by what came true. Both are learned from every training token: its bits are counted by cell (what the
predictors said, in steps), which sums up over tasks in any order, and the weights are fit to the sums. In texts that were counted,
each bit is predicted without its own occurrence. A frequent word has a code of its own; all other words of one beginning (two bytes) share one, and are told apart by
lm_score. Codes are the paths of a Huffman tree over training counts, so a token is about as many bits as it is worth. Each bit
is a decision at a node of the tree, and has these predictors: the node's own counts, and its counts after the last very
common word and after the last token. Contexts reach over words, to the start of the document.
"""

from __future__ import annotations

import heapq
import itertools
import zlib

import numpy as np

TOPS = 255  # the most frequent words, which stay a context until the next one comes
CONTEXTS = 2
INPUTS = CONTEXTS + 2  # the node's own counts, the contexts, and a constant
SEGMENT = 4_000  # tokens whose bits are held at a time
WIDE = 64_000  # and whose cells are
HELD = 1_500_000  # tokens that are counted at a time
LEVELS = (5, 5)
ZS = 33  # places of the refinement, by mixed odds
FEW = 0.4
STEP, FAR = 0.5, 10.0  # log odds that share a cell, and the last one
ROUNDS = 30  # steps of the fit at most

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def beginning(word: bytes) -> bytes:
    """Two bytes; a space stands for the end of a shorter word, which is then told in full."""
    return (word + b" ")[:2]


def _steps() -> np.ndarray:
    """What the 256 marks of a count stand for: counts up to 127, then growing steps."""
    return np.r_[np.arange(128), np.rint(128 * 2 ** (np.arange(128) / 6.0))].astype(np.float64)


def marks(counts: np.ndarray) -> np.ndarray:
    return np.where(counts < 128, counts, np.clip(np.rint(6 * np.log2(np.maximum(counts, 1) / 128)) + 128, 0, 255)).astype(np.uint16)


def _views() -> tuple[np.ndarray, np.ndarray]:
    """Log odds and level of evidence of a packed slot; rows: as it is, without a zero of its own, without a one of its own."""
    n = _steps()
    n0, n1 = n[None, :], n[:, None]  # packed: mark of ones * 256 + mark of zeros
    odds, level = np.empty((3, 65536), np.float32), np.empty((3, 65536), np.int8)
    for row, (less0, less1) in enumerate(((0, 0), (1, 0), (0, 1))):
        a, b = np.maximum(n0 - less0, 0) + 0 * n1, np.maximum(n1 - less1, 0) + 0 * n0
        odds[row] = np.log((b + FEW) / (a + FEW)).ravel()
        level[row] = np.digitize((a + b).ravel(), (0.5, 1.5, 3.5, 15.5))
    return odds, level


ODDS, LEVEL = (x.ravel() for x in _views())


def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind of a packed slot in each view (odds in steps, by level of evidence), and of each kind its odds and level."""
    step = np.rint(np.clip(ODDS, -FAR, FAR) / STEP).astype(np.int64) + round(FAR / STEP)
    found, kind = np.unique(LEVEL.astype(np.int64) * 1000 + step, return_inverse=True)
    # Weighed by slots of small counts, which are most.
    small = np.tile((np.arange(65536) >> 8) + (np.arange(65536) & 255) < 40, 3) + 1e-6
    odds = np.bincount(kind, ODDS * small) / np.bincount(kind, small)
    return kind.astype(np.uint8), odds, found // 1000


KIND, KIND_ODDS, KIND_LEVEL = _kinds()
KINDS, OWN_STEPS = len(KIND_ODDS), 2 * round(FAR / STEP) + 1
CELLS = OWN_STEPS * KINDS**CONTEXTS


def _stirred(x: np.ndarray) -> np.ndarray:
    """64 bits, each of which hangs on all of x."""
    x = x * _K[1]
    x ^= x >> np.uint64(32)
    x *= _K[2]
    x ^= x >> np.uint64(29)
    x *= _K[3]
    return x ^ x >> np.uint64(32)


HASHED = np.uint64(0x00FFFFFF00FFFFFF)


class Code:
    """Symbols are the frequent words, then the beginnings of others, then one for beginnings that are not listed."""

    def __init__(self, words: list[bytes], counts: list[int], starts: list[bytes], start_counts: list[int], rest: int):
        self.words = {w: i for i, w in enumerate(words)}
        self.starts = {p: len(words) + i for i, p in enumerate(starts)}
        self.rest = len(words) + len(starts)
        weight = [max(1, c) for c in (*counts, *start_counts, rest)]
        n = len(weight)
        heap = [(c, i) for i, c in enumerate(weight)]
        heapq.heapify(heap)
        parent, side, zeros, ones = np.zeros(2 * n - 1, np.int32), np.zeros(2 * n - 1, np.int8), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for node in range(n - 1):
            (c0, a), (c1, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a], parent[b], side[b] = n + node, n + node, 1
            zeros[node], ones[node] = c0, c1
            heapq.heappush(heap, (c0 + c1, n + node))
        symbols, nodes, bits, at, who = [], [], [], np.arange(n), np.arange(n)
        while n > 1 and len(at):
            symbols.append(who)
            nodes.append(parent[at] - n)
            bits.append(side[at])
            at = parent[at]
            who, at = who[at != 2 * n - 2], at[at != 2 * n - 2]
        symbols = np.concatenate(symbols) if symbols else np.zeros(0, int)
        order = np.argsort(symbols, kind="stable")
        self.nodes = (np.concatenate(nodes)[order] if nodes else order).astype(np.int32)
        self.bits = (np.concatenate(bits)[order] if bits else order).astype(np.int8)
        self.depth = np.bincount(symbols, minlength=n).astype(np.int64)
        self.start = np.r_[0, np.cumsum(self.depth)[:-1]]
        self.odds = np.log((ones + FEW) / (zeros + FEW)).astype(np.float32)
        self._derive()

    def __getstate__(self) -> dict:
        """What travels to tasks; the rest is made anew there."""
        return {k: v for k, v in self.__dict__.items() if k not in ("own", "spread")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._derive()

    def _derive(self) -> None:
        """By place in a path: the node's odds; and in one number its part of slots (24 bits for each table, from bits 0 and 32 on), the
        step of its odds (from bit 24 on), and the bit (the top one)."""
        step = (np.rint(np.clip(self.odds, -FAR, FAR) / STEP) + round(FAR / STEP)).astype(np.uint64)
        parts = _stirred((np.arange(len(step), dtype=np.uint64) + np.uint64(1)) * _K[0]) & HASHED | step << np.uint64(24)
        self.own = self.odds[self.nodes]
        self.spread = parts[self.nodes] | self.bits.astype(np.uint64) << np.uint64(63)

    def symbols(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.words.get, words, itertools.repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(out < 0)
        out[rare] = np.fromiter(map(self.starts.get, [beginning(words[i]) for i in rare.tolist()], itertools.repeat(self.rest)), np.int64, len(rare))
        return out

    def contexts(self, words: list[bytes], symbols: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """A hash for each context and token. firsts: where documents start."""
        return self.contexts_by(self.rare_hashes(words, symbols), symbols, firsts)

    def rare_hashes(self, words: list[bytes], symbols: np.ndarray) -> np.ndarray:
        """Of the tokens without a code of their own, in order."""
        rare = np.flatnonzero(symbols >= len(self.words)).tolist()
        return np.fromiter(map(zlib.crc32, [words[i] for i in rare]), np.uint32, len(rare))

    def contexts_by(self, hashes: np.ndarray, symbols: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        n = len(symbols)
        key = symbols.astype(np.uint64) + np.uint64(1)
        key[symbols >= len(self.words)] = hashes.astype(np.uint64) + np.uint64(1 << 33)
        place = np.arange(n)
        first = np.zeros(n, np.int64)
        first[firsts] = firsts
        first = np.maximum.accumulate(first)
        last_top = np.maximum.accumulate(np.where(symbols < min(TOPS, len(self.words)), place, -1))
        last_top = np.r_[-1, last_top[:-1]]
        one = np.r_[np.uint64(0), key[:-1]]
        one[place == first] = 0
        top = np.where(last_top >= first, key[np.maximum(last_top, 0)], np.uint64(0))
        return np.stack([top, one])

    def places(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of bits of each token, and the place of each bit among all paths."""
        depth = self.depth[symbols]
        ends = np.cumsum(depth)
        return depth, np.arange(int(depth.sum())) + np.repeat(self.start[symbols] - ends + depth, depth)

    @staticmethod
    def spreads(contexts: np.ndarray) -> np.ndarray:
        """The contexts' part of slots, 24 bits for each table, in one number a token."""
        out = np.zeros(contexts.shape[1], np.uint64)
        for k in range(CONTEXTS):
            out |= (_stirred(contexts[k] + np.uint64(k + 1)) >> np.uint64(40)) << np.uint64(32 * k)
        return out

    @staticmethod
    def slot(spread: np.ndarray, k: int, size: int) -> np.ndarray:
        """Slot in table k, of 2**size slots (2**24 at most), from a place's number and a context's, one xor the other."""
        return ((spread >> np.uint64(32 * k) if k else spread) & np.uint64((1 << size) - 1)).view(np.int64)


def table_size(tokens: int) -> int:
    """Slots of a table, as a power of two: with the training tokens, from 2**12 to 2**22."""
    return min(22, max(12, int(tokens).bit_length()))


class Counter:
    """Count tables of the tokens given to it: (2 * slots) 32-bit counts a context, zeros before ones."""

    def __init__(self, code: Code, size: int):
        self.code, self.size = code, size
        self.tables = np.zeros((CONTEXTS, 2 << size), np.int32)
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, symbols: np.ndarray, contexts: np.ndarray) -> None:
        self.waiting.append(contexts << np.uint64(20) | symbols.astype(np.uint64))
        self.n += len(symbols)
        if self.n >= HELD:
            self.close()

    def close(self) -> None:
        """What follows what is summed first, so a frequent pair costs its bits once."""
        for k, table in enumerate(self.tables if self.n else []):
            pairs, n = np.unique(np.concatenate([p[k] for p in self.waiting]), return_counts=True)
            for s in range(0, len(pairs), SEGMENT):
                part = pairs[s : s + SEGMENT]
                depth, at = self.code.places((part & np.uint64((1 << 20) - 1)).astype(np.int64))
                contexts = np.broadcast_to(part >> np.uint64(20), (CONTEXTS, len(part)))
                spread = self.code.spread.take(at, mode="clip")
                slot = self.code.slot(np.repeat(self.code.spreads(contexts), depth) ^ spread, k, self.size)
                slot += (spread >> np.uint64(63)).view(np.int64) << self.size
                np.add.at(table, slot, np.repeat(n[s : s + SEGMENT].astype(np.int32), depth))
        self.waiting, self.n = [], 0


class Mixer:
    """Weights by gate (how much evidence the contexts have), and the refinement by what came true."""

    def __init__(self, code: Code, tables: np.ndarray, size: int):
        """tables: (CONTEXTS, slots), packed marks."""
        self.code, self.tables, self.size = code, tables, size
        self.weights = np.zeros((INPUTS, LEVELS[0] * LEVELS[1]), np.float32)
        self.weights[:3] = [[0.4], [0.4], [0.2]]
        self.seen = np.zeros((2, LEVELS[0] * ZS))

    def keys(self, symbols: np.ndarray, contexts: np.ndarray, counted: np.ndarray | bool = True) -> np.ndarray:
        """All that a token's chance hangs on, in one number: whether it was counted, its symbol, and its contexts' part of slots."""
        assert (self.code.rest + 1).bit_length() + 1 + CONTEXTS * self.size <= 64
        keys = symbols.astype(np.uint64) + np.where(counted, np.uint64(self.code.rest + 1), np.uint64(0))
        spreads = self.code.spreads(contexts)
        for k in range(CONTEXTS):
            keys = keys << np.uint64(self.size) | self.code.slot(spreads, k, self.size).view(np.uint64)
        return keys

    def _bits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of keys that are all counted or all not: their numbers of bits; the places, the places' numbers and the bits; and where the view
        of each table's slot is. Of counted tokens, the bit's own occurrence is taken out."""
        mask = np.uint64((1 << self.size) - 1)
        symbols = (keys >> np.uint64(CONTEXTS * self.size)).view(np.int64)
        counted = bool(symbols[0] > self.code.rest)
        depth, at = self.code.places(symbols - (self.code.rest + 1) * counted)
        spread = self.code.spread.take(at, mode="clip")
        bits = (spread >> np.uint64(63)).view(np.int64)
        own = (bits + 1) << 16 if counted else 0
        packed = []
        for k, table in enumerate(self.tables):
            slot = np.repeat(keys >> np.uint64((CONTEXTS - 1 - k) * self.size) & mask, depth).view(np.int64)
            slot ^= self.code.slot(spread, k, self.size)
            packed.append(own + table.take(slot, mode="clip").astype(np.int64))
        return depth, at, spread, bits, packed

    @staticmethod
    def _place(z: np.ndarray, level: np.ndarray) -> np.ndarray:
        return level * np.int32(ZS) + (z * np.float32((ZS - 1) / 24) + np.float32(ZS / 2)).astype(np.int32)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """How many zeros and ones of counted tokens fall in each cell. What comes again is looked up once."""
        sums = np.zeros(2 * CELLS)
        keys, n = np.unique(keys, return_counts=True)
        for s in range(0, len(keys), WIDE):
            cells, times = [], []
            for t in range(s, min(s + WIDE, len(keys)), SEGMENT):
                part = slice(t, min(t + SEGMENT, s + WIDE))
                depth, _, spread, bits, packed = self._bits(keys[part])
                cell = bits * OWN_STEPS + (spread >> np.uint64(24) & np.uint64(255)).view(np.int64)
                for x in packed:
                    cell = cell * KINDS + KIND.take(x, mode="clip")
                cells.append(cell)
                times.append(np.repeat(n[part].astype(np.float64), depth))
            sums += np.bincount(np.concatenate(cells), np.concatenate(times), 2 * CELLS)
        return sums.astype(np.int64).reshape(2, CELLS)

    def fit(self, sums: np.ndarray) -> None:
        """Weights by Newton's method from what cells sum up to, each gate for itself, drawn a little to where they began; then the refinement."""
        at = np.flatnonzero(sums.any(axis=0))
        n0, n1 = sums[:, at].astype(np.float64)
        kinds = at // KINDS % KINDS, at % KINDS
        odds = np.stack([(at // KINDS**2) * STEP - FAR, KIND_ODDS[kinds[0]], KIND_ODDS[kinds[1]], np.full(len(at), 0.3)])
        gate, z = KIND_LEVEL[kinds[0]] * LEVELS[1] + KIND_LEVEL[kinds[1]], np.zeros(len(at))
        for g in np.unique(gate):
            rows = np.flatnonzero(gate == g)
            x, a, b = odds[:, rows], n0[rows], n1[rows]
            begun = self.weights[:, g].astype(np.float64)

            def loss(w):
                mixed = w @ x
                return (a * np.logaddexp(0, mixed) + b * np.logaddexp(0, -mixed)).sum() + 2.5 * ((w - begun) ** 2).sum()

            w, now = begun, loss(begun)
            for _ in range(ROUNDS):
                p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
                slope = x @ (b - (a + b) * p) - 5 * (w - begun)
                move = np.linalg.solve((x * ((a + b) * p * (1 - p))) @ x.T + 5 * np.eye(INPUTS), slope)
                while (then := loss(w + move)) > now and np.abs(move).max() > 1e-9:
                    move = move / 2
                if then > now or np.abs(move).max() <= 1e-9:
                    break
                w, now = w + move, then
            self.weights[:, g] = w
            z[rows] = np.clip(w @ x, -12, 12)
        place = self._place(z.astype(np.float32), KIND_LEVEL[kinds[1]].astype(np.int32))
        self.seen = np.stack([np.bincount(place, n, self.seen.shape[1]) for n in (n0, n1)])

    def learn(self, symbols: np.ndarray, contexts: np.ndarray) -> None:
        """From counted tokens, all at once."""
        self.fit(self.count(self.keys(symbols, contexts)))

    def log10(self, symbols: np.ndarray, contexts: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """Of each token. counted: whether the token's own occurrence is in the tables, to be taken out."""
        return self.chances(self.keys(symbols, contexts, counted))

    def chances(self, keys: np.ndarray) -> np.ndarray:
        """The same, of keys."""
        keys, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(keys))
        total = self.seen.sum(axis=0)
        sure = 0.5 * total / (total + 400)
        lift, rest = (sure * (self.seen[1] + 0.5) / (total + 1)).astype(np.float32), (1 - sure).astype(np.float32)
        weights, constant = self.weights[:-1], self.weights[-1] * np.float32(0.3)
        first = int(np.searchsorted(keys, np.uint64(self.code.rest + 1) << np.uint64(CONTEXTS * self.size)))  # counted one
        for s in (*range(0, first, SEGMENT), *range(first, len(keys), SEGMENT)):
            part = slice(s, min(s + SEGMENT, first if s < first else len(keys)))
            depth, at, _, bits, packed = self._bits(keys[part])
            if not len(at):
                continue
            level = LEVEL.take(packed[1], mode="clip")
            gate = (LEVEL.take(packed[0], mode="clip") * np.int8(LEVELS[1]) + level).astype(np.int64)
            z = constant.take(gate, mode="clip")
            for w, o in zip(weights, (self.code.own.take(at, mode="clip"), *(ODDS.take(x, mode="clip") for x in packed))):
                o *= w.take(gate, mode="clip")
                z += o
            np.clip(z, -12, 12, out=z)
            place = self._place(z, level).astype(np.int64)
            p = np.exp(np.negative(z, out=z), out=z)
            p += 1
            np.divide(rest.take(place, mode="clip"), p, out=p)
            p += lift.take(place, mode="clip")  # of a one
            p -= (1 - bits).astype(np.float32)
            np.log(np.maximum(np.abs(p, out=p), np.float32(1e-9), out=p), out=p)
            # All codes have bits, or there is only one symbol and no bit at all.
            out[part] = np.add.reduceat(p, np.cumsum(depth) - depth, dtype=np.float64) / np.log(10)
        return out[back]
