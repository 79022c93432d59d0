"""LM scoring by logistic context mixing, over the stream of a document's tokens, in order.

A token is coded as bits: the path of a Huffman tree for FREQUENT words, and for all others the path of their first two bytes,
then their count or spelling among the words that begin so. Hashed-context predictors, which reach over words, are mixed by gated
weights and refined adaptively (token_mixing). The bits' log probabilities sum to the token's, the text's, and so to bits per byte.

Among rare words of one beginning, one that training has seen c times weighs c - 1/2, and all that training has not seen weigh
as much as the words seen once (and 1/2). Of these, each has its share by spelling: the bits of further bytes and of a closing
space, by the same kind of mixer over contexts inside the word (place and last byte, the last two, three and four bytes, the
whole beginning), counted over the words that occur once, each once, as new words look like these. Within a document, rare
words of one beginning are learned as they come (Witten-Bell): after t of them, u distinct, n of this one, (n + u * p) / (t + u).

1. Words are counted over all documents (in tasks before the shuffle), training and held-out counts apart. Texts are split in pieces of
   PIECE bytes, here and in step 2, so that only a piece's distinct words become objects and are looked up.
2. Texts are read once more, into streams of symbols that the next steps take. Count tables of contexts are filled from all training tokens, and added up by slot block in a shuffle. They have as many
   slots as there are training tokens, from 2**12 to 2**22 each, which bounds memory; frequent contexts stay exact in them at
   any size, and rare ones share slots beyond that.
3. Both mixers learn from all that trains, and do not hang on partitions. That of tokens is fit to sums over all bits of all training
   tokens. That of spelling learns from every word seen once: these are dealt to shards by a hash, each of about SHARD words is gone
   through online in the order of the hash, and the shards' weights are averaged, their evidence is added up.
4. Documents are scored; their rare words meet the vocabulary in a join, with u / n of each repeat, as (n + u * p) / (t + u)
   is n / (t + u) times 1 + p * u / n.

Word counts grow with the corpus; only tables of bounded size and FREQUENT words travel to all tasks.

Defined results: null text is empty text (one token, the end); a null doc_id trains (its crc32 is that of empty text)
and is returned as null; repeated rows are each counted and scored; with no training rows all counts are zero and
the base is 0 for each token; an empty table gives an empty result. Very long texts are scored in segments, with contexts
carried on. Extra columns are ignored. Words of equal counts go in byte order. A word that training has seen once, and that is not frequent, is priced
by its count in the text that it is from too, so that its own occurrence counts; a new word costs what its spelling costs, at any length.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import token_mixing
from .scratch import drop, stash

FREQUENT, LONGEST = 1 << 17, 256  # words with a code of their own, of those seen twice: how many, and their bytes at most
STARTS = 1023  # beginnings with a code of their own
SHARD = 60_000  # words from which one speller learns, about
TASK_TOKENS = 12_000_000  # that one task counts contexts of; its tables are as large as those of the corpus
BATCH = 60_000  # tokens of one stream
BITS = (21, 18, 20, 20, 21)  # slots of the spelling tables: word so far, place and last byte, last two bytes, three, four
SLOT_BLOCK = 1 << 16
PIECE = 1 << 20  # bytes of text whose distinct words are looked up once
FLUSH = 300_000  # distinct words that a task counts before it sends them on
GRID = 1 << 15  # bytes spelled side by side
TREE = 1 << 20  # bytes of sorted words, of which what several begin with is spelled once
LESSON = 256  # words whose bits the speller learns from at a time
RATE = 0.04
GATES = (4, 4)
SPACE = 32

# Of a group of documents: a row of its token stream (kind 0), and one for each document's rare word (kind 1).
READ = pa.schema(
    [("kind", pa.int32()), ("uid", pa.int64()), ("stream", pa.binary())]
    + [(k, pa.list_(v)) for k, v in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()))]
    + [("word", pa.binary()), ("n", pa.int64()), ("repeats", pa.list_(pa.float64()))]
)
READ_SCHEMA = "kind int, uid long, stream binary, doc_id array<long>, held_out array<boolean>, n_bytes array<long>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>, word binary, n long, repeats array<double>"
STREAM = ("uid", "stream", "doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base", "score")
DOC_SCHEMA = "uid long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, score double"
BLOCK_SCHEMA = "t int, at int, blob binary"


def tokens(text: str | None) -> list[bytes]:
    """Words and the end (an empty word). bytes.lower() and bytes.split() touch A-Z and the six ASCII spaces alone."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(b"")
    return words


def _listed(words: pa.Array) -> list[bytes]:
    """What to_pylist() gives, where nothing is null, several times as fast."""
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    flat = (words.buffers()[2] or pa.py_buffer(b""))[int(ends[0]) : int(ends[-1])].to_pybytes()
    ends = (ends - ends[0]).tolist()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _cut(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs that end as soon as their sizes add up to most."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(ends):
        end = min(len(ends), int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most)) + 1)
        yield slice(begin, end)
        begin = end


def _flat_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The same of many texts, in one array; and each text's number of tokens and bytes."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = (flat != SPACE) & (flat - np.uint8(9) > 4)
    after, before = np.zeros(len(flat) + 1, bool), np.zeros(len(flat) + 1, bool)
    after[1:], before[:-1] = inside, inside
    # Words end where texts do. An end at 0 touches the last place of before[1:], where there is nothing.
    after[ends], before[ends] = False, False
    begin, close = np.flatnonzero(inside & ~after[:-1]), np.flatnonzero(inside & ~before[1:]) + 1
    last = np.searchsorted(begin, ends[1:])  # words up to the end of each text
    lengths = np.insert(close - begin, last, 0)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.py_buffer(np.frombuffer(flat.tobytes().lower(), np.uint8)[inside])])
    return words, np.diff(last, prepend=0) + 1, np.diff(ends)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Documents, by PIECE bytes of text or little more: their ids, whether they are held out, their numbers of tokens and of bytes; and
    all tokens, as numbers of distinct words."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for part in _cut(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64), PIECE):
            words, sizes, n_bytes = _flat_tokens(texts.slice(part.start, part.stop - part.start))
            words = words.dictionary_encode()
            yield ids[part], np.array([held_out(i) for i in ids[part]]), sizes, n_bytes, words.indices.to_numpy(), words.dictionary


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def trains() -> Column:
    """The same as not held_out, as a column."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1


# ---- counting ----


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, n = [], 0

    def summed() -> pa.RecordBatch:
        words = pa.concat_arrays([w for w, _ in found]).dictionary_encode()
        counts = np.bincount(words.indices.to_numpy(), np.concatenate([c for _, c in found]), len(words.dictionary))
        return pa.RecordBatch.from_arrays([words.dictionary, pa.array(counts.astype(np.int64))], names=["word", "c"])

    for _, held, sizes, _, numbers, words in _pieces(batches):
        found.append((words, np.bincount(numbers[np.repeat(~held, sizes)], minlength=len(words))))
        n += len(words)
        if n > 2 * FLUSH:
            row = summed()
            found, n = [(row.column(0), row.column(1).to_numpy())], row.num_rows
            if n > FLUSH:
                yield row
                found, n = [], 0
    if found:
        yield summed()


def _squeeze(part: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(part.tobytes())


def _unsqueeze(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _block(t: int, at: int, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([at], pa.int32()), pa.array([_squeeze(part)], pa.binary())], names=["t", "at", "blob"])


def _blocks(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Tables of shape (2, slots), by blocks of slots that are not empty."""
    for t, table in enumerate(tables):
        for at in range(0, table.shape[1], SLOT_BLOCK):
            part = table[:, at : at + SLOT_BLOCK]
            if part.any():
                yield _block(t, at, np.ascontiguousarray(part, np.int32))


def _add(pack):
    """Rows come by table and block; their counts are added up, then packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for t, at, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                part = _unsqueeze(blob, np.int32).astype(np.int64)
                if (t, at) == now:
                    total = total + part
                    continue
                if now is not None:
                    yield _block(*now, pack(total.reshape(2, -1)))
                now, total = (t, at), part
        if now is not None:
            yield _block(*now, pack(total.reshape(2, -1)))

    return run


def _gathered(blocks: DataFrame, pack, tables: list[np.ndarray]) -> list[np.ndarray]:
    """Tables of all tasks added up: a row for each block leaves the sums, whatever the input."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = blocks.repartition(parts, "t", "at").sortWithinPartitions("t", "at").mapInArrow(_add(pack), BLOCK_SCHEMA).toArrow()
    for t, at, blob in zip(added["t"].to_pylist(), added["at"].to_pylist(), added["blob"].to_pylist()):
        kind = tables[t].dtype
        part = _unsqueeze(blob, kind).reshape(*tables[t].shape[:-1], -1)
        tables[t][..., at : at + part.shape[-1]] = part
    return tables


# ---- the token stream ----


def _pack(counts: np.ndarray) -> np.ndarray:
    return token_mixing.marks(counts[1]) << np.uint16(8) | token_mixing.marks(counts[0])


def _rows(kind: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()) if f.name == "kind" else columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in READ], schema=READ)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, where runs of equals begin in it, and each one's place in its run."""
    order = np.argsort(keys, kind="stable")
    begins = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, int)
    return order, begins, np.arange(len(keys)) - np.repeat(begins, np.diff(np.r_[begins, len(keys)]))


def _repeated(doc: np.ndarray, words: list[bytes] | pa.Array, starts: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Rare words of documents, in order, and their beginnings. Of each, n / (t + u) by what its document has shown of its beginning (see
    above; u / (t + u) for a new one); and for each document and word, how often it comes and u / n of its repeats, for the join."""
    words = pa.array(words, pa.binary())
    word = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    order, begins, place = _runs(doc * max(1, len(words)) + word)
    n = np.empty(len(words), np.int64)
    n[order] = place
    by_start, firsts, t_there = _runs(doc << 32 | starts)
    new = (n[by_start] == 0).astype(np.int64)
    before = np.cumsum(new) - new
    t, u = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    t[by_start], u[by_start] = t_there, before - np.repeat(before[firsts], np.diff(np.r_[firsts, len(words)]))
    some = np.maximum(u, 1)
    again = order[place > 0]
    times = np.diff(np.r_[begins, len(words)])
    listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(times - 1)], pa.int32()), pa.array(u[again] / n[again], pa.float64()))
    shown = order[begins]
    return np.where(n > 0, n, some) / (t + some), {"uid": pa.array(doc[shown]), "word": words.take(pa.array(shown)), "n": pa.array(times), "repeats": listed}


def _read(code: token_mixing.Code, bases: np.ndarray):
    """Token streams of texts, and what hangs on no weights. bases: the base score of each frequent word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for ids, all_held, all_sizes, all_bytes, numbers, words in _pieces(batches):
            distinct = _listed(words)
            symbol_of = code.symbols(distinct)
            hash_of = np.zeros(len(distinct), np.uint32)
            hash_of[symbol_of >= len(bases)] = code.rare_hashes(distinct, symbol_of)
            base_of = np.where(symbol_of < len(bases), np.r_[bases, 0.0][np.minimum(symbol_of, len(bases))], 0.0)
            all_ends = np.cumsum(all_sizes)
            for part in _cut(all_sizes, BATCH):  # documents, by as many as have BATCH tokens together
                held, sizes = all_held[part], all_sizes[part]
                firsts = np.cumsum(sizes) - sizes
                number = numbers[all_ends[part.start] - all_sizes[part.start] : all_ends[part.stop - 1]]
                symbols, base = symbol_of[number], base_of[number]
                frequent = symbols < len(bases)
                rare = np.flatnonzero(~frequent)
                doc = np.repeat(np.arange(len(sizes)), sizes)[rare]
                share, rows = _repeated(doc, words.take(pa.array(number[rare])), symbols[rare])
                rows["uid"] = pa.array(rows["uid"].to_numpy() + uid)
                yield _rows(1, rows)
                columns = {
                    "doc_id": ids[part],
                    "held_out": held.tolist(),
                    "n_bytes": all_bytes[part].tolist(),
                    "n_tokens": sizes.tolist(),
                    "n_known": np.add.reduceat(frequent.astype(np.int64), firsts).tolist(),
                    "base": np.add.reduceat(base, firsts).tolist(),
                    "score": np.bincount(doc, np.log10(share), len(sizes)).tolist(),
                }
                stream = zstandard.ZstdCompressor(level=1).compress(symbols.astype(np.int32).tobytes() + hash_of[number[rare]].tobytes())
                yield _rows(0, {"uid": pa.array([uid]), "stream": pa.array([stream])} | {k: pa.array([v], READ.field(k).type) for k, v in columns.items()})
                uid += len(sizes)

    return run


def _streams(code: token_mixing.Code, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of kind 0, with all tokens' symbols, contexts and whether they were counted."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            sizes = np.array(row["n_tokens"])
            flat = _unsqueeze(row["stream"], np.uint32)
            symbols, firsts = flat[: sizes.sum()].astype(np.int64), np.cumsum(sizes) - sizes
            yield row, symbols, code.contexts_by(flat[len(symbols) :], symbols, firsts), np.repeat(~np.array(row["held_out"]), sizes)


def _fill(code: token_mixing.Code, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_mixing.Counter(code, size)
        for _, symbols, contexts, trained in _streams(code, batches):
            counter.add(symbols[trained], contexts[:, trained])
        counter.close()
        yield from _blocks([t.reshape(2, -1) for t in counter.tables])

    return run


def _lesson(code: token_mixing.Code, packed: list[bytes], size: int):
    """What all training tokens sum up to, by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = token_mixing.Mixer(code, [_unsqueeze(p, np.uint16) for p in packed], size)
        sums, keys, n = np.zeros((2, token_mixing.CELLS), np.int64), [], 0
        for _, symbols, contexts, trained in _streams(code, batches):
            keys.append(mixer.keys(symbols[trained], contexts[:, trained]))
            n += len(keys[-1])
            if n >= token_mixing.HELD:
                sums += mixer.count(np.concatenate(keys))
                keys, n = [], 0
                if sums.max() > 1 << 30:  # blocks hold 32-bit counts
                    yield from _blocks([sums])
                    sums[:] = 0
        if keys:
            sums += mixer.count(np.concatenate(keys))
        yield from _blocks([sums])

    return run


# ---- the spelling of words ----


_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]


def _tree(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted words, and the spaces that close them, each byte's word and place; the bytes that begin something new, as places in all
    the text; and for each byte which of these it is the same as, with all before it in its word."""
    lengths = np.array([len(w) + 1 for w in words])
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(flat)) - np.repeat(starts, lengths)
    shift = np.repeat(np.r_[0, lengths[:-1]], lengths)  # to the same place of the word before; 0 in the first word
    same = (flat[np.arange(len(flat)) - shift] == flat) & (place < shift)
    alike = np.minimum.reduceat(np.where(same, len(flat), place), starts)
    new = place >= np.repeat(alike, lengths)
    # Place by place: an old byte is the same as the one of the last word that had a new one there.
    order = np.argsort(place.astype(np.uint16 if lengths.max() < 1 << 16 else np.int64), kind="stable")
    stands = np.empty(len(flat), np.int64)
    stands[order] = np.maximum.accumulate(np.where(new[order], np.arange(len(flat)), 0))
    number = np.cumsum(new) - 1
    return word, place, np.flatnonzero(new), number[order[stands]]


def _steps(words: list[bytes], some: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, list[np.ndarray]]]:
    """For each bit place of the bytes of words, and of the spaces that close them: the words, places in them, the bit place, the
    bits, and the slots in each table. GRID bytes at a time. With some of the bytes, their numbers among these instead of the words."""
    lengths = np.array([len(w) + 1 for w in words])
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    place = np.arange(len(flat)) - np.repeat(starts, lengths)
    # The whole beginning: a sum of bytes times powers of an odd number, up to the byte before.
    apart = [np.uint64(k * int(_ODD[1]) & (1 << 64) - 1) for k in range(5)]
    powers = np.cumprod(np.full(int(lengths.max()), _ODD[0] | np.uint64(1)))
    summed = np.r_[np.uint64(0), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers[place])]
    total = len(flat) if some is None else len(some)
    for s in range(0, total, GRID):
        at = np.arange(s, min(s + GRID, total))
        rows = at if some is not None else word[at]
        at = at if some is None else some[at]
        w, i, byte = word[at], place[at], flat[at].astype(np.uint64)
        last = np.zeros(len(at), np.uint64)
        for j in range(1, 5):
            last |= np.where(i >= j, flat[np.maximum(at - j, 0)], SPACE).astype(np.uint64) << np.uint64(8 * j - 8)
        whole = summed[at] - summed[starts[w]] + i.astype(np.uint64)
        contexts = [whole * _ODD[0], ((last & np.uint64(255)) | np.minimum(i, 24).astype(np.uint64) << np.uint64(8)) * _ODD[0] + _ODD[1]]
        contexts += [(last & np.uint64((1 << 8 * k) - 1)) * _ODD[0] + apart[k] for k in (2, 3, 4)]
        node = np.ones(len(at), np.uint64)
        for b in range(8):
            slots = []
            for c, bits in zip(contexts, BITS):
                h = (c + node) * _ODD[1]
                slots.append(((h ^ h >> np.uint64(29)) * _ODD[0] >> np.uint64(64 - bits)).view(np.int64))
            bit = (byte >> np.uint64(7 - b) & np.uint64(1)).astype(np.int64)
            yield rows, i, b, bit, slots
            node = node * np.uint64(2) + bit.astype(np.uint64)


_SCALE = 2000.0
_decode = np.rint(np.exp2(np.arange(65536) / _SCALE) * 4 - 4) / 4
_decode = _decode.astype(np.float32)
# As it is, and less one: of a word's own occurrence.
_counts = np.r_[_decode, np.maximum(_decode - 1, 0)]
_logs = {few: np.log(_counts + np.float32(few)) for few in (0.02, 0.2)}


def _encode(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(np.log2(1.0 + counts) * _SCALE), 65535).astype(np.uint16)


def _chunks(words: list[bytes]) -> Iterator[slice]:
    """Words whose bytes are held together: about TREE bytes."""
    return _cut(np.fromiter(map(len, words), np.int64, len(words)) + 1, TREE)


def _fill_spelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count tables of words, each once. They come sorted."""
    tables = [np.zeros((2, 1 << b), np.int32) for b in BITS]
    for words in _held(batches):
        _, _, new, same = _tree(words)
        times = np.bincount(same, minlength=len(new)).astype(np.int32)
        for rows, _, _, bit, slots in _steps(words, new):
            for table, slot in zip(tables, slots):
                np.add.at(table.ravel(), bit * table.shape[1] + slot, times[rows])
    yield from _blocks(tables)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Words by about TREE bytes, whatever their batches."""
    words, size = [], 0
    for batch in batches:
        words += _listed(batch.column("word"))
        size += batch.column("word").nbytes
        if size >= TREE:
            yield from (words[part] for part in _chunks(words))
            words, size = [], 0
    if words:
        yield from (words[part] for part in _chunks(words))


class Speller:
    """Weights by gate, and the adaptive table of the last step, of the mixer of bits inside a word."""

    N = len(BITS) + 1

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables  # of shape (2, slots), 16-bit logarithms of counts
        self.weights = np.full((GATES[0] * GATES[1], self.N), 0.25)
        self.weights[:, -1] = 0
        self.seen = np.zeros((2, 8 * 3 * 33))

    def inputs(self, slots: list[np.ndarray], bit: np.ndarray, own: np.ndarray | None):
        """Log odds of each predictor, a row each, and the gate. own: 1 for words whose own occurrence is taken out."""
        odds, size = np.empty((self.N, len(bit)), np.float32), []
        less1 = 0 if own is None else (own * bit).astype(np.int64) << 16
        less0 = 0 if own is None else (own * (1 - bit)).astype(np.int64) << 16
        for t, slot in enumerate(slots):
            at0, at1 = less0 + self.tables[t][0].take(slot, mode="clip"), less1 + self.tables[t][1].take(slot, mode="clip")
            logs = _logs[0.02 if t == 0 else 0.2]
            np.subtract(logs.take(at1, mode="clip"), logs.take(at0, mode="clip"), out=odds[t])
            if t in (0, 4):
                size.append(_counts.take(at0, mode="clip") + _counts.take(at1, mode="clip"))
        odds[-1] = 0.3
        gate = np.zeros(len(bit), np.int64)
        for seen, limits, one in zip(size, ((0.5, 8, 64), (7, 63, 511)), (GATES[1], 1)):
            for limit in limits:
                gate += (seen >= limit).view(np.int8) * np.int8(one)
        return np.clip(odds, -14, 14, out=odds), gate

    @staticmethod
    def _place(z: np.ndarray, i: np.ndarray, b: int) -> np.ndarray:
        return (np.minimum(i, 2) * 8 + b) * 33 + np.clip(np.rint(z * 2) + 16, 0, 32).astype(np.int64)

    def predict(self, odds: np.ndarray, gate: np.ndarray, i: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Chance of a one by the mixer, and refined."""
        z = np.clip(np.einsum("ji,ij->i", odds, self.weights[gate]), -16, 16)
        p = 1 / (1 + np.exp(-z))
        at = self._place(z, i, b)
        n0, n1 = self.seen[0, at], self.seen[1, at]
        strength = 40.0
        refined = (n1 + strength * p) / (n0 + n1 + strength)
        return z, np.where(np.abs(z) < 6, 0.5 * p + 0.5 * refined, p)

    def learn(self, words: list[bytes]) -> None:
        """Online: predict each bit without the word's own count, then move the weights of its gate and the adaptive table."""
        for _, i, b, bit, slots in _steps(words):
            odds, gate = self.inputs(slots, bit, np.ones(len(bit), np.int64))
            z = np.clip(np.einsum("ji,ij->i", odds, self.weights[gate]), -16, 16)
            err = bit - 1 / (1 + np.exp(-z))
            total = np.bincount(gate, minlength=len(self.weights))
            some = total > 0
            for j in range(self.N):
                self.weights[some, j] += RATE * np.clip(np.bincount(gate, err * odds[j], len(self.weights))[some] / total[some], -2, 2)
            at = self._place(z, i, b)
            # Old evidence fades, so that what was counted under early weights goes.
            self.seen *= 0.9998
            self.seen += np.bincount(at + self.seen.shape[1] * bit, minlength=self.seen.size).reshape(self.seen.shape)

    def log10(self, words: list[bytes], told: np.ndarray) -> np.ndarray:
        """Of the bytes of each word, and its end, that follow the first ones (told). words: sorted."""
        word, place, new, same = _tree(words)
        chance = np.zeros(len(new))
        for rows, i, b, bit, slots in _steps(words, new):
            odds, gate = self.inputs(slots, bit, None)
            _, p = self.predict(odds, gate, i, b)
            p = np.clip(np.where(bit == 1, p, 1 - p), 1e-9, 1)
            chance[rows] += np.log10(p)
        untold = place >= told[word]
        return np.bincount(word[untold], chance[same[untold]], len(words))


def _learn_spelling(packed: list[bytes]):
    """Rows come by shard: a speller learns from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_unsqueeze(p, np.uint16).reshape(2, -1) for p in packed]
        rows = (row for batch in batches for row in zip(batch.column("shard").to_numpy().tolist(), _listed(batch.column("word"))))
        for shard, group in itertools.groupby(rows, itemgetter(0)):
            speller, n = Speller(tables), 0
            for lesson in itertools.batched(group, LESSON):
                speller.learn([word for _, word in lesson])
                n += len(lesson)
            columns = ([shard], pa.int64()), ([n], pa.int64()), ([speller.weights.tobytes()], pa.binary()), ([speller.seen.tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], names=["shard", "n", "weights", "seen"])

    return run


def _spellers(once_only: DataFrame, n: int, packed: list[bytes]) -> Speller:
    """One speller of what those of all shards have learned: each word that training has seen once is in one. n: how many such words there are."""
    shards = max(1, -(-n // SHARD))
    parts = int(once_only.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = once_only.withColumn("at", F.xxhash64("word")).withColumn("shard", F.pmod("at", F.lit(shards)))
    dealt = dealt.repartition(min(parts, shards), "shard").sortWithinPartitions("shard", "at", "word").select("shard", "word")
    learned = dealt.mapInArrow(_learn_spelling(packed), "shard long, n long, weights binary, seen binary").toArrow().sort_by("shard").to_pylist()
    speller = Speller([])
    if learned:
        speller.weights = sum(r["n"] * np.frombuffer(r["weights"]) for r in learned).reshape(speller.weights.shape) / sum(r["n"] for r in learned)
        speller.seen = sum(np.frombuffer(r["seen"]) for r in learned).reshape(speller.seen.shape)
    return speller


def _rate(packed: list[bytes], weights: np.ndarray, seen: np.ndarray, starts: dict[bytes, tuple[float, float]], rest: tuple[float, float]):
    """Rare words with their log probabilities among the words of their beginning. starts: weight of known and of new words, by beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller([_unsqueeze(p, np.uint16).reshape(2, -1) for p in packed])
        speller.weights, speller.seen = weights, seen
        numbers, pairs = {s: i for i, s in enumerate(starts)}, np.array([*starts.values(), rest], np.float64)
        # In order, and many at a time: words that begin alike meet.
        for batch in itertools.chain.from_iterable(map(pa.Table.to_batches, map(pa.Table.combine_chunks, map(pa.Table.from_batches, itertools.batched(batches, 8))))):
            column, c = batch.column("word"), batch.column("c").to_numpy().astype(np.float64)
            words = _listed(column)
            start = np.fromiter(map(numbers.get, map(token_mixing.beginning, words), itertools.repeat(len(starts))), np.int64, len(words))
            known, other = pairs[start].T
            lp = np.log10(np.where(c > 0, c - 0.5, other) / (known + other))
            new = np.flatnonzero(c == 0)
            new = new[pc.sort_indices(column.take(pa.array(new))).to_numpy()]
            fresh = [words[i] for i in new.tolist()]
            told = np.where(start[new] < len(starts), 2, 0)
            for part in _chunks(fresh):
                lp[new[part]] += speller.log10(fresh[part], told[part])
            yield pa.RecordBatch.from_arrays([column.cast(pa.binary()), pa.array(c.astype(np.int64), pa.int64()), pa.array(lp, pa.float64())], names=["word", "c", "lp"])

    return run


# ---- documents ----


def _sum_up(code: token_mixing.Code, packed: list[bytes], size: int, weights: np.ndarray, seen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = token_mixing.Mixer(code, [_unsqueeze(p, np.uint16) for p in packed], size)
        mixer.weights, mixer.seen = weights, seen
        waiting, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            """What comes again in many streams is looked up once."""
            chances = mixer.chances(np.concatenate([keys for _, keys in waiting]))
            for row, keys in waiting:
                sizes = np.array(row["n_tokens"])
                scores = np.add.reduceat(chances[: len(keys)], np.cumsum(sizes) - sizes) + np.array(row["score"])
                chances = chances[len(keys) :]
                columns = [pa.array(np.arange(len(sizes)) + row["uid"])] + [pa.array(row[k], READ.field(k).type.value_type) for k in STREAM[2:-1]] + [pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=[STREAM[0], *STREAM[2:]])

        for row, symbols, contexts, trained in _streams(code, batches):
            waiting.append((row, mixer.keys(symbols, contexts, trained)))
            n += len(symbols)
            if n >= token_mixing.HELD:
                yield from out()
                waiting, n = [], 0
        if waiting:
            yield from out()

    return run


def _squeezed(tables: list[np.ndarray]) -> list[bytes]:
    """Tables travel compressed: they are as large as their contents, not as their slots."""
    return [_squeeze(t) for t in tables]


def score_documents(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = stash(texts.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()

    def base(c):
        return np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))

    # FREQUENT words at most, of LONGEST bytes at most, so they can travel; the least of equals.
    head = stash(counted.where((F.col("c") > 1) & (F.octet_length("word") <= LONGEST)).orderBy(F.desc("c"), "word").limit(FREQUENT), "frequent-words")
    top = head.orderBy(F.desc("c"), "word").toArrow()
    others = stash(counted.join(F.broadcast(head.select("word")), "word", "left_anti"), "rare-words")
    by_start = others.where("c > 0").groupBy(F.expr("substring(concat(word, X'20'), 1, 2)").alias("start")).agg(F.sum(F.col("c") - 0.5).alias("known"), F.sum(F.when(F.col("c") == 1, 1.0).otherwise(0.0)).alias("once")).orderBy(F.desc(F.expr("known + once")), "start").toArrow()
    # There are 65,536 beginnings at most.
    starts = {s: (known, once + 0.5) for s, known, once in zip(*(by_start[k].to_pylist() for k in ("start", "known", "once")))}
    listed = dict(list(starts.items())[:STARTS])
    rest = (sum(k for k, _ in list(starts.values())[STARTS:]), sum(n - 0.5 for _, n in list(starts.values())[STARTS:]) + 0.5)
    words = top["word"].to_pylist()
    code = token_mixing.Code(words, top["c"].to_pylist(), list(listed), [round(sum(x)) for x in listed.values()], round(sum(rest)))
    size = token_mixing.table_size(total)

    tasks = max(6, min(parts, -(-total // TASK_TOKENS)))
    read = stash(texts.mapInArrow(_read(code, base(top["c"].to_numpy().astype(np.float64))), READ_SCHEMA), "texts-read")
    streams = read.where("kind = 0").select(*STREAM)
    filled = streams.coalesce(tasks).mapInArrow(_fill(code, size), BLOCK_SCHEMA)
    packed = _squeezed(_gathered(filled, _pack, [np.zeros(1 << size, np.uint16) for _ in range(token_mixing.CONTEXTS)]))
    mixer = token_mixing.Mixer(code, [], size)
    lessons = streams.mapInArrow(_lesson(code, packed, size), BLOCK_SCHEMA)
    mixer.fit(_gathered(lessons, np.ascontiguousarray, [np.zeros((2, token_mixing.CELLS), np.int64)])[0])

    once_only = counted.where("c = 1").select("word")
    spelled = once_only.coalesce(tasks).sortWithinPartitions("word").mapInArrow(_fill_spelling, BLOCK_SCHEMA)
    letters = _squeezed(_gathered(spelled, _encode, [np.zeros((2, 1 << b), np.uint16) for b in BITS]))
    speller = _spellers(once_only, round(sum(n - 0.5 for _, n in starts.values())), letters)
    rated = stash(others.mapInArrow(_rate(letters, speller.weights, speller.seen, listed, rest), "word binary, c long, lp double"), "rated-words")

    summed = stash(streams.mapInArrow(_sum_up(code, packed, size, mixer.weights, mixer.seen), DOC_SCHEMA), "document-sums")
    own_base = F.log10((F.col("c") + 0.5) / F.lit(float(total + 0.5 * (distinct + 1))))
    again = F.aggregate("repeats", F.lit(0.0), lambda total, r: total + F.log1p(r * F.pow(F.lit(10.0), "lp"))) / math.log(10)
    rest_of = (
        read.where("kind = 1").select("uid", "word", "n", "repeats").join(rated.hint("shuffle_hash"), "word")
        .groupBy("uid")
        .agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * own_base).alias("b"), F.sum(F.col("lp") + again).alias("s"))
    )
    score = F.col("score") + F.coalesce("s", F.lit(0.0))
    out = stash(
        summed.join(rest_of, "uid", "left").select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
            F.lit(int(total)).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
            score.alias("score"),
            "n_bytes",
            (-score * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
        ),
        "document-scores",
    )
    drop(counted, head, others, read, rated, summed)
    return out
