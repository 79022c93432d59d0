"""PBF: framed blobs of protobuf messages, read and written without a schema compiler.

A frame is a big-endian length, a BlobHeader (type, size) and a Blob (raw, or zlib with its raw size). Field numbers below
are those of the public format. Coordinates come out in fixed units by integer arithmetic.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

from ..model import TYPES
from .varint import Reader, Writer, pack, pack_deltas, pack_list, unpack, unpack_list, unpack_signed, unpack_sums

BLOCK = 8000
KNOWN = {"OsmSchema-V0.6", "DenseNodes"}
PROGRAM = "terrane"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message."""
    r = Reader(data)
    while r.at < len(data):
        key = r.unsigned()
        kind = key & 7
        if kind == 0:
            yield key >> 3, r.unsigned()
        elif kind == 2:
            n = r.unsigned()
            r.at += n
            yield key >> 3, data[r.at - n : r.at]
        elif kind in (1, 5):
            r.at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"wire type {kind} is not known")


def message(*parts: tuple[int, int | bytes | str]) -> bytes:
    w = Writer()
    for number, value in parts:
        if isinstance(value, int):
            w.unsigned(number << 3)
            w.unsigned(value)
        else:
            raw = value.encode() if isinstance(value, str) else value
            w.unsigned(number << 3 | 2)
            w.unsigned(len(raw))
            w.data += raw
    return bytes(w.data)


# ---- frames ----


def frame(kind: str, body: bytes) -> bytes:
    small = zlib.compress(body)
    blob = message((2, len(body)), (3, small)) if len(small) < len(body) else message((1, body))
    head = message((1, kind), (3, len(blob)))
    return struct.pack(">i", len(head)) + head + blob


def frames(f) -> Iterator[tuple[str, int, int]]:
    """Type, offset and size of each blob, read from headers only."""
    while raw := f.read(4):
        (n,) = struct.unpack(">i", raw)
        if not 0 < n <= 64 << 10:
            raise ValueError("a blob header is out of bounds")
        head = dict(fields(f.read(n)))
        yield bytes(head[1]).decode(), f.tell(), int(head[3])
        f.seek(int(head[3]), 1)


def inflate(blob: bytes) -> bytes:
    got = dict(fields(blob))
    if 1 in got:
        return bytes(got[1])
    if 3 in got:
        body = zlib.decompress(got[3])
        if len(body) != got.get(2, len(body)):
            raise ValueError("a blob's size is not what it says")
        return body
    raise ValueError("a blob's compression is not known")


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def read_header(body: bytes) -> tuple[int, int]:
    """Replication timestamp and sequence number, 0 where unset. A required feature that is not known is an error."""
    when = sequence = 0
    for number, value in fields(body):
        if number == 4 and bytes(value).decode() not in KNOWN:
            raise ValueError(f"the file needs {bytes(value).decode()}")
        when = _signed(value) if number == 32 else when
        sequence = _signed(value) if number == 33 else sequence
    return when, sequence


def header(when: int = 0, sequence: int = 0) -> bytes:
    parts = [(4, f) for f in sorted(KNOWN, reverse=True)] + [(16, PROGRAM)]
    parts += [(32, when)] if when > 0 else []
    parts += [(33, sequence)] if sequence > 0 else []
    return frame("OSMHeader", message(*parts))


# ---- blocks ----


def decode(body: bytes, kind: str) -> Iterator[tuple]:
    """Entities of one kind in a block."""
    strings: list[str] = []
    groups, granularity, lat0, lon0 = [], 100, 0, 0
    for number, value in fields(body):
        if number == 1:
            strings = [bytes(s).decode() for n, s in fields(value) if n == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            granularity = value
        elif number == 19:
            lat0 = _signed(value)
        elif number == 20:
            lon0 = _signed(value)

    def fixed(v, offset: int):
        nano = np.asarray(v, np.int64) * granularity + offset
        return np.where(nano < 0, -(-nano // 100), nano // 100)

    def tagged(parts: dict) -> list[tuple[str, str]]:
        return [(strings[k], strings[v]) for k, v in zip(unpack_list(parts.get(2, b"")), unpack_list(parts.get(3, b"")))]

    for group in groups:
        for number, value in fields(group):
            if kind == "nodes" and number == 1:
                got = dict(fields(value))
                one = lambda n: unpack_signed(pack(np.array([got.get(n, 0)], np.uint64)))  # noqa: E731, B023
                yield int(one(1)[0]), int(fixed(one(8), lat0)[0]), int(fixed(one(9), lon0)[0]), tagged(got)
            elif kind == "nodes" and number == 2:
                got = dict(fields(value))
                ids, lats, lons = (np.cumsum(unpack_signed(got.get(n, b""))) for n in (1, 8, 9))
                tags: list[list] = [[] for _ in ids]
                at, codes = 0, unpack(got.get(10, b"")).tolist()
                i = 0
                while i < len(codes):
                    if codes[i] == 0:
                        at, i = at + 1, i + 1
                    else:
                        tags[at].append((strings[codes[i]], strings[codes[i + 1]]))
                        i += 2
                yield from zip(ids.tolist(), fixed(lats, lat0).tolist(), fixed(lons, lon0).tolist(), tags)
            elif kind == "ways" and number == 3:
                got = dict(fields(value))
                yield _signed(got.get(1, 0)), unpack_sums(got.get(8, b"")), tagged(got)
            elif kind == "relations" and number == 4:
                got = dict(fields(value))
                roles, ids, kinds = unpack_list(got.get(8, b"")), unpack_sums(got.get(9, b"")), unpack_list(got.get(10, b""))
                yield _signed(got.get(1, 0)), [(TYPES[t] if t < len(TYPES) else None, i, strings[r]) for t, i, r in zip(kinds, ids, roles)], tagged(got)


class Strings:
    """A block's string table: codes from 1 in the order first seen; 0 is the empty string that opens the table."""

    def __init__(self):
        self.codes: dict[str, int] = {}

    def code(self, s: str) -> int:
        return self.codes.setdefault(s, len(self.codes) + 1)

    def table(self) -> bytes:
        return message((1, ""), *((1, s) for s in self.codes))


def _delta(values: Iterable[int]) -> bytes:
    return pack_deltas(list(values))


def encode(kind: str, entities: Iterable[tuple]) -> Iterator[bytes]:
    """Frames of at most BLOCK entities, nodes always dense."""
    rest = iter(entities)
    while chunk := list(islice(rest, BLOCK)):
        s = Strings()
        if kind == "nodes":
            codes = [c for e in chunk for c in (*(s.code(x) for t in e[3] or [] for x in t), 0)]
            group = message((2, message(*((n, _delta(e[i] for e in chunk)) for n, i in ((1, 0), (8, 1), (9, 2))), (10, pack(np.array(codes, np.uint64))))))
        else:
            parts = []
            for e in chunk:
                tags = e[-1] or []
                own = [(1, e[0]), (2, pack_list([s.code(k) for k, _ in tags])), (3, pack_list([s.code(v) for _, v in tags]))]
                if kind == "ways":
                    parts.append((3, message(*own, (8, _delta(e[1])))))
                else:
                    roles, kinds = [s.code(r or "") for _, _, r in e[1]], [TYPES.index(t) for t, _, _ in e[1]]
                    parts.append((4, message(*own, (8, pack_list(roles)), (9, _delta(m[1] for m in e[1])), (10, pack_list(kinds)))))
            group = message(*parts)
        yield frame("OSMData", message((1, s.table()), (2, group)))
