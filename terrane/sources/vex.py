"""VEX: blocks of one entity type. A block is a 4-byte mark, entity count and compressed size (big-endian), and zlib data.

Inside a block differences start from 0: ids and coordinates from entity to entity, node references of ways across the
whole block; members are absolute. Entities here are tuples: (id, lat, lon, tags), (id, refs, tags), (id, members, tags),
with tags as (key, value) and members as (type, id, role).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

from ..model import TYPES
from .varint import Reader, Writer

MARKS = {b"VEXN": "nodes", b"VEXW": "ways", b"VEXR": "relations"}  # fixed values
SIZE, MARGIN = 1 << 20, 1 << 16
FULL = SIZE - (1 << 10)  # deflating may add some bytes
MAX_TAGS, MAX_STRING = 500, 1024


def _put(w: Writer, kind: str, e: tuple, last: list[int]) -> None:
    w.signed(e[0] - last[0])
    last[0] = e[0]
    tags = e[-1] or []
    w.unsigned(len(tags))
    for k, v in tags:
        w.string(k)
        w.string(v)
    if kind == "nodes":
        w.signed(e[1] - last[1])
        w.signed(e[2] - last[2])
        last[1], last[2] = e[1], e[2]
    elif kind == "ways":
        w.unsigned(len(e[1]))
        for ref in e[1]:
            w.signed(ref - last[1])
            last[1] = ref
    else:
        w.unsigned(len(e[1]))
        for type_, id_, role in e[1]:
            w.signed(id_)
            w.unsigned(TYPES.index(type_))
            w.string(role or "")


def encode(kind: str, entities: Iterable[tuple]) -> Iterator[bytes]:
    """Blocks of SIZE at most. An entity that would make a block larger begins the next one; one that is larger itself is a block alone."""
    mark = next(m for m, k in MARKS.items() if k == kind)
    w, last, n = Writer(), [0, 0, 0], 0

    def block() -> bytes:
        body = zlib.compress(bytes(w.data))
        return mark + struct.pack(">ii", n, len(body)) + body

    for e in entities:
        held = len(w.data)
        _put(w, kind, e, last)
        if n and len(w.data) > FULL:
            del w.data[held:]
            yield block()
            w, last, n = Writer(), [0, 0, 0], 0
            _put(w, kind, e, last)
        n += 1
        if len(w.data) > SIZE - MARGIN:
            yield block()
            w, last, n = Writer(), [0, 0, 0], 0
    if n:
        yield block()


def blocks(f) -> Iterator[tuple[str, int, int, int]]:
    """Kind, entity count, offset and size of each block's data, read from headers only."""
    while head := f.read(12):
        if len(head) < 12 or head[:4] not in MARKS:
            raise ValueError("not a VEX block")
        n, size = struct.unpack(">ii", head[4:])
        if not (0 <= n <= SIZE and 0 <= size and (n == 1 or size <= SIZE)):
            raise ValueError("a VEX block's header is out of bounds")
        yield MARKS[head[:4]], n, f.tell(), size
        f.seek(size, 1)


def decode(kind: str, n: int, body: bytes, limits: bool = True) -> Iterator[tuple]:
    """limits: refuse over 500 tags and strings over 1024 bytes. Bytes after the last entity are padding."""
    r, last = Reader(zlib.decompress(body), MAX_STRING if limits else None), [0, 0, 0]
    for _ in range(n):
        last[0] += r.signed()
        count = r.unsigned32()
        if limits and count > MAX_TAGS:
            raise ValueError(f"{count} tags on one entity: corrupted")
        tags = [(r.string(), r.string()) for _ in range(count)]
        if kind == "nodes":
            last[1] += r.signed()
            last[2] += r.signed()
            yield last[0], last[1], last[2], tags
        elif kind == "ways":
            refs = []
            for _ in range(r.unsigned32()):
                last[1] += r.signed()
                refs.append(last[1])
            yield last[0], refs, tags
        else:
            members = []
            for _ in range(r.unsigned32()):
                id_ = r.signed()
                members.append((TYPES[r.unsigned32()], id_, r.string()))
            yield last[0], members, tags
