"""Varints: base-128 integers, least group first; zigzag maps signed to unsigned."""

from __future__ import annotations

import numpy as np

U64 = (1 << 64) - 1


def zigzag(n: int) -> int:
    return (n << 1 ^ n >> 63) & U64


def unzigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values, one after another."""
    v = np.asarray(values, np.uint64)
    if not len(v):
        return b""
    width = np.ones(len(v), np.int64)
    for k in range(1, 10):
        width += v >> np.uint64(7 * k) > 0
    start = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    for k in range(int(width.max())):
        has = width > k
        out[start[has] + k] = (v[has] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | np.where(width[has] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def pack_signed(values: np.ndarray) -> bytes:
    v = np.asarray(values, np.int64)
    return pack((v << 1 ^ v >> 63).view(np.uint64))


def unpack(data: bytes | memoryview) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(b < 128)
    if not len(ends) or ends[-1] != len(b) - 1:
        raise ValueError("a varint is cut off")
    starts = np.r_[0, ends[:-1] + 1]
    if (ends - starts).max() > 9:
        raise ValueError("a varint is longer than 10 bytes")
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def unpack_signed(data: bytes | memoryview) -> np.ndarray:
    v = unpack(data)
    return (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).view(np.int64)


SHORT = 64  # values up to which plain loops are quicker than arrays


def pack_list(values: list[int]) -> bytes:
    """As pack, of a list that may be short."""
    if len(values) > SHORT:
        return pack(np.array(values, np.uint64))
    out = bytearray()
    for n in values:
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
    return bytes(out)


def pack_deltas(values: list[int]) -> bytes:
    """Differences of neighbours, the first one from 0, as signed values."""
    if len(values) > SHORT:
        return pack_signed(np.diff(np.array(values, np.int64), prepend=0))
    steps, before = [], 0
    for v in values:
        d = (v - before + (1 << 63) & U64) - (1 << 63)
        steps.append((d << 1 ^ d >> 63) & U64)
        before = v
    return pack_list(steps)


def unpack_list(data: bytes) -> list[int]:
    """As unpack, to a list that may be short."""
    if len(data) > 4 * SHORT:
        return unpack(data).tolist()
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        if b < 128:
            out.append(n & U64)
            n = shift = 0
        else:
            shift += 7
            if shift > 63:
                break
    return unpack(data).tolist() if shift else out  # which says what is wrong


def unpack_sums(data: bytes) -> list[int]:
    """Running sums of signed values: what pack_deltas packs."""
    if len(data) > 4 * SHORT:
        return np.cumsum(unpack_signed(data)).tolist()
    out, at = [], 0
    for n in unpack_list(data):
        at = (at + (n >> 1 ^ -(n & 1)) + (1 << 63) & U64) - (1 << 63)
        out.append(at)
    return out


class Writer:
    def __init__(self):
        self.data = bytearray()

    def unsigned(self, n: int) -> None:
        n &= U64
        while n > 127:
            self.data.append(n & 127 | 128)
            n >>= 7
        self.data.append(n)

    def signed(self, n: int) -> None:
        self.unsigned(zigzag(n))

    def string(self, s: str) -> None:
        raw = s.encode()
        self.unsigned(len(raw))
        self.data += raw


class Reader:
    def __init__(self, data: bytes, limit: int | None = None):
        """limit: bytes of a string."""
        self.data, self.at, self.limit = data, 0, limit

    def unsigned(self) -> int:
        n = shift = 0
        while True:
            if self.at >= len(self.data):
                raise ValueError("a varint is cut off")
            b = self.data[self.at]
            self.at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n & U64
            shift += 7
            if shift > 63:
                raise ValueError("a varint is longer than 10 bytes")

    def unsigned32(self) -> int:
        return self.unsigned() & 0xFFFFFFFF

    def signed(self) -> int:
        return unzigzag(self.unsigned())

    def string(self) -> str:
        n = self.unsigned32()
        if self.limit is not None and n > self.limit:
            raise ValueError(f"a string of {n} bytes is over the limit of {self.limit}")
        if self.at + n > len(self.data):
            raise ValueError("a string is cut off")
        self.at += n
        return bytes(self.data[self.at - n : self.at]).decode()
