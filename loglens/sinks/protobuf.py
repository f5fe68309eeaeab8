"""Protocol-buffer wire format, as far as telemetry requests need it."""

from __future__ import annotations

VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


def varint(n: int) -> bytes:
    """Base-128 groups, low ones first; negative numbers as 64-bit two's complement."""
    n &= (1 << 64) - 1
    groups = []
    while n > 0x7F:
        groups.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*groups, n])


def tag(field: int, kind: int) -> bytes:
    return varint(field << 3 | kind)


def number(field: int, n: int) -> bytes:
    return tag(field, VARINT) + varint(n)


def fixed64(field: int, n: int) -> bytes:
    return tag(field, FIXED64) + (n & (1 << 64) - 1).to_bytes(8, "little")


def fixed32(field: int, n: int) -> bytes:
    return tag(field, FIXED32) + (n & (1 << 32) - 1).to_bytes(4, "little")


def chunk(field: int, data: bytes | str) -> bytes:
    """A string, byte string or nested message."""
    raw = data.encode() if isinstance(data, str) else data
    return tag(field, BYTES) + varint(len(raw)) + raw


def fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """(field, value) of a message: numbers as they are, the rest as bytes."""
    out, at = [], 0

    def read() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return n

    while at < len(data):
        key = read()
        kind, size = key & 7, {FIXED64: 8, FIXED32: 4}.get(key & 7)
        if kind == VARINT:
            out.append((key >> 3, read()))
            continue
        size = read() if kind == BYTES else size
        if size is None or at + size > len(data):
            raise ValueError("bad message")
        out.append((key >> 3, data[at : at + size]))
        at += size
    return out
