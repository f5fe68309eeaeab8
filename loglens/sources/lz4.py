"""LZ4 blocks behind an eight-byte length, as journal files hold them."""

from __future__ import annotations

MOST = 16 << 20


class BadBlock(ValueError):
    """The bytes are no block of the stated length."""


def decompress(data: bytes, most: int = MOST) -> bytes:
    """The content of a block that follows its length (little-endian, 64 bits)."""
    if len(data) < 8 or (size := int.from_bytes(data[:8], "little")) > most:
        raise BadBlock("no usable length")
    out = block(memoryview(data)[8:], size)
    if len(out) != size:
        raise BadBlock("content differs from its length")
    return bytes(out)


def block(src: memoryview | bytes, most: int) -> bytearray:
    """The content of a bare block: runs of literals, each but the last followed by a copy of earlier output."""
    out, at = bytearray(), 0

    def long_length(start: int) -> int:
        nonlocal at
        total = start
        if start == 15:
            while True:
                if at >= len(src):
                    raise BadBlock("cut off")
                total += src[at]
                at += 1
                if src[at - 1] != 255:
                    break
        return total

    while True:
        if at >= len(src):
            raise BadBlock("cut off")
        token = src[at]
        at += 1
        literals = long_length(token >> 4)
        if at + literals > len(src) or len(out) + literals > most:
            raise BadBlock("cut off")
        out += src[at : at + literals]
        at += literals
        if at == len(src):
            return out
        if at + 2 > len(src):
            raise BadBlock("cut off")
        back = src[at] | src[at + 1] << 8
        at += 2
        if not 0 < back <= len(out):
            raise BadBlock("copy from before the start")
        length = long_length(token & 15) + 4
        if len(out) + length > most:
            raise BadBlock("too long")
        piece = out[-back:]
        out += (piece * (length // back + 1))[:length]
