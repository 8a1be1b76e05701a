"""Lossless JPEG (process 14, start of frame 3), as raw tiles use it."""

from __future__ import annotations

import struct

import numpy as np

LOOKUP_BITS = 16


def huffman(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(length, symbol) for every 16-bit look-ahead of a canonical code; length 0 is no code."""
    length, symbol = np.zeros(1 << LOOKUP_BITS, np.uint8), np.zeros(1 << LOOKUP_BITS, np.uint8)
    code = k = 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            a = code << (LOOKUP_BITS - n)
            if a >= 1 << LOOKUP_BITS:
                raise ValueError("bad code table")
            length[a: a + (1 << (LOOKUP_BITS - n))] = n
            symbol[a: a + (1 << (LOOKUP_BITS - n))] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


class Bits:
    """Bits of an entropy-coded part; beyond its end there are zeros."""

    def __init__(self, data: bytes) -> None:
        self.data = data.replace(b"\xff\x00", b"\xff") + bytes(8)
        self.at = 0

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        word = int.from_bytes(self.data[byte: byte + 5], "big") if byte + 5 <= len(self.data) else 0
        return word >> (40 - n - (self.at & 7)) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        v = self.peek(n) if n else 0
        self.at += n
        return v


def difference(bits: Bits, table: tuple[np.ndarray, np.ndarray]) -> int:
    ahead = bits.peek(LOOKUP_BITS)
    n, s = int(table[0][ahead]), int(table[1][ahead])
    if not n or s > 16:
        raise ValueError("bad code")
    bits.at += n
    if s == 0:
        return 0
    if s == 16:
        return 32768
    v = bits.take(s)
    return v if v >> (s - 1) else v - (1 << s) + 1


def predict(kind: int, left: int, above: int, corner: int) -> int:
    return (0, left, above, corner, left + above - corner, left + ((above - corner) >> 1), above + ((left - corner) >> 1), (left + above) >> 1)[kind]


def decode(data: bytes, width: int, height: int) -> np.ndarray:
    """Samples of a tile; its components are laid side by side in each row."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    at, tables, restart, frame = 2, {}, 0, None
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("bad marker")
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4: at + 2 + size]
        at += 2 + size
        if kind == 0xC4:
            k = 0
            while k + 17 <= len(body):
                n = sum(body[k + 1: k + 17])
                tables[body[k] & 15] = huffman(body[k + 1: k + 17], body[k + 17: k + 17 + n])
                k += 17 + n
        elif kind == 0xC3:
            precision, rows, cols, parts = struct.unpack_from(">BHHB", body)
            frame = (precision, rows, cols, parts)
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xDA:
            break
    if frame is None or not 1 <= frame[3] <= 4:
        raise ValueError("no lossless frame")
    precision, rows, cols, parts = frame
    if cols * parts != width or rows != height:
        # Two components may hold two rows or columns of the tile; only their number counts.
        if cols * parts * rows != width * height:
            raise ValueError("tile has another size")
    chosen = [tables[body[2 + 2 * k] >> 4] for k in range(body[0])]
    kind, shift = body[1 + 2 * body[0]], body[3 + 2 * body[0]] & 15
    if not 1 <= kind <= 7:
        raise ValueError("bad predictor")
    stream, pieces, k = data[at:], [], 0
    start = 0
    while k + 1 < len(stream):
        if stream[k] == 0xFF and stream[k + 1] != 0:
            pieces.append(stream[start:k])
            if not 0xD0 <= stream[k + 1] <= 0xD7:
                start = None
                break
            start = k + 2
            k += 1
        k += 1
    if start is not None:
        pieces.append(stream[start:])
    out = np.zeros((rows, cols, parts), np.int64)
    base = 1 << (precision - shift - 1)
    bits, top = Bits(pieces[0]), 1 << (precision - shift)
    piece, left_in_piece, fresh = 0, restart, True
    for y in range(rows):
        for x in range(cols):
            if restart and left_in_piece == 0:
                piece += 1
                bits = Bits(pieces[piece] if piece < len(pieces) else b"")
                left_in_piece, fresh = restart, True
            for c in range(parts):
                if fresh:
                    p = base
                elif y == 0 or (restart and piece and y * cols + x < piece * restart + cols):
                    p = int(out[y, x - 1, c]) if x else int(out[y - 1, x, c])
                elif x == 0:
                    p = int(out[y - 1, x, c])
                else:
                    p = predict(kind, int(out[y, x - 1, c]), int(out[y - 1, x, c]), int(out[y - 1, x - 1, c]))
                v = (p + difference(bits, chosen[c])) & 0xFFFF
                if v >= top:
                    raise ValueError("sample beyond precision")
                out[y, x, c] = v
            fresh = False
            left_in_piece -= 1
    return (out << shift).reshape(height, width).astype(np.uint16)
