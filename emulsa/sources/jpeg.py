"""A baseline JPEG of one image: 8 bits, no subsampling, the standard tables; for the image sink.

Quality scales the quantisation tables as usual (50: as they stand).  Blocks are transformed by NumPy; only coefficients
that aren't zero are visited one by one.
"""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the baseline standard: quantisation (luminance, chrominance) in reading order.
LUMINANCE = (
    "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 "
    "18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
)
CHROMINANCE = "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99 " + "99 " * 32
#: Codes of each length from 1 on for the sizes of differences of DC (luminance table, used for all components).
DC_COUNTS, DC_VALUES = (0, 1, 5, 1, 1, 1, 1, 1, 1), tuple(range(12))
#: Any complete code serves AC coefficients; ours has a code of 8 bits for each of the 162 run and size pairs.
AC_VALUES = tuple([0x00, 0xF0] + [run << 4 | size for size in range(1, 11) for run in range(16)])
AC_COUNTS = (0, 0, 0, 0, 0, 0, 0, len(AC_VALUES))

ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
_K = np.arange(8)
DCT = np.sqrt(np.where(_K[:, None] == 0, 1, 2) / 8) * np.cos((2 * _K + 1) * _K[:, None] * np.pi / 16)


def codes(counts: tuple[int, ...], values: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """value: (code, bits), in canonical order."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for v in values[at : at + n]:
            out[v] = (code, bits)
            code += 1
        at, code = at + n, code << 1
    return out


def quantisation(base: str, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base.split(), int) * scale + 50) // 100, 1, 255)


def _blocks(plane: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Quantised coefficients of every 8 x 8 block in zigzag order; edges are repeated."""
    h, w = plane.shape
    plane = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    cells = plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    return np.rint((DCT @ cells @ DCT.T).reshape(-1, 64) / q).astype(int)[:, ZIGZAG]


def _number(v: int) -> tuple[int, int]:
    size = abs(v).bit_length()
    return (v if v >= 0 else v + (1 << size) - 1), size


def jpeg(rgb: np.ndarray, quality: int = 95) -> bytes:
    """rgb: (height, width, 3) of 0..255; quality is cut to 1..100."""
    quality = min(max(int(quality), 1), 100)
    tables = [quantisation(LUMINANCE, quality), quantisation(CHROMINANCE, quality)]
    r, g, b = (rgb[..., k].astype(float) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402]
    parts = [_blocks(p, tables[min(k, 1)]) for k, p in enumerate(planes)]
    dc, ac, bits = codes(DC_COUNTS, DC_VALUES), codes(AC_COUNTS, AC_VALUES), []
    put = lambda v, n: bits.append(f"{v:0{n}b}") if n else None
    before = [0, 0, 0]
    for k in range(len(parts[0])):
        for c, blocks in enumerate(parts):
            block = blocks[k]
            v, size = _number(int(block[0]) - before[c])
            before[c] = int(block[0])
            put(*dc[size])
            put(v, size)
            last = 0
            for i in np.flatnonzero(block[1:]) + 1:
                run = int(i) - last - 1
                for _ in range(run // 16):
                    put(*ac[0xF0])
                v, size = _number(int(block[i]))
                put(*ac[run % 16 << 4 | size])
                put(v, size)
                last = int(i)
            if last < 63:
                put(*ac[0x00])
    line = "".join(bits)
    line += "1" * (-len(line) % 8)
    body = int(line, 2).to_bytes(len(line) // 8, "big").replace(b"\xff", b"\xff\x00") if line else b""
    segment = lambda mark, data: struct.pack(">BBH", 0xFF, mark, len(data) + 2) + data
    huffman = lambda kind, counts, values: segment(0xC4, bytes([kind, *counts, *[0] * (16 - len(counts)), *values]))
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    head += b"".join(segment(0xDB, bytes([k, *t[ZIGZAG].tolist()])) for k, t in enumerate(tables))
    head += segment(0xC0, struct.pack(">BHHB", 8, *rgb.shape[:2], 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    head += huffman(0x00, DC_COUNTS, DC_VALUES) + huffman(0x10, AC_COUNTS, AC_VALUES)
    return head + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + body + b"\xff\xd9"
