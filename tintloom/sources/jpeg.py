"""Baseline JPEG in NumPy: all blocks are transformed at once; only the codes of a scan are read one by one.

Sequential DCT with Huffman codes and 8 bits a sample, 1 or 3 components, any sampling, restart intervals, and streams
whose tables stand elsewhere (as in TIFF). Progressive, lossless, arithmetic and 12-bit streams are errors.
"""

from __future__ import annotations

import re
import struct

import numpy as np

# Quantization of quality 50, rows of 8, and the usual Huffman codes (codes by length, then symbols).
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
DC_LUMA = "00010501010101010100000000000000", "000102030405060708090a0b"
DC_CHROMA = "00030101010101010101010000000000", "000102030405060708090a0b"
AC_LUMA = (
    "0002010303020403050504040000017d",
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
)
AC_CHROMA = (
    "00020102040403040705040400010277",
    "0001020311040521310612415107617113223281081442"
    "91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
)


def _zigzag() -> np.ndarray:
    """Places (rows of 8) in the order of a scan: diagonals, up and down by turns."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


ZIGZAG = _zigzag()
_K = np.arange(8)
#: The DCT as a matrix: rows are frequencies.
DCT = np.cos((2 * _K[None] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)


def _codes(lengths: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, bits) of canonical codes."""
    out, code, k = [], 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out.append((symbols[k], code, bits))
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Tables:
    """Quantization and codes as a stream has them; look-ups by the next 16 bits give bits << 8 | symbol."""

    def __init__(self, other: Tables | None = None):
        self.quant: dict[int, np.ndarray] = dict(other.quant) if other else {}
        self.codes: dict[tuple[int, int], list[int]] = dict(other.codes) if other else {}

    def take(self, marker: int, data: bytes) -> None:
        at = 0
        while at < len(data):
            kind, which, at = data[at] >> 4, data[at] & 15, at + 1
            if marker == 0xDB:
                width = 2 if kind else 1
                self.quant[which] = np.frombuffer(data, ">u2" if kind else np.uint8, 64, at).astype(np.float64)
                at += 64 * width
            else:
                lengths = data[at : at + 16]
                symbols = data[at + 16 : at + 16 + sum(lengths)]
                look = np.zeros(1 << 16, np.int64)
                for symbol, code, bits in _codes(lengths, symbols):
                    look[code << 16 - bits : code + 1 << 16 - bits] = bits << 8 | symbol
                self.codes[kind, which] = look.tolist()
                at += 16 + len(symbols)


class _Bits:
    """The bits of a stretch between restart markers; ``list[i]`` has the 8 bytes from byte base + i on."""

    AHEAD = 1 << 16

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data + b"\xff" * 16, np.uint8)
        self.end = 8 * len(data)
        self.move(0)

    def move(self, byte: int) -> None:
        part = self.data[byte : byte + self.AHEAD + 8].astype(np.uint64)
        n = max(0, len(part) - 7)
        words = np.zeros(n, np.uint64)
        for i in range(8):
            words |= part[i : i + n] << np.uint64(56 - 8 * i)
        self.base, self.list = byte, words.tolist()


def _segments(data: bytes, tables: Tables | None = None):
    """Frame, tables, restart interval, Adobe's transform and the scan (its header, and where its data begins)."""
    found, at = Tables(tables), 0
    frame = scan = None
    restart, transform = 0, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("not a JPEG stream")
        marker = data[at + 1]
        at += 2
        if marker in (0xD8, 0x01, 0xFF) or 0xD0 <= marker <= 0xD7:
            at -= marker == 0xFF
            continue
        if marker == 0xD9:
            break
        size = struct.unpack(">H", data[at : at + 2])[0]
        body = data[at + 2 : at + size]
        at += size
        if marker in (0xDB, 0xC4):
            found.take(marker, body)
        elif marker in (0xC0, 0xC1):
            frame = body
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline JPEG is supported")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xEE and body[:5] == b"Adobe":
            transform = body[11]
        elif marker == 0xDA:
            scan = body, at
            break
    return frame, found, restart, transform, scan


def shared_tables(data: bytes) -> Tables:
    """Tables of a stream that holds nothing else."""
    return _segments(data)[1]


def _stretches(data: bytes, at: int) -> list[bytes]:
    """The scan's data from byte ``at``, parted at restart markers, without stuffing."""
    end = next((m.start() for m in re.finditer(rb"\xff[^\x00\xff\xd0-\xd7]", data[at:], re.DOTALL)), len(data) - at)
    return [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff+[\xd0-\xd7]", data[at : at + end])]


def _read_scan(stretches: list[bytes], units: list[tuple[int, int, int, int, list, list]], across: int, n_units: int, restart: int) -> list[tuple[list, list]]:
    """Places and values of the coefficients of each component.

    units: for each block of a unit its component, its place in the unit (x and y), the blocks in a row of the
    component, and look-ups for DC and AC.
    """
    found: list[tuple[list, list]] = [([], []) for _ in range(1 + max(u[0] for u in units))]
    wide = {c: (1 + max(u[1] for u in units if u[0] == c), 1 + max(u[2] for u in units if u[0] == c)) for c in {u[0] for u in units}}
    zigzag, done = ZIGZAG.tolist(), 0
    for data in stretches:
        bits, p, before = _Bits(data), 0, [0] * len(found)
        for k in range(done, min(n_units, done + restart) if restart else n_units):
            if (p >> 3) - bits.base > _Bits.AHEAD // 2:
                bits.move(p >> 3)
            words, base = bits.list, bits.base
            for c, bx, by, row, dc, ac in units:
                block = ((k // across * wide[c][1] + by) * row + k % across * wide[c][0] + bx) * 64
                places, values = found[c]
                w = words[(p >> 3) - base] >> 32 - (p & 7) & 0xFFFFFFFF
                e = dc[w >> 16]
                n, s = e >> 8, e & 255
                if not n or s > 15:
                    raise ValueError("broken JPEG codes")
                if s:
                    v = w >> 32 - n - s & (1 << s) - 1
                    before[c] += v if v >> s - 1 else v - (1 << s) + 1
                places.append(block)
                values.append(before[c])
                p += n + s
                i = 1
                while i < 64:
                    w = words[(p >> 3) - base] >> 32 - (p & 7) & 0xFFFFFFFF
                    e = ac[w >> 16]
                    n, s = e >> 8, e & 15
                    if not n:
                        raise ValueError("broken JPEG codes")
                    if not s:
                        p += n
                        if e & 255 == 0xF0:
                            i += 16
                            continue
                        break
                    i += e >> 4 & 15
                    if i > 63:
                        raise ValueError("broken JPEG codes")
                    v = w >> 32 - n - s & (1 << s) - 1
                    places.append(block + zigzag[i])
                    values.append(v if v >> s - 1 else v - (1 << s) + 1)
                    p += n + s
                    i += 1
            if p > bits.end + 64:
                raise ValueError("a JPEG stream is shorter than its size")
        done = min(n_units, done + restart) if restart else n_units
        if done == n_units:
            return found
    raise ValueError("a JPEG stream is shorter than its size")


def _smooth(x: np.ndarray, axis: int) -> np.ndarray:
    """Twice as many samples along an axis: each between its nearest (3 parts) and the next (1 part), times 4."""
    x = np.moveaxis(x, axis, 0)
    ahead, behind = np.concatenate([x[1:], x[-1:]]), np.concatenate([x[:1], x[:-1]])
    out = np.empty((2 * len(x), *x.shape[1:]), x.dtype)
    out[::2], out[1::2] = 3 * x + behind, 3 * x + ahead
    return np.moveaxis(out, 0, axis)


def _enlarged(x: np.ndarray, fx: int, fy: int) -> np.ndarray:
    """Samples at full resolution: smooth where a side is doubled, else repeated. The rounding alternates from left to right."""
    x = x.astype(np.int32)
    if (fx, fy) == (2, 2):
        out = _smooth(_smooth(x, 0), 1)
        out[:, ::2] += 8
        out[:, 1::2] += 7
        return out >> 4
    if (fx, fy) == (2, 1):
        out = _smooth(x, 1)
        out[:, ::2] += 1
        out[:, 1::2] += 2
        return out >> 2
    return x.repeat(fx, axis=1).repeat(fy, axis=0)


def decode(data: bytes, tables: Tables | None = None, ycc: bool | None = None) -> np.ndarray:
    """The image of a stream as RGB. ycc: whether its colours are luminance and chroma; None: as the stream says."""
    frame, found, restart, transform, scan = _segments(data, tables)
    if frame is None or scan is None:
        raise ValueError("a JPEG stream without an image")
    bits, h, w, n = struct.unpack(">BHHB", frame[:6])
    if bits != 8 or n not in (1, 3) or not (h and w):
        raise ValueError(f"JPEG of {n} components of {bits} bits is not supported")
    parts = [(frame[6 + 3 * i], frame[7 + 3 * i] >> 4, frame[7 + 3 * i] & 15, frame[8 + 3 * i]) for i in range(n)]
    if scan[0][0] != n:
        raise ValueError("JPEG scans of single components are not supported")
    chosen = {scan[0][1 + 2 * i]: scan[0][2 + 2 * i] for i in range(n)}
    if n == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    mx, my = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-w // (8 * mx)), -(-h // (8 * my))
    units = []
    for c, (name, sx, sy, _) in enumerate(parts):
        codes = [found.codes.get((kind, chosen[name] >> 4 if kind == 0 else chosen[name] & 15)) for kind in (0, 1)]
        if None in codes:
            raise ValueError("a JPEG stream lacks its codes")
        units += [(c, bx, by, across * sx, *codes) for by in range(sy) for bx in range(sx)]
    planes = []
    try:
        coefficients = _read_scan(_stretches(data, scan[1]), units, across, across * down, restart)
    except IndexError as e:
        raise ValueError("a JPEG stream is shorter than its size") from e
    for (places, values), (_, sx, sy, q) in zip(coefficients, parts, strict=True):
        if q not in found.quant:
            raise ValueError("a JPEG stream lacks its quantization")
        rows, cols = down * sy, across * sx
        coded = np.zeros(rows * cols * 64)
        coded[places] = values
        scale = np.empty(64)
        scale[ZIGZAG] = found.quant[q]
        blocks = DCT.T @ (coded.reshape(-1, 8, 8) * scale.reshape(8, 8)) @ DCT
        plane = np.clip(np.rint(blocks + 128), 0, 255).astype(np.uint8).reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)
        plane = plane[: -(-h * sy // my), : -(-w * sx // mx)]
        planes.append(_enlarged(plane, mx // sx, my // sy)[:h, :w])
    if n == 1:
        return np.repeat(planes[0][..., None], 3, axis=2).astype(np.uint8)
    if ycc is None:
        ycc = transform != 0 if transform is not None else [p[0] for p in parts] != [82, 71, 66]
    if not ycc:
        return np.stack(planes, -1).astype(np.uint8)
    y, cb, cr = (p.astype(np.float64) for p in planes)
    cb, cr = cb - 128, cr - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb], -1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _quantization(quality: int) -> list[np.ndarray]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA)]


def table_segments(quality: int) -> bytes:
    """The tables of streams of a quality from 1 to 100."""
    out = b"".join(_segment(0xDB, bytes([i]) + q[ZIGZAG].astype(np.uint8).tobytes()) for i, q in enumerate(_quantization(quality)))
    for which, codes in ((0x00, DC_LUMA), (0x10, AC_LUMA), (0x01, DC_CHROMA), (0x11, AC_CHROMA)):
        out += _segment(0xC4, bytes([which]) + b"".join(map(bytes.fromhex, codes)))
    return out


def _look_up(codes: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    code, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, c, n in _codes(*map(bytes.fromhex, codes)):
        code[symbol], bits[symbol] = c, n
    return code, bits


def _size_and_bits(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The size class of each value, and its bits."""
    size = np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def _packed(values: np.ndarray, lengths: np.ndarray, step: int = 200_000) -> bytes:
    """Values of the given numbers of bits, one after the other; the last byte is filled with ones."""
    out, rest = [], np.zeros(0, np.uint8)
    for a in range(0, len(values), step):
        n = lengths[a : a + step]
        ends = np.cumsum(n)
        shift = np.repeat(ends, n) - 1 - np.arange(ends[-1])
        rest = np.concatenate([rest, (np.repeat(values[a : a + step], n) >> shift & 1).astype(np.uint8)])
        whole = len(rest) // 8 * 8
        out.append(np.packbits(rest[:whole]).tobytes())
        rest = rest[whole:]
    if len(rest):
        out.append(np.packbits(np.concatenate([rest, np.ones(8 - len(rest), np.uint8)])).tobytes())
    return b"".join(out)


def encode(image: np.ndarray, quality: int = 90, subsample: bool = True, tables: bool = True) -> bytes:
    """A stream of an RGB image: luminance and chroma, the latter at half resolution with ``subsample``.

    Without ``tables`` they must stand elsewhere (``table_segments`` of the same quality).
    """
    h, w, _ = image.shape
    step = 16 if subsample else 8
    x = np.pad(image, ((0, -h % step), (0, -w % step), (0, 0)), mode="edge").astype(np.float64)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    chroma = [-0.168735892 * r - 0.331264108 * g + 0.5 * b + 128, 0.5 * r - 0.418687589 * g - 0.081312411 * b + 128]
    if subsample:
        chroma = [c.reshape(c.shape[0] // 2, 2, c.shape[1] // 2, 2).mean((1, 3)) for c in chroma]
    quant, scan = _quantization(quality), []
    down, across = x.shape[0] // step, x.shape[1] // step
    for c, plane in enumerate((y, *chroma)):
        n = 2 if subsample and c == 0 else 1
        blocks = np.rint(plane).reshape(down, n, 8, across, n, 8).transpose(0, 3, 1, 4, 2, 5).reshape(-1, 8, 8) - 128
        coded = np.rint(DCT @ blocks @ DCT.T / quant[c > 0].reshape(8, 8)).astype(np.int64).reshape(-1, 64)[:, ZIGZAG]
        coded[:, 0] = np.diff(coded[:, 0], prepend=0)
        scan.append(coded.reshape(down * across, n * n, 64))
    coded = np.concatenate(scan, axis=1)
    kinds = np.tile(np.arange(coded.shape[1]) >= scan[0].shape[1], len(coded))
    coded = coded.reshape(-1, 64)
    look = [(_look_up(DC_LUMA), _look_up(AC_LUMA)), (_look_up(DC_CHROMA), _look_up(AC_CHROMA))]
    # symbols with the place where they stand: block, coefficient, and long runs of zeros before a coefficient
    at, k = np.nonzero(coded[:, 1:])
    gap = k - np.where(np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool), -1, np.r_[0, k[:-1]] if len(k) else k) - 1
    runs = np.repeat(np.arange(len(at)), gap // 16)
    last = np.full(len(coded), -1)
    last[at] = k
    short = np.flatnonzero(last < 62)
    size_dc, bits_dc = _size_and_bits(coded[:, 0])
    size_ac, bits_ac = _size_and_bits(coded[at, k + 1])
    blocks = np.concatenate([np.arange(len(coded)), at[runs], at, short])
    order = np.concatenate([np.zeros(len(coded), np.int64), 2 * k[runs] + 1, 2 * k + 2, np.full(len(short), 200)])
    symbol = np.concatenate([size_dc, np.full(len(runs), 0xF0), (gap % 16) << 4 | size_ac, np.zeros(len(short), np.int64)])
    size = np.concatenate([size_dc, np.zeros(len(runs), np.int64), size_ac, np.zeros(len(short), np.int64)])
    extra = np.concatenate([bits_dc, np.zeros(len(runs), np.int64), bits_ac, np.zeros(len(short), np.int64)])
    code, bits = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64)
    of_chroma, is_dc = kinds[blocks], order == 0
    for c in (0, 1):
        for d in (0, 1):
            which = (of_chroma == bool(c)) & (is_dc == (d == 0))
            code[which], bits[which] = look[c][d][0][symbol[which]], look[c][d][1][symbol[which]]
    sort = np.lexsort((order, blocks))
    data = _packed((code << size | extra)[sort], (bits + size)[sort]).replace(b"\xff", b"\xff\x00")
    head = b"\xff\xd8" + (_segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + table_segments(quality) if tables else b"")
    sampling = 0x22 if subsample else 0x11
    head += _segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, sampling, 0, 2, 0x11, 1, 3, 0x11, 1]))
    return head + _segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + data + b"\xff\xd9"
