"""Small encoders and decoders for PNG, TIFF and BMP, on top of struct and zlib."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import jpeg

# TIFF tags used here.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, JPEG_TABLES, SUBSAMPLING = 317, 347, 530
X_RES, Y_RES, PLANAR, UNIT, TILE_W, TILE_H, TILES, TILE_BYTES, SUBFILE = 282, 283, 284, 296, 322, 323, 324, 325, 254
#: Not a tag: the byte order of the file, "<" or ">", as read_tiff_directories found it.
ORDER = 0
SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 7: ("s", 1), 16: ("Q", 8)}


def encode_png(image: np.ndarray) -> bytes:
    h, w, _ = image.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image).reshape(h, w * 3)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def encode_tiff(image: np.ndarray, lzw: bool = False) -> bytes:
    """A baseline RGB TIFF of one strip, uncompressed or LZW."""
    h, w, _ = image.shape
    data = np.ascontiguousarray(image).tobytes()
    if lzw:
        data = pack_lzw(data)
        data += bytes(len(data) % 2)
    entries = [(WIDTH, 4, 1, w), (HEIGHT, 4, 1, h), (BITS, 3, 3, 8 + len(data)), (COMPRESSION, 3, 1, 5 if lzw else 1), (PHOTOMETRIC, 3, 1, 2), (STRIPS, 4, 1, 8), (SAMPLES, 3, 1, 3), (ROWS, 4, 1, h), (STRIP_BYTES, 4, 1, len(data)), (PLANAR, 3, 1, 1)]
    ifd = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, 8 + len(data) + 6) + data + struct.pack("<HHH", 8, 8, 8) + ifd


def bigtiff_header(first_ifd: int) -> bytes:
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, first_ifd)


def bigtiff_ifds(start: int, images: list[dict]) -> bytes:
    """Directories of tiled RGB images, one after the other, beginning at byte ``start``.

    Each image: width, height, tile, offsets, sizes, resolution, unit; the first is the full level. With compression 7
    also tables, those that its JPEG blocks share.
    """
    out = b""
    for k, im in enumerate(images):
        n = len(im["offsets"])
        ratio = struct.pack("<II", round(im["resolution"] * 1000) & 0xFFFFFFFF, 1000)
        fields = [
            (SUBFILE, 4, struct.pack("<I", int(k > 0))), (WIDTH, 4, struct.pack("<I", im["width"])), (HEIGHT, 4, struct.pack("<I", im["height"])),
            (BITS, 3, struct.pack("<HHH", 8, 8, 8)), (COMPRESSION, 3, struct.pack("<H", im.get("compression", 8))), (PHOTOMETRIC, 3, struct.pack("<H", 6 if "tables" in im else 2)), (SAMPLES, 3, struct.pack("<H", 3)),
            (X_RES, 5, ratio), (Y_RES, 5, ratio), (PLANAR, 3, struct.pack("<H", 1)), (UNIT, 3, struct.pack("<H", im["unit"])),
            (TILE_W, 4, struct.pack("<I", im["tile"])), (TILE_H, 4, struct.pack("<I", im["tile"])),
            (TILES, 16, struct.pack(f"<{n}Q", *im["offsets"])), (TILE_BYTES, 16, struct.pack(f"<{n}Q", *im["sizes"])),
        ]
        if "tables" in im:
            fields += [(JPEG_TABLES, 7, im["tables"]), (SUBSAMPLING, 3, struct.pack("<HH", 2, 2))]
        at = start + len(out)
        extra_at = at + 8 + 20 * len(fields) + 8
        table, extra = struct.pack("<Q", len(fields)), b""
        for tag, kind, data in fields:
            count = len(data) // SIZES[kind][1]
            if len(data) <= 8:
                value = data.ljust(8, b"\0")
            else:
                value = struct.pack("<Q", extra_at + len(extra))
                extra += data
            table += struct.pack("<HHQ", tag, kind, count) + value
        following = extra_at + len(extra) if k + 1 < len(images) else 0
        out += table + struct.pack("<Q", following) + extra
    return out


def read_tiff_directories(read) -> list[dict]:
    """The directories of a TIFF or BigTIFF; read(offset, length) gives bytes."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + "Q", head[8:16])[0] if big else struct.unpack(order + "I", head[4:8])[0]
    found = []
    while at:
        n = struct.unpack(order + ("Q" if big else "H"), read(at, 8 if big else 2))[0]
        size, first = (20, at + 8) if big else (12, at + 2)
        tags = {ORDER: order}
        for i in range(n):
            e = read(first + size * i, size)
            tag, kind = struct.unpack(order + "HH", e[:4])
            count = struct.unpack(order + ("Q" if big else "I"), e[4 : 12 if big else 8])[0]
            if kind not in SIZES:
                continue
            code, width = SIZES[kind]
            data = e[12:] if big else e[8:]
            if count * width > len(data):
                data = read(struct.unpack(order + ("Q" if big else "I"), data)[0], count * width)
            per = len(code) if kind == 5 else 1
            tags[tag] = struct.unpack(order + code[0] * (count * per), data[: count * width]) if kind not in (2, 7) else data[:count]
        found.append(tags)
        at = struct.unpack(order + ("Q" if big else "I"), read(first + size * n, 8 if big else 4))[0]
    return found


def unpack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, the highest bit first, each width ending one code early."""
    clear, end = 256, 257
    table: list[bytes] = []
    out, before = [], b""
    held = bits = at = 0
    width = 9
    while True:
        while bits < width:
            if at == len(data):
                return b"".join(out)
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFF, bits + 8, at + 1
        code = held >> (bits - width) & ((1 << width) - 1)
        bits -= width
        if code == end:
            return b"".join(out)
        if code == clear:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif before and code == len(table):
            now = before + before[:1]
        else:
            raise ValueError("broken LZW data")
        out.append(now)
        if before:
            table.append(before + now[:1])
            width = min(12, max(9, (len(table) + 1).bit_length()))
        before = now


def decode_block(data: bytes, tags: dict, h: int, w: int) -> np.ndarray:
    """A tile or strip as RGB. Uncompressed, deflate and LZW, with or without differences along rows, and baseline JPEG;
    8-bit RGB, 8-bit and 16-bit gray, samples side by side. All else is an error."""
    kind = tags.get(COMPRESSION, (1,))[0]
    if kind == 7:
        tables = tags.get(JPEG_TABLES)
        image = jpeg.decode(data, jpeg.shared_tables(tables) if tables else None, tags.get(PHOTOMETRIC, (6,))[0] == 6)
        if image.shape[0] < h or image.shape[1] < w:
            raise ValueError("a block is shorter than its size")
        return image[:h, :w]
    if kind in (8, 32946):
        data = zlib.decompress(data)
    elif kind == 5:
        data = unpack_lzw(data)
    elif kind != 1:
        raise ValueError(f"TIFF compression {kind} is not supported")
    samples, bits = tags.get(SAMPLES, (1,))[0], tags.get(BITS, (8,))[0]
    if bits not in (8, 16):
        raise ValueError(f"{bits} bits a sample are not supported")
    if samples > 1 and tags.get(PLANAR, (1,))[0] != 1:
        raise ValueError("samples in separate planes are not supported")
    predictor = tags.get(PREDICTOR, (1,))[0]
    if predictor not in (1, 2):
        raise ValueError(f"TIFF predictor {predictor} is not supported")
    kind = np.dtype(np.uint8) if bits == 8 else np.dtype(tags.get(ORDER, "<") + "u2")
    if len(data) < h * w * samples * kind.itemsize:
        raise ValueError("a block is shorter than its size")
    image = np.frombuffer(data, kind)[: h * w * samples].reshape(h, w, samples)
    if predictor == 2:
        image = np.cumsum(image, axis=1, dtype=np.uint16 if bits == 16 else np.uint8)
    if bits == 16:
        return np.repeat((image[..., :1] / 65535 * 255).astype(np.uint8), 3, axis=2)
    return image[..., :3] if samples >= 3 else np.repeat(image[..., :1], 3, axis=2)


def read_region(read, tags: dict, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """The pixels of a rectangle within an image, as RGB; only the blocks that it meets are read."""
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    tiled = TILES in tags
    bw, bh = (tags[TILE_W][0], tags[TILE_H][0]) if tiled else (width, tags.get(ROWS, (height,))[0])
    offsets, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    across = -(-width // bw)
    out = np.zeros((y1 - y0, x1 - x0, 3), np.uint8)
    for by in range(y0 // bh, -(-y1 // bh)):
        for bx in range(x0 // bw, -(-x1 // bw)):
            h = bh if tiled else min(bh, height - by * bh)
            image = decode_block(read(offsets[by * across + bx], sizes[by * across + bx]), tags, h, bw)
            top, left, bottom, right = max(y0, by * bh), max(x0, bx * bw), min(y1, by * bh + h), min(x1, bx * bw + bw)
            out[top - y0 : bottom - y0, left - x0 : right - x0] = image[top - by * bh : bottom - by * bh, left - bx * bw : right - bx * bw]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """An 8-bit PNG as RGB: gray, RGB or palette, with or without alpha (which is left out); not interlaced."""
    at, parts, palette = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body, at = data[at + 8 : at + 8 + n], at + 12 + n
        if kind == b"IHDR":
            w, h, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if bits != 8 or interlaced:
        raise ValueError(f"PNG of {bits} bits, or interlaced, is not supported")
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * samples)
    out, above = np.zeros((h, w, samples), np.uint8), np.zeros((w, samples), np.uint8)
    for y in range(h):
        method, line = lines[y, 0], lines[y, 1:].reshape(w, samples)
        if method == 0:
            above = line
        elif method == 1:
            above = np.cumsum(line, axis=0, dtype=np.uint8)
        elif method == 2:
            above = line + above
        else:
            now, left, corner = np.zeros_like(line), [0] * samples, [0] * samples
            for x in range(w):
                for c in range(samples):
                    a, b, d = left[c], int(above[x, c]), corner[c]
                    if method == 3:
                        guess = (a + b) // 2
                    else:
                        near = sorted((abs(v - (a + b - d)), k, v) for k, v in enumerate((a, b, d)))
                        guess = near[0][2]
                    corner[c], left[c] = b, int(line[x, c]) + guess & 255
                    now[x, c] = left[c]
            above = now
        out[y] = above
    if colour == 3:
        return palette[out[..., 0]]
    return out[..., :3] if samples >= 3 else np.repeat(out[..., :1], 3, axis=2)


def decode_bmp(data: bytes) -> np.ndarray:
    """An uncompressed BMP of 24 or 32 bits as RGB; rows from the bottom up, or down if the height is negative."""
    begin, size = struct.unpack("<I", data[10:14])[0], struct.unpack("<I", data[14:18])[0]
    if size < 40:
        raise ValueError("BMP of this kind is not supported")
    w, h, _, bits, method = struct.unpack("<iiHHI", data[18:34])
    if bits not in (24, 32) or method not in (0, 3):
        raise ValueError(f"BMP of {bits} bits or compressed is not supported")
    line = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, line * abs(h), begin).reshape(abs(h), line)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return (rows[::-1] if h > 0 else rows)[..., 2::-1]


def decode_image(data: bytes) -> np.ndarray:
    """A whole TIFF (its first directory), JPEG, PNG or BMP as RGB."""
    if data[:2] in (b"II", b"MM"):
        read = lambda offset, length: data[offset : offset + length]
        tags = read_tiff_directories(read)[0]
        return read_region(read, tags, 0, 0, tags[WIDTH][0], tags[HEIGHT][0])
    if data[:2] == b"\xff\xd8":
        return jpeg.decode(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("not an image of a known kind")


def pack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it, the inverse of ``unpack_lzw``."""
    table: dict[bytes, int] = {}
    out, held, bits, width, now = bytearray(), 0, 0, 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    def reset() -> None:
        nonlocal table, width
        put(256)
        table, width = {bytes([i]): i for i in range(256)}, 9

    reset()
    for k in range(len(data)):
        more = now + data[k : k + 1]
        if more in table:
            now = more
            continue
        put(table[now])
        table[more] = len(table) + 2
        now = data[k : k + 1]
        # the decoder's table is one entry behind
        if len(table) + 2 > 4094:
            reset()
        else:
            width = max(9, (len(table) + 2).bit_length())
    if now:
        put(table[now])
        table[b""] = 0
        width = min(12, max(9, (len(table) + 2).bit_length()))
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def encode_image(image: np.ndarray, ending: str) -> bytes:
    """A file of the kind that an ending names: jpg or jpeg (quality 100, chroma at full resolution), png, bmp, tif or tiff (LZW)."""
    h, w, _ = image.shape
    if ending in ("jpg", "jpeg"):
        return jpeg.encode(image, 100, subsample=False)
    if ending == "png":
        return encode_png(image)
    if ending == "bmp":
        rows = np.pad(image[::-1, :, ::-1].reshape(h, w * 3), ((0, 0), (0, -w * 3 % 4))).tobytes()
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 54, 40, w, h, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows
    return encode_tiff(image, lzw=True)
