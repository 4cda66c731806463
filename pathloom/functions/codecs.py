"""Small image codecs on numpy and zlib: PNG, TIFF and array files.

Enough to write what the engine makes and to read masks and flat or tiled
pyramids without compression, with deflate or PackBits. Other formats come in
through Spark's image source or a metadata table.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Sequence

import numpy as np

_PNG = b"\x89PNG\r\n\x1a\n"
# PNG colour type by channels, TIFF tags and field types.
_COLOR_TYPE = {1: 0, 2: 4, 3: 2, 4: 6}
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _DESCRIPTION = 256, 257, 258, 259, 262, 270
_STRIPS, _SAMPLES, _STRIP_ROWS, _STRIP_BYTES, _X_RES, _Y_RES, _PLANAR, _RES_UNIT = 273, 277, 278, 279, 282, 283, 284, 296
_PREDICTOR, _TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_BYTES = 317, 322, 323, 324, 325
_FORMATS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 16: "Q"}
UNITS = {1: "NONE", 2: "INCH", 3: "CENTIMETER"}


def png_bytes(image: np.ndarray) -> bytes:
    """PNG of a boolean or uint8 array [y, x] or [y, x, 1 to 4 channels]."""
    bits = 1 if image.dtype == bool else 8
    a = image if image.ndim == 3 else image[:, :, None]
    h, w, c = a.shape
    if bits == 1:
        rows = np.packbits(a[:, :, 0], axis=1)
    else:
        rows = a.astype(np.uint8).reshape(h, w * c)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", w, h, bits, _COLOR_TYPE[c], 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """uint8 [y, x, channels], or boolean [y, x] of a 1-bit image. Palettes,
    16 bits and interlacing aren't read."""
    if data[:8] != _PNG:
        raise ValueError("no PNG file")
    at, body, w = 8, [], 0
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            w, h, bits, kind, _, _, interlaced = struct.unpack(">IIBBBBB", part)
        elif name == b"IDAT":
            body.append(part)
        at += 12 + n
    if not w or bits not in (1, 8) or kind not in _CHANNELS or interlaced or bits == 1 and kind:
        raise ValueError("PNG variant isn't supported")
    c = _CHANNELS[kind]
    stride = (w * c * bits + 7) // 8
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        out[y] = above = _unfilter(int(lines[y, 0]), lines[y, 1:], above, c if bits == 8 else 1)
    if bits == 1:
        return np.unpackbits(out, axis=1)[:, :w].astype(bool)
    return out.reshape(h, w, c)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel() if len(line) % step == 0 else line
    out = bytearray(line.tobytes())
    up = above.tolist()
    for i in range(len(out)):
        left = out[i - step] if i >= step else 0
        if kind == 3:
            guess = (left + up[i]) >> 1
        else:
            corner = up[i - step] if i >= step else 0
            p = left + up[i] - corner
            guess = min((left, up[i], corner), key=lambda v, p=p: abs(p - v))
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def tiff_bytes(levels: Sequence[np.ndarray], *, resolution: tuple[float, float] | None = None, tile: int = 256, compress: bool = True, description: str = "") -> bytes:
    """A tiled RGB TIFF with one directory a level. resolution: pixels a
    centimetre of the first level; later levels get theirs by size."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for image in levels:
        h, w, c = image.shape
        offsets, sizes = [], []
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                block = np.zeros((tile, tile, c), np.uint8)
                part = image[y : y + tile, x : x + tile]
                block[: part.shape[0], : part.shape[1]] = part
                data = zlib.compress(block.tobytes()) if compress else block.tobytes()
                offsets.append(len(out))
                sizes.append(len(data))
                out += data
        extra: list[tuple[int, int, list]] = []
        if resolution:
            scale = w / levels[0].shape[1]
            extra = [(_X_RES, 5, [resolution[0] * scale]), (_Y_RES, 5, [resolution[1] * scale]), (_RES_UNIT, 3, [3])]
        fields = [
            (_WIDTH, 4, [w]), (_HEIGHT, 4, [h]), (_BITS, 3, [8] * c), (_COMPRESSION, 3, [8 if compress else 1]), (_PHOTOMETRIC, 3, [2]),
            (_DESCRIPTION, 2, [description.encode() + b"\0"]), (_SAMPLES, 3, [c]), *extra, (_PLANAR, 3, [1]),
            (_TILE_WIDTH, 4, [tile]), (_TILE_HEIGHT, 4, [tile]), (_TILES, 4, offsets), (_TILE_BYTES, 4, sizes),
        ]
        entries = b""
        for tag, kind, values in sorted(fields):
            if kind == 2:
                data, n = values[0], len(values[0])
            elif kind == 5:
                data, n = b"".join(struct.pack("<II", round(v * 10_000), 10_000) for v in values), len(values)
            else:
                data, n = b"".join(struct.pack("<" + _FORMATS[kind], v) for v in values), len(values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                place = struct.pack("<I", len(out))
                out += data
            else:
                place = data.ljust(4, b"\0")
            entries += struct.pack("<HHI", tag, kind, n) + place
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_directories(data) -> list[dict[int, list]]:
    """The fields of every directory of a classic or big TIFF; ``data`` is bytes
    or anything that gives bytes for a slice."""
    end = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not end:
        raise ValueError("no TIFF file")

    def at(form: str, place: int) -> tuple:
        return struct.unpack(end + form, data[place : place + struct.calcsize("<" + form)])

    big = at("H", 2)[0] == 43
    word, entry, inline = ("Q", 20, 8) if big else ("I", 12, 4)
    here = at(word, 8 if big else 4)[0]
    found, seen = [], set()
    while here and here not in seen:
        seen.add(here)
        n = at("Q" if big else "H", here)[0]
        here += 8 if big else 2
        fields: dict[int, list] = {}
        for i in range(n):
            place = here + i * entry
            tag, kind = at("HH", place)
            count = at(word, place + 4)[0]
            value = place + 4 + inline
            form = _FORMATS.get(kind)
            if form is None:
                continue
            if count * struct.calcsize("<" + form) > inline:
                value = at(word, value)[0]
            if kind == 2:
                fields[tag] = [data[value : value + count].split(b"\0")[0].decode(errors="replace")]
            elif kind == 5:
                pairs = at("II" * count, value)
                fields[tag] = [p / q if q else 0.0 for p, q in zip(pairs[::2], pairs[1::2])]
            else:
                fields[tag] = list(at(form * count, value))
        found.append(fields)
        here = at(word, here + n * entry)[0]
    return found


def _unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def read_tiff_page(data, fields: dict[int, list], window: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """uint8 [y, x, channels] of a directory's image, or of its window (x1, y1,
    x2, y2): only the tiles or strips that it meets are decoded."""
    one = lambda tag, default=None: fields.get(tag, [default])[0]
    w, h, c = one(_WIDTH), one(_HEIGHT), one(_SAMPLES, 1)
    method, predictor = one(_COMPRESSION, 1), one(_PREDICTOR, 1)
    if set(fields.get(_BITS, [1])) != {8} or one(_PLANAR, 1) != 1 or method not in (1, 8, 32946, 32773):
        raise ValueError("TIFF variant isn't supported")
    x1, y1, x2, y2 = window or (0, 0, w, h)
    tiled = _TILES in fields
    tw, th = (one(_TILE_WIDTH), one(_TILE_HEIGHT)) if tiled else (w, min(one(_STRIP_ROWS, h), h))
    offsets, sizes = (fields[_TILES], fields[_TILE_BYTES]) if tiled else (fields[_STRIPS], fields[_STRIP_BYTES])
    across = -(-w // tw)
    out = np.zeros((y2 - y1, x2 - x1, c), np.uint8)
    for ty in range(max(y1, 0) // th, -(-min(y2, h) // th)):
        for tx in range(max(x1, 0) // tw, -(-min(x2, w) // tw)):
            k = ty * across + tx
            raw = data[offsets[k] : offsets[k] + sizes[k]]
            raw = zlib.decompress(raw) if method in (8, 32946) else _unpack_bits(raw) if method == 32773 else raw
            rows = th if tiled else min(th, h - ty * th)
            block = np.frombuffer(raw, np.uint8)[: rows * tw * c].reshape(rows, tw, c)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            left, top = tx * tw, ty * th
            a, b = max(x1, left), min(x2, left + tw, w)
            p, q = max(y1, top), min(y2, top + rows, h)
            if a < b and p < q:
                out[p - y1 : q - y1, a - x1 : b - x1] = block[p - top : q - top, a - left : b - left]
    return out


def page_size(fields: dict[int, list]) -> tuple[int, int]:
    return fields[_WIDTH][0], fields[_HEIGHT][0]


def page_properties(fields: dict[int, list]) -> dict[str, str]:
    """Resolution and description of a directory, as text."""
    named = {"tiff.XResolution": _X_RES, "tiff.YResolution": _Y_RES, "tiff.ImageDescription": _DESCRIPTION}
    found = {n: str(fields[t][0]) for n, t in named.items() if t in fields}
    if _RES_UNIT in fields:
        found["tiff.ResolutionUnit"] = UNITS.get(fields[_RES_UNIT][0], "NONE")
    return found


def array_bytes(array: np.ndarray, *, packed: bool = True) -> bytes:
    """An .npz with the key "data", or a plain .npy."""
    out = io.BytesIO()
    if packed:
        np.savez_compressed(out, data=array)
    else:
        np.save(out, array)
    return out.getvalue()


def read_array(data: bytes, key: str = "data") -> np.ndarray:
    """The array of an .npy file, or of the key of an .npz one."""
    found = np.load(io.BytesIO(data), allow_pickle=False)
    return found if isinstance(found, np.ndarray) else found[key]
