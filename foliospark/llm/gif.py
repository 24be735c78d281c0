"""GIF89a streams: LZW coding, palettes, transparency, disposal and timing."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

CLEAR, MOST_BITS = 256, 12


def widths_of(n: int, first: int) -> np.ndarray:
    """Bits of each of the ``n`` codes that follow a clear code; ``first``: the first table entry."""
    entries = first + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.floor(np.log2(entries)).astype(np.int64) + 1, MOST_BITS)


_WIDTHS = widths_of(8192, 258)


def lzw_codes(pixels: bytes) -> list[list[int]]:
    """Code runs for 8-bit pixels; each run starts after a clear code, before its table overflows."""
    runs, codes, table, free = [], [], {}, 258
    find = table.get
    if not pixels:
        return [[]]
    w = pixels[0]
    for b in pixels[1:]:
        key = w << 8 | b
        c = find(key)
        if c is not None:
            w = c
            continue
        codes.append(w)
        w = b
        if free == 4096:
            runs.append(codes)
            codes, free = [], 258
            table.clear()
        else:
            table[key] = free
            free += 1
    codes.append(w)
    runs.append(codes)
    return runs


def pack_codes(frames: list[list[list[int]]]) -> list[bytes]:
    """The bit streams of frames' code runs, each with its clear and end codes."""
    codes, widths, sizes = [], [], []
    for runs in frames:
        n = 0
        for i, run in enumerate(runs):
            last = i == len(runs) - 1
            codes += [CLEAR, *run] if i == 0 else run
            codes.append(CLEAR + 1 if last else CLEAR)
            w = _WIDTHS[: len(run) + 1]
            widths += [_WIDTHS[:1], w] if i == 0 else [w]
            n += len(run) + 1 + (i == 0)
        sizes.append(n)
    c, w = np.array(codes, np.int64), np.concatenate(widths)
    ends = np.cumsum(w)
    frame_ends = ends[np.cumsum(sizes) - 1]
    bits = np.diff(np.r_[0, frame_ends])
    padded = -(-bits // 8) * 8
    shift = np.repeat(np.cumsum(np.r_[0, padded[:-1]]) - np.r_[0, frame_ends[:-1]], sizes)
    at = ends - w + shift
    value, byte, size = c << (at & 7), at >> 3, int(padded.sum()) // 8 + 2
    flat = sum(np.bincount(byte + i, value >> 8 * i & 255, size) for i in range(3))  # no bit is set twice
    data = flat.astype(np.uint8).tobytes()
    cut = np.cumsum(np.r_[0, padded // 8]).tolist()
    return [data[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """The pixels of one run of codes, all entries at once.

    Table entry e is the string of the run's code e and the pixel after it, so a
    code is a copy from what its entry's code gave. Lengths and sources are
    followed to literals by doubling.
    """
    entry = codes - clear - 2
    n = np.arange(len(codes))
    if (entry >= n).any() or ((codes >= clear) & (entry < 0)).any():
        raise ValueError("LZW code beyond the table")
    literal = codes < clear
    up, length = np.where(literal, n, entry), np.where(literal, 0, 1)
    while (step := length[up]).any():
        length, up = length + step, up[up]
    length += 1
    start = np.cumsum(length) - length
    source = np.arange(int(length.sum()))
    source += np.repeat(np.where(literal, 0, start[np.maximum(entry, 0)] - start), length)
    while ((further := source[source]) != source).any():
        source = further
    pixels = np.empty(len(source), np.uint8)
    pixels[start[literal]] = codes[literal]
    return pixels[source]


def lzw_decode(data: bytes, min_bits: int, pixels: int) -> bytes:
    """Decodes any GIF code stream, up to ``pixels``; a stream that stops early is filled with zeros."""
    clear, first = 1 << min_bits, (1 << min_bits) + 2
    b = np.frombuffer(data + bytes(4), np.uint8).astype(np.int64)
    total, at, out = 8 * len(data), 0, []
    schedule = _WIDTHS if first == 258 else widths_of(8192, first)
    run: list[np.ndarray] = []
    held = 0
    while at < total:
        # the codes up to the next clear code have widths known beforehand
        n = min((total - at) // (min_bits + 1) + 1, 4096)
        w = schedule[held : held + n] if held + n <= len(schedule) else np.full(n, MOST_BITS)
        ends = at + np.cumsum(w)
        w = w[: int(np.searchsorted(ends, total, "right"))]
        if not len(w):
            break
        start = ends[: len(w)] - w
        o = start >> 3
        codes = ((b[o] | b[o + 1] << 8 | b[o + 2] << 16) >> (start & 7)) & ((1 << w) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if not len(stop):
            run.append(codes)
            at, held = int(ends[len(w) - 1]), held + len(w)
            continue
        upto = int(stop[0])
        run.append(codes[:upto])
        out.append(_expand(np.concatenate(run), clear).tobytes())
        run, at, held = [], int(ends[upto]), 0
        if codes[upto] == clear + 1:
            break
    if run:
        out.append(_expand(np.concatenate(run), clear).tobytes())
    return b"".join(out)[:pixels].ljust(pixels, b"\0")


@dataclass
class Frame:
    """An image block: where it lies, its indices, and what its control extension says."""

    left: int
    top: int
    width: int
    height: int
    indices: np.ndarray
    palette: np.ndarray
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame]
    comment: bytes = b""
    background: tuple[int, int, int, int] = (0, 0, 0, 0)

    def simple(self) -> bool:
        return all(f.transparent is None and (f.left, f.top, f.width, f.height) == (0, 0, self.width, self.height) for f in self.frames)

    def shown(self) -> np.ndarray:
        """RGBA of the canvas as each frame shows it: frames x height x width x 4."""
        out = np.empty((len(self.frames), self.height, self.width, 4), np.uint8)
        if self.simple():
            for i, f in enumerate(self.frames):
                out[i, ..., :3], out[i, ..., 3] = f.palette[f.indices], 255
            return out
        canvas = np.zeros((self.height, self.width, 4), np.uint8)
        canvas[:] = self.background
        for i, f in enumerate(self.frames):
            before = canvas.copy() if f.disposal == 3 else None
            area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
            indices = f.indices[: area.shape[0], : area.shape[1]]
            drawn = np.ones(indices.shape, bool) if f.transparent is None else indices != f.transparent
            area[drawn, :3] = f.palette[indices[drawn]]
            area[drawn, 3] = 255
            out[i] = canvas
            if f.disposal == 2:
                area[:] = self.background
            elif before is not None:
                canvas = before
        return out


def encode(width: int, palette: np.ndarray, frames: list[bytes], delay: int, comment: bytes) -> bytes:
    """Opaque frames of 8-bit indices, all ``width`` wide and laid at the top, under one global palette.

    The first is as high as the canvas, later ones may be lower; each stays when
    the next is drawn. ``delay`` is in hundredths of a second.
    """
    parts = [b"GIF89a", struct.pack("<HHBBB", width, len(frames[0]) // width, 0xF7, 0, 0), palette.astype(np.uint8).tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0", b"\x21\xfe", bytes([len(comment)]), comment, b"\0"]
    head = b"\x21\xf9\x04\x04" + struct.pack("<H", delay) + b"\0\0\x2c"
    for pixels, stream in zip(frames, pack_codes([lzw_codes(f) for f in frames]), strict=True):
        parts += [head, struct.pack("<HHHHB", 0, 0, width, len(pixels) // width, 0), b"\x08"]
        for i in range(0, len(stream), 255):
            block = stream[i : i + 255]
            parts += [bytes([len(block)]), block]
        parts.append(b"\0")
    return b"".join([*parts, b"\x3b"])


def decode(data: bytes) -> Gif:
    """Parses any GIF87a or GIF89a; raises ValueError where it is none."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, back, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def colours(bits: int) -> np.ndarray:
        nonlocal at
        n = 3 << bits + 1
        out = np.zeros((256, 3), np.uint8)
        out[: n // 3] = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
        return out

    def blocks() -> bytes:
        nonlocal at
        out = []
        while size := data[at]:
            out.append(data[at + 1 : at + 1 + size])
            at += size + 1
        at += 1
        return b"".join(out)

    shared = colours(flags & 7) if flags & 0x80 else np.zeros((256, 3), np.uint8)
    gif, control = Gif(width, height, []), (0, 0, None)
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9:
                packed, delay, clear = struct.unpack_from("<BHB", body)
                control = (delay, packed >> 2 & 7, clear if packed & 1 else None)
            elif label == 0xFE:
                gif.comment += body
        elif kind == 0x2C:
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
            at += 9
            palette = colours(packed & 7) if packed & 0x80 else shared
            bits = data[at]
            at += 1
            indices = np.frombuffer(lzw_decode(blocks(), bits, w * h), np.uint8).reshape(h, w)
            if packed & 0x40:  # interlaced: every 8th line, those between, and so on
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                rows = np.empty_like(indices)
                rows[order] = indices
                indices = rows
            gif.frames.append(Frame(left, top, w, h, indices, palette, *control))
            control = (0, 0, None)
        else:
            raise ValueError("unknown block in a GIF")
    return gif
