"""Media columns: byte payloads as animated GIFs, read back as timed frames with colour histograms."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.llm import gif
from foliospark.llm.common import map_batches, texts_of

#: Payloads are whole units of bytes; a frame is 96 wide and, but for the last, 96 high.
UNIT, WIDTH = 576, 96
FRAME = WIDTH * 96
DELAY = 10
_I = np.arange(256)
#: Colour of each byte: three bits of red, three of green, two of blue.
PALETTE = np.stack([(_I >> 5) * 255 // 7, (_I >> 2 & 7) * 255 // 7, (_I & 3) * 85], 1).astype(np.uint8)
#: The level of a channel's value, 0-7.
_LEVEL = (np.arange(256) * 7 + 127) // 255
_BLUE = (np.arange(256) * 3 + 127) // 255
#: Which of the 20 levels each byte's colour counts for.
_BINS = np.zeros((256, 20), np.int64)
_BINS[_I, _I >> 5] = _BINS[_I, 8 + (_I >> 2 & 7)] = _BINS[_I, 16 + (_I & 3)] = 1


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media: each text's bytes, padded with 255 to whole units, as a GIF; a null text is empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(1).to_pylist():
            data = payload_of(text)
            frames = [data[i : i + FRAME] for i in range(0, len(data), FRAME)]
            out.append(gif.encode(WIDTH, PALETTE, frames, DELAY, b"bytes=%d" % len(text.encode("utf-8"))))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "media"])

    return map_batches(texts_of(docs, id_col, text_col), run, "doc_id long, media binary")


def indices_of(rgba: np.ndarray) -> np.ndarray:
    """The byte whose colour each pixel has."""
    return ((_LEVEL[rgba[..., 0]] << 5) | (_LEVEL[rgba[..., 1]] << 2) | _BLUE[rgba[..., 2]]).astype(np.uint8)


def histograms(rgba: np.ndarray) -> np.ndarray:
    """Pixels by level of red (8), green (8) and blue (4), of each frame."""
    n = len(rgba)
    levels = [table[rgba[..., k].reshape(n, -1)] for k, table in enumerate((_LEVEL, _LEVEL, _BLUE))]
    base = np.arange(n)[:, None] * 20
    return sum(np.bincount((base + shift + x).ravel(), minlength=20 * n).reshape(n, 20) for shift, x in zip((0, 8, 16), levels, strict=True))


def frames(media: DataFrame) -> DataFrame:
    """A row for each frame of any GIF: doc_id, frame, start_ms, delay_ms, width, height, rgba, red, green, blue."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if data is None:
                continue
            image = gif.decode(data)
            shown, at = image.shown(), 0
            for i, (f, h) in enumerate(zip(image.frames, histograms(shown), strict=True)):
                rows.append({"doc_id": doc, "frame": i, "start_ms": at, "delay_ms": f.delay * 10, "width": image.width, "height": image.height, "rgba": shown[i].tobytes(), "red": h[:8].tolist(), "green": h[8:16].tolist(), "blue": h[16:].tolist()})
                at += f.delay * 10
        longs = pa.list_(pa.int64())
        kinds = [("doc_id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("red", longs), ("green", longs), ("blue", longs)]
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return map_batches(media.select("doc_id", "media"), run, "doc_id long, frame int, start_ms long, delay_ms long, width int, height int, rgba binary, red array<long>, green array<long>, blue array<long>")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long"


def features(media: DataFrame) -> DataFrame:
    """Decodes each stored GIF and describes it: the payload that its shown colours spell, and its colour histogram.

    A null medium gives a row of nulls beside its id; rows that repeat are decoded
    each; an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(10)]
        for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if data is None:
                for column, value in zip(out, (doc, *[None] * 9), strict=True):
                    column.append(value)
                continue
            image = gif.decode(data)
            shown = image.shown()
            payload = b"".join(indices_of(s[f.top : f.top + f.height, f.left : f.left + f.width]).tobytes() for s, f in zip(shown, image.frames, strict=True))
            h = (np.bincount(np.frombuffer(payload, np.uint8), minlength=256) @ _BINS).tolist()
            duration = 10 * sum(f.delay for f in image.frames)
            feature = f"frames={len(image.frames)};ms={duration};r={','.join(map(str, h[:8]))};g={','.join(map(str, h[8:16]))};b={','.join(map(str, h[16:]))}"
            row = (doc, int(image.comment.partition(b"=")[2]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(image.frames), duration)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[x.strip().split(" ")[0] for x in FEATURES.split(",")])

    return map_batches(media, run, FEATURES)
