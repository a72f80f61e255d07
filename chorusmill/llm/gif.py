"""GIF media columns: LZW code streams, palettes, disposal, transparency and interlace; timed frames with colour histograms.

Code widths follow from a code's place after the last clear code, so a stream is cut into codes by array
arithmetic; entry j of the table is the output of code j and one byte more. An encoder of the same format stores
byte payloads as 8-bit samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import materialize, texts_of

#: Payload storage: samples per row, rows per frame, hundredths of a second a frame stays.
ROW = 576
FRAME_ROWS = 64
DELAY = 10
#: Histogram bins per colour channel.
BINS = 4
#: The bin of a channel's value.
_BIN_OF = (np.arange(256) * BINS >> 8).astype(np.uint8)
_MAX_CODE = 4096


def _palette() -> np.ndarray:
    """256 colours by rule: 3 bits red, 3 bits green, 2 bits blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, ((i >> 2) & 7) * 255 // 7, (i & 3) * 85], axis=1).astype(np.uint8)


PALETTE = _palette()


def _widths(clear: int, n: int) -> np.ndarray:
    """Bits of the 0th to nth code after a clear code."""
    nxt = clear + 2 + np.maximum(np.arange(n) - 1, 0)
    w = np.zeros(n, np.int64)
    for bits in range(1, 13):
        w[nxt >= (1 << (bits - 1))] = bits
    return np.minimum(np.maximum(w, clear.bit_length()), 12)


_WIDTHS8 = _widths(256, _MAX_CODE)
_FULL = np.full(_MAX_CODE, 12)
_FULL_SUMS = np.cumsum(_FULL)
_LITERALS = [bytes((k,)) for k in range(256)]
#: Which of 16 bits, the lowest first, a code of so many bits has.
_LANES = np.arange(16)[None, :] < np.arange(13)[:, None]


def lzw_encode(data: bytes) -> bytes:
    """LZW stream for 8-bit samples: a clear code, the codes, a new table when 4096 is reached, the end code."""
    codes: list[int] = [256]
    places: list[int] = [0]
    table: dict[int, int] = {}
    nxt, place = 258, 0
    put, get = codes.append, table.get
    prefix = data[0]
    for b in data[1:]:
        key = prefix << 8 | b
        c = get(key)
        if c is not None:
            prefix = c
            continue
        put(prefix)
        table[key] = nxt
        nxt += 1
        place += 1
        prefix = b
        if nxt == _MAX_CODE:
            put(256)
            places.append(len(codes) - 1)
            table.clear()
            nxt, place = 258, 0
    put(prefix)
    put(257)
    # widths: the first clear code has 9 bits; others stand at the place after their segment's codes
    bounds = [*places, len(codes)]
    widths = np.empty(len(codes), np.int64)
    widths[0] = 9
    for a, b in zip(bounds, bounds[1:], strict=False):
        run = b - a - 1
        last = min(run + 1, len(codes) - a - 1)
        widths[a + 1 : a + 1 + last] = _WIDTHS8[:last]
    low_first = np.array(codes, "<u2").view(np.uint8).reshape(-1, 2)
    return np.packbits(np.unpackbits(low_first, axis=1, bitorder="little")[_LANES[widths]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, min_bits: int, expected: int) -> bytes:
    """Samples of an LZW stream, cut or filled with 0 to expected ones; a broken stream yields what precedes the break."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    literals = _LITERALS[:clear] + [None] * (clear - 256)
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    n_bits = len(stream) * 8
    table = _WIDTHS8 if min_bits == 8 else _widths(clear, _MAX_CODE)
    table_sums = np.cumsum(table)
    out = bytearray()
    # most streams begin with a clear code: the codes after it are cut at once
    begin = int(table[0])
    at = begin if (int(raw[0]) | int(raw[1]) << 8) & ((1 << begin) - 1) == clear else 0
    while at < n_bits and len(out) < expected:
        codes: list[int] = []
        done = False
        while True:
            widths, sums = (table, table_sums) if not codes else (_FULL, _FULL_SUMS)
            ends = at + sums
            k = int(np.searchsorted(ends, n_bits, side="right"))
            if k == 0:
                done = True
                break
            pos = ends[:k] - widths[:k]
            byte = pos >> 3
            vals = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (pos & 7)) & ((1 << widths[:k]) - 1)
            stop = np.flatnonzero((vals == clear) | (vals == end))
            if len(stop):
                s = int(stop[0])
                codes += vals[:s].tolist()
                at = int(ends[s])
                done = int(vals[s]) == end
                break
            codes += vals.tolist()
            at = int(ends[k - 1])
            if k < len(widths):
                done = True
                break
        # entry j: the output of code j and the first sample of the next one; the last may be asked for before that sample is known
        entries: list[bytes | None] = [*literals, None, None]
        prev = b""
        parts: list[bytes] = []
        grow, put = entries.append, parts.append
        for c in codes:
            if c < len(entries):
                e = entries[c]
                if e is None:
                    raise ValueError("samples have 8 bits")
                if prev:
                    grow(prev + e[:1])
            elif c == len(entries) and prev:
                e = prev + prev[:1]
                grow(e)
            else:
                done = True
                break
            put(e)
            prev = e
        out += b"".join(parts)
        if done:
            break
    del out[expected:]
    return bytes(out) + bytes(expected - len(out))


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int
    palette: np.ndarray
    samples: np.ndarray


def parse(media: bytes) -> tuple[int, int, list[Frame]]:
    """Screen size and frames (samples as stored, interlace undone). Raises ValueError unless it is a GIF."""
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        raise ValueError("not a GIF")
    width, height, packed, _, _ = struct.unpack_from("<HHBBB", media, 6)
    at = 13
    shared = np.zeros((256, 3), np.uint8)
    if packed & 0x80:
        n = 2 << (packed & 7)
        shared[:n] = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, -1

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(media) and media[at]:
            parts.append(media[at + 1 : at + 1 + media[at]])
            at += 1 + media[at]
        return b"".join(parts), at + 1

    while at < len(media):
        kind = media[at]
        if kind == 0x21:
            body, nxt = blocks(at + 2)
            if media[at + 1] == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else -1
            at = nxt
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", media, at + 1)
            at += 10
            palette = shared
            if flags & 0x80:
                n = 2 << (flags & 7)
                palette = np.zeros((256, 3), np.uint8)
                palette[:n] = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            min_bits = media[at]
            stream, at = blocks(at + 1)
            samples = np.frombuffer(lzw_decode(stream, min_bits, w * h), np.uint8).reshape(h, w)
            if flags & 0x40:
                rows = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
                plain = np.empty_like(samples)
                plain[rows] = samples
                samples = plain
            frames.append(Frame(left, top, w, h, delay, disposal, transparent, palette, samples))
            delay, disposal, transparent = 0, 0, -1
        else:
            break  # the trailer, or what no reader knows
    return width, height, frames


def composited(width: int, height: int, frames: list[Frame]):
    """(frame, canvas, shown) after each frame: transparent samples keep what is there; then its disposal applies.

    shown marks the pixels ever drawn. Disposal 2 clears the frame's area, 3 puts back what was there before it.
    """
    canvas = np.zeros((height, width, 3), np.uint8)
    shown = np.zeros((height, width), bool)
    for f in frames:
        area = (slice(f.top, min(height, f.top + f.height)), slice(f.left, min(width, f.left + f.width)))
        before = (canvas[area].copy(), shown[area].copy()) if f.disposal == 3 else None
        part = f.samples[: area[0].stop - area[0].start, : area[1].stop - area[1].start] if f.top < height and f.left < width else f.samples[:0, :0]
        drawn = part != f.transparent
        if part.size:
            if drawn.all():
                canvas[area] = f.palette.take(part, axis=0)
            else:
                canvas[area][drawn] = f.palette[part[drawn]]
            shown[area] |= drawn
        yield f, canvas, shown
        if f.disposal == 2:
            canvas[area], shown[area] = 0, False
        elif before is not None:
            canvas[area], shown[area] = before


def histogram(canvas: np.ndarray, shown: np.ndarray) -> np.ndarray:
    """Counts of the shown pixels over BINS^3 colours."""
    drawn = canvas.reshape(-1, 3) if shown.all() else canvas[shown]
    c = _BIN_OF[drawn]
    return np.bincount((c[:, 0] * BINS + c[:, 1]) * BINS + c[:, 2], minlength=BINS**3)


def store(payload: bytes) -> bytes:
    """A GIF whose frames' samples are the payload (a positive multiple of ROW bytes), row by row, without loss."""
    rows = len(payload) // ROW
    screen = min(rows, FRAME_ROWS)
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, screen, 0xF7, 0, 0), PALETTE.tobytes()]
    for first in range(0, rows, FRAME_ROWS):
        n = min(FRAME_ROWS, rows - first)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, ROW, n, 0) + b"\x08")
        stream = lzw_encode(payload[first * ROW : (first + n) * ROW])
        for k in range(0, len(stream), 255):
            piece = stream[k : k + 255]
            out += [bytes([len(piece)]), piece]
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def pad(raw: bytes) -> bytes:
    return raw + b"\xff" * (ROW - len(raw) % ROW if len(raw) % ROW or not raw else 0)


def _encode(batches):
    for batch in batches:
        for first in range(0, batch.num_rows, 50):
            part = batch.slice(first, 50)
            raw = [t.encode() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([store(pad(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8 bytes, padded with 255, as a stored GIF. Null text: empty.

    Equal texts give equal bytes; repeated rows and null ids stay; an empty table gives no rows; other columns, whatever
    their names, are not read.
    """
    return materialize(texts_of(docs).mapInArrow(_encode, "doc_id long, n_bytes long, media binary"), "gif")


def _frame_rows(batches):
    fields = ["doc_id", "frame", "start_ms", "duration_ms", "width", "height", "disposal", "histogram"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    for batch in batches:
        for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            try:
                start = 0
                for k, (f, canvas, shown) in enumerate(composited(*parse(media or b""))):
                    rows.append((key, k, start, f.delay * 10, f.width, f.height, f.disposal, histogram(canvas, shown).tolist()))
                    start += f.delay * 10
            except (ValueError, struct.error, IndexError):
                rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=fields)


def frames(media: DataFrame) -> DataFrame:
    """One row per timed frame of (doc_id, media): its time, size, disposal and the screen's colour histogram.

    Null, empty or broken media give no rows.
    """
    return media.select("doc_id", "media").mapInArrow(_frame_rows, "doc_id long, frame int, start_ms long, duration_ms long, width int, height int, disposal int, histogram array<long>")


def _digests(batches):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
    for batch in batches:
        rows = []
        for key, n, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            width, height, found = parse(media)
            payload = b"".join(f.samples.tobytes() for f in found)
            total = np.zeros(BINS**3, np.int64)
            for _, canvas, shown in composited(width, height, found):
                total += histogram(canvas, shown)
            ms = sum(f.delay for f in found) * 10
            feature = f"{len(found)}x{width}x{height}:" + ",".join(map(str, total.tolist()))
            rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(found), ms))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def digests(stored: DataFrame) -> DataFrame:
    """Per document from the stored bytes: payload and media digests and the feature (frame layout, summed colour histogram).

    An empty table gives no rows; equal texts have equal values; rows that repeat stay.
    """
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        _digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long"
    )
