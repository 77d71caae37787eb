"""MPEG audio columns: payloads stored in the frames of a variable-bitrate stream, and a reader.

The writer puts an ID3v2 tag with the payload's CRC-32, a frame with a variable-bitrate table and then
protected mono Layer III frames whose granules are silent; the payload rides in each frame's ancillary bytes
behind a 16-bit length. The reader parses any MPEG audio stream: it reads tags and their text frames,
resynchronises on a header whose successor is a header too (or the stream's end), checks frame checksums, reads
the table with its seek entries and counts those that miss their frame, and gives the exact duration as samples
over rate with every frame's byte offset. A length that runs past its frame is clipped there and counted.

A null stream reads as null features; bytes without any frame give 0 frames and an empty payload.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts_of

#: Fixed values of the MPEG audio header: kbit/s by (MPEG-1?, layer), Hz by version bits, samples a frame.
KBPS = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
HZ = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}

UNIT, CHUNK, SIDE = 64, 896, 17
#: The description of the tag's text frame that holds the payload's CRC-32.
CHECKSUM = "payload-crc"
#: Bytes of a 48 kHz Layer III frame by bitrate index.
FRAME = [144 * k // 48 for k in KBPS[True, 3]]


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    value = 0xFFFF
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ (0x8005 if value & 0x8000 else 0)) & 0xFFFF
    return value


@lru_cache(maxsize=65536)
def header(word: bytes) -> tuple[int, int, int, int, bool, bool, int] | None:
    """(bytes of the frame, samples, Hz, layer, MPEG-1?, protected?, channels); None if it's no header."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hz = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3), word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    first, pad = version == 3, word[2] >> 1 & 1
    kbps, hertz, samples = KBPS[first, layer][rate], HZ[version][hz], SAMPLES[first, layer]
    size = (12 * kbps * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hertz + pad
    return size, samples, hertz, layer, first, not word[1] & 1, 1 if word[3] >> 6 == 3 else 2


def _frame_head(index: int, protected: bool) -> bytes:
    return bytes([0xFF, 0xFA if protected else 0xFB, index << 4 | 1 << 2, 0xC0])


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write_stream(payload: bytes, title: str = "") -> bytes:
    """An MPEG audio stream that carries `payload`."""
    data = np.frombuffer(payload, np.uint8)
    full, rest = divmod(len(data), CHUNK)
    sizes = [FRAME[-1]] * full
    body = np.zeros((full, FRAME[-1]), np.uint8)
    prefix = _frame_head(14, True)
    prefix += struct.pack(">H", crc16(prefix[2:] + bytes(SIDE))) + bytes(SIDE) + struct.pack(">H", CHUNK)
    body[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
    body[:, len(prefix) : len(prefix) + CHUNK] = data[: full * CHUNK].reshape(full, CHUNK)
    stream = body.tobytes()
    if rest:
        index = next(i for i in range(1, 15) if FRAME[i] >= rest + len(prefix))
        head = _frame_head(index, True)
        last = head + struct.pack(">H", crc16(head[2:] + bytes(SIDE))) + bytes(SIDE) + struct.pack(">H", rest) + payload[full * CHUNK :]
        stream += last.ljust(FRAME[index], b"\0")
        sizes.append(FRAME[index])
    ends = np.cumsum([FRAME[3], *sizes])
    at = np.minimum(np.arange(100) * len(sizes) // 100, max(0, len(sizes) - 1))
    toc = (ends[at] * 256 // ends[-1]).clip(0, 255).astype(np.uint8).tobytes()
    table = _frame_head(3, False) + bytes(SIDE) + b"Xing" + struct.pack(">III", 7, len(sizes), int(ends[-1])) + toc
    texts = {b"TIT2": title.encode() + b"\0", b"TXXX": f"{CHECKSUM}\0{zlib.crc32(payload):08x}\0".encode()}
    tag = b"".join(name + _synchsafe(len(text) + 1) + b"\0\0\3" + text for name, text in texts.items())
    return b"ID3\4\0\0" + _synchsafe(len(tag)) + tag + table.ljust(FRAME[3], b"\0") + stream


def _size_of(data: bytes, synchsafe: bool) -> int:
    return sum((b & 0x7F) << s for b, s in zip(data, (21, 14, 7, 0))) if synchsafe else int.from_bytes(data)


def text_frames(tag: bytes, version: int) -> dict[str, str]:
    """The text frames of an ID3v2.3 or 2.4 tag by name, those of the user's own by their description."""
    found, pos = {}, 0
    while version in (3, 4) and pos + 10 <= len(tag) and tag[pos : pos + 1].isalpha():
        name, size = tag[pos : pos + 4].decode("latin-1"), _size_of(tag[pos + 4 : pos + 8], version == 4)
        data = tag[pos + 10 : pos + 10 + size]
        if name[0] == "T" and data:
            text = data[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(data[0], "utf-8"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            found[key] = value.rstrip("\0")
        pos += 10 + size
    return found


def seek_misses(toc: bytes, seek: list[int], first: int, end: int) -> int:
    """How many of a table's 100 entries lie off, by more than one 256th of the stream, the frame that plays at their percent."""
    length = max(1, end - first)
    return sum(abs(entry - min(255, (seek[min(len(seek) - 1, i * len(seek) // 100)] - first) * 256 // length)) > 1 for i, entry in enumerate(toc)) if seek else 0


def read_stream(media: bytes) -> dict:
    """What a stream holds: frames with offsets, exact duration, checks, table, tags and payload; payload_ok is null where no tag
    has a checksum."""
    out = {
        "hz": 0, "channels": 0, "layer": 0, "n_frames": 0, "n_samples": 0, "crc_checked": 0, "crc_failed": 0, "skipped_bytes": 0, "clipped": 0, "table_frames": None, "table_bytes": None,
        "table_entries": 0, "table_misses": 0, "tags": [], "seek": [], "kbit": 0,
    }
    pos, end, parts, toc, texts, table_at = 0, len(media), [], b"", {}, 0
    while media[pos : pos + 3] == b"ID3" and pos + 10 <= end:
        size = _size_of(media[pos + 6 : pos + 10], True)
        out["tags"].append(f"ID3v2.{media[pos + 3]}")
        texts |= text_frames(media[pos + 10 : pos + 10 + size], media[pos + 3])
        pos += 10 + size + (10 if media[pos + 5] & 0x10 else 0)
    if end - pos >= 128 and media[end - 128 : end - 125] == b"TAG":
        out["tags"].append("ID3v1")
        end -= 128
    first, locked = True, False
    while pos + 4 <= end:
        head = header(media[pos : pos + 4])
        after = pos + head[0] if head else 0
        if not head or after > end or not (locked or after == end or header(media[after : after + 4])):
            locked = False
            found = media.find(b"\xff", pos + 1, end)
            out["skipped_bytes"] += (end if found < 0 else found) - pos
            pos = end if found < 0 else found
            continue
        locked = True
        size, samples, hz, layer, mpeg1, protected, channels = head
        side = (17 if channels == 1 else 32) if mpeg1 else (9 if channels == 1 else 17)
        if first and layer == 3 and media[pos + 4 + side : pos + 8 + side] in (b"Xing", b"Info"):
            at, table_at = pos + 8 + side, pos
            flags = int.from_bytes(media[at : at + 4])
            at += 4
            for bit, name in ((1, "table_frames"), (2, "table_bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(media[at : at + 4])
                    at += 4
            toc = media[at : at + 100] if flags & 4 else b""
        else:
            if not out["n_frames"]:
                out |= {"hz": hz, "channels": channels, "layer": layer}
            out["n_frames"] += 1
            out["n_samples"] += samples
            out["kbit"] += size * 8
            out["seek"].append(pos)
            if protected:
                if layer == 3:
                    out["crc_checked"] += 1
                    out["crc_failed"] += crc16(media[pos + 2 : pos + 4] + media[pos + 6 : pos + 6 + side]) != int.from_bytes(media[pos + 4 : pos + 6])
                at = pos + 8 + side
                length = int.from_bytes(media[at - 2 : at])
                out["clipped"] += at + length > after
                parts.append(media[at : min(at + length, after)])
        first = False
        pos = after
    out["skipped_bytes"] += max(0, end - pos)
    payload = b"".join(parts)
    told = texts.get(CHECKSUM)
    ok = None if told is None else told == f"{zlib.crc32(payload):08x}"
    return out | {"table_entries": len(toc), "table_misses": seek_misses(toc, out["seek"], table_at, end), "payload_ok": ok, "payload": payload}


def padded(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes((-len(raw)) % UNIT or (0 if raw else UNIT))


def write_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each text's UTF-8 bytes, zero-filled to a positive multiple of 64, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([write_stream(padded(t)) for t in texts], pa.binary())], [id_col, "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


FEATURES = pa.schema([("hz", pa.int32()), ("channels", pa.int32()), ("layer", pa.int32()), ("n_frames", pa.int64()), ("n_samples", pa.int64()), ("crc_checked", pa.int64()), ("crc_failed", pa.int64()), ("skipped_bytes", pa.int64()), ("clipped", pa.int64()), ("table_frames", pa.int64()), ("table_bytes", pa.int64()), ("table_entries", pa.int64()), ("table_misses", pa.int64()), ("payload_ok", pa.bool_()), ("kbit", pa.int64()), ("tags", pa.list_(pa.string())), ("seek", pa.list_(pa.int64())), ("payload", pa.binary())])


def read_media(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media, features): duration is features.n_samples / features.hz seconds, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column=2):
                found = [None if m is None else read_stream(m) for m in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.struct(list(FEATURES)))], [id_col, "n_bytes", "media", "features"])

    kind = df.schema[id_col].dataType.simpleString()
    fields = "hz int, channels int, layer int, n_frames bigint, n_samples bigint, crc_checked bigint, crc_failed bigint, skipped_bytes bigint, clipped bigint, table_frames bigint, table_bytes bigint, table_entries bigint, table_misses bigint, payload_ok boolean, kbit bigint, tags array<string>, seek array<bigint>, payload binary"
    return df.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary, features struct<{fields.replace(' ', ':').replace(',:', ',')}>")
