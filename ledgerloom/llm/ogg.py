"""Operator 9, media columns: Ogg.

A payload is stored as unsigned 8-bit samples in an Ogg file of two logical streams: the samples (an OggPCM header
packet, a comment packet, data packets) and a note with the payload's unpadded length. Reading verifies the checksum of
each page, reassembles packets from lacing values over page borders, tells the streams apart by serial number, and derives times
from granule positions.

Null texts are empty ones; an empty text is 192 blanks. Files depend on the payload alone, so equal texts give equal files.
A damaged file (checksum, lost page, missing stream) gives null features and its ``error``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 8000
UNIT = 192
PACKET = 4096
#: Each byte with its bits in reverse order: the page checksum is zlib's on such bytes.
_TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, high bit first, start and final value 0."""
    x = zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return struct.unpack("<I", struct.pack(">I", x)[::1].translate(_TURNED))[0]


def pages(serial: int, packets: list[tuple[bytes, int]], alone: int = 1) -> list[bytes]:
    """The pages of a logical stream from (packet, granule position at its end); each of the first ``alone`` packets gets its own page."""
    out: list[bytes] = []
    segments: list[tuple[bytes, int]] = []  # (segment, granule position if a packet ends with it, else -1)
    first_of_page_continues = False

    def close(last: bool) -> None:
        nonlocal segments, first_of_page_continues
        held, segments = segments[:255], segments[255:]
        ends = [g for _, g in held if g >= 0]
        flags = (1 if first_of_page_continues else 0) | (0 if out else 2) | (4 if last and not segments else 0)
        head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, ends[-1] if ends else -1, serial, len(out), 0, len(held))
        page = head + bytes(len(s) for s, _ in held) + b"".join(s for s, _ in held)
        out.append(page[:22] + struct.pack("<I", checksum(page)) + page[26:])
        first_of_page_continues = bool(held) and held[-1][1] < 0

    for k, (packet, granule) in enumerate(packets):
        n = len(packet)
        segments += [(packet[i : i + 255], -1) for i in range(0, n - n % 255, 255)]
        segments.append((packet[n - n % 255 :], granule))
        last = k == len(packets) - 1
        while len(segments) > 255 or segments and (last or k < alone):
            close(last)
    return out


def encode(payload: bytes, n_bytes: int, rate: int = RATE) -> bytes:
    serial = zlib.crc32(payload)
    sound = [(struct.pack(">8sHHIIBBHI", b"PCM     ", 0, 0, 1, rate, 8, 1, PACKET, 0), 0), (struct.pack("<I", 0) * 2, 0)]
    sound += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    first, *rest = pages(serial, sound, alone=2)
    note = pages(serial ^ 0xFFFFFFFF, [(b"LENGTH\x00" + struct.pack("<Q", n_bytes), 0)])
    return b"".join([first, *note, *rest])


def decode(media: bytes) -> dict[int, dict]:
    """By serial number: packets, times (granule position of each page on which a packet ends), pages. Raises ValueError on damage."""
    streams: dict[int, dict] = {}
    at, n = 0, len(media)
    while at < n:
        if n - at < 27 or media[at : at + 4] != b"OggS":
            raise ValueError("no page where one must start")
        _, _, flags, granule, serial, number, crc, count = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if len(lacing) < count or end > n:
            raise ValueError("a page is cut off")
        page = media[at:end]
        if checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError("checksum")
        s = streams.setdefault(serial, {"packets": [], "times": [], "pages": 0, "open": [], "ended": False})
        if number != s["pages"] or bool(flags & 2) != (number == 0) or bool(flags & 1) != bool(s["open"]) or s["ended"]:
            raise ValueError("a page is missing or out of order")
        s["pages"] += 1
        s["ended"] = bool(flags & 4)
        pos, start = 27 + count, 27 + count
        for x in lacing:
            pos += x
            if x < 255:
                s["packets"].append(b"".join([*s["open"], page[start:pos]]))
                s["open"], start = [], pos
        if start < pos or count and lacing[-1] == 255:
            s["open"].append(page[start:pos])
        if granule >= 0:
            s["times"].append(granule)
        at = end
    if any(s["open"] or not s["ended"] for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def encode_column(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media: the whole text of each row, padded by blanks to a positive multiple of 192 bytes, as an Ogg file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            media = [encode(t.ljust(max(1, -(-len(t) // UNIT)) * UNIT), len(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def read(media: bytes) -> tuple[bytes, int, str]:
    """The payload, its unpadded length and the features."""
    streams = decode(media)
    sound = next((s for s in streams.values() if s["packets"][0].startswith(b"PCM     ")), None)
    note = next((s for s in streams.values() if s["packets"][0].startswith(b"LENGTH\x00")), None)
    if sound is None or note is None:
        raise ValueError("a stream is missing")
    rate = struct.unpack_from(">I", sound["packets"][0], 16)[0]
    payload = b"".join(sound["packets"][2:])
    if sound["times"][-1] != len(payload):
        raise ValueError("granule position")
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    centred = x * len(x) >= x.sum()
    said = f"rate={rate};samples={len(x)};ms={sound['times'][-1] * 1000 // rate};pages={sound['pages'] + note['pages']};packets={len(sound['packets']) + len(note['packets'])};sum={x.sum()};energy={(x * x).sum()};crossings={np.count_nonzero(centred[1:] != centred[:-1])};low={x.min()};high={x.max()}"
    return payload, struct.unpack_from("<Q", note["packets"][0], 7)[0], said


def features(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """What the stored bytes hold: payload digests, digest of the file, features; error where a file is damaged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(1).to_pylist():
                try:
                    payload, n, said = read(m or b"")
                    own = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), said, None)
                except (ValueError, IndexError, struct.error) as e:
                    own = (None, None, None, None, None, str(e) or "damaged")
                rows.append((*own[:4], len(m or b""), hashlib.sha256(m or b"").hexdigest(), *own[4:]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])

    kind = media.schema[key].dataType.simpleString()
    return media.select(F.col(key).alias("key"), F.col(column)).mapInArrow(run, f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string").withColumnRenamed("key", key)
