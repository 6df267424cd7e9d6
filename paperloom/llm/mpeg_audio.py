"""MPEG audio columns: frames written and read back, with tags, seek tables, checksums and exact durations.

The writer makes MPEG-1 layer III frames (32 kHz, mono, checksum on) whose granules are empty, so that they
play as silence, and carries a payload as ancillary data behind the side information; bitrates vary so that the
last frame fits what is left.  A variable-bitrate table leads, an ID3 tag holds the payload's length.  The reader
takes any stream of MPEG-1 or MPEG-2 layer III: it skips tags, finds the next believable header after damage,
verifies each frame's checksum and keeps the offset of every frame.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches

#: Fixed values of the format: kbit/s by index, Hz by index, samples of a frame.
KBITS = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
HERTZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000)}
SAMPLES = {1: 1152, 2: 576}
SIDE = {(1, False): 32, (1, True): 17, (2, False): 17, (2, True): 9}
RATE, SAMPLE_INDEX = 32000, 2
BLOCK = 64


@dataclass(frozen=True)
class Header:
    version: int
    checked: bool
    kbits: int
    hertz: int
    mono: bool
    size: int

    @property
    def side(self) -> int:
        """Bytes of side information."""
        return SIDE[self.version, self.mono]


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """A layer III frame header, or None."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {3: 1, 2: 2}.get(four[1] >> 3 & 3)
    rate, hertz = four[2] >> 4, four[2] >> 2 & 3
    if version is None or four[1] >> 1 & 3 != 1 or rate in (0, 15) or hertz == 3:
        return None
    kbits, herz = KBITS[version][rate], HERTZ[version][hertz]
    return Header(version, not four[1] & 1, kbits, herz, four[3] >> 6 == 3, SAMPLES[version] // 8 * kbits * 1000 // herz + (four[2] >> 1 & 1))


def _crc16_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        out.append(value)
    return out


_CRC16 = _crc16_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005 from 0xFFFF, over the header's last two bytes and the side information."""
    value = 0xFFFF
    for byte in data:
        value = (value << 8 & 0xFF00) ^ _CRC16[value >> 8 ^ byte]
    return value


@lru_cache(64)
def _lead(kbits: int) -> tuple[bytes, int]:
    """A frame's header, checksum and empty side information, and its size, at a bitrate."""
    four = bytes((0xFF, 0xFA, KBITS[1].index(kbits) << 4 | SAMPLE_INDEX << 2, 0xC0))
    side = bytes(SIDE[1, True])
    return four + struct.pack(">H", crc16(four[2:] + side)) + side, header(four).size


def write(payload: bytes, unpadded: int) -> bytes:
    """A stream that carries ``payload``; its tag notes the payload's length and that without padding."""
    rates = KBITS[1][1:]
    room = {k: size - len(lead) for k in rates for lead, size in (_lead(k),)}
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        kbits = next((k for k in rates if room[k] >= left), rates[-1])
        part = payload[at : at + room[kbits]]
        frames.append(_lead(kbits)[0] + part + bytes(room[kbits] - len(part)))
        at += len(part)
    note = b"\x00payload\x00" + f"{len(payload)}/{unpadded}".encode()
    body = b"TXXX" + struct.pack(">IH", len(note), 0) + note
    tag = b"ID3\x03\x00\x00" + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + body
    four = bytes((0xFF, 0xFB, 1 << 4 | SAMPLE_INDEX << 2, 0xC0))
    size = header(four).size
    ends = [size]
    for x in frames:
        ends.append(ends[-1] + len(x))
    points = bytes(min(255, 256 * ends[k * len(frames) // 100] // ends[-1]) for k in range(100))
    first = four + bytes(SIDE[1, True]) + b"Xing" + struct.pack(">III", 7, len(frames), ends[-1]) + points
    return b"".join([tag, first + bytes(size - len(first)), *frames])


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    table: tuple[int, int, bytes] | None = None
    offsets: list[int] = field(default_factory=list)
    kbits: set[int] = field(default_factory=set)
    samples: int = 0
    hertz: int = 0
    skipped: int = 0
    damaged: int = 0
    ancillary: list[bytes] = field(default_factory=list)

    delay: int = 0

    @property
    def lengths(self) -> tuple[int, int] | None:
        """Bytes that the writer stored, with and without padding, by its tag; None where that is missing or another's."""
        found = re.fullmatch(r"([0-9]{1,15})/([0-9]{1,15})", self.tags.get("payload", ""), re.ASCII)
        return (int(found[1]), int(found[2])) if found else None

    @property
    def payload(self) -> bytes:
        """What the writer stored, or all ancillary data where its tag is missing."""
        data = b"".join(self.ancillary)
        return data[: self.lengths[0]] if self.lengths else data


def _id3(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of a leading ID3v2 tag, and the bytes that it takes."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    size = 0
    for byte in data[6:10]:
        size = size << 7 | byte & 127
    end, at, tags = min(len(data), 10 + size), 10, {}
    while at + 10 <= end and data[at : at + 4].isalnum():
        name = data[at : at + 4].decode("latin-1")
        many = int.from_bytes(data[at + 4 : at + 8], "big")
        if data[3] >= 4:  # from the fourth version on sizes have seven bits a byte
            many = sum((x & 127) << s for x, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0), strict=True))
        text = data[at + 11 : at + 10 + many].decode("latin-1")
        if name == "TXXX":
            name, _, text = text.partition("\x00")
        if name[:1] == "T" or data[at : at + 4] == b"TXXX":
            tags[name] = text.rstrip("\x00")
        at += 10 + many
    return tags, 10 + size


def _table(data: bytes, at: int, end: int) -> tuple[tuple[int, int, bytes], int] | None:
    """(frames, bytes, seek points) of a variable-bitrate table at ``at``, and the samples of encoder delay and padding that
    stand behind it; None where there is no table.  Fields that are flagged as missing or lie beyond ``end`` are 0 or empty."""
    number = lambda k, size: int.from_bytes(data[k : min(end, k + size)], "big") if k + size <= end else 0
    if data[at : at + 4] == b"VBRI":
        return (number(at + 14, 4), number(at + 10, 4), b""), 0
    if data[at : at + 4] not in (b"Xing", b"Info"):
        return None
    flags, at = number(at + 4, 4), at + 8
    frames, at = (number(at, 4), at + 4) if flags & 1 else (0, at)
    many, at = (number(at, 4), at + 4) if flags & 2 else (0, at)
    points, at = (data[at : min(end, at + 100)], at + 100) if flags & 4 else (b"", at)
    at += 4 if flags & 8 else 0
    gaps = number(at + 21, 3) if data[at : at + 4] in (b"LAME", b"Lavc", b"Lavf") else 0
    return (frames, many, points), (gaps >> 12) + (gaps & 0xFFF)


def read(data: bytes) -> Stream:
    """Parse a stream; bytes that belong to no believable frame are skipped and counted."""
    out = Stream()
    out.tags, at = _id3(data)
    end = len(data)
    if data[-128:-125] == b"TAG" and end >= 128:  # the older tag, at the end
        end -= 128
        out.tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1"))
    sure = False
    while at + 4 <= end:
        found = header(data[at : at + 4])
        next_at = at + found.size if found else 0
        # behind damage a header counts only if another follows it, or the stream ends with it
        if not found or next_at > end or not (sure or next_at == end or header(data[next_at : next_at + 4])):
            following = data.find(b"\xff", at + 1, end)
            following = end if following < 0 else following
            out.skipped += following - at
            at, sure = following, False
            continue
        body = at + 4 + 2 * found.checked
        side = data[body : body + found.side]
        first = not out.offsets and out.table is None
        # one kind of table stands behind the side information, the other always 32 bytes behind the header
        held = (_table(data, body + found.side, next_at) or (_table(data, at + 36, next_at) if data[at + 36 : at + 40] == b"VBRI" else None)) if first else None
        if held:
            out.table, out.delay = held
        else:
            if found.checked and int.from_bytes(data[at + 4 : at + 6], "big") != crc16(data[at + 2 : at + 4] + side):
                out.damaged += 1
            out.offsets.append(at)
            out.kbits.add(found.kbits)
            out.samples += SAMPLES[found.version]
            out.hertz = out.hertz or found.hertz
            out.ancillary.append(data[body + found.side : next_at])
        at, sure = next_at, True
    out.skipped += max(0, end - at)
    out.samples = max(0, out.samples - out.delay)
    return out


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of BLOCK."""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def store(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``media``: each text's UTF-8 bytes, padded, as an MPEG stream.  A null text counts as empty; null
    and repeated doc_ids stay rows; further columns are ignored; an empty table gives an empty result."""
    small_batches(docs.sparkSession)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
            yield pa.record_batch([batch.column(0), pa.array([write(padded(x), len(x)) for x in texts], pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(stored, "doc_id long, media binary")


PROBE = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, samples long, hertz int, seconds double, vbr boolean, skipped long, damaged long, seek_offsets array<long>"


def probe(media: DataFrame) -> DataFrame:
    """Read streams (``doc_id``, ``media``): payload and media digests, exact length in samples, seek offsets of all frames.
    A null or foreign stream gives no frames, or what frames are found in it."""
    small_batches(media.sparkSession)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py() or b""
                x = read(data)
                payload = x.payload
                unpadded = x.lengths[1] if x.lengths else len(payload)
                seconds = x.samples / x.hertz if x.hertz else 0.0
                rows.append((doc_id, unpadded, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), len(x.offsets), x.samples, x.hertz, seconds, len(x.kbits) > 1, x.skipped, x.damaged, x.offsets))
            types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            columns = list(zip(*rows, strict=True)) or [[] for _ in types]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split(" ")[0] for c in PROBE.split(", ")])

    return media.select("doc_id", "media").mapInArrow(probed, PROBE)


def audio_report(docs: DataFrame) -> DataFrame:
    """Store, read back, and one ``feature`` string of length, frames, seek table and checks."""
    feature = F.format_string("frames=%d;samples=%d;hertz=%d;vbr=%s;skipped=%d;damaged=%d;seek=%s", "frames", "samples", "hertz", F.col("vbr").cast("string"), "skipped", "damaged", F.hex(F.xxhash64("seek_offsets")))
    return probe(store(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
