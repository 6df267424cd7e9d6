"""Foreign and damaged MPEG streams, byte by byte."""

import random
import struct

import pytest

from paperloom.llm import mpeg_audio as m

FOUR = bytes((0xFF, 0xFB, 9 << 4, 0xC4))  # version 1, layer III, 128 kbit, 44100 Hz, mono, no checksum
SIZE = m.header(FOUR).size
FRAME = FOUR + bytes(SIZE - 4)
SIDE = m.header(FOUR).side


def frame(inside, at=4 + SIDE):
    return FOUR + bytes(at - 4) + inside + bytes(SIZE - at - len(inside))


def tag(version, name, text):
    many = len(text) + 1
    size = bytes(many >> s & 127 for s in (21, 14, 7, 0)) if version >= 4 else struct.pack(">I", many)
    body = name + size + b"\x00\x00\x00" + text
    return b"ID3" + bytes((version, 0, 0)) + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + body


def test_tables_by_their_flags():
    only_bytes = m.read(frame(b"Xing" + struct.pack(">II", 2, 4711)) + 3 * FRAME)
    assert only_bytes.table == (0, 4711, b"") and len(only_bytes.offsets) == 3
    both = m.read(frame(b"Info" + struct.pack(">III", 3, 3, 99)) + 3 * FRAME)
    assert both.table == (3, 99, b"") and both.samples == 3 * 1152
    vbri = m.read(frame(b"VBRI" + struct.pack(">HHHII", 1, 0, 50, 1234, 3), 36) + 3 * FRAME)
    assert vbri.table == (3, 1234, b"") and vbri.samples == 3 * 1152


def test_encoder_delay_shortens():
    table = b"Xing" + struct.pack(">III", 3, 3, 99) + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    assert m.read(frame(table) + 3 * FRAME).samples == 3 * 1152 - 1576


def test_tags():
    for version in (3, 4):
        found = m.read(tag(version, b"TIT2", b"a" * 300) + 2 * FRAME)
        assert found.tags["TIT2"] == "a" * 300 and len(found.offsets) == 2 and found.skipped == 0
    foreign = m.read(tag(3, b"TXXX", b"payload\x00no/number") + 2 * FRAME)
    assert foreign.lengths is None and foreign.payload == b"".join(foreign.ancillary)


@pytest.mark.parametrize("seed", range(4))
def test_no_bytes_crash_the_reader(seed):
    rng = random.Random(seed)
    whole = m.write(m.padded(b"some text " * 200), 2000)
    assert m.read(whole).payload == m.padded(b"some text " * 200)
    for _ in range(300):
        data = bytearray(whole[: rng.randrange(len(whole) + 1)])
        for _ in range(rng.randrange(8)):
            if data:
                data[rng.randrange(len(data))] = rng.randrange(256)
        m.read(bytes(data)).payload  # noqa: B018
    for end in range(len(FRAME) + 60):
        m.read((frame(b"Xing" + struct.pack(">I", 15)) + FRAME)[:end]).payload  # noqa: B018


def test_foreign_streams_give_rows(spark):
    streams = [tag(3, b"TXXX", b"payload\x00x/y") + 2 * FRAME, b"no audio", None, b""]
    out = {r.doc_id: r for r in m.probe(spark.createDataFrame(list(enumerate(streams)), "doc_id long, media binary")).collect()}
    assert [out[k].frames for k in range(4)] == [2, 0, 0, 0] and out[0].n_bytes == out[0].payload_bytes
