import hashlib
import random
import zlib

import pytest

from tallyloom.llm import ogg_media as ogg


def slow_crc(data):
    """Ogg's checksum bit by bit."""
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x104C11DB7 if crc & 1 << 31 else crc << 1
    return crc & 0xFFFFFFFF


def test_checksum_is_oggs():
    rng = random.Random(1)
    for n in (0, 1, 5, 100):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_crc(data)
    assert ogg.checksum(b"123456789") == 0x89A1897F


@pytest.mark.parametrize("n", [192, 1920, 1920 * 2, 1920 * 3 + 192, 255 * 255 + 192, 300_000])
def test_round_trip_and_times(n):
    payload = random.Random(n).randbytes(n)
    data = ogg.encode(payload)
    got, count = ogg.decode(data)
    assert got == payload and count["bad"] == count["lost"] == 0 and count["streams"] == 2
    packets, _ = ogg.read(data)
    for serial in (0x7A00, 0x7A01):
        own = [(p, end) for s, i, p, end in packets if s == serial and i]
        at = 0
        for p, end in own:
            at += len(p)
            assert end == at
    assert sum(len(p) for _, i, p, _ in packets if i) == n


def test_packets_cross_pages_and_lacing_of_255():
    one = [b"a" * 255, b"", b"b" * 510, b"c" * (255 * 300)]
    data = b"".join(ogg.stream_pages(7, b"head", one))
    packets, count = ogg.read(data)
    assert [p for _, _, p, _ in packets] == [b"head", *one] and count["pages"] == 3
    flags = [x[0] for x in ogg.pages(data)]
    assert flags[0] & ogg.FIRST and flags[2] & ogg.CONTINUED and flags[-1] & ogg.LAST
    assert next(x for x in ogg.pages(data) if x[2] == 7 and x[3] == 1)[1] == 765


def test_damage_is_found_and_the_rest_is_read():
    payload = bytes(range(256)) * 600
    data = bytearray(ogg.encode(payload))
    at = data.find(b"OggS", len(data) // 2)
    data[at + 40] ^= 1
    packets, count = ogg.read(bytes(data))
    assert count["bad"] >= 1 and 0 < sum(len(p) for _, _, p, _ in packets) < len(payload)
    assert all(p in payload for _, i, p, _ in packets if i)
    assert ogg.read(b"noise" + ogg.encode(b" " * 192) + b"OggS")[1]["bad"] == 2
    assert ogg.read(None) == ([], {"pages": 0, "bad": 0, "lost": 0, "streams": 0})


def test_operator(spark):
    rows = [(1, "", "x"), (2, None, "x"), (3, "é" * 96, "x"), (3, "é" * 96, "y"), (None, "a" * 200_001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = ogg.probe(ogg.store_texts(df)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, text, _ in rows:
        raw = (text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        for r in by[i]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert len(by[3]) == 2 and by[3][0][1:] == by[3][1][1:] and by[1][0][1:] == by[2][0][1:]
    assert ogg.packets(ogg.store_texts(df)).where("doc_id = 3").count() == 6
    assert ogg.probe(ogg.store_texts(df.where("false"))).count() == 0


def test_times_are_of_each_streams_own_rate(spark):
    heads = {
        1: ogg.HEAD.pack(ogg.MAGIC, 16_000, 10, 0, 1, 30),
        2: b"OpusHead\x01\x02" + (312).to_bytes(2, "little") + b"\x80\xbb\0\0\0\0\0",
        3: b"\x01vorbis" + bytes(5) + (44_100).to_bytes(4, "little") + bytes(14),
        4: b"\x7fFLAC\x01\0\0\x01fLaC" + bytes(14) + ((96_000 << 12) | 5).to_bytes(4, "big"),
        5: b"Speex   " + bytes(28) + (8_000).to_bytes(4, "little"),
        6: b"unknown",
    }
    data = b"".join(b"".join(ogg.stream_pages(n, head, [b"a" * 10, b"b" * 470])) for n, head in heads.items())
    got = {(r.serial, r.packet): (r.granule, r.end_s) for r in ogg.packets(spark.createDataFrame([(1, data), (2, None)], "doc_id long, media binary")).collect()}
    assert len(got) == 18 and got[1, 1] == (10, 10 / 16_000) and got[1, 2] == (480, 0.03)
    assert [got[n, 1] for n in range(2, 7)] == [(None, None)] * 5
    assert [got[n, 2][1] for n in range(2, 7)] == [pytest.approx(x) if x else None for x in (168 / 48_000, 480 / 44_100, 480 / 96_000, 0.06, None)]


def test_length_is_of_granule_positions():
    payload = b"x" * 16_128
    data = ogg.encode(payload)
    assert ogg.decode(data)[1]["ms"] == 2016
    twice = b"".join(ogg.stream_pages(9, ogg.HEAD.pack(ogg.MAGIC, 16_000, ogg.PACKET, 0, 1, len(payload)), [payload[i : i + ogg.PACKET] for i in range(0, len(payload), ogg.PACKET)]))
    got, count = ogg.decode(twice)
    assert got == payload and count["ms"] == 1008
