import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweave.llm import ogg


def slow_crc(data):
    x = 0
    for b in data:
        x ^= b << 24
        for _ in range(8):
            x = ((x << 1) ^ (0x04C11DB7 if x & 0x80000000 else 0)) & 0xFFFFFFFF
    return x


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=80))
def test_checksum(data):
    assert ogg.crc(data) == slow_crc(data)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 140_000), min_size=1, max_size=5), st.lists(st.integers(0, 600), min_size=1, max_size=400), st.integers(1, 255))
def test_two_streams(big, small, per_page):
    a, b = ogg.Writer(1), ogg.Writer(2)
    pa_, pb = [bytes([i % 251]) * n for i, n in enumerate(big)], [bytes([i % 241]) * n for i, n in enumerate(small)]
    x, y = list(a.packets(pa_, [5] * len(pa_), True, True, per_page)), list(b.packets(pb, [3] * len(pb), True, True, per_page))
    mixed = [p for pair in zip(x, y) for p in pair] + x[len(y) :] + y[len(x) :]
    got = ogg.demux(b"".join(mixed))
    assert got[1].packets == pa_ and got[2].packets == pb
    assert ogg.times(got[1], [5] * len(pa_), 1).tolist() == [5 * k for k in range(len(pa_))]
    assert ogg.times(got[2], [3] * len(pb), 1).tolist() == [3 * k for k in range(len(pb))]


def test_damage():
    data = ogg.store(b"abc".ljust(576 * 100, b"\xff"), 3)
    for at in (30, len(data) // 2, len(data) - 1):
        with pytest.raises(ogg.DamagedPage):
            ogg.demux(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ogg.DamagedPage):
        ogg.demux(data[:-5])


def test_query(spark):
    texts = {1: "héllo", 2: None, 3: "", 4: "x" * 576, 5: "y" * 300_000, 6: "héllo"}
    df = spark.createDataFrame([(k, v, b"z") for k, v in texts.items()] + [(None, "q", b"z")], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in ogg.read_media(ogg.store_texts(df)).collect()}
    for k, v in texts.items():
        raw = (v or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.seconds == len(payload) / 8000 and r.n_packets == len(payload) // 576
    assert got[1][1:] == got[6][1:] and got[1].feature != got[4].feature and None in got
    assert ogg.read_media(ogg.store_texts(df.limit(0))).count() == 0
