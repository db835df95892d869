import hashlib
import random
import zlib

import pytest

from quern.llm import queries, transport


@pytest.mark.parametrize("size", [64, 128, 176, 184, 192, 16_320, 16_384, 16_448, 16_384 * 40 + 64])
def test_round_trip(size):
    payload = random.Random(size).randbytes(size)
    media = transport.write(payload)
    s = transport.read(media)
    assert s.payload == payload and not s.problems and len(media) % 188 == 0
    assert (s.program, s.pmt_pid, s.es_pid, s.stream_type) == (1, 0x1000, 0x100, 6)
    assert s.pts == [i * 3600 for i in range(-(-size // 16_384))] and [t for _, t in s.points] == s.pts
    for packet, _ in s.points:
        assert media[188 * packet] == 0x47 and media[188 * packet + 5] & 0x40


def test_damage_is_found():
    media = transport.write(bytes(range(256)) * 64)
    n = len(media) // 188
    for cut in (0, 1, 2, 5, n - 1):  # a packet is lost
        assert transport.read(media[: 188 * cut] + media[188 * (cut + 1) :]).problems
    for at in (0, 13, 188 + 20, 188 * 5):  # sync, tables, sync
        broken = bytearray(media)
        broken[at] ^= 0x55
        assert transport.read(bytes(broken)).problems
    assert transport.read(b"").problems and transport.read(media[:-1]).problems


def test_packets_sent_twice_and_announced_jumps():
    payload = random.Random(3).randbytes(16_384 * 3)
    media = transport.write(payload)
    n = len(media) // 188
    for at in (0, 1, 2, 3, 7, n - 1):  # tables, first, inner and last packet
        packet = media[188 * at : 188 * (at + 1)]
        s = transport.read(media[: 188 * at] + packet + media[188 * at :])
        assert s.payload == payload and not s.problems
        assert transport.read(media[: 188 * at] + packet * 2 + media[188 * at :]).problems
    firsts = [p for p, _ in transport.read(media).points]
    moved = bytearray(media)
    for at in range(firsts[1], n):  # all counters from the second elementary packet on jump by five
        moved[188 * at + 3] = moved[188 * at + 3] & 0xF0 | (moved[188 * at + 3] + 5) % 16
    assert transport.read(bytes(moved)).problems == ["continuity of 256: 1"]
    moved[188 * firsts[1] + 5] |= 0x80
    s = transport.read(bytes(moved))
    assert s.payload == payload and not s.problems


def test_packets_without_a_length_and_a_network_entry():
    payload = bytes(range(256)) * 256
    media = bytearray(transport.write(payload))
    for at, _ in transport.read(bytes(media)).points:
        start = media.index(b"\0\0\1\xbd", 188 * at)
        media[start + 4 : start + 6] = b"\0\0"
    section = transport._section(0x00, bytes([0, 1, 0xC1, 0, 0, 0, 0, 0xE0, 0x10, 0, 1, 0xF0, 0]))
    for at in range(0, len(media), 188):
        if media[at + 1 : at + 3] == b"\x40\0":
            media[at : at + 188] = bytes(media[at : at + 5]) + section.ljust(183, b"\xff")
    s = transport.read(bytes(media))
    assert s.payload == payload and not s.problems and s.program == 1


def test_table_checksum_is_the_standards():
    assert transport.crc32_mpeg(b"123456789") == 0x0376E6E7


def plain_stream(payload):
    """The same stream from the format's definition, a packet at a time and a bit string at a time."""

    def crc(data):
        reg = 0xFFFFFFFF
        for byte in data:
            for k in range(7, -1, -1):
                top = reg >> 31 ^ (byte >> k & 1)
                reg = (reg << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
        return reg

    def bits(*fields):
        text = "".join(f"{v:0{n}b}" for v, n in fields)
        return int(text, 2).to_bytes(len(text) // 8, "big")

    def table(kind, number, loop):
        body = bits((number, 16), (3, 2), (0, 5), (1, 1), (0, 8), (0, 8)) + loop
        head = bits((kind, 8), (1, 1), (0, 1), (3, 2), (len(body) + 4, 12)) + body
        return b"\0" + head + crc(head).to_bytes(4, "big")

    counters, out = {0: 0, 0x1000: 0, 0x100: 0}, b""

    def packet(pid, start, data, field=b""):
        nonlocal out
        room = 184 - len(data) - len(field)
        if pid != 0x100:
            data, room = data + b"\xff" * room, 0
        if room == 1 and not field:
            field = b"\0"
        elif room or field:
            flags = field or bits((room, 0), (0, 8)) if field else b"\0"
            filler = 184 - len(data) - 1 - len(flags)
            field = bytes([len(flags) + filler]) + flags + b"\xff" * filler
        out += bits((0x47, 8), (0, 1), (start, 1), (0, 1), (pid, 13), (0, 2), (3 if field else 1, 2), (counters[pid], 4)) + field + data
        counters[pid] = (counters[pid] + 1) % 16

    for n, at in enumerate(range(0, len(payload), 16_384)):
        if n % 16 == 0:
            packet(0, 1, table(0, 1, bits((1, 16), (7, 3), (0x1000, 13))))
            packet(0x1000, 1, table(2, 1, bits((7, 3), (0x100, 13), (15, 4), (0, 12), (6, 8), (7, 3), (0x100, 13), (15, 4), (0, 12))))
        pts, part = n * 3600, payload[at : at + 16_384]
        stamp = bits((2, 4), (pts >> 30, 3), (1, 1), (pts >> 15 & 0x7FFF, 15), (1, 1), (pts & 0x7FFF, 15), (1, 1))
        pes = b"\0\0\1\xbd" + (len(part) + 8).to_bytes(2, "big") + bits((2, 2), (0, 6), (2, 2), (0, 6), (5, 8)) + stamp + part
        clock = bits((0, 1), (1, 1), (0, 1), (1, 1), (0, 4)) + bits((pts, 33), (63, 6), (0, 9))
        packet(0x100, 1, pes[:176], clock)
        for k in range(176, len(pes), 184):
            packet(0x100, 0, pes[k : k + 184])
    return out


def test_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries.op3_transport(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        raw = (d["text"] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64) or b"\0" * 64
        r = rows[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(plain_stream(payload)).hexdigest() and r["feature"].endswith("problems=")


def test_odd_rows(spark, odd, nothing):
    muxed = transport.mux(odd)
    rows = transport.demux(muxed.drop("feature")).collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(muxed.columns)
    for r in rows:
        raw = (r["text"] or "").encode()
        assert bytes(r["payload"])[: len(raw)] == raw and r["n_bytes"] == len(raw) and r["problems"] == []
    assert transport.demux(transport.mux(nothing)).count() == 0
    bad = spark.createDataFrame([(None,), (bytearray(b"junk"),)], "media binary")
    assert sorted((r["payload_bytes"] is None, bool(r["problems"])) for r in transport.demux(bad).collect()) == [(False, True), (True, False)]
