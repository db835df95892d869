"""Media columns as MPEG transport streams: writing, and reading back with all checks.

A stream is packets of 188 bytes: a program association table, a program map table, and the
packets of one elementary stream of private data. The payload is cut into elementary (PES)
packets with a presentation timestamp each; the first transport packet of each carries a
program clock reference and marks a random-access point. Tables are repeated before every
``TABLES_EVERY`` elementary packets, with their checksums.

Reading finds the first program through its tables (an entry for the network is passed over) and
reads that program's first stream. It checks sync bytes, table checksums and every identifier's
continuity counter, joins the elementary packets, checks their lengths, and returns the payload,
the timestamps and the random-access points (packet number, timestamp). A packet may be sent twice
in a row: the second one is left out. A counter may jump where the packet says so (discontinuity
indicator). An elementary packet of length 0 reaches to the next one.

Defined results: a null text is stored as an empty one; a payload is padded with zero bytes
to a positive multiple of 64, so even the empty text has a stream; a very long text is one stream
of many elementary packets. Null media read as null everywhere; media that break a check give the
problems found and whatever payload could be joined. Equal texts give equal bytes, repeated rows
equal rows; an empty table gives an empty one. Other columns pass through, those named like a result
(media, n_bytes; what is read) are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.common import over_batches

# Fixed values of the format.
PACKET, SYNC, PAT_PID, STUFFING = 188, 0x47, 0x0000, 0xFF
PRIVATE_DATA_STREAM, PRIVATE_DATA_TYPE = 0xBD, 0x06
CLOCK = 90_000

# Choices of this writer.
PROGRAM, PMT_PID, ES_PID = 1, 0x1000, 0x0100
PES_PAYLOAD, TICKS, TABLES_EVERY, UNIT = 16_384, CLOCK // 25, 16, 64


@cache
def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        crc = i << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
        table.append(crc)
    return table


def crc32_mpeg(data: bytes) -> int:
    crc, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ table[(crc >> 24) ^ b]
    return crc


def _section(table_id: int, body: bytes) -> bytes:
    """A table section: header with its length, body, checksum."""
    length = len(body) + 4
    data = bytes([table_id, 0xB0 | length >> 8, length & 0xFF]) + body
    return data + crc32_mpeg(data).to_bytes(4, "big")


@cache
def _tables() -> tuple[bytes, bytes]:
    """Transport packets of the association and the map table, with counter 0."""
    pat = _section(0x00, bytes([0, 1, 0xC1, 0, 0]) + PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    es = bytes([PRIVATE_DATA_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + (0xF000).to_bytes(2, "big")
    pmt = _section(0x02, PROGRAM.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + (0xE000 | ES_PID).to_bytes(2, "big") + (0xF000).to_bytes(2, "big") + es)
    packet = lambda pid, section: (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, bytes([STUFFING]))
    return packet(PAT_PID, pat), packet(PMT_PID, pmt)


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 0xFF, 0x01 | (pts << 1 & 0xFE)])


def _pts_value(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The stored payload of a text, and its length before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"), len(raw)


def write(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out: list[bytes] = []
    counter = 0
    for n, at in enumerate(range(0, max(1, len(payload)), PES_PAYLOAD)):
        if n % TABLES_EVERY == 0:
            for packet in _tables():
                out.append(packet[:3] + bytes([0x10 | n // TABLES_EVERY % 16]) + packet[4:])
        pts = n * TICKS % (1 << 33)
        part = payload[at : at + PES_PAYLOAD]
        pes = b"\0\0\1" + bytes([PRIVATE_DATA_STREAM]) + (len(part) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _pts_bytes(pts) + part
        # first packet: adaptation field with the random-access mark and the clock reference
        clock = bytes([pts >> 25 & 0xFF, pts >> 17 & 0xFF, pts >> 9 & 0xFF, pts >> 1 & 0xFF, (pts & 1) << 7 | 0x7E, 0])
        room = PACKET - 12
        first = pes[:room]
        spare = room - len(first)
        adaptation = bytes([7 + spare, 0x50]) + clock + bytes([STUFFING]) * spare
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter]) + adaptation + first)
        counter = (counter + 1) % 16
        rest = pes[room:]
        full = len(rest) // (PACKET - 4)
        if full:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
            packets[:, 3] = 0x10 | (counter + np.arange(full)) % 16
            packets[:, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, -1)
            out.append(packets.tobytes())
            counter = (counter + full) % 16
        if last := rest[full * (PACKET - 4) :]:
            spare = PACKET - 4 - len(last)  # at least the byte for the field's length
            adaptation = bytes([spare - 1]) + (b"\0" + bytes([STUFFING]) * (spare - 2) if spare > 1 else b"")
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter]) + adaptation + last)
            counter = (counter + 1) % 16
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    program: int = 0
    pmt_pid: int = 0
    es_pid: int = 0
    stream_type: int = 0
    packets: int = 0
    pts: list[int] = field(default_factory=list)
    points: list[tuple[int, int]] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)


def _table(rows: np.ndarray, pid: int, table_id: int, problems: list[str]) -> bytes:
    """The body of the table sections of ``pid``; all repeats must agree and have a right checksum."""
    found: set[bytes] = set()
    for row in rows:
        data = row.tobytes()
        at = 4 + (1 + data[4] if data[3] & 0x20 else 0)
        at += 1 + data[at]
        length = (data[at + 1] & 0x0F) << 8 | data[at + 2]
        section = data[at : at + 3 + length]
        if section not in found:
            if len(section) != 3 + length or section[0] != table_id or crc32_mpeg(section) != 0:
                problems.append(f"table of {pid}")
                continue
            found.add(section)
    if len(found) != 1:
        problems.append(f"{len(found)} tables of {pid}")
        return b""
    return found.pop()[8:-4]


def read(media: bytes) -> Stream:
    """Demultiplex a transport stream of one program with one elementary stream."""
    s = Stream()
    if not media or len(media) % PACKET:
        s.problems.append("length")
        return s
    a = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    s.packets = len(a)
    if (a[:, 0] != SYNC).any() or (a[:, 1] & 0x80).any():
        s.problems.append("sync or transport error")
        return s
    pid = (a[:, 1].astype(np.int32) & 0x1F) << 8 | a[:, 2]
    has_payload, has_field = (a[:, 3] & 0x10) > 0, (a[:, 3] & 0x20) > 0
    body = _table(a[pid == PAT_PID], PAT_PID, 0x00, s.problems)
    if not body:
        return s
    entries = [body[at : at + 4] for at in range(0, len(body) - 3, 4)]
    first = next((e for e in entries if e[0] or e[1]), None)  # program 0 is the network's
    if first is None:
        s.problems.append("no program")
        return s
    s.program, s.pmt_pid = first[0] << 8 | first[1], (first[2] & 0x1F) << 8 | first[3]
    body = _table(a[pid == s.pmt_pid], s.pmt_pid, 0x02, s.problems)
    if not body:
        return s
    at = 4 + ((body[2] & 0x0F) << 8 | body[3])
    if at + 5 > len(body):
        s.problems.append("no stream")
        return s
    s.stream_type, s.es_pid = body[at], (body[at + 1] & 0x1F) << 8 | body[at + 2]
    rows = np.zeros(0, np.int64)
    for p in (PAT_PID, s.pmt_pid, s.es_pid):
        rows = np.flatnonzero((pid == p) & has_payload)
        twice = np.concatenate(([False], (a[rows[1:]] == a[rows[:-1]]).all(axis=1)))
        twice[1:] &= ~twice[:-1]  # a third copy is an error
        rows = rows[~twice]
        own = a[rows, 3] & 0x0F
        said = has_field[rows] & (a[rows, 4] > 0) & ((a[rows, 5] & 0x80) > 0)
        lost = int(((((own[1:].astype(np.int16) - own[:-1]) % 16) != 1) & ~said[1:]).sum())
        if lost:
            s.problems.append(f"continuity of {p}: {lost}")
    if not len(rows):
        s.problems.append("no elementary packets")
        return s
    es = a[rows]
    begin = np.where(has_field[rows], 5 + es[:, 4].astype(np.int32), 4)
    data = es[np.arange(PACKET) >= begin[:, None]].tobytes()
    edges = np.concatenate(([0], np.cumsum(PACKET - begin)))
    starts = np.flatnonzero(es[:, 1] & 0x40)
    marked = has_field[rows] & (es[:, 4] > 0) & ((es[:, 5] & 0x40) > 0)
    bounds = [*edges[starts].tolist(), len(data)]
    parts = []
    if not len(starts) or bounds[0] != 0:
        s.problems.append("bytes before the first elementary packet")
    for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        head = data[lo : lo + 14]
        if head[:3] != b"\0\0\1" or len(head) < 14:
            s.problems.append(f"start of elementary packet {k}")
            continue
        if (head[4] << 8 | head[5]) not in (0, hi - lo - 6):  # 0 sets no bound
            s.problems.append(f"length of elementary packet {k}")
        pts = _pts_value(head[9:14]) if head[7] & 0x80 else -1
        s.pts.append(pts)
        if marked[starts[k]]:
            s.points.append((int(rows[starts[k]]), pts))
        parts.append(data[lo + 9 + head[8] : hi])
    s.payload = b"".join(parts)
    return s


def mux(df: DataFrame, text: str = "text", media: str = "media", keep_text: bool = True) -> DataFrame:
    """Add the transport stream of each text, and n_bytes, the bytes of the text."""
    kept = [f for f in df.schema.fields if f.name not in {media, "n_bytes", *([] if keep_text else [text])}]
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                made = [(n, write(p)) for p, n in map(payload_of, batch.column(text).to_pylist())]
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], names=schema.names)

    return over_batches(df.select(text, *[f.name for f in kept if f.name != text]), run, schema)


def demux(df: DataFrame, media: str = "media", with_payload: bool = True) -> DataFrame:
    """Read ``media`` back: digests, timestamps, random-access points, a feature string and, if asked, the payload."""
    long, text = T.LongType(), T.StringType()
    point = T.StructType([T.StructField("packet", long), T.StructField("pts", long)])
    added = [("payload_bytes", long), ("payload_sha256", text), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", text), ("feature", text), ("pts", T.ArrayType(long)), ("points", T.ArrayType(point)), ("problems", T.ArrayType(text))]
    if with_payload:
        added.append(("payload", T.BinaryType()))
    names = {n for n, _ in added} | (set() if with_payload else {media})
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in added]])
    arrow = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.struct([("packet", pa.int64()), ("pts", pa.int64())])), pa.list_(pa.string()), pa.binary()]

    def row(data: bytes | None) -> list:
        if data is None:
            return [None] * len(arrow)
        s = read(data)
        said = f"program={s.program};pmt={s.pmt_pid};es={s.es_pid};type={s.stream_type};packets={s.packets};pes={len(s.pts)};last_pts={s.pts[-1] if s.pts else -1};points={','.join(f'{p}@{t}' for p, t in s.points)};problems={','.join(s.problems)}"
        return [len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), said, s.pts, [{"packet": p, "pts": t} for p, t in s.points], s.problems, s.payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                made = [row(m) for m in batch.column(media).to_pylist()]
                columns = [pa.array([r[k] for r in made], t) for k, t in enumerate(arrow[: len(added)])]
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *columns], names=schema.names)

    return over_batches(df.select(media, *[f.name for f in kept if f.name != media]), run, schema)
