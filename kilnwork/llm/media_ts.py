"""MPEG transport streams as a media column.

``pack`` writes a payload into one elementary stream: a program association table, a program map table, and
timed packets of ``UNIT`` payload bytes that are spread over 188-byte transport packets, with continuity
counters, a clock reference and a random-access mark at the start of every ``ACCESS``-th unit. ``unpack``
takes any stream of this kind: it checks the sync bytes and table checksums, follows the tables from the
program to its elementary stream, checks continuity counters, reassembles the timed packets and lists their
timestamps and random-access points. Packets are handled as numpy matrices, a document at a time.

Defined cases: a null or empty text has a payload of 64 zero bytes. Very long texts are stored whole; a document's
stream is in a worker's memory a few times over. Null ids are kept and repeated rows each
get a row. A stream that is damaged in ``unpack`` gives a count of continuity errors, or ValueError where
tables or timed packets can't be read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kilnwork.llm.blocks import arrow_batches, id_schema

PACKET, BODY = 188, 184
#: Payload bytes in a timed packet; timed packets from one random-access point to the next, and to the next tables.
UNIT, ACCESS = 32_704, 8
#: Ticks of the 90 kHz clock between timed packets.
TICKS = 3_003
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 1, 0x06, 0xBD
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, access_points array<long>, media binary"


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


_TABLES = np.stack([
    _table_packet(0, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))),
    _table_packet(PMT_PID, _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")),
])


def _timestamp(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, t >> 22 & 0xFF, 1 | (t >> 14) & 0xFE, t >> 7 & 0xFF, 1 | (t << 1) & 0xFE])


def _unit_packets(unit: bytes, ticks: int, access: bool) -> np.ndarray:
    """One timed packet as transport packets, without counters."""
    pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(ticks) + unit
    ref = (ticks << 15 | 0x7E00).to_bytes(6, "big")
    lead = bytes([0x50 if access else 0x10]) + ref
    first = min(len(pes), BODY - 1 - len(lead))
    lead += b"\xff" * (BODY - 1 - len(lead) - first)
    rest = len(pes) - first
    whole, left = divmod(rest, BODY)
    out = np.full((1 + whole + (left > 0), PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = 0x47, ES_PID >> 8, ES_PID & 0xFF, 0x10
    out[0, 1] |= 0x40
    out[0, 3] = 0x30
    out[0, 4] = len(lead)
    out[0, 5 : 5 + len(lead)] = np.frombuffer(lead, np.uint8)
    body = np.frombuffer(pes, np.uint8)
    out[0, PACKET - first :] = body[:first]
    out[1 : 1 + whole, 4:] = body[first : first + whole * BODY].reshape(whole, BODY)
    if left:
        stuff = BODY - left - 1
        out[-1, 3] = 0x30
        out[-1, 4] = stuff
        if stuff:
            out[-1, 5] = 0
        out[-1, PACKET - left :] = body[-left:]
    return out


def pack(payload: bytes) -> np.ndarray:
    """The transport stream of a payload, one row for each packet."""
    parts = []
    for k, a in enumerate(range(0, len(payload), UNIT)):
        if k % ACCESS == 0:
            parts.append(_TABLES)
        parts.append(_unit_packets(payload[a : a + UNIT], 90_000 + k * TICKS, k % ACCESS == 0))
    out = np.concatenate(parts) if parts else _TABLES.copy()
    pid = (out[:, 1] & 0x1F).astype(np.int32) << 8 | out[:, 2]
    for p in (0, PMT_PID, ES_PID):
        mine = np.flatnonzero(pid == p)
        out[mine, 3] |= (np.arange(len(mine)) & 15).astype(np.uint8)
    return out


@dataclass
class Stream:
    payload: bytes
    pmt_pid: int
    es_pid: int
    stream_type: int
    continuity_errors: int
    timestamps: list[int]
    access_points: list[int]
    packets: int


def _section_of(packets: np.ndarray, start: np.ndarray, mine: np.ndarray, table_id: int) -> bytes:
    first = next((i for i in mine if packets[i, 1] & 0x40), None)
    if first is None:
        raise ValueError(f"no table {table_id}")
    raw = packets[first, start[first] :].tobytes()
    raw = raw[1 + raw[0] :]
    size = 3 + (int.from_bytes(raw[1:3], "big") & 0x0FFF)
    if raw[0] != table_id or size > len(raw) or section_crc(raw[:size]):
        raise ValueError(f"table {table_id} is damaged")
    return raw[:size]


def unpack(media: bytes | np.ndarray) -> Stream:
    """Reads the first program's first elementary stream back."""
    p = np.frombuffer(media, np.uint8) if isinstance(media, bytes) else media.reshape(-1)
    if len(p) % PACKET or not len(p):
        raise ValueError("not a whole number of transport packets")
    p = p.reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    pid = (p[:, 1] & 0x1F).astype(np.int32) << 8 | p[:, 2]
    field = p[:, 3] >> 4 & 3
    start = 4 + np.where(field & 2, p[:, 4].astype(np.int32) + 1, 0)
    start[(field & 1) == 0] = PACKET
    pat = _section_of(p, start, np.flatnonzero(pid == 0), 0x00)
    programs = [pat[i : i + 4] for i in range(8, len(pat) - 4, 4) if pat[i : i + 2] != b"\x00\x00"]
    pmt_pid = int.from_bytes(programs[0][2:], "big") & 0x1FFF
    pmt = _section_of(p, start, np.flatnonzero(pid == pmt_pid), 0x02)
    at = 12 + (int.from_bytes(pmt[10:12], "big") & 0x0FFF)
    stream_type, es_pid = pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF

    mine = np.flatnonzero((pid == es_pid) & ((field & 1) == 1))
    e, start = p[mine], start[mine]
    counter = e[:, 3] & 15
    errors = int(((counter[1:] - counter[:-1]) & 15 != 1).sum())
    body = e[np.arange(PACKET) >= start[:, None]]
    upto = np.zeros(len(e) + 1, np.int64)
    np.cumsum(PACKET - start, out=upto[1:])
    heads = np.flatnonzero(e[:, 1] & 0x40)
    marked = ((e[heads, 3] & 0x20) > 0) & (e[heads, 4] > 0) & ((e[heads, 5] & 0x40) > 0)
    units, times, points, size = [], [], [], 0
    raw = body.tobytes()
    for k, (a, z) in enumerate(zip(upto[heads].tolist(), [*upto[heads[1:]].tolist(), int(upto[-1])])):
        if raw[a : a + 3] != b"\x00\x00\x01":
            raise ValueError("a timed packet does not begin with its start code")
        length = int.from_bytes(raw[a + 4 : a + 6], "big")
        if length:
            z = min(z, a + 6 + length)
        if raw[a + 7] & 0x80:
            t = raw[a + 9 : a + 14]
            times.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
        if marked[k]:
            points.append(size)
        unit = raw[a + 9 + raw[a + 8] : z]
        units.append(unit)
        size += len(unit)
    return Stream(b"".join(units), pmt_pid, es_pid, stream_type, errors, times, points, len(p))


def padded(text: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def store_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, and each text's payload as a transport stream in the column ``media``."""
    arrow_batches(docs.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array((pack(padded(t)).tobytes() for t in texts), pa.binary())], names=["doc_id", "n_bytes", "media"])

    docs = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    return docs.mapInArrow(store, id_schema(docs, "doc_id long, n_bytes long, media binary"))


def read_streams(stored: DataFrame, keep_media: bool = True) -> DataFrame:
    """The columns of SCHEMA from what ``store_streams`` gave, in whatever table it was kept; ``keep_media`` False leaves ``media`` null."""
    arrow_batches(stored.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for media in batch.column(2).to_pylist():
                s = unpack(media)
                feature = f"program={s.pmt_pid:#06x};stream={s.es_pid:#06x}/{s.stream_type:#04x};packets={s.packets};units={len(s.timestamps)};first={s.timestamps[0]};last={s.timestamps[-1]};access={len(s.access_points)};discontinuities={s.continuity_errors}"
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, s.timestamps, s.access_points, media if keep_media else None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds))], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, id_schema(stored, SCHEMA))


def transport_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Stores each text as a transport stream in a column, reads that column back and returns the columns of SCHEMA."""
    return read_streams(store_streams(docs, id_col, text_col), keep_media)
