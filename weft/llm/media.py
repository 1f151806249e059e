"""Media columns as MPEG transport streams.

``store`` keeps each text as a transport stream: its UTF-8 bytes, filled with 255 up to a positive multiple of
576, are cut into access units, each unit a PES packet with a presentation time, the packets
spread over 188-byte transport packets behind a program association and a program map table.
``inspect`` reads stored bytes back: it checks sync bytes, adaptation fields, section CRCs and the continuity counters of
tables and streams, follows PAT and PMT to the elementary stream, reassembles its PES packets, and lists time stamps with the
random-access flag. A packet sent twice, as the format allows, counts once; sections may span packets; what is
damaged is counted and left out. Both are row-wise Arrow functions: no shuffle, memory bounded by a slice of a batch.

Defined results: a null text is an empty one, stored as one block of 576 times 255; equal texts
give equal streams and features; repeated rows and empty tables pass through; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch_of, pieces, table, texts

PACKET, BODY, SYNC = 188, 184, 0x47
BLOCK = 576
UNIT = 10 * BLOCK  # bytes of an access unit
PMT_PID, ES_PID, PROGRAM, PRIVATE, STREAM_ID = 0x1000, 0x100, 1, 0x06, 0xBD
CLOCK, UNIT_TICKS, RAP_EVERY = 90_000, 3_600, 4  # a unit lasts 1/25 s; every fourth is a random-access point
FIELD = 8  # bytes of the adaptation field of a unit's first packet: its length, flags, and the clock reference
PES_HEAD = 14


@cache
def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        r = i << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
        out.append(r)
    return tuple(out)


def crc32_mpeg(data: bytes) -> int:
    r, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        r = ((r << 8) & 0xFFFFFFFF) ^ t[(r >> 24) ^ b]
    return r


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


@cache
def _psi() -> bytes:
    """PAT and PMT packets."""
    pat = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE, 0xE000 | ES_PID, 0xF000))
    return b"".join((struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + s).ljust(PACKET, b"\xff") for pid, s in ((0, pat), (PMT_PID, pmt)))


def _pts(t: int) -> bytes:
    return bytes((0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 0x01 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 0x01 | (t << 1) & 0xFE))


def _pcr(t: int) -> bytes:
    return ((t & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big")


def padded(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b"\xff")


def mux(payload: bytes) -> bytes:
    """A transport stream whose one elementary stream carries ``payload``."""
    out, counter = [_psi()], 0
    for k in range(-(-len(payload) // UNIT)):
        unit = payload[k * UNIT : (k + 1) * UNIT]
        rap = k % RAP_EVERY == 0
        pes = b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, len(unit) + PES_HEAD - 6, 0x84, 0x80, 5) + _pts((k + 1) * UNIT_TICKS & (1 << 33) - 1) + unit
        # The first packet has an adaptation field with the clock reference and the random-access flag; the last one is filled up by one.
        first = pes[: BODY - FIELD]
        rest = pes[len(first) :]
        full, last = divmod(len(rest), BODY)
        n = 1 + full + bool(last)
        rows = np.empty((n, PACKET), np.uint8)
        rows[:, 0] = SYNC
        rows[:, 1] = ES_PID >> 8
        rows[0, 1] |= 0x40
        rows[:, 2] = ES_PID & 0xFF
        rows[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter = (counter + n) & 15
        fill = BODY - FIELD - len(first)
        rows[0, 3] |= 0x20
        rows[0, 4] = FIELD - 1 + fill
        rows[0, 5] = 0x50 if rap else 0x10
        rows[0, 6:12] = np.frombuffer(_pcr(k * UNIT_TICKS), np.uint8)
        rows[0, 12 : 12 + fill] = 255
        rows[0, 12 + fill :] = np.frombuffer(first, np.uint8)
        body = np.frombuffer(rest, np.uint8)
        if full:
            rows[1 : 1 + full, 4:] = body[: full * BODY].reshape(full, BODY)
        if last:
            fill = BODY - last
            rows[-1, 3] |= 0x20
            rows[-1, 4] = fill - 1
            if fill > 1:
                rows[-1, 5] = 0
                rows[-1, 6 : 4 + fill] = 255
            rows[-1, 4 + fill :] = body[full * BODY :]
        out.append(rows.tobytes())
    return b"".join(out)


class Stream:
    """What ``demux`` reads: program -> {pid: stream type}, errors, and the units of the elementary streams."""

    def __init__(self) -> None:
        self.programs: dict[int, dict[int, int]] = {}
        self.packets = self.sync_errors = self.field_errors = self.crc_errors = self.continuity_errors = self.unit_errors = self.duplicates = 0
        self.units: list[tuple[int | None, bool, bytes]] = []  # (time stamp, random access, bytes)

    @property
    def payload(self) -> bytes:
        return b"".join(u[2] for u in self.units)


class _Packets:
    """Whole packets with a sound header, as rows of bytes."""

    def __init__(self, data: bytes, out: Stream) -> None:
        rows = np.frombuffer(data, np.uint8)[: len(data) // PACKET * PACKET].reshape(-1, PACKET)
        out.packets = len(rows)
        good = rows[:, 0] == SYNC
        out.sync_errors = int((~good).sum())
        field = rows[:, 4].astype(np.int32) * (rows[:, 3] >> 5 & 1)
        sound = good & (field <= np.where(rows[:, 3] & 0x10, PACKET - 6, PACKET - 5))
        out.field_errors = int((good & ~sound).sum())
        self.rows = rows = rows[sound]
        self.pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
        self.has_field = rows[:, 3] & 0x20 != 0
        self.start = np.where(self.has_field, 5 + field[sound], 4)
        self.begins = rows[:, 1] & 0x40 != 0
        self.flags = np.where(self.has_field & (self.start > 5), rows[:, 5], 0)

    def of(self, pid: int, out: Stream) -> tuple[np.ndarray, np.ndarray]:
        """The packets of a pid that carry payload, each once, and whether packets are missing before each."""
        at = np.flatnonzero((self.pid == pid) & (self.rows[:, 3] & 0x10 != 0))
        if not len(at):
            return at, np.empty(0, bool)
        cc = self.rows[at, 3] & 15
        step = np.concatenate(([1], (cc[1:] - cc[:-1]) & 15))
        same = np.flatnonzero(step == 0)
        twice = np.zeros(len(at), bool)
        twice[same] = (self.rows[at[same]] == self.rows[at[same - 1]]).all(axis=1)
        again = twice & np.concatenate(([False], twice[:-1]))  # a packet may be sent twice, not three times
        gap = (step != 1) & ~twice & (self.flags[at] & 0x80 == 0)
        out.duplicates += int(twice.sum())
        out.continuity_errors += int((gap | again).sum())
        return at[~twice], gap[~twice]

    def body(self, i: int) -> bytes:
        return self.rows[i, self.start[i] :].tobytes()


def _sections(packets: _Packets, pid: int, out: Stream):
    """Table id, number and body of the whole sections of a pid; a section may span packets, a packet hold several."""
    held: bytes | None = None
    for i, gap in zip(*packets.of(pid, out), strict=True):
        body = packets.body(i)
        if gap and held:
            out.crc_errors += 1
            held = None
        if packets.begins[i]:
            new = 1 + body[0] if body else 1
            if held:
                if (yield from _cut(held + body[1:new], out)):
                    out.crc_errors += 1
            held = body[new:] if new <= len(body) else None
        elif held is not None:
            held += body
        if held:
            held = yield from _cut(held, out)
    if held:
        out.crc_errors += 1


def _cut(data: bytes, out: Stream):
    """Yields the whole sections at the front; returns what is left."""
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + (struct.unpack(">H", data[1:3])[0] & 0x0FFF)
        if size > len(data):
            return data
        if size < 12 or crc32_mpeg(data[:size]):
            out.crc_errors += 1
        else:
            yield data[0], struct.unpack(">H", data[3:5])[0], data[8 : size - 4]
        data = data[size:]
    return b"" if not data or data[0] == 0xFF else data


def _streams(section: bytes) -> dict[int, int]:
    """pid -> stream type of a program map."""
    at, out = 4 + (struct.unpack(">H", section[2:4])[0] & 0x0FFF) if len(section) >= 4 else 0, {}
    while at and at + 5 <= len(section):
        kind, p, more = struct.unpack(">BHH", section[at : at + 5])
        out[p & 0x1FFF] = kind
        at += 5 + (more & 0x0FFF)
    return out


def _unit(pes: bytes) -> tuple[int | None, bytes] | None:
    """Time stamp and body of a PES packet; None if its header is damaged or it is shorter than it says."""
    if len(pes) < 9 or pes[:3] != b"\0\0\1" or 9 + pes[8] > len(pes):
        return None
    t = None
    if pes[7] & 0x80:
        if pes[8] < 5:
            return None
        p = pes[9:14]
        t = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
    size = struct.unpack(">H", pes[4:6])[0]
    if size and 6 + size > len(pes):
        return None
    return t, pes[9 + pes[8] : 6 + size if size else len(pes)]


def demux(data: bytes) -> Stream:
    """Parses a transport stream of whole packets; what is damaged is counted and left out, whatever the bytes are."""
    out = Stream()
    packets = _Packets(data, out)
    maps: dict[int, int] = {}
    for table, _, s in _sections(packets, 0, out):
        if table == 0:
            maps |= {p & 0x1FFF: n for n, p in struct.iter_unpack(">HH", s[: len(s) // 4 * 4]) if n}
    for pid in sorted(maps):
        for table, number, s in _sections(packets, pid, out):
            if table == 2:
                out.programs[number] = _streams(s)
    for es in sorted({p for x in out.programs.values() for p in x} - {0} - set(maps)):
        at, gap = packets.of(es, out)
        heads = np.flatnonzero(packets.begins[at])
        out.unit_errors += bool(len(at) and not (len(heads) and heads[0] == 0))  # packets before the first unit begins
        for a, b in zip(heads, [*heads, len(at)][1:], strict=True):
            part = at[a:b]
            whole = packets.start[part] == 4
            if len(part) > 2 and whole[1:-1].all():
                pes = packets.body(part[0]) + packets.rows[part[1:-1], 4:].tobytes() + packets.body(part[-1])
            else:
                pes = b"".join(map(packets.body, part))
            unit = None if gap[a + 1 : b].any() else _unit(pes)
            if unit is None:
                out.unit_errors += 1
            else:
                out.units.append((unit[0], bool(packets.flags[part[0]] & 0x40), unit[1]))
    return out


def feature(s: Stream) -> str:
    """Streams by program, errors, units, random-access points as time stamps' first, count and last, byte statistics."""
    times = [t for t, _, _ in s.units if t is not None]
    raps = [t for t, r, _ in s.units if r]
    body = np.frombuffer(s.payload, np.uint8)
    counts = np.bincount(body, minlength=256)
    p = counts[counts > 0] / max(1, len(body))
    programs = ";".join(f"{n}={','.join(f'{k}:{v}' for k, v in sorted(x.items()))}" for n, x in sorted(s.programs.items()))
    return (
        f"programs {programs} packets {s.packets} sync {s.sync_errors} field {s.field_errors} crc {s.crc_errors} continuity {s.continuity_errors} duplicates {s.duplicates} units {len(s.units)} damaged {s.unit_errors} "
        f"pts {min(times, default=-1)}-{max(times, default=-1)} rap {len(raps)} last_rap {max(raps, default=-1)} entropy {max(0.0, -float((p * np.log2(p)).sum())):.4f}"
    )


STORED = "doc_id long, n_bytes long, media binary"
_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, random_access array<long>"
_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("random_access", pa.list_(pa.int64()))])


def _store(batches):
    for batch in pieces(batches, "text"):
        raw = [t.encode() for t in batch.column("text").to_pylist()]
        yield batch_of(_STORED, {"doc_id": batch.column("doc_id"), "n_bytes": [len(x) for x in raw], "media": [mux(padded(x)) for x in raw]})


def _inspect(batches):
    for batch in pieces(batches, "media"):
        rows = []
        for media in batch.column("media").to_pylist():
            s = demux(media)
            got = s.payload
            rows.append((len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), [t for t, r, _ in s.units if r]))
        cols = dict(zip(_READ.names[2:], zip(*rows, strict=True), strict=True))
        yield batch_of(_READ, {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | cols)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the column ``media`` with the stored stream."""
    return texts(docs).mapInArrow(_store, STORED)


def inspect(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back from them alone."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_inspect, READ)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect(store(table(spark, sf_dir, "documents")))
