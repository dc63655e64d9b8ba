"""MPEG transport streams as a column: writing, reading, checking.

mux() stores bytes as a private stream in packetised elementary packets (one for
each access unit) with presentation times at 25 units a second; every
INTRA-th unit is marked as a random-access point. demux() reads a stream of
188-byte packets: it parses the program tables, whatever packets their sections span,
checks continuity counters, puts the elementary packets of one stream together again
and lists times and access points. streams() lists all elementary streams of all
programs, of which demux() takes the first unless told another. Of a table the first
whole section counts; tables of several sections are read by their first.

A packet with the counter of the one before is a resend if it has the same bytes, and
then left out; with others it is an error of the counters. A jump of the counter that
the packet announces (discontinuity indicator) is none. A unit in which packets are
missing is damaged: it is counted and left out of the payload, times and access
points, as are bytes before the first unit's start.

Defined results: null bytes give a null stream; empty bytes give a stream of one empty
unit; a stream that is no multiple of 188 bytes, lacks a sync byte or a program table,
or has a damaged table raises ValueError in demux(), and comes as an ``error`` in
probe(); an empty table gives no row; repeated rows and extra columns pass, but for
those that have a name of the result, which are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PACKET, UNIT, INTRA, TICK = 188, 16_384, 8, 3600
PMT_PID, MEDIA_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x100, 0x06, 0xBD


def crc_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2 of a section."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, key: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, key, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


@functools.cache
def _tables() -> bytes:
    pat = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    pmt = _section(2, 1, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, STREAM_TYPE, 0xE000 | MEDIA_PID, 0xF000))
    return _table_packet(0, pat) + _table_packet(PMT_PID, pmt)


def _time(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0xE, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])


def _adaptation(total: int, flags: int = 0, body: bytes = b"") -> bytes:
    """An adaptation field of so many bytes, its length byte included."""
    return b"\0" if total == 1 else (bytes([total - 1, flags]) + body).ljust(total, b"\xff")


def mux(payload: bytes) -> bytes:
    import numpy as np

    out, counter = [_tables()], 0
    for k, at in enumerate(range(0, max(1, len(payload)), UNIT)):
        unit, pts = payload[at : at + UNIT], (90_000 + k * TICK) & 0x1FFFFFFFF
        pes = struct.pack(">BBBBHBBB", 0, 0, 1, STREAM_ID, 8 + len(unit), 0x84, 0x80, 5) + _time(pts) + unit
        clock = struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        field_ = _adaptation(max(8, 184 - len(pes)), 0x10 | (0x40 if k % INTRA == 0 else 0), clock)
        first = 184 - len(field_)
        out.append(struct.pack(">BHB", 0x47, 0x4000 | MEDIA_PID, 0x30 | counter) + field_ + pes[:first])
        counter = (counter + 1) & 15
        full = (len(pes) - first) // 184
        if full:
            block = np.empty((full, PACKET), dtype=np.uint8)
            block[:, :3] = (0x47, MEDIA_PID >> 8, MEDIA_PID & 0xFF)
            block[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            block[:, 4:] = np.frombuffer(pes, np.uint8, full * 184, first).reshape(full, 184)
            out.append(block.tobytes())
            counter = (counter + full) & 15
        if rest := pes[first + 184 * full :]:
            out.append(struct.pack(">BHB", 0x47, MEDIA_PID, 0x30 | counter) + _adaptation(184 - len(rest)) + rest)
            counter = (counter + 1) & 15
    return b"".join(out)


@dataclass
class Stream:
    """What demux() finds; times in ticks of 1/90000 s, random_access: indexes of units, offsets: their first packets."""

    pid: int
    stream_type: int
    packets: int
    payload: bytes
    times: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    discontinuities: int = 0
    resent: int = 0
    damaged: int = 0


@functools.lru_cache(maxsize=256)
def _parsed(section: bytes, table: int) -> tuple:
    size = 3 + (struct.unpack(">H", section[1:3])[0] & 0xFFF)
    if section[0] != table or size > len(section) or crc_mpeg(section[:size]):
        raise ValueError("damaged program table")
    body = section[8 : size - 4]
    if table == 0:
        return tuple((n, pid & 0x1FFF) for n, pid in struct.iter_unpack(">HH", body) if n)
    at, found = 4 + (struct.unpack(">H", body[2:4])[0] & 0xFFF), []
    while at + 5 <= len(body):
        kind, pid, more = struct.unpack(">BHH", body[at : at + 5])
        found.append((kind, pid & 0x1FFF))
        at += 5 + (more & 0xFFF)
    return tuple(found)


class Packets:
    """The fields of all packets of a stream."""

    def __init__(self, data: bytes):
        import numpy as np

        if not data or len(data) % PACKET:
            raise ValueError("no whole packets")
        p = self.raw = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
        if (p[:, 0] != 0x47).any():
            raise ValueError("sync byte")
        self.pids = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
        self.starts, self.fields, self.loads = p[:, 1] & 0x40 != 0, p[:, 3] & 0x20 != 0, p[:, 3] & 0x10 != 0

    def load(self, at: int) -> bytes:
        raw = self.raw[at].tobytes()
        return raw[4 + (1 + raw[4] if self.fields[at] else 0) :]

    def table(self, pid: int, kind: int) -> tuple:
        """Entries of the first section on a pid, from as many packets as it spans."""
        import numpy as np

        own = np.flatnonzero((self.pids == pid) & self.loads)
        begin = own[self.starts[own]]
        if not len(begin):
            raise ValueError("no program table")
        raw = self.load(begin[0])
        section = raw[1 + raw[0] :] if raw else b""
        rest = iter(own[own > begin[0]].tolist())
        while len(section) < 3 or len(section) < 3 + (struct.unpack(">H", section[1:3])[0] & 0xFFF):
            at = next(rest, None)
            if at is None or self.starts[at] and self.load(at)[:1] == b"\0":
                raise ValueError("damaged program table")
            more = self.load(at)
            section += more[1 : 1 + more[0]] if self.starts[at] else more  # a pointer tells where the next section begins
        return _parsed(section[: 3 + (struct.unpack(">H", section[1:3])[0] & 0xFFF)], kind)


def streams(packets: Packets) -> list[tuple[int, int, int]]:
    """(program, stream type, pid) of every elementary stream."""
    return [(n, kind, pid) for n, at in packets.table(0, 0) for kind, pid in packets.table(at, 2)]


def demux(data: bytes, pid: int | None = None) -> Stream:
    """One elementary stream: that of a pid, or the first of the first program."""
    import numpy as np

    p = Packets(data)
    listed = [x for x in streams(p) if pid is None or x[2] == pid]
    if not listed:
        raise ValueError("no elementary stream")
    _, kind, pid = listed[0]
    own = np.flatnonzero((p.pids == pid) & p.loads)
    q, begin = p.raw[own], p.starts[own]
    step = np.diff(q[:, 3].astype(np.int32) & 15) & 15
    same = np.zeros(len(own), bool)
    if (step == 0).any():
        # A resend repeats all bytes but those of its clock, which may differ.
        plain = q.copy()
        clocked = (q[:, 3] & 0x20 != 0) & (q[:, 4] >= 7) & (q[:, 5] & 0x10 != 0)
        plain[clocked, 6:12] = 0
        same[1:] = (step == 0) & (plain[1:] == plain[:-1]).all(axis=1)
    said = (q[:, 3] & 0x20 != 0) & (q[:, 4] > 0) & (q[:, 5] & 0x80 != 0)
    gap = np.zeros(len(own), bool)
    gap[1:] = (step != 1) & ~same[1:] & ~said[1:]
    q, begin, own, gap = q[~same], begin[~same], own[~same], gap[~same]
    offset = np.where(q[:, 3] & 0x20 != 0, 5 + q[:, 4].astype(np.int32), 4)
    raw = q[np.arange(PACKET) >= offset[:, None]].tobytes()
    ends = np.cumsum(np.maximum(PACKET - offset, 0))
    out = Stream(pid, kind, len(p.raw), b"", discontinuities=int(gap.sum()), resent=int(same.sum()))
    units, first = [], np.flatnonzero(begin).tolist()
    lost = np.concatenate([[0], np.cumsum(gap)])
    for k, i in enumerate(first):
        j = first[k + 1] if k + 1 < len(first) else len(own)
        at, end = int(ends[i - 1]) if i else 0, int(ends[j - 1])
        if raw[at : at + 3] != b"\0\0\1" or end - at < 9:
            raise ValueError("elementary packet")
        size, head = struct.unpack(">H", raw[at + 4 : at + 6])[0], 9 + raw[at + 8]
        # Packets missing before the next unit's start may have been this one's: its size tells, if it has one.
        cut = lost[j] > lost[i + 1] or (at + 6 + size > end if size else j < len(own) and gap[j])
        if cut:
            out.damaged += 1
            continue
        if raw[at + 7] & 0x80:
            t = raw[at + 9 : at + 14]
            out.times.append((t[0] & 0xE) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1)
        if q[i, 3] & 0x20 and q[i, 4] and q[i, 5] & 0x40:
            out.random_access.append(len(units))
        out.offsets.append(int(own[i]) * PACKET)
        units.append(raw[at + head : at + 6 + size if size else end])
    out.payload = b"".join(units)
    return out


def with_streams(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """df with a column of transport streams of the bytes in payload, which goes."""
    common.ship(df.sparkSession)
    keep = [c for c in df.columns if c not in (payload, media)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data = pa.array([None if x is None else mux(x) for x in batch.column(payload).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), data], names=[*keep, media])

    schema = df.select(*keep, F.lit(None).cast("binary").alias(media)).schema
    return df.select(*keep, payload).mapInArrow(run, schema)


PROBE = "error string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, packets bigint, stream_type int, discontinuities bigint, damaged bigint, times array<bigint>, random_access array<bigint>, offsets array<bigint>"


def probe(df: DataFrame, media: str = "media", tail: int = 64) -> DataFrame:
    """df without its streams, and what demux() reads from them: see PROBE."""
    common.ship(df.sparkSession)
    names = [x.split()[0] for x in PROBE.split(", ")]
    keep = [c for c in df.columns if c != media and c not in names]

    def one(data: bytes | None) -> dict:
        if data is None:
            return {"error": "null"}
        try:
            s = demux(data)
        except ValueError as e:
            return {"error": str(e), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        return {"payload_bytes": len(s.payload), "payload_sha256": hashlib.sha256(s.payload).hexdigest(), "tail_crc32": zlib.crc32(s.payload[-tail:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "packets": s.packets, "stream_type": s.stream_type, "discontinuities": s.discontinuities, "damaged": s.damaged, "times": s.times, "random_access": s.random_access, "offsets": s.offsets}

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}
        types = {x.split()[0]: kinds[x.split()[1]] for x in PROBE.split(", ")}
        for batch in batches:
            rows = [one(x) for x in batch.column(media).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array([r.get(n) for r in rows], types[n]) for n in names)], names=[*keep, *names])

    extra = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in PROBE.split(", ")]
    return df.select(*keep, media).mapInArrow(run, df.select(*keep, *extra).schema)
