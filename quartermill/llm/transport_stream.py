"""Media columns as MPEG transport streams.

``store`` writes 8-bit samples (8 kHz) as a transport stream of one program: a
program association table, a program map table, and packetised elementary
stream packets of ``UNITS`` access units of 576 samples, each with a
presentation time stamp, its first packet with a clock reference, every
``EVERY``-th of them marked as a random-access point. ``load`` reads any such
stream: it parses the program tables (checking their CRC), follows each
elementary stream, checks continuity counters (dropping repeated packets,
counting gaps), reassembles the elementary packets and gives their samples,
time stamps and random-access points.

Packets are handled as numpy matrices of 188 columns; Python only walks over
elementary packets (one in 18 KB). Each row is handled by itself, so the pass
is narrow, and memory is bounded by the longest document.

Edge cases. Null and empty texts store 576 bytes of 255. Streams with damaged
packets load with ``errors`` counted, and an elementary packet that lacks
bytes is left out. A null doc_id is kept; repeated rows give equal rows; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import per_document, raw, table

UNIT, UNITS, EVERY = 576, 32, 8
PACKET, BODY = 188, 184
PAT_PID, PMT_PID, STREAM_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
#: Private data, as neither standard audio nor video coding is used.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: 90 kHz ticks of an access unit at 8000 samples a second.
TICKS = UNIT * 90_000 // 8_000


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        c = k << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


# --- writing --------------------------------------------------------------


def section(table_id: int, key: int, body: bytes) -> bytes:
    """A program-specific table section with its CRC."""
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + key.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def table_packet(pid: int, data: bytes, counter: int = 0) -> bytes:
    head = bytes([0x47]) + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | counter & 15, 0])
    return (head + data).ljust(PACKET, b"\xff")


def tables() -> bytes:
    pat = section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
    return table_packet(PAT_PID, pat) + table_packet(PMT_PID, pmt)


def _stamp(ticks: np.ndarray) -> np.ndarray:
    """The five bytes of a presentation time stamp, for each."""
    t = ticks.astype(np.int64) & (2**33 - 1)
    return np.stack([0x21 | t >> 29 & 14, t >> 22 & 255, 1 | t >> 14 & 254, t >> 7 & 255, 1 | t << 1 & 254], 1).astype(np.uint8)


def _clock(ticks: np.ndarray) -> np.ndarray:
    """The six bytes of a clock reference (extension zero), for each."""
    t = ticks.astype(np.int64) & (2**33 - 1)
    return np.stack([t >> 25 & 255, t >> 17 & 255, t >> 9 & 255, t >> 1 & 255, (t & 1) << 7 | 0x7E, t & 0], 1).astype(np.uint8)


def _elementary(samples: np.ndarray, ticks: np.ndarray, random_access: np.ndarray, counter: int) -> np.ndarray:
    """Transport packets (n, packets, 188) of n elementary packets of equal size (samples: n rows)."""
    n, m = samples.shape
    data = np.empty((n, m + 14), np.uint8)
    data[:, :9] = np.frombuffer(bytes([0, 0, 1, STREAM_ID]) + (m + 8).to_bytes(2, "big") + bytes([0x84, 0x80, 5]), np.uint8)
    data[:, 9:14] = _stamp(ticks)
    data[:, 14:] = samples
    # the first packet: 8 bytes of adaptation field with the clock
    count = 1 + max(0, -(-(m + 14 - (BODY - 8)) // BODY))
    out = np.full((n, count, PACKET), 255, np.uint8)
    pid = np.full(count, STREAM_PID, np.int64)
    pid[0] |= 0x4000
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = 0x47, pid >> 8, pid & 255
    out[:, :, 3] = 0x10 | (counter + np.arange(n * count).reshape(n, count)) & 15
    first = min(BODY - 8, m + 14)
    out[:, 0, 3] |= 0x20
    out[:, 0, 4] = BODY - 1 - first
    out[:, 0, 5] = 0x10 | random_access.astype(np.uint8) << 6
    out[:, 0, 6:12] = _clock(ticks)
    out[:, 0, PACKET - first :] = data[:, :first]
    if count > 2:
        out[:, 1:-1, 4:] = data[:, first : first + BODY * (count - 2)].reshape(n, count - 2, BODY)
    if count > 1:
        last = m + 14 - first - BODY * (count - 2)
        pad = BODY - last
        if pad:
            out[:, -1, 3] |= 0x20
            out[:, -1, 4] = pad - 1
            if pad > 1:
                out[:, -1, 5] = 0
        out[:, -1, PACKET - last :] = data[:, -last:]
    return out


def store(payload: bytes) -> bytes:
    """The transport stream of a payload of whole access units."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    samples, size = np.frombuffer(payload, np.uint8), UNIT * UNITS
    n = len(samples) // size
    parts, counter = [tables()], 0
    for rows, begin in ((samples[: n * size].reshape(n, size), 0), (samples[n * size :].reshape(1, -1), n)):
        if rows.size:
            k = begin + np.arange(len(rows))
            made = _elementary(rows, k * UNITS * TICKS, k % EVERY == 0, counter)
            counter += made.shape[0] * made.shape[1]
            parts.append(made.tobytes())
    return b"".join(parts)


# --- reading --------------------------------------------------------------


@dataclass
class Elementary:
    """An elementary stream: its packets' samples, time stamps and random-access points."""

    pid: int
    kind: int
    parts: list[bytes] = field(default_factory=list)
    stamps: list[int | None] = field(default_factory=list)
    #: (time stamp, index of the transport packet) of each random-access point.
    points: list[tuple[int | None, int]] = field(default_factory=list)
    gaps: int = 0
    repeats: int = 0
    broken: int = 0

    @property
    def samples(self) -> bytes:
        return b"".join(self.parts)


@dataclass
class Media:
    """What a stream holds. errors: lost sync bytes, failed table CRCs, gaps and broken elementary packets."""

    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, Elementary] = field(default_factory=dict)
    damaged: int = 0

    @property
    def errors(self) -> int:
        return self.damaged + sum(s.gaps + s.broken for s in self.streams.values())


def _sections(payloads: list[tuple[bool, bytes]]) -> list[bytes]:
    """Whole sections from the payloads of a table's packets."""
    out, held = [], b""
    for starts, data in payloads:
        if starts and data:
            held, data = b"", data[1 + data[0] :]
        held += data
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)
            if len(held) < size:
                break
            out.append(held[:size])
            held = held[size:]
    return out


def load(stream: bytes) -> Media:
    """Reads a transport stream."""
    media = Media()
    n = len(stream) // PACKET
    media.damaged += len(stream) % PACKET > 0
    rows = np.frombuffer(stream, np.uint8, n * PACKET).reshape(n, PACKET)
    good = (rows[:, 0] == 0x47) & (rows[:, 1] < 0x80)  # sync byte, no transport error
    media.damaged += int(n - good.sum())
    where = np.flatnonzero(good)
    rows = rows[where]
    pid = (rows[:, 1].astype(np.int64) & 31) << 8 | rows[:, 2]
    has_field, has_body = rows[:, 3] & 0x20 > 0, rows[:, 3] & 0x10 > 0
    begin = 4 + np.where(has_field, 1 + rows[:, 4].astype(np.int64), 0)
    begin = np.where(has_body, np.minimum(begin, PACKET), PACKET)
    starts = rows[:, 1] & 0x40 > 0

    def checked(want: int, table_id: int) -> list[bytes]:
        at = np.flatnonzero(pid == want)
        out = []
        for x in _sections([(bool(starts[k]), rows[k, begin[k] :].tobytes()) for k in at]):
            if x[0] == table_id:
                if crc32_mpeg(x):
                    media.damaged += 1
                else:
                    out.append(x)
        return out

    for x in checked(PAT_PID, 0):
        for k in range(8, len(x) - 4, 4):
            if program := int.from_bytes(x[k : k + 2], "big"):
                media.programs[program] = int.from_bytes(x[k + 2 : k + 4], "big") & 0x1FFF
    for map_pid in set(media.programs.values()):
        for x in checked(map_pid, 2):
            k = 12 + (int.from_bytes(x[10:12], "big") & 0xFFF)
            while k < len(x) - 4:
                own = int.from_bytes(x[k + 1 : k + 3], "big") & 0x1FFF
                media.streams[own] = Elementary(own, x[k])
                k += 5 + (int.from_bytes(x[k + 3 : k + 5], "big") & 0xFFF)
    for own, found in media.streams.items():
        at = np.flatnonzero(pid == own)
        if len(at):
            _read_stream(found, rows[at], begin[at], starts[at], has_field[at], has_body[at], where[at])
    return media


def _read_stream(out: Elementary, rows: np.ndarray, begin: np.ndarray, starts: np.ndarray, has_field: np.ndarray, has_body: np.ndarray, where: np.ndarray) -> None:
    counter = (rows[:, 3] & 15).astype(np.int64)
    flags = np.where(has_field & (rows[:, 4] > 0), rows[:, 5], 0)
    again = np.zeros(len(rows), bool)
    again[1:] = (counter[1:] == counter[:-1]) & has_body[1:] & (rows[1:] == rows[:-1]).all(1)
    out.repeats = int(again.sum())
    keep = ~again
    rows, begin, starts, has_body, where, counter, flags = (x[keep] for x in (rows, begin, starts, has_body, where, counter, flags))
    step = (counter[1:] - counter[:-1]) & 15
    gap = np.zeros(len(rows), bool)
    gap[1:] = (step != has_body[1:]) & (flags[1:] & 0x80 == 0)
    out.gaps = int(gap.sum())
    sizes = PACKET - begin
    body = rows[np.arange(PACKET)[None, :] >= begin[:, None]]
    ends = np.cumsum(sizes)
    firsts = np.flatnonzero(starts).tolist()
    gaps = np.cumsum(gap)
    for a, z in zip(firsts, [*firsts[1:], len(rows)], strict=True):
        data = body[ends[a] - sizes[a] : ends[z - 1]].tobytes()
        size = 6 + int.from_bytes(data[4:6], "big") if data[:3] == b"\0\0\1" and len(data) >= 9 else 0
        if size == 6:  # length not stated: all up to the next start
            size = len(data)
        if size < 9 or len(data) < size or gaps[z - 1] > gaps[a]:
            out.broken += 1
            continue
        stamp = None
        if data[7] & 0x80:
            p = data[9:14]
            stamp = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
        out.parts.append(data[9 + data[8] : size])
        out.stamps.append(stamp)
        if flags[a] & 0x40:
            out.points.append((stamp, int(where[a])))


# --- columns --------------------------------------------------------------


def payload_of(text: bytes) -> bytes:
    """A text's bytes, filled with 255 to a positive multiple of 576."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b"\xff")


def store_media(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the stream) and points (pts and packet of its random-access points)."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw(b.column(1))
        media = [store(payload_of(t)) for t in texts]
        points = [[{"pts": p, "packet": k} for s in load(m).streams.values() for p, k in s.points] for m in media]
        kind = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64())]))
        return pa.record_batch([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary()), pa.array(points, kind)], ["doc_id", "n_bytes", "media", "points"])

    return per_document(docs, ["doc_id", column], "doc_id bigint, n_bytes bigint, media binary, points array<struct<pts: bigint, packet: bigint>>", work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as a stream, reads it back, and digests both."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "n_random_access", "errors"]

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in raw(b.column(1)):
            media = store(payload_of(text))
            back = load(media)
            stream = next(iter(back.streams.values()))
            got = stream.samples
            x = np.frombuffer(got, np.uint8)
            feature = f"pid={stream.pid};type={stream.kind};pes={len(stream.parts)};pts={stream.stamps[0]}-{stream.stamps[-1]};rap={len(stream.points)};sum={int(x.sum(dtype=np.int64))};min={x.min()};max={x.max()};turns={int(np.count_nonzero(np.diff((x > 127).view(np.int8))))}"
            rows.append((len(text), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(media) // PACKET, len(stream.points), back.errors))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.record_batch([b.column(0), *columns], names)

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_packets bigint, n_random_access bigint, errors bigint"
    return per_document(table(spark, sf_dir, "documents"), ["doc_id", "text"], schema, work)
