"""Media columns as MPEG transport streams.

``muxed`` packs bytes into a stream of 188-byte packets: a program association
table, a program map table, then packetised elementary stream packets of private
data, each one access unit with a presentation timestamp, a program clock
reference and a random-access mark.  ``parsed`` reads such a stream: it checks
the tables' checksums and every continuity counter, reassembles the elementary
packets and keeps the timestamps with their random-access points.  Damage is
counted, never raised, so that one bad stream does not end a job.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbuf
from .store import input_table

PACKET, PAD = 188, 64
#: Bytes of an access unit, and its length in 90 kHz ticks.
UNIT, TICKS = 8192, 3600
PMT_PID, ES_PID, NULL_PID, PRIVATE_PES, PRIVATE_DESCRIPTOR = 0x1000, 0x0100, 0x1FFF, 0x06, 0xF0
_PRIVATE_STREAM_1 = 0xBD


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """The tables' checksum: not reflected, not inverted."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % PAD or (0 if data else PAD))


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section + b"\xff" * (PACKET - 5 - len(section))


def _timestamp(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 1 | t >> 14 & 0xFE, t >> 7 & 0xFF, 1 | t << 1 & 0xFE])


def muxed(payload: bytes, unpadded: int) -> bytes:
    """The transport stream of a payload; the map table also carries the unpadded length."""
    descriptor = bytes([PRIVATE_DESCRIPTOR, 8]) + unpadded.to_bytes(8, "big")
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    program = (0xE000 | ES_PID).to_bytes(2, "big") + (0xF000 | len(descriptor)).to_bytes(2, "big") + descriptor
    pmt = _section(2, 1, program + bytes([PRIVATE_PES]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
    out = [_table_packet(0, pat), _table_packet(PMT_PID, pmt)]
    begin, more = bytes([0x47, 0x40 | ES_PID >> 8, ES_PID & 0xFF]), bytes([0x47, ES_PID >> 8, ES_PID & 0xFF])
    counter = 0
    for n, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        ticks = (n + 1) * TICKS
        pes = b"\x00\x00\x01" + bytes([_PRIVATE_STREAM_1]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(ticks) + unit
        # Random access and clock reference in the first packet's adaptation field.
        clock = ticks - TICKS
        field_ = bytes([0x50]) + (clock << 15 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 5 - len(field_)
        stuff = max(0, room - len(pes))
        out.append(begin + bytes([0x30 | counter, len(field_) + stuff]) + field_ + b"\xff" * stuff + pes[: room - stuff])
        counter = counter + 1 & 15
        p = room - stuff
        full = (len(pes) - p) // 184
        for _ in range(full):
            out.append(more + bytes([0x10 | counter]) + pes[p : p + 184])
            p += 184
            counter = counter + 1 & 15
        if rest := len(pes) - p:
            stuff = 184 - rest
            field_ = b"\x00" if stuff == 1 else bytes([stuff - 1, 0]) + b"\xff" * (stuff - 2)
            out.append(more + bytes([0x30 | counter]) + field_ + pes[p:])
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass(frozen=True)
class Unit:
    """An access unit: its presentation time (-1: none), the offset of its data in the payload, whether decoding may begin there, and whether nothing of it is lost."""

    pts: int
    offset: int
    random_access: bool
    whole: bool


@dataclass
class Stream:
    """What a transport stream holds, and what was found wrong with it."""

    payload: bytes = b""
    unpadded: int = -1
    stream_type: int = -1
    units: list[Unit] = field(default_factory=list)
    packets: int = 0
    counter_errors: int = 0
    sync_errors: int = 0
    table_errors: int = 0
    duplicates: int = 0

    def at(self, ticks: int) -> int:
        """The offset of the last random-access point at or before a time; 0 without one."""
        return max((u.offset for u in self.units if u.random_access and u.pts <= ticks), default=0)

    def feature(self) -> str:
        first, last = (self.units[0].pts, self.units[-1].pts) if self.units else (0, 0)
        return (
            f"type={self.stream_type};packets={self.packets};units={len(self.units)};random_access={sum(u.random_access for u in self.units)};pts={first}-{last};"
            f"counter_errors={self.counter_errors};sync_errors={self.sync_errors};table_errors={self.table_errors};duplicates={self.duplicates};broken={sum(not u.whole for u in self.units)}"
        )


class _Sections:
    """Joins a PID's packets into table sections."""

    def __init__(self) -> None:
        self.open: bytes | None = None

    def take(self, data: bytes, begins: bool) -> Iterator[bytes]:
        """The sections that are whole with this packet's payload, without checks."""
        if begins:
            if self.open is not None:
                yield from self._whole(self.open + data[1 : 1 + data[0]])
            yield from self._whole(data[1 + data[0] :])
        elif self.open is not None:
            yield from self._whole(self.open + data)

    def _whole(self, data: bytes) -> Iterator[bytes]:
        while len(data) >= 3 and data[0] != 0xFF:
            size = 3 + ((data[1] & 0x0F) << 8 | data[2])
            if len(data) < size:
                break
            yield data[:size]
            data = data[size:]
        self.open = data if data and data[0] != 0xFF else None


def _elementary(parts: list[bytes], whole: bool, random_access: bool, offset: int) -> tuple[Unit, bytes]:
    """One elementary packet from its transport packets' payloads: what it says of itself, and its data."""
    pes = b"".join(parts)
    if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
        return Unit(-1, offset, random_access, False), b""
    size = pes[4] << 8 | pes[5]
    if size:
        whole &= len(pes) == 6 + size
        pes = pes[: 6 + size]
    ticks, b = -1, pes[9:14]
    if pes[7] & 0x80 and len(b) == 5:
        ticks = (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1
    return Unit(ticks, offset, random_access, whole), pes[9 + pes[8] :]


def _mapped(section: bytes) -> tuple[int, list[tuple[int, int]]]:
    """A program map's unpadded length (-1: not said), and its streams' PIDs and types."""
    end, p, unpadded, streams = min(12 + ((section[10] & 0x0F) << 8 | section[11]), len(section) - 4), 12, -1, []
    while p + 1 < end:
        if section[p] == PRIVATE_DESCRIPTOR:
            unpadded = int.from_bytes(section[p + 2 : p + 2 + section[p + 1]], "big")
        p += 2 + section[p + 1]
    p = end
    while p + 4 < len(section) - 4:
        streams.append(((section[p + 1] & 0x1F) << 8 | section[p + 2], section[p]))
        p += 5 + ((section[p + 3] & 0x0F) << 8 | section[p + 4])
    return unpadded, streams


def parsed(media: bytes) -> Stream:
    """Read a transport stream.

    Null packets are skipped.  A packet that repeats the one before of its PID is
    dropped once, as the format allows.  A counter that jumps is an error unless
    the packet marks a discontinuity; the unit it falls into counts as broken and
    keeps what came before the gap.  Packets out of step, a last packet that is
    cut off, and tables with a wrong checksum are counted and skipped.  The first
    stream of the program maps is reassembled.
    """
    out = Stream(packets=len(media) // PACKET, sync_errors=int(len(media) % PACKET > 0))
    maps: set[int] = set()
    tables: dict[int, _Sections] = {0: _Sections()}
    last: dict[int, tuple[int, bytes, bool]] = {}  # per PID: the counter, the payload, and whether it has been repeated
    wanted, parts, payloads, offset = -1, None, [], 0
    random_access, whole = False, True

    def close() -> None:
        nonlocal offset
        if parts is not None:
            unit, data = _elementary(parts, whole, random_access, offset)
            out.units.append(unit)
            payloads.append(data)
            offset += len(data)

    for at in range(0, out.packets * PACKET, PACKET):
        flags = media[at + 1]
        pid, control, start = (flags & 0x1F) << 8 | media[at + 2], media[at + 3], at + 4
        if media[at] != 0x47 or flags & 0x80:
            out.sync_errors += 1
            continue
        if pid == NULL_PID:
            continue
        marks = 0
        if control & 0x20:
            marks = media[start + 1] if media[start] else 0
            start += 1 + media[start]
        if not control & 0x10 or start >= at + PACKET:
            continue
        data, counter = media[start : at + PACKET], control & 15
        was = last.get(pid)
        if was is not None and not marks & 0x80:
            if counter == was[0] and data == was[1] and not was[2]:
                last[pid] = (counter, data, True)
                out.duplicates += 1
                continue
            if counter != was[0] + 1 & 15:
                out.counter_errors += 1
                if pid == wanted:
                    whole = False
                    if not flags & 0x40:
                        close()
                        parts = None
                elif pid in tables:
                    tables[pid].open = None
        last[pid] = (counter, data, False)
        if pid in tables:
            for section in tables[pid].take(data, bool(flags & 0x40)):
                if len(section) < 12 or crc32_mpeg(section):
                    out.table_errors += 1
                elif pid == 0:
                    new = {(section[p + 2] & 0x1F) << 8 | section[p + 3] for p in range(8, len(section) - 4, 4) if section[p] << 8 | section[p + 1]} - maps
                    maps |= new
                    tables |= {k: _Sections() for k in new}
                elif wanted < 0:
                    out.unpadded, streams = _mapped(section)
                    if streams:
                        wanted, out.stream_type = streams[0]
        elif pid == wanted:
            if flags & 0x40:
                close()
                random_access, whole, parts = bool(marks & 0x40), True, []
            if parts is not None:
                parts.append(data)
    close()
    out.payload = b"".join(payloads)
    return out


def with_media(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``media``: the text's UTF-8 as a transport stream (a column of that name is replaced).

    Null texts are stored as empty ones: one block of 64 zero bytes.  Repeated
    rows stay; an empty table gives an empty result.
    """
    others = [c for c in docs.columns if c.lower() != "media"]
    schema = docs.select(*(docs[c] for c in others)).schema.add("media", "binary")
    place = others.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textbuf.texts_of(batch.column(place))
            for i, j in textbuf.blocks(texts):
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns), pa.array([muxed(padded(t), len(t)) for t in texts[i:j]], pa.binary())], schema.names)

    return docs.select(*(docs[c] for c in others)).mapInArrow(run, schema)


def media_features(media: DataFrame) -> DataFrame:
    """Read every row's stream back: sizes, checksums, features and access units by doc_id.

    ``units`` has each access unit's presentation time, offset, whether it is a
    random-access point, and whether it came through whole.  A null stream gives
    nulls beside its doc_id; a damaged one what is left of it, with its errors in
    ``feature``.  Repeated rows stay; other columns are ignored.
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "units"]
    unit = pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("random_access", pa.bool_()), ("whole", pa.bool_())])
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(unit)]

    def run(batches):
        for batch in batches:
            rows = []
            for m in batch.column(1):
                m = m.as_py()
                if m is None:
                    rows.append((None,) * 8)
                    continue
                s = parsed(m)
                rows.append((s.unpadded, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), s.feature(), [vars(u) for u in s.units]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True))], names)

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units array<struct<pts:long,offset:long,random_access:boolean,whole:boolean>>")


def op8_mpegts(spark, sf_dir: str) -> DataFrame:
    """The query: every document stored as a stream and read back."""
    return media_features(with_media(input_table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("units")
