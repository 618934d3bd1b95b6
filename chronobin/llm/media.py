"""Media columns: MPEG transport streams in binary columns.

`mux` stores a payload as one private elementary stream: 188-byte packets with a program
association table, a program map table, and PES packets of PES_UNITS payload units each. Every
PES packet has a 90 kHz presentation timestamp; every RAP_EVERY-th starts with the
random-access indicator and a program clock reference.

`demux` parses transport streams of others too: it follows the tables, of one packet or more,
to every program's elementary streams (network entries are no programs), checks continuity
counters packet by packet (a repeated packet counts once, a signalled discontinuity is none),
reassembles PES packets with or without lengths and timestamps, and returns each stream with
its timestamps, packet offsets and random-access points. What it can't read raises ValueError,
never an empty payload: partial packets, no sync byte, broken or missing tables, a program
without streams, scrambled payloads, PES packets without start code or, where no packet was
lost, of another length than they say.

Defined results: a null payload is stored as an empty one; an empty payload has its tables and
no PES packet; equal payloads give equal bytes; null media parse to nulls; very long payloads
are one value, of a size that a binary value can have; rows that repeat stay; an empty table
gives no rows; columns named like those that `parse` adds are replaced. Lost packets show as
continuity errors.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread, tidy

#: Fixed values of ISO/IEC 13818-1, and this stream's identifiers.
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 188, 0x47, 0, 0x1000, 0x100, 1, 0x06, 0xBD
#: Payload units, the bytes of a unit, units a PES packet, timestamp ticks a PES packet, PES packets between random-access points.
UNIT, PES_UNITS, TICKS, RAP_EVERY = 192, 16, 3600, 8


def _crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    """A PSI section with its pointer field, stuffed to one packet's payload."""
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return (b"\x00" + head + _crc32_mpeg(head).to_bytes(4, "big")).ljust(PACKET - 4, b"\xff")


_PAT = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
_TABLES = b"".join(bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10]) + section for pid, section in ((PAT_PID, _PAT), (PMT_PID, _PMT)))


def _pts(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 255, 0x01 | (t >> 14) & 0xFE, (t >> 7) & 255, 0x01 | (t << 1) & 0xFE])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter = [_TABLES], 0
    first, later = bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 255]), bytes([SYNC, ES_PID >> 8, ES_PID & 255])
    span = UNIT * PES_UNITS
    for k, at in enumerate(range(0, len(payload), span)):
        body = payload[at : at + span]
        t = k * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(t) + body
        field_ = b""
        if k % RAP_EVERY == 0:
            field_ = b"\x50" + (t << 15 | 0x7E00).to_bytes(6, "big")  # random access, PCR
        pos, size, head = 0, len(pes), first
        while pos < size:
            room = PACKET - 4 - (len(field_) + 1 if field_ else 0)
            take = min(room, size - pos)
            stuff = room - take
            if field_ or stuff:
                if not field_ and stuff == 1:
                    adapt = b"\x00"
                else:
                    inner = field_ or b"\x00"
                    pad = stuff if field_ else stuff - 2
                    adapt = bytes([len(inner) + pad]) + inner + b"\xff" * pad
                out.append(head + bytes([0x30 | counter]) + adapt + pes[pos : pos + take])
            else:
                out.append(head + bytes([0x10 | counter]) + pes[pos : pos + take])
            counter = counter + 1 & 15
            pos += take
            field_, head = b"", later
    return b"".join(out)


@dataclass
class Elementary:
    """One stream of a program. pts (None where a PES packet has none) and offsets (of its first packet) are a PES packet's; random_access holds PES numbers."""

    program: int
    pid: int
    stream_type: int
    continuity_errors: int = 0
    pts: list[int | None] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    pcr: list[int] = field(default_factory=list)
    payload: bytes = b""


@dataclass
class Stream:
    """What demux found: all elementary streams by packet id, the first of the first program's first."""

    packets: int
    streams: dict[int, Elementary]

    @property
    def first(self) -> Elementary:
        return next(iter(self.streams.values()))

    def __getattr__(self, name):
        return getattr(self.first, name)


_KNOWN: dict[bytes, bool] = {}


def _checked(section: bytes) -> None:
    """Sections repeat from stream to stream; each is checked once a worker."""
    if section not in _KNOWN:
        if len(_KNOWN) > 1000:
            _KNOWN.clear()
        _KNOWN[section] = _crc32_mpeg(section) == 0
    if not _KNOWN[section]:
        raise ValueError("broken program table")


class _Sections:
    """Reassembles the sections of one packet id."""

    def __init__(self):
        self.held, self.open = b"", False

    def add(self, payload: bytes, start: bool):
        """Whole sections that this packet ends."""
        if start:
            if not payload or payload[0] >= len(payload):
                raise ValueError("broken program table")
            if self.open:
                self.held += payload[1 : 1 + payload[0]]
                yield from self._whole()
            self.held, self.open = payload[1 + payload[0] :], True
        elif self.open:
            self.held += payload
        yield from self._whole()

    def _whole(self):
        while self.open and len(self.held) >= 3 and self.held[0] != 0xFF:
            size = 3 + (int.from_bytes(self.held[1:3], "big") & 0xFFF)
            if len(self.held) < size:
                return
            section, self.held = self.held[:size], self.held[size:]
            _checked(section)
            yield section
        if self.held[:1] == b"\xff":
            self.held, self.open = b"", False


class _Pes:
    """Reassembles the PES packets of one elementary stream."""

    #: Fixed values of the standard: stream ids without the optional header.
    BARE = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))

    def __init__(self, out: Elementary):
        self.out, self.parts, self.open, self.bodies, self.faults = out, [], False, [], 0

    def start(self, at: int) -> None:
        self.flush()
        self.open = True
        self.out.offsets.append(at)

    def flush(self) -> None:
        if not self.open:
            return
        data, out = b"".join(self.parts), self.out
        self.parts, self.open = [], False
        if data[:3] != b"\x00\x00\x01" or len(data) < 6:
            raise ValueError("no PES start code")
        size, at, pts = int.from_bytes(data[4:6], "big"), 6, None
        if data[3] not in self.BARE:
            if len(data) < 9 or data[6] & 0xC0 != 0x80:
                raise ValueError("broken PES header")
            at = 9 + data[8]
            if data[7] & 0x80:
                h = data[9:14]
                pts = (h[0] >> 1 & 7) << 30 | h[1] << 22 | h[2] >> 1 << 15 | h[3] << 7 | h[4] >> 1
        end = 6 + size if size else len(data)
        if end > len(data) or at > end:
            self.faults += 1
        out.pts.append(pts)
        if data[3] != 0xBE:  # padding
            self.bodies.append(data[at:end])


def demux(media: bytes) -> Stream:
    """Parse a transport stream: all elementary streams of all its programs."""
    if not media or len(media) % PACKET:
        raise ValueError("not whole packets")
    tables: dict[int, _Sections] = {PAT_PID: _Sections()}
    programs: dict[int, int] = {}  # program map's packet id: program
    found: dict[int, _Pes] = {}
    last: dict[int, tuple[int, bytes, bool]] = {}
    for at in range(0, len(media), PACKET):
        if media[at] != SYNC:
            raise ValueError("no sync byte")
        b1, control = media[at + 1], media[at + 3]
        pid = (b1 & 0x1F) << 8 | media[at + 2]
        pes = found.get(pid)
        if pes is None and pid not in tables:
            continue  # null packets, and streams of no program
        begin, fresh = at + 4, False
        if control & 0x20:
            length = media[begin]
            if length > PACKET - 5:
                raise ValueError("broken adaptation field")
            if length:
                flags = media[begin + 1]
                fresh = bool(flags & 0x80)
                if pes and flags & 0x40:
                    pes.out.random_access.append(len(pes.out.offsets) - (0 if b1 & 0x40 else 1))
                if pes and flags & 0x10:
                    pes.out.pcr.append(int.from_bytes(media[begin + 2 : begin + 8], "big") >> 15)
            begin += 1 + length
        if not control & 0x10:
            continue
        if b1 & 0x80:  # the receiver marked it as damaged
            if pes:
                pes.out.continuity_errors += 1
            continue
        if control & 0xC0:
            raise ValueError("scrambled payload")
        counter, payload = control & 15, media[begin : at + PACKET]
        if (before := last.get(pid)) and not fresh:
            if counter == before[0] and payload == before[1] and not before[2]:
                last[pid] = (counter, payload, True)
                if pes and control & 0x20 and media[at + 4] and media[at + 5] & 0x40:
                    pes.out.random_access.pop()
                if pes and control & 0x20 and media[at + 4] and media[at + 5] & 0x10:
                    pes.out.pcr.pop()
                continue  # a packet may be sent twice
            if counter != before[0] + 1 & 15 and pes:
                pes.out.continuity_errors += 1
        last[pid] = (counter, payload, False)
        start = bool(b1 & 0x40)
        if pes:
            if start:
                pes.start(at)
            if pes.open:
                pes.parts.append(payload)
            continue
        for section in tables[pid].add(payload, start):
            if pid == PAT_PID and section[0] == 0x00:
                for k in range(8, len(section) - 4, 4):
                    number, where = int.from_bytes(section[k : k + 2], "big"), int.from_bytes(section[k + 2 : k + 4], "big") & 0x1FFF
                    if number:  # 0 is the network's table
                        programs[where] = number
                        tables.setdefault(where, _Sections())
            elif section[0] == 0x02 and pid in programs:
                k = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
                while k + 5 <= len(section) - 4:
                    where = int.from_bytes(section[k + 1 : k + 3], "big") & 0x1FFF
                    if where not in found:
                        found[where] = _Pes(Elementary(int.from_bytes(section[3:5], "big"), where, section[k]))
                    k += 5 + (int.from_bytes(section[k + 3 : k + 5], "big") & 0xFFF)
    if not found:
        raise ValueError("no program with an elementary stream")
    for pes in found.values():
        pes.flush()
        if pes.faults and not pes.out.continuity_errors:
            raise ValueError("PES lengths don't match")
        pes.out.payload = b"".join(pes.bodies)
    order = list(dict.fromkeys(programs.values()))
    ranked = sorted(found.values(), key=lambda p: order.index(p.out.program) if p.out.program in order else len(order))
    return Stream(len(media) // PACKET, {p.out.pid: p.out for p in ranked})


def feature(s: Stream) -> str:
    """What the first stream of the first program is."""
    e = s.first
    pts = [t for t in e.pts if t is not None]
    span = f"{pts[0]}-{pts[-1]}" if pts else "none"
    return f"program={e.program};type={e.stream_type};packets={s.packets};pes={len(e.pts)};rap={len(e.random_access)};pts={span};cc_errors={e.continuity_errors}"


def store(docs: DataFrame, payload_col: str, media_col: str = "media") -> DataFrame:
    """docs with a binary column of the payloads' transport streams."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounded memory beside long texts
                part = batch.slice(at, 256)
                media = [mux(x or b"") for x in part.column(payload_col).to_pylist()]
                keep = [i for i, n in enumerate(part.schema.names) if n != payload_col]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], pa.array(media, pa.binary())], names=[*[part.schema.names[i] for i in keep], media_col])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != payload_col)
    return spread(docs).mapInArrow(tidy(run), f"{fields}, `{media_col}` binary")


PARSED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<int>, packet_offsets array<long>"
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]


def parse(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """Read stored streams back: the other columns, digests of payload and media, timestamps and random-access points with their packets' offsets."""
    added = [x.split()[0] for x in PARSED.split(", ")]
    kept = [c for c in stored.columns if c != media_col and c not in added]

    def facts(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * len(added)
        s = demux(raw)
        e = s.first
        return (len(e.payload), hashlib.sha256(e.payload).hexdigest(), zlib.crc32(e.payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(s), e.pts, e.random_access, e.offsets)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [facts(media.as_py()) for media in part.column(media_col)]
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *made], names=[*kept, *added])

    kinds = dict(stored.dtypes)
    return stored.select(*kept, media_col).mapInArrow(tidy(run), "".join(f"`{c}` {kinds[c]}, " for c in kept) + PARSED)


def padded(text: F.Column) -> F.Column:
    """UTF-8 bytes of a text, null as empty, with blanks appended up to a positive multiple of UNIT."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    short = F.when(F.octet_length(raw) == 0, F.lit(UNIT)).otherwise(F.pmod(-F.octet_length(raw), F.lit(UNIT)))
    return F.concat(raw, F.repeat(F.lit(" "), short).cast("binary"))


def op8_query(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's payload, as read back from the column of transport streams that was written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    stored = materialise(store(docs.select("doc_id", n.alias("n_bytes"), padded(F.col("text")).alias("payload")), "payload"), "media")
    return parse(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access", "packet_offsets")
