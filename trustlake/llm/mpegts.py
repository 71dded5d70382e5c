"""MPEG transport streams as media columns: stored payloads, and what a parser finds in them.

``store`` puts a payload into a transport stream of one programme: a program association table, a program map table and
one private elementary stream. Access units of ``unit`` bytes are carried in one PES packet each, with a presentation
time; the first unit and every ``group``-th after it is a random-access point, with the tables repeated before it and a
program clock reference in its first packet.

``read`` walks the 188-byte packets, parses the tables (with their CRC, over as many packets as a section has), checks
the continuity counter of each PID, reassembles the PES packets of the first elementary stream and returns the payload,
the programme, the counters of errors and the access units with time stamps, byte ranges and random-access flags.

A task holds one row's stream at a time beside its batch. Defined cases: a null payload is empty; an empty stream, one
that is not whole packets, or one with a lost sync byte gives null columns but for sync_errors; a packet sent twice
counts once; a PES packet whose header is cut or has no start code gives no access unit and one whose length is not the
one it states keeps its bytes, both count as pes_errors; a stream without tables has no access units; repeated rows give
equal values; other columns are kept unless they have the name of a result, which replaces them; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import column, in_small_batches

PACKET = 188
UNIT_BYTES = 3072
#: The length field of a PES packet has 16 bits and counts 8 bytes of its header.
MOST_UNIT_BYTES = 65527
GROUP = 8
#: Ticks of the 90 kHz clock from one access unit to the next.
TICKS = 3600
PMT_PID, STREAM_PID, PROGRAM, STREAM_TYPE = 0x1000, 0x100, 1, 0x06

FOUND = "payload binary, sync_errors int, crc_errors int, continuity_errors int, pes_errors int, program int, pmt_pid int, stream_pid int, stream_type int, packets int, units array<struct<pts:long,offset:long,size:long,random_access:boolean>>"
_UNIT = pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("random_access", pa.bool_())])
_KINDS = [pa.binary(), *[pa.int32()] * 9, pa.list_(_UNIT)]


@cache
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


@lru_cache(4096)
def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2, zero over a section with its own CRC. Sections are few and repeat, so results are kept."""
    c, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[(c >> 24) ^ b]
    return c


@cache
def section_packet(pid: int, counter: int) -> bytes:
    """The packet of the program association table (PID 0) or of the program map table."""
    if pid == 0:
        body = PROGRAM.to_bytes(2) + (0xE000 | PMT_PID).to_bytes(2)
        table, number = 0x00, 1
    else:
        body = (0xE000 | STREAM_PID).to_bytes(2) + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2) + b"\xf0\x00"
        table, number = 0x02, PROGRAM
    section = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2) + number.to_bytes(2) + b"\xc1\x00\x00" + body
    section += crc32_mpeg(section).to_bytes(4)
    return (bytes([0x47]) + (0x4000 | pid).to_bytes(2) + bytes([0x10 | counter, 0]) + section).ljust(PACKET, b"\xff")


def stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E]) + ((pts >> 14 & 0xFFFE) | 1).to_bytes(2) + ((pts << 1 & 0xFFFE) | 1).to_bytes(2)


def mux(payload: bytes, unit: int = UNIT_BYTES, group: int = GROUP, ticks: int = TICKS) -> bytes:
    """The transport stream of a payload."""
    out, counter, tables = [], 0, 0
    plain = [(0x0100 | STREAM_PID >> 8) & 0x1F, STREAM_PID & 0xFF]
    heads = [bytes([0x47, plain[0], plain[1], 0x10 | c]) for c in range(16)]
    for k, at in enumerate(range(0, len(payload), unit)):
        key, pts, own = k % group == 0, k * ticks, payload[at : at + unit]
        if key:
            out += [section_packet(0, tables & 15), section_packet(PMT_PID, tables & 15)]
            tables += 1
        pes = b"\x00\x00\x01\xbd" + (len(own) + 8).to_bytes(2) + b"\x84\x80\x05" + stamp(pts) + own
        clock = (pts << 15 | 0x7E00).to_bytes(6) if key else b""
        field = bytes([0x50 if key else 0x00]) + clock
        take = min(len(pes), PACKET - 5 - len(field))
        fill = b"\xff" * (PACKET - 5 - len(field) - take)
        out.append(bytes([0x47, plain[0] | 0x40, plain[1], 0x30 | counter, len(field) + len(fill)]) + field + fill + pes[:take])
        counter = counter + 1 & 15
        whole = (len(pes) - take) // 184
        for at_packet in range(take, take + whole * 184, 184):
            out.append(heads[counter] + pes[at_packet : at_packet + 184])
            counter = counter + 1 & 15
        left = pes[take + whole * 184 :]
        if left:
            space = 183 - len(left)
            out.append(bytes([0x47, plain[0], plain[1], 0x30 | counter, space]) + (b"\x00" + b"\xff" * (space - 1) if space else b"") + left)
            counter = counter + 1 & 15
    return b"".join(out)


class Sections:
    """Puts the sections of one PID together over packets."""

    def __init__(self):
        self.held: bytearray | None = None

    def lost(self) -> None:
        self.held = None

    def feed(self, begins: bool, data: bytes) -> list[bytes]:
        """The sections that this packet's payload completes; a pointer field comes first where one begins."""
        out = []
        if begins and data:
            first = 1 + data[0]
            if self.held is not None:
                self.held += data[1:first]
                out += self.whole()
            self.held, data = bytearray(), data[first:]
        if self.held is not None:
            self.held += data
            out += self.whole()
        return out

    def whole(self) -> list[bytes]:
        out = []
        while self.held is not None and len(self.held) >= 3:
            size = 3 + (int.from_bytes(self.held[1:3]) & 0x0FFF)
            if self.held[0] == 0xFF:
                self.held = None
            elif len(self.held) < size:
                break
            else:
                out.append(bytes(self.held[:size]))
                del self.held[:size]
        return out


def access_unit(pes: bytes) -> tuple[int | None, bytes, bool] | None:
    """Time, bytes and soundness of a PES packet; None where its header is cut or has no start code."""
    if len(pes) < 9 or pes[:3] != b"\x00\x00\x01" or len(pes) < 9 + pes[8]:
        return None
    size, head = int.from_bytes(pes[4:6]), 9 + pes[8]
    timed = pes[7] & 0x80 and pes[8] >= 5
    pts = (pes[9] >> 1 & 7) << 30 | (int.from_bytes(pes[10:12]) >> 1) << 15 | int.from_bytes(pes[12:14]) >> 1 if timed else None
    return pts, pes[head : 6 + size] if size else pes[head:], not size or len(pes) == 6 + size


def demux(data: bytes) -> tuple:
    """The values of FOUND for one stream; no bytes make it fail."""
    bad = sum(data[i] != 0x47 for i in range(0, len(data), PACKET)) + bool(len(data) % PACKET)
    if bad or not data:
        return (None, max(1, bad), *[None] * 8, None)
    crc_errors = continuity = pes_errors = 0
    program = pmt = stream = kind = None
    last: dict[int, tuple[int, bytes, bool]] = {}
    tables: dict[int, Sections] = {}
    packets: list[bytes] = []
    keys: list[bool] = []
    current: list[bytes] = []
    for at in range(0, len(data), PACKET):
        a, b, c = data[at + 1], data[at + 2], data[at + 3]
        pid, begins, control, counter = (a & 0x1F) << 8 | b, bool(a & 0x40), c >> 4 & 3, c & 15
        start, key, jump = at + 4, False, False
        if control & 2:
            if n := data[start]:
                key, jump = bool(data[start + 1] & 0x40), bool(data[start + 1] & 0x80)
            start += 1 + n
        # A packet marked as damaged is passed over and leaves a gap in the counters.
        if not control & 1 or a & 0x80:
            continue
        body, gap = data[start : at + PACKET], False
        if pid in last and not jump:
            before, same, again = last[pid]
            if counter == before and body == same and not again:
                # A packet may be sent twice.
                last[pid] = (counter, body, True)
                continue
            gap = counter != (before + 1 & 15)
            continuity += gap
        last[pid] = (counter, body, False)
        if pid == stream:
            if begins:
                if current:
                    packets.append(b"".join(current))
                current = []
                keys.append(key)
            if keys:
                current.append(body)
        elif pid == 0 or pid == pmt:
            held = tables.setdefault(pid, Sections())
            if gap:
                held.lost()
            for section in held.feed(begins, body):
                size = len(section)
                if crc32_mpeg(section):
                    crc_errors += 1
                elif pid == 0 and section[0] == 0x00:
                    for i in range(8, size - 7, 4):
                        if (number := int.from_bytes(section[i : i + 2])) and program is None:
                            program, pmt = number, int.from_bytes(section[i + 2 : i + 4]) & 0x1FFF
                elif pid == pmt and section[0] == 0x02 and stream is None:
                    i = 12 + (int.from_bytes(section[10:12]) & 0x0FFF)
                    if i < size - 8:
                        kind, stream = section[i], int.from_bytes(section[i + 1 : i + 3]) & 0x1FFF
    if current:
        packets.append(b"".join(current))
    units, bodies, at = [], [], 0
    # A start without any byte behind it has a flag and no packet, and only the last one can be so.
    for pes, key in zip(packets, keys):
        found = access_unit(pes)
        pes_errors += found is None or not found[2]
        if found is not None:
            units.append({"pts": found[0], "offset": at, "size": len(found[1]), "random_access": key})
            bodies.append(found[1])
            at += len(found[1])
    return b"".join(bodies), 0, crc_errors, continuity, pes_errors, program, pmt, stream, kind, len(data) // PACKET, units


def store(df: DataFrame, payload_col: str, media_col: str = "media", unit: int = UNIT_BYTES) -> DataFrame:
    """``df`` with the transport stream of ``payload_col`` in ``media_col``."""
    if not 1 <= unit <= MOST_UNIT_BYTES:
        raise ValueError(f"an access unit has 1 to {MOST_UNIT_BYTES} bytes")
    df = df.drop(media_col) if media_col != payload_col else df
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                media = pa.array([mux(p.as_py() or b"", unit) for p in column(batch, payload_col)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, media], [*names, media_col])

    return in_small_batches(df).mapInArrow(run, schema_of(df) + f", `{media_col}` binary")


def read(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with the columns of FOUND, parsed from ``media_col``."""
    results = [f.split()[0] for f in FOUND.split(", ")]
    df = df.drop(*[c for c in df.columns if c in results and c != media_col])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                rows = [demux(m.as_py() or b"") for m in column(batch, media_col)]
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*names, *results])

    return in_small_batches(df).mapInArrow(run, f"{schema_of(df)}, {FOUND}")


def parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def padded(text: F.Column, block: int = 192) -> F.Column:
    """The UTF-8 bytes of a text with spaces up to a positive multiple of ``block``."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    n = F.octet_length(text)
    goal = F.greatest(F.lit(1), F.ceil(n / block)) * block
    return F.concat(text, F.repeat(F.lit(" "), (goal - n).cast("int"))).cast("binary")
