"""Media columns: MPEG transport streams held in a binary column.

`pack` stores a payload as a program of one private-data stream: a program association table, a program map table and
one PES packet per access unit, in 188-byte packets. The first packet of each PES packet carries the random-access
flag and a clock reference in its adaptation field; the last is filled by an adaptation field. `unpack` reads any
stream of this kind: it parses the tables, whose sections may span packets, follows the first program's first elementary
stream, checks continuity counters, reassembles the PES packets and returns the time stamps and the byte offsets of the
random-access points. Continuity: packets without payload don't count, a packet may be sent twice (the second is left
out), and a packet with the discontinuity flag starts anew; every other step but one is a gap.

Nulls: a null text is an empty one; the payload is then 576 bytes 255. A null doc_id stays null. Repeated rows are
packed each for itself, equal texts give equal bytes. Stored bytes that are no such stream (or null) give a row whose
feature says `error=` and why, and null payload columns. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import binascii
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.shared import batched

UNIT = 576
#: Bytes of an access unit, and its duration in ticks of the 90 kHz clock (a 25 Hz raster).
ACCESS_UNIT = 8 * UNIT
TICKS = 3600
PACKET, BODY = 188, 184
PROGRAM, PMT_PID, DATA_PID, PRIVATE_DATA = 1, 0x100, 0x101, 0x06


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ x]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_DATA, 0xE000 | DATA_PID, 0xF000))
)


def _pts_bytes(pts: int) -> bytes:
    return bytes((0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE))


def pack(payload: bytes) -> bytes:
    """The stream of a payload."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        pts = k * TICKS & (2**33 - 1)
        unit = payload[at : at + ACCESS_UNIT]
        data = b"\0\0\1\xbd" + struct.pack(">HBBB", len(unit) + 8, 0x84, 0x80, 5) + _pts_bytes(pts) + unit
        # A first packet with 176 bytes of data, then 184 each, the last one filled.
        rest = max(0, len(data) - 176)
        n = 1 + -(-rest // BODY)
        grid = np.zeros((n, PACKET), np.uint8)
        grid[:, 0] = 0x47
        grid[:, 1], grid[:, 2] = DATA_PID >> 8, DATA_PID & 255
        grid[0, 1] |= 0x40
        grid[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
        counter = (counter + n) & 15
        first = min(len(data), 176)
        pad = 176 - first
        clock = struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        grid[0, 3] |= 0x20
        grid[0, 4 : 188 - first] = np.frombuffer(bytes((7 + pad, 0x50)) + clock + b"\xff" * pad, np.uint8)
        grid[0, 188 - first :] = np.frombuffer(data, np.uint8, first)
        if n > 1:
            whole = rest // BODY
            grid[1 : 1 + whole, 4:] = np.frombuffer(data, np.uint8, whole * BODY, 176).reshape(whole, BODY)
            if tail := rest - whole * BODY:
                fill = BODY - tail
                grid[n - 1, 3] |= 0x20
                grid[n - 1, 4 : 4 + fill] = np.frombuffer((bytes((fill - 1, 0)) + b"\xff" * fill)[:fill], np.uint8)
                grid[n - 1, 4 + fill :] = np.frombuffer(data, np.uint8, tail, len(data) - tail)
        out.append(grid.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What `unpack` finds."""

    payload: bytes = b""
    programs: int = 0
    stream_type: int = -1
    packets: int = 0
    gaps: int = 0
    crc_errors: int = 0
    stamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)


def _heads(rows: np.ndarray) -> np.ndarray:
    """Offset of each packet's payload; 188 where it has none."""
    adapted = rows[:, 3] & 0x20 > 0
    heads = np.where(adapted, 5 + rows[:, 4].astype(np.int64), 4)
    if (heads > PACKET).any():
        raise ValueError("an adaptation field is longer than its packet")
    return np.where(rows[:, 3] & 0x10 > 0, heads, PACKET)


def _sections(rows: np.ndarray, table_id: int, found: Stream) -> Iterator[bytes]:
    """Bodies of a table's sections from the packets of its PID; a section may span packets, a packet hold several."""
    waiting = None
    for row, head in zip(rows, _heads(rows).tolist()):
        data = row[head:].tobytes()
        if not data:
            continue
        parts = [data]
        if row[1] & 0x40:
            parts = [data[1 : 1 + data[0]], data[1 + data[0] :]]
        for k, part in enumerate(parts):
            if len(parts) == 2 and k == 1:
                waiting = b""
            if waiting is None:
                continue
            waiting += part
            while len(waiting) >= 3 and waiting[0] != 0xFF:
                size = 3 + (struct.unpack(">H", waiting[1:3])[0] & 0x0FFF)
                if len(waiting) < size:
                    break
                section, waiting = waiting[:size], waiting[size:]
                if section[0] == table_id and size >= 12:
                    if crc32_mpeg(section):
                        found.crc_errors += 1
                    else:
                        yield section[8:-4]


def unpack(media: bytes) -> Stream:
    """Reads a stream: the first program's first elementary stream, whole. Raises ValueError if it isn't one."""
    found = Stream()
    if not media or len(media) % PACKET:
        raise ValueError(f"{len(media)} bytes are not whole packets")
    grid = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (grid[:, 0] != 0x47).any():
        raise ValueError("a packet doesn't start with the sync byte")
    found.packets = len(grid)
    pids = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    maps: dict[int, int] = {}
    for body in _sections(grid[pids == 0], 0, found):
        for i in range(0, len(body) - 3, 4):
            number, pid = struct.unpack(">HH", body[i : i + 4])
            if number:
                maps.setdefault(number, pid & 0x1FFF)
    found.programs = len(maps)
    data_pid = -1
    for body in _sections(grid[pids == maps[min(maps)]], 2, found) if maps else ():
        skip = 4 + (struct.unpack(">H", body[2:4])[0] & 0x0FFF)
        if data_pid < 0 and len(body) >= skip + 5:
            found.stream_type, pid = struct.unpack(">BH", body[skip : skip + 3])
            data_pid = pid & 0x1FFF
    if data_pid < 0:
        raise ValueError("no program has an elementary stream")
    rows = np.flatnonzero(pids == data_pid)
    own, heads = grid[rows], _heads(grid[rows])
    flags = np.where((own[:, 3] & 0x20 > 0) & (own[:, 4] > 0), own[:, 5], 0)
    told = np.flatnonzero(heads < PACKET)  # packets with a payload, which alone count
    step = np.diff(own[told, 3].astype(np.int64) & 15) & 15
    again = np.zeros(len(told), bool)
    for i in (np.flatnonzero(step == 0) + 1).tolist():
        again[i] = not again[i - 1] and bool((own[told[i]] == own[told[i - 1]]).all())
    found.gaps = int(((step != 1) & ~again[1:] & (flags[told[1:]] & 0x80 == 0)).sum())
    told = told[~again]
    found.random_access = (rows[told[flags[told] & 0x40 > 0]] * PACKET).tolist()
    own, heads = own[told], heads[told]
    starts = np.flatnonzero(own[:, 1] & 0x40)
    data = own[np.arange(PACKET)[None, :] >= heads[:, None]].tobytes()
    offsets = np.concatenate(([0], np.cumsum(PACKET - heads)))
    parts = []
    for a, b in zip(starts, [*starts[1:], len(own)]):
        pes = data[offsets[a] : offsets[b]]
        if len(pes) < 9 or pes[:3] != b"\0\0\1":
            raise ValueError("an elementary packet doesn't start with its prefix")
        size, marks, head = struct.unpack(">H", pes[4:6])[0], pes[7], pes[8]
        if marks & 0x80 and len(pes) >= 14:
            p = pes[9:14]
            found.stamps.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1)
        parts.append(pes[9 + head : 6 + size if size else len(pes)])
    found.payload = b"".join(parts)
    return found


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8, then bytes 255 up to a positive multiple of 576; and the length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [payload_of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([pack(p) for p, _ in made], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return batched(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


FEATURES = (
    "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, "
    "n_packets bigint, n_gaps bigint, pts array<bigint>, access_points array<bigint>"
)


def described(stored: bytes | None) -> tuple:
    """What `features` says of a stream, in the order of its columns."""
    digest = (len(stored), hashlib.sha256(stored).hexdigest()) if stored is not None else (None, None)
    try:
        s = unpack(stored or b"")
    except (ValueError, IndexError, struct.error) as e:
        return (None, None, None, *digest, f"error={e}", None, None, None, None)
    steps = np.diff(s.stamps)
    sizes = np.bincount(np.frombuffer(s.payload, np.uint8), minlength=256)
    share = sizes[sizes > 0] / max(1, len(s.payload))
    feature = (
        f"programs={s.programs};type={s.stream_type};packets={s.packets};gaps={s.gaps};crc_errors={s.crc_errors};"
        f"units={len(s.stamps)};pts_step={int(steps.max()) if len(steps) else 0};access_points={len(s.random_access)};"
        f"last_access={s.random_access[-1] if s.random_access else -1};byte_entropy={-(share * np.log2(share)).sum():.4f}"
    )
    return (
        len(s.payload), hashlib.sha256(s.payload).hexdigest(), binascii.crc32(s.payload[-32:]), *digest, feature,
        s.packets, s.gaps, s.stamps, s.random_access,
    )


def features(media: DataFrame) -> DataFrame:
    """Reads the stored bytes back: one row a stream, with what was found in it.

    pts has the time stamps of the elementary packets in order, access_points the byte offsets of the packets from which
    reading can start.
    """
    names = ["doc_id", "n_bytes", *[x.split()[0] for x in FEATURES.split(", ")]]
    long, many = pa.int64(), pa.list_(pa.int64())
    kinds = [long, pa.string(), long, long, pa.string(), pa.string(), long, long, many, many]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*[described(value.as_py()) for value in batch.column(2)])) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return batched(media).select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, {FEATURES}")
