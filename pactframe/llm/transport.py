"""MPEG transport streams in binary columns: writing, parsing and checking.

A stream has a program association table, a program map table and elementary
streams carried in timestamped PES packets.  The parser takes any stream of
188-byte packets; the writer makes single-program streams.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pactframe.llm.common import as_map

# Fixed values of the transport stream format.
PACKET = 188
SYNC = 0x47
PAT_PID = 0
NULL_PID = 0x1FFF
PRIVATE_DATA = 0x06
PRIVATE_STREAM = 0xBD
CLOCK = 90_000
# What the writer chooses.
PMT_PID = 0x1000
DATA_PID = 0x100
UNIT = 4096
UNIT_TICKS = 3600
UNITS_PER_POINT = 8

_POLY = 0x04C11DB7


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ _POLY if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        table.append(crc)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The checksum of program tables; 0 over a table with its own checksum."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc << 8 ^ _CRC[crc >> 24 ^ byte]) & 0xFFFFFFFF
    return crc


def _section_packet(pid: int, table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\0\0"
    section = head + body
    section += section_crc(section).to_bytes(4, "big")
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0" + section).ljust(PACKET, b"\xff")


_TABLES = np.stack([np.frombuffer(t, np.uint8) for t in (
    _section_packet(PAT_PID, 0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")),
    _section_packet(PMT_PID, 2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0"))])


def _tables(point: int) -> bytes:
    """Both program tables as they go before the random-access point of that number."""
    out = _TABLES.copy()
    out[:, 3] |= point % 16
    return out.tobytes()


def _units(data: np.ndarray, first: int, counter: int) -> np.ndarray:
    """Packets of equally long units, `data` being units x bytes; shape units x packets x 188."""
    many, length = data.shape
    at = np.arange(first, first + many, dtype=np.int64)
    pts = at * UNIT_TICKS + CLOCK
    pes = np.empty((many, length + 14), np.uint8)
    pes[:, :9] = np.frombuffer(bytes([0, 0, 1, PRIVATE_STREAM]) + (length + 8).to_bytes(2, "big") + b"\x80\x80\x05", np.uint8)
    pes[:, 9] = 0x21 | pts >> 29 & 0x0E
    pes[:, 10] = pts >> 22 & 0xFF
    pes[:, 11] = 1 | pts >> 14 & 0xFE
    pes[:, 12] = pts >> 7 & 0xFF
    pes[:, 13] = 1 | pts << 1 & 0xFE
    pes[:, 14:] = data
    lead = min(176, pes.shape[1])
    rest = pes.shape[1] - lead
    packets = 1 + -(-rest // 184)
    out = np.full((many, packets, PACKET), 0xFF, np.uint8)
    out[:, :, 0] = SYNC
    out[:, :, 1] = DATA_PID >> 8
    out[:, :, 2] = DATA_PID & 0xFF
    out[:, :, 3] = 0x10 | (counter + np.arange(many * packets).reshape(many, packets)) % 16
    out[:, 0, 1] |= 0x40
    out[:, 0, 3] |= 0x20
    out[:, 0, 4] = PACKET - 5 - lead
    out[:, 0, 5] = 0x10 | np.where(at % UNITS_PER_POINT == 0, 0x40, 0)
    base = pts - CLOCK
    for k, shift in enumerate((25, 17, 9, 1)):
        out[:, 0, 6 + k] = base >> shift & 0xFF
    out[:, 0, 10] = (base & 1) << 7 | 0x7E
    out[:, 0, 11] = 0
    out[:, 0, PACKET - lead:] = pes[:, :lead]
    full = rest // 184
    out[:, 1:1 + full, 4:] = pes[:, lead:lead + full * 184].reshape(many, full, 184)
    if left := rest - full * 184:
        out[:, -1, 3] |= 0x20
        out[:, -1, 4] = 183 - left
        if left < 183:
            out[:, -1, 5] = 0
        out[:, -1, PACKET - left:] = pes[:, -left:]
    return out


def write_stream(payload: bytes) -> bytes:
    """A transport stream that carries `payload` in timestamped units of 4096 bytes.

    The program tables go before each random-access point, so that a reader
    can begin at any of them.
    """
    data = np.frombuffer(payload, np.uint8)
    whole = len(data) // UNIT
    rest = len(data) % UNIT or not whole
    packets = _units(data[:whole * UNIT].reshape(whole, UNIT), 0, 0) if whole else np.zeros((0, 1, PACKET), np.uint8)
    parts = []
    for first in range(0, whole, UNITS_PER_POINT):
        parts += [_tables(first // UNITS_PER_POINT), packets[first:first + UNITS_PER_POINT].tobytes()]
    if rest:
        if whole % UNITS_PER_POINT == 0:
            parts.append(_tables(whole // UNITS_PER_POINT))
        parts.append(_units(data[whole * UNIT:].reshape(1, -1), whole, packets.shape[0] * packets.shape[1]).tobytes())
    return b"".join(parts)


def _sections(packets: np.ndarray, pid: np.ndarray, wanted: int, table: int) -> list[bytes]:
    """Bodies of the sound sections of one table, which may run over packets; equal ones once, in order."""
    found: dict[bytes, None] = {}
    held, last = b"", b""
    for p in packets[pid == wanted]:
        raw = p.tobytes()
        start = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
        if not raw[3] & 0x10 or start >= PACKET or raw == last:
            continue
        last = raw
        parts = [held + raw[start:]]
        if raw[1] & 0x40:  # the pointer says where the first new section begins; what is before it ends an old one
            begin = start + 1 + raw[start]
            parts = [held + raw[start + 1:begin], raw[begin:]] if held else [raw[begin:]]
        for rest in parts:
            held = b""
            while len(rest) >= 3 and rest[0] != 0xFF:
                need = 3 + (int.from_bytes(rest[1:3], "big") & 0x0FFF)
                if len(rest) < need:
                    held = rest
                    break
                body = rest[:need]
                if rest[0] == table and need >= 12 and body not in found and section_crc(body) == 0:
                    found[body] = None
                rest = rest[need:]
            else:
                held = rest if 0 < len(rest) < 3 and rest[0] != 0xFF else b""
    return [body[8:-4] for body in found]


def _programs(packets: np.ndarray, pid: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(program, map pid, stream pid, stream type) of all that the program tables ever say, in that order."""
    out: dict[tuple[int, int, int, int], None] = {}
    for body in _sections(packets, pid, PAT_PID, 0):
        for k in range(0, len(body) - 3, 4):
            program, map_pid = int.from_bytes(body[k:k + 2], "big"), int.from_bytes(body[k + 2:k + 4], "big") & 0x1FFF
            for map_body in _sections(packets, pid, map_pid, 2) if program else []:
                at = 4 + (int.from_bytes(map_body[2:4], "big") & 0x0FFF)
                while at + 5 <= len(map_body):
                    out[program, map_pid, int.from_bytes(map_body[at + 1:at + 3], "big") & 0x1FFF, map_body[at]] = None
                    at += 5 + (int.from_bytes(map_body[at + 3:at + 5], "big") & 0x0FFF)
    return list(out)


def _duplicates(own: np.ndarray) -> np.ndarray:
    """Which packets repeat the one before them: the same counter and the same bytes, but for the clock reference."""
    same = np.zeros(len(own), bool)
    near = 1 + np.flatnonzero(own[1:, 3] == own[:-1, 3])
    if len(near):
        a, b = own[near].copy(), own[near - 1].copy()
        for x in (a, b):
            clock = (x[:, 3] & 0x20 > 0) & (x[:, 4] >= 7) & (x[:, 5] & 0x10 > 0)
            x[clock, 6:12] = 0
        same[near] = (a == b).all(1)
    return same


def parse_stream(media: bytes) -> dict:
    """What a transport stream holds.

    packets, sync_errors (packets without the sync byte, which are skipped;
    bytes after the last whole packet count as one) and, for each elementary
    stream of the program tables: program, map_pid, pid, stream_type, data
    (the joined PES payloads), units (PES packets), continuity_errors (gaps of
    the counter; a packet that repeats the one before it is dropped and not
    counted, another one with the same counter follows a gap; a jump that a
    packet's discontinuity indicator tells of is none), pts (ticks, -1
    where a unit has none), offsets (of each unit in data) and random_access
    (its random-access indicator).
    """
    whole = len(media) // PACKET
    packets = np.frombuffer(media, np.uint8, whole * PACKET).reshape(whole, PACKET)
    sound = packets[:, 0] == SYNC
    errors = int((~sound).sum()) + (len(media) % PACKET > 0)
    packets = packets[sound]
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    streams = []
    for program, map_pid, stream_pid, kind in _programs(packets, pid):
        own = packets[(pid == stream_pid) & (packets[:, 3] & 0x10 > 0) & (packets[:, 1] & 0x80 == 0)]
        own = own[~_duplicates(own)]
        told = (own[1:, 3] & 0x20 > 0) & (own[1:, 4] > 0) & (own[1:, 5] & 0x80 > 0)  # the discontinuity indicator
        gaps = int(((np.diff((own[:, 3] & 0x0F).astype(np.int16)) % 16 != 1) & ~told).sum())
        start = np.where(own[:, 3] & 0x20, 5 + own[:, 4].astype(np.int32), 4).clip(4, PACKET)
        size = PACKET - start
        begins = np.flatnonzero(own[:, 1] & 0x40)
        stream = {"program": program, "map_pid": map_pid, "pid": stream_pid, "stream_type": kind, "continuity_errors": gaps}
        flat = own[np.arange(PACKET) >= start[:, None]]
        ends = np.concatenate([[0], np.cumsum(size)])
        data, pts, offsets, points, at = [], [], [], [], 0
        for k, b in enumerate(begins):
            unit = flat[ends[b]:ends[begins[k + 1]] if k + 1 < len(begins) else ends[-1]]
            if len(unit) < 9 or unit[0] or unit[1] or unit[2] != 1:
                continue
            length = int(unit[4]) << 8 | int(unit[5])
            head = 9 + int(unit[8])
            body = unit[head:6 + length if length else None]
            ticks = -1
            if unit[7] & 0x80 and len(unit) >= 14:
                a, b1, c, d, e = (int(x) for x in unit[9:14])
                ticks = (a >> 1 & 7) << 30 | b1 << 22 | (c >> 1) << 15 | d << 7 | e >> 1
            data.append(body)
            pts.append(ticks)
            offsets.append(at)
            points.append(bool(own[b, 3] & 0x20 and own[b, 4] and own[b, 5] & 0x40))
            at += len(body)
        stream |= {"data": np.concatenate(data).tobytes() if data else b"", "units": len(data), "pts": pts, "offsets": offsets, "random_access": points}
        streams.append(stream)
    return {"packets": whole, "sync_errors": errors, "streams": streams}


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 text (null: empty), and the text with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def store_texts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_bytes and media: each whole text as a transport stream.

    Null and empty texts give a stream of 64 zero bytes; equal texts give
    equal streams, and repeated rows repeated ones; texts of any length are
    stored whole; other columns are dropped.
    """
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("media", "binary")

    def over(batch):
        pairs = [padded(t) for t in batch.column(len(keep)).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array([n for n, _ in pairs], pa.int64()), pa.array([write_stream(p) for _, p in pairs], pa.binary())],
            names=schema.names)

    return as_map(docs.select(*keep, text), over, schema)


STREAM = ("struct<program:int,map_pid:int,pid:int,stream_type:int,units:int,continuity_errors:int,payload_bytes:long,payload_sha256:string,"
          "tail_crc32:long,pts:array<long>,offsets:array<long>,random_access:array<boolean>>")


def parse_media(stored: DataFrame, media: str = "media", with_data: bool = False) -> DataFrame:
    """Adds what `media` holds: media_bytes, media_sha256, packets, sync_errors, streams.

    Each stream has its table entries, counter errors, timestamps with byte
    offsets and random-access flags, and digests of its reassembled payload;
    `with_data` adds the payload of the first stream as `data`.  Null media
    give null fields, media without program tables no stream.
    """
    from pyspark.sql import types as T

    schema = stored.drop(media).schema
    added = "media_bytes long, media_sha256 string, packets int, sync_errors int, streams array<" + STREAM + ">" + (", data binary" if with_data else "")
    extra = T.StructType.fromDDL(added)
    full = T.StructType(schema.fields + extra.fields)
    others = schema.names

    def digest(s: dict) -> dict:
        return {k: s[k] for k in ("program", "map_pid", "pid", "stream_type", "units", "continuity_errors", "pts", "offsets", "random_access")} | {
            "payload_bytes": len(s["data"]), "payload_sha256": sha256(s["data"]).hexdigest(), "tail_crc32": zlib.crc32(s["data"][-64:])}

    def over(batch):
        raw = batch.column(len(others)).to_pylist()
        parsed = [None if m is None else parse_stream(m) for m in raw]
        for p in parsed:
            if p:
                p["first"] = p["streams"][0]["data"] if p["streams"] else None
        columns = [[None if m is None else len(m) for m in raw], [None if m is None else sha256(m).hexdigest() for m in raw],
                   [p and p["packets"] for p in parsed], [p and p["sync_errors"] for p in parsed],
                   [p and [digest(s) for s in p["streams"]] for p in parsed], [p and p["first"] for p in parsed]]
        from pyspark.sql.pandas.types import to_arrow_type

        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:len(others)], *[pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, extra.fields, strict=False)]], names=full.names)

    return as_map(stored.select(*others, media), over, full)
