"""Media columns as MPEG transport streams: 188-byte packets, program tables, PES units.

A payload is stored as one program with one private-data stream. Every PES packet starts with a
random-access point: an adaptation field with the random-access flag and a PCR, and a PTS that counts
one tick per stored byte at 90 kHz, so timestamps index the samples. Reading goes the other way:
the program association table names the map table, that one names the stream, continuity counters are
checked packet by packet, adaptation fields are skipped, and PES packets are put together. A unit that
does not fill its last packet is stuffed there as the standard says: by an adaptation field in front of
the payload. All packets of a stream are laid out and read as numpy rows; no loop runs over packets.
Streams are stored as a binary column of a table, and read from there.

Defined cases: null text is stored like an empty one (64 zero bytes); very long texts are split over
many PES packets and stay whole; repeated rows and equal texts give equal bytes; an empty table gives no
rows; other columns are ignored; a damaged stream raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from holdfast.llm.common import Scratch, slices, small_batches, table

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x0100, 0x0101
#: Stream type of PES packets with private data, and the stream id used for them.
PRIVATE_TYPE, PRIVATE_ID = 0x06, 0xBD
#: First packet of a PES: 4 header + 8 adaptation field; further ones: 4 header. PES header: 14 bytes.
FIRST, NEXT, PES_HEADER = 176, 184, 14
#: Payload bytes of a PES: a first packet and 63 full ones.
UNIT = FIRST - PES_HEADER + 63 * NEXT
UNIT_PACKETS = 64
PAD = 64


def _crc_table() -> np.ndarray:
    rows = np.arange(256, dtype=np.uint64) << 24
    for _ in range(8):
        rows = ((rows << 1) ^ np.where(rows & 0x80000000, np.uint64(0x04C11DB7), np.uint64(0))) & 0xFFFFFFFF
    return rows


_CRC = _crc_table().tolist()


def crc_mpeg(data: bytes) -> int:
    """The CRC of program tables: polynomial 04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ byte]
    return crc


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


#: The two program tables are the same for every stream: program 1 with one private stream.
HEAD = _table_packet(PAT_PID, _section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(0x02, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _fields(value: np.ndarray, shifts: list[tuple[int, int, int]]) -> np.ndarray:
    """A byte column for each (shift, mask, fixed bits)."""
    return np.stack([((value >> s) & m) | f for s, m, f in shifts], axis=-1).astype(np.uint8)


def mux(payload: bytes) -> bytes:
    data = np.frombuffer(payload, np.uint8)
    units = max(1, -(-len(data) // UNIT))
    filled = np.zeros(units * UNIT, np.uint8)
    filled[: len(data)] = data
    filled = filled.reshape(units, UNIT)
    sizes = np.minimum(UNIT, len(data) - np.arange(units) * UNIT)
    start = np.arange(units, dtype=np.int64) * UNIT
    out = np.full((units, UNIT_PACKETS, PACKET), 0xFF, np.uint8)
    out[:, :, 0] = SYNC
    out[:, :, 1:3] = np.array([DATA_PID >> 8, DATA_PID & 0xFF], np.uint8)
    out[:, 0, 1] |= 0x40
    out[:, :, 3] = 0x10
    out[:, 0, 3] = 0x30
    out[:, 0, 4], out[:, 0, 5] = 7, 0x50
    # the PCR base counts stored bytes, like the PTS; its extension is 0
    out[:, 0, 6:12] = np.concatenate([_fields(start, [(25, 255, 0), (17, 255, 0), (9, 255, 0), (1, 255, 0)]), ((start & 1) << 7 | 0x7E).astype(np.uint8)[:, None], np.zeros((units, 1), np.uint8)], axis=1)
    out[:, 0, 12:16] = np.array([0, 0, 1, PRIVATE_ID], np.uint8)
    out[:, 0, 16:18] = _fields(sizes + PES_HEADER - 6, [(8, 255, 0), (0, 255, 0)])
    out[:, 0, 18:21] = np.array([0x84, 0x80, 5], np.uint8)
    out[:, 0, 21:26] = _fields(start << 1, [(30, 0x0E, 0x21), (23, 255, 0), (15, 0xFE, 1), (8, 255, 0), (0, 0xFE, 1)])
    out[:, 0, 26:] = filled[:, : FIRST - PES_HEADER]
    out[:, 1:, 4:] = filled[:, FIRST - PES_HEADER :].reshape(units, UNIT_PACKETS - 1, NEXT)
    out = out.reshape(-1, PACKET)
    last = int(sizes[-1])
    used = (units - 1) * UNIT_PACKETS + 1 + max(0, -(-(last - (FIRST - PES_HEADER)) // NEXT))
    out = out[:used].copy()
    out[:, 3] |= (np.arange(used) & 15).astype(np.uint8)
    _stuff(out[-1], last)
    return HEAD + out.tobytes()


def _stuff(packet: np.ndarray, last: int) -> None:
    """Move the payload of the last packet, of a unit with `last` bytes, to its end, and fill up the adaptation field before it."""
    if last <= FIRST - PES_HEADER:
        spare, body, field = FIRST - PES_HEADER - last, packet[12 : 12 + PES_HEADER + last].copy(), packet[4:12].copy()
    else:
        held = (last - (FIRST - PES_HEADER) - 1) % NEXT + 1
        spare, body, field = NEXT - held, packet[4 : 4 + held].copy(), np.zeros(0, np.uint8)
    if not spare:
        return
    if not len(field):
        packet[3] |= 0x20
        field = np.array([0, 0][: min(2, spare)], np.uint8)  # its length, and flags if there is room for them
        spare -= len(field)
    field[0] = len(field) - 1 + spare
    packet[4:] = np.concatenate([field, np.full(spare, 0xFF, np.uint8), body])


def _table(rows: np.ndarray, pid: int, table_id: int) -> bytes:
    mine = rows[(((rows[:, 1] & 0x1F).astype(np.int32) << 8) | rows[:, 2]) == pid]
    if not len(mine):
        raise ValueError(f"no table on PID {pid}")
    raw = mine[0].tobytes()
    at = 5 + raw[4]
    size = int.from_bytes(raw[at + 1 : at + 3], "big") & 0x0FFF
    section = raw[at : at + 3 + size]
    if section[0] != table_id or crc_mpeg(section):
        raise ValueError(f"damaged table on PID {pid}")
    return section[8:-4]


def demux(stream: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """payload, timestamps of the PES packets, and the packet numbers of their random-access points."""
    if len(stream) % PACKET:
        raise ValueError("not whole packets")
    rows = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pmt = int.from_bytes(_table(rows, PAT_PID, 0x00)[2:4], "big") & 0x1FFF
    pid = int.from_bytes(_table(rows, pmt, 0x02)[5:7], "big") & 0x1FFF
    number = np.nonzero((((rows[:, 1] & 0x1F).astype(np.int32) << 8) | rows[:, 2]) == pid)[0]
    mine = rows[number]
    if (((mine[1:, 3] & 15) - (mine[:-1, 3] & 15)) & 15 != 1).any():
        raise ValueError("continuity counter jumps")
    starts = np.nonzero(mine[:, 1] & 0x40)[0]
    if not len(starts) or starts[0]:
        raise ValueError("stream starts inside a PES packet")
    if (mine[:, 3] & 0x10 == 0).any():
        raise ValueError("a packet without payload")
    # where the payload begins: behind the header, and the adaptation field if there is one
    begin = 4 + np.where(mine[:, 3] & 0x20, mine[:, 4].astype(np.int64) + 1, 0)
    if (begin > PACKET).any() or (begin[starts] > PACKET - PES_HEADER).any():
        raise ValueError("an adaptation field is too long")
    heads = np.take_along_axis(mine[starts], begin[starts, None] + np.arange(PES_HEADER), axis=1).astype(np.int64)
    if (heads[:, :4] != np.array([0, 0, 1, PRIVATE_ID])).any() or (mine[starts, 3] & 0x20 == 0).any() or (heads[:, 8] != 5).any():
        raise ValueError("not the PES packets of this format")
    sizes = heads[:, 4] << 8 | heads[:, 5]
    pts = (heads[:, 9] & 0x0E) << 29 | heads[:, 10] << 22 | (heads[:, 11] & 0xFE) << 14 | heads[:, 12] << 7 | heads[:, 13] >> 1
    access = number[starts[(mine[starts, 5] & 0x40) > 0]]
    begin[starts] += PES_HEADER
    payload = mine[np.arange(PACKET) >= begin[:, None]]
    held = np.add.reduceat(PACKET - begin, starts)
    if (held != sizes - (PES_HEADER - 6)).any():
        raise ValueError("a PES packet is not as long as it says")
    return payload.tobytes(), pts, access


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(PAD, -(-len(raw) // PAD) * PAD), b"\0")


def store(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, media (the stream)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [(n, mux(p)) for n, p in map(padded, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def feature(payload: bytes, pts: np.ndarray, access: np.ndarray) -> str:
    """From the bytes read back: PES count, last timestamp, last access point, mean and deviation of the samples, zero share."""
    data = np.frombuffer(payload, np.uint8)
    total, squares, n = int(data.sum(dtype=np.int64)), int((data.astype(np.int64) ** 2).sum()), len(data)
    return f"pes={len(pts)};pts={int(pts[-1])};rap={int(access[-1])};mean={total * 1000 // n};var={(n * squares - total * total) * 1000 // (n * n)};zero={int((data == 0).sum())}"


def read_back(media: DataFrame) -> DataFrame:
    """media (doc_id, n_bytes, media) -> the digests and features of what was stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for stream in batch.column("media").to_pylist():
                payload, pts, access = demux(stream)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(payload, pts, access)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *cols], NAMES)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def query(spark, sf_dir: str) -> DataFrame:
    stored = Scratch(spark, "media").save(store(table(spark, sf_dir, "documents")), "streams")
    return read_back(stored)
