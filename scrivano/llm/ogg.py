"""Media columns in Ogg: pages with checksums, lacing, logical streams, granule positions.

A payload of bytes is stored as unsigned 8-bit samples in two logical streams: runs of RUN samples
go to them in turn, one packet a run, a header packet first.  Reading verifies each page's
checksum, sequence number and flags, demultiplexes pages by serial number, reassembles packets from
lacing values (also those that span pages), takes times from granule positions, which count a
stream's samples, and merges the streams' packets by their turns.

The checksum's polynomial is that of CRC-32 with unreflected bits, so it is zlib's CRC-32 of the
bytes with their bits reversed, start and end values taken out.

Defined results: null or empty text is 64 zero bytes; repeated rows and equal texts give equal
values; damaged pages raise ValueError; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches

RATE = 8000
RUN = 4000
PAD = 64
#: Lacing values, and with them segments, that one page may have.
LACES = 255
#: Fixed values of the page header: pattern, version, and flags for continued, first and last pages.
CAPTURE, VERSION, CONTINUED, FIRST, LAST = b"OggS", 0, 1, 2, 4
SERIALS = (1, 2)
HEADER = struct.Struct(">8sHHIIBBHI")
PAGE = struct.Struct("<4sBBqIIIB")
NO_PACKET = -1
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC of a page whose checksum field is zero."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, number: int, granule: int, flags: int, laces: bytes, body: bytes) -> bytes:
    head = PAGE.pack(CAPTURE, VERSION, flags, granule, serial, number, 0, len(laces)) + laces
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def pages_of(serial: int, packets: list[tuple[bytes, int]]):
    """Pages of one stream as (first packet's index, bytes).  packets: data and granule position."""
    laces, body, done, opened, number = bytearray(), bytearray(), NO_PACKET, False, 0
    first, out = 0, []

    def close(flags: int) -> None:
        nonlocal laces, body, done, number
        out.append((first, page(serial, number, done, flags, bytes(laces), bytes(body))))
        laces, body, done, number = bytearray(), bytearray(), NO_PACKET, number + 1

    for k, (data, granule) in enumerate(packets):
        at, left = 0, True
        if not laces:
            first = k
        while left:
            if len(laces) == LACES:
                close((CONTINUED if opened else 0) | (0 if number else FIRST))
                opened, first = at > 0, k
            n = min(255, len(data) - at)
            laces.append(n)
            body += data[at : at + n]
            at, left = at + n, n == 255
        done = granule
        if k == 0 or k == len(packets) - 1:  # headers have a page of their own
            close((CONTINUED if opened else 0) | (0 if number else FIRST) | (LAST if k == len(packets) - 1 else 0))
            opened = False
    return out


def header(extra: int) -> bytes:
    """Identification of uncompressed unsigned 8-bit samples, one channel."""
    return HEADER.pack(b"PCM     ", 0, 0, 1, RATE, 8, 1, RUN, extra)


def mux(payload: bytes) -> bytes:
    streams: list[list[tuple[bytes, int]]] = [[(header(0), 0)] for _ in SERIALS]
    for k, lo in enumerate(range(0, len(payload), RUN)):
        s = streams[k % len(SERIALS)]
        run = payload[lo : lo + RUN]
        s.append((run, s[-1][1] + len(run)))
    every = [(first, turn, data) for turn, (serial, s) in enumerate(zip(SERIALS, streams)) for first, data in pages_of(serial, s)]
    every.sort(key=lambda x: x[:2])  # stable: pages of one stream keep their order
    return b"".join(x[2] for x in every)


def demux(media: bytes) -> tuple[dict[int, list[tuple[bytes, float | None]]], int]:
    """By serial number, the packets with the time in seconds at their end, where a page gives it; and the number of pages."""
    at, streams, state, pages = 0, {}, {}, 0
    while at < len(media):
        if len(media) - at < PAGE.size:
            raise ValueError(f"cut page at {at}")
        capture, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(media, at)
        if capture != CAPTURE or version != VERSION:
            raise ValueError(f"no page at {at}")
        laces = media[at + PAGE.size : at + PAGE.size + n]
        start = at + PAGE.size + n
        end = start + sum(laces)
        if len(laces) < n or end > len(media):
            raise ValueError(f"cut page at {at}")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum at {at}")
        s = state.setdefault(serial, {"next": 0, "part": bytearray(), "open": False, "ended": False})
        if number != s["next"] or s["ended"] or bool(flags & FIRST) != (number == 0) or bool(flags & CONTINUED) != s["open"]:
            raise ValueError(f"page out of order at {at}")
        packets = streams.setdefault(serial, [])
        last = None
        for lace in laces:
            s["part"] += media[start : start + lace]
            start += lace
            s["open"] = lace == 255
            if not s["open"]:
                last = len(packets)
                packets.append((bytes(s["part"]), None))
                s["part"] = bytearray()
        if last is not None and granule != NO_PACKET:
            packets[last] = (packets[last][0], granule / RATE)
        s["next"], s["ended"], at = number + 1, bool(flags & LAST), end
        pages += 1
    if any(s["open"] or not s["ended"] for s in state.values()):
        raise ValueError("a stream has no end")
    return streams, pages


def payload_of(streams: dict[int, list[tuple[bytes, float | None]]]) -> bytes:
    for packets in streams.values():
        kind = HEADER.unpack(packets[0][0][: HEADER.size])
        if kind[0] != b"PCM     " or kind[3:7] != (1, RATE, 8, 1):
            raise ValueError("not unsigned 8-bit samples")
    queues = [[p for p, _ in streams[s][1:]] for s in SERIALS]
    return b"".join(q[k] for k in range(max(map(len, queues))) for q in queues if k < len(q))


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % PAD or (0 if raw else PAD))


def features(payload: bytes, streams: dict, pages: int) -> str:
    ends = [next((t for _, t in reversed(streams[s]) if t is not None), 0.0) for s in SERIALS]
    packets = [len(streams[s]) for s in SERIALS]
    zeros = payload.count(0)
    return f"streams={len(streams)};packets={packets[0]},{packets[1]};pages={pages};ends={ends[0]:.6f},{ends[1]:.6f};sum={sum(payload)};zeros={zeros}"


def described(raw: bytes) -> list:
    stored = mux(padded(raw))
    streams, pages = demux(stored)
    payload = payload_of(streams)
    return [
        len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]),
        len(stored), hashlib.sha256(stored).hexdigest(), features(payload, streams, pages),
    ]


FIELDS = (
    ("n_bytes", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"),
    ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string"),
)


def _mapped(df: DataFrame, id_col: str, text_col: str, row, fields) -> DataFrame:
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [row(x) for x in b.column("raw").to_pylist()]
            made = [pa.array([r[k] for r in rows], f[1]) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=[id_col, *(f[0] for f in fields)])

    sent = df.select(F.col(id_col), as_bytes(text_col).alias("raw"))
    return sent.mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{f[0]} {f[2]}" for f in fields)]))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and media, the text's bytes as an Ogg file."""
    return _mapped(df, id_col, text_col, lambda raw: [mux(padded(raw))], (("media", pa.binary(), "binary"),))


def describe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and FIELDS, from the bytes as stored and read back."""
    return _mapped(df, id_col, text_col, described, FIELDS)
