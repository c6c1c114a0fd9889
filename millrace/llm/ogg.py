"""Ogg media columns: pages, packets, logical streams and timestamps.

``mux`` writes logical streams of packets into an Ogg bit stream, ``demux``
reads one back: it checks each page's checksum and sequence number,
reassembles packets from the lacing values over page borders, separates the
logical streams by serial number and derives times from granule positions.

The page checksum is the CRC with polynomial 0x04C11DB7, not reflected, with
zero initial value.  It is computed as the reflected CRC of the bit-reversed
bytes, which zlib has in C.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

RATE = 8000
PACKET = 4096
AUDIO, INDEX = 0x41554430, 0x49445830
MAGIC = b"PCM8"
CONTINUED, FIRST, LAST = 1, 2, 4
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """A stream that breaks the container's rules."""


def page_crc(page: bytes) -> int:
    c = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Stream:
    """A logical stream: its packets, and per packet the granule position of the page on which it ends (-1: none)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    closed: bool = False


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of one stream; packets come with the granule position after them. The first packet has a page of its own."""
    seq, lacing, body, granule, flags = 0, bytearray(), [], -1, FIRST

    def page(last: bool) -> bytes:
        head = struct.pack("<4sBBqIII", b"OggS", 0, flags | (LAST if last else 0), granule, serial, seq, 0) + bytes([len(lacing)]) + bytes(lacing)
        raw = head + b"".join(body)
        return raw[:22] + struct.pack("<I", page_crc(raw)) + raw[26:]

    for k, (packet, after) in enumerate(packets):
        at, left = 0, len(packet) // 255 + 1
        while left:
            room = min(left, 255 - len(lacing))
            take = min(room * 255, len(packet) - at)
            lacing += b"\xff" * (room - 1) + bytes([255 if room < left else len(packet) % 255])
            body.append(packet[at : at + take])
            at, left = at + take, left - room
            if not left:
                granule = after
            if len(lacing) == 255 and (left or k + 1 < len(packets)):
                yield page(False)
                seq, lacing, body, granule, flags = seq + 1, bytearray(), [], -1, CONTINUED if left else 0
        if k == 0 and len(packets) > 1 and lacing:
            yield page(False)
            seq, lacing, body, granule, flags = seq + 1, bytearray(), [], -1, 0
    yield page(True)


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """One bit stream of the given streams: first pages first, then the others by turns."""
    runs = [list(_pages(serial, packets)) for serial, packets in streams.items()]
    out = [r[0] for r in runs]
    for i in range(1, max(map(len, runs), default=0)):
        out += [r[i] for r in runs if i < len(r)]
    return b"".join(out)


def demux(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number; OggError on any damage."""
    streams: dict[int, Stream] = {}
    open_: dict[int, list[bytes]] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27 or data[at : at + 4] != b"OggS":
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, seq, crc, n = struct.unpack_from("<4sBBqIIIB", data, at)
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            raise OggError(f"bad page at byte {at}")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        if bool(flags & FIRST) == (serial in streams):
            raise OggError(f"stream {serial} begins twice or not at all")
        s = streams.setdefault(serial, Stream(serial))
        if s.closed or seq != s.pages:
            raise OggError(f"page {seq} of stream {serial} is out of order")
        if bool(flags & CONTINUED) != bool(open_.get(serial)):
            raise OggError(f"page {seq} of stream {serial} doesn't continue its packet")
        s.pages += 1
        parts = open_.pop(serial, [])
        run = 0
        for x in lacing:
            run += x
            if x < 255:
                s.packets.append(b"".join([*parts, data[body : body + run]]))
                s.granules.append(-1)
                body, run, parts = body + run, 0, []
                ended = len(s.packets)
        if run or (lacing and lacing[-1] == 255):
            open_[serial] = [*parts, data[body : body + run]]
        if granule >= 0:
            if not any(x < 255 for x in lacing):
                raise OggError("a granule position on a page on which no packet ends")
            s.granules[ended - 1] = granule
        s.closed = bool(flags & LAST)
        at = end
    if any(open_.values()) or not all(s.closed for s in streams.values()):
        raise OggError("the stream ends within a packet")
    return streams


def seconds(granule: int, rate: int) -> float:
    return granule / rate


def encode_pcm8(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit samples as an Ogg stream of two logical streams: the samples, and an index of packet starts."""
    header = MAGIC + struct.pack("<IQ", rate, len(samples))
    cuts = range(0, len(samples), PACKET)
    audio = [(header, 0)] + [(samples[i : i + PACKET], min(i + PACKET, len(samples))) for i in cuts]
    index = [(b"INDX" + struct.pack("<I", PACKET), 0)] + [(struct.pack(f"<{len(cuts)}Q", *cuts), len(samples))]
    return mux({AUDIO: audio, INDEX: index})


def decode_pcm8(data: bytes) -> tuple[bytes, int, dict[int, Stream]]:
    """Samples, rate and streams of ``encode_pcm8``'s output; packets are checked against index, header and times."""
    streams = demux(data)
    if set(streams) != {AUDIO, INDEX} or not streams[AUDIO].packets[0].startswith(MAGIC):
        raise OggError("not a stream of 8-bit samples")
    audio, index = streams[AUDIO], streams[INDEX]
    rate, n = struct.unpack_from("<IQ", audio.packets[0], len(MAGIC))
    samples = b"".join(audio.packets[1:])
    starts = np.frombuffer(index.packets[1], dtype="<u8")
    sizes = np.fromiter(map(len, audio.packets[1:]), dtype=np.int64)
    if len(samples) != n or audio.granules[-1] != n or not np.array_equal(np.cumsum(sizes) - sizes, starts.astype(np.int64)):
        raise OggError("packets, index and granule positions differ")
    return samples, rate, streams


def pad64(raw: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))


def features(samples: bytes, rate: int, streams: dict[int, Stream]) -> str:
    """Integer features of the decoded samples and of the container."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    last = max(streams[AUDIO].granules)
    return f"ms={round(1000 * seconds(last, rate))};pages={sum(s.pages for s in streams.values())};packets={len(streams[AUDIO].packets)};sum={x.sum()};energy={(x * x).sum()};peak={np.abs(x).max()};crossings={crossings}"


SCHEMA = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
_DDL = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def ogg_media(df: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """Key, the media column (with ``keep_media``) and what was read back from it, per row.

    Null text counts as empty; any text length is taken whole; equal texts
    give equal values; other columns of ``df`` aren't read.  A damaged stream
    raises.  Rows are handled one at a time, without a shuffle.
    """
    src = df.select(df[f"`{key}`"].alias("k"), df[f"`{text}`"].cast("string").alias("t"))
    kind = dict(src.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # rows go out in groups, so that the media of a batch are never held together
            step = 64 if keep_media else len(b) or 1
            for lo in range(0, len(b), step):
                part = b.slice(lo, step)
                rows = []
                for t in part.column(1):
                    raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                    media = encode_pcm8(pad64(raw))
                    back, rate, streams = decode_pcm8(media)
                    rows.append((media, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(back, rate, streams)))
                cols = list(zip(*rows, strict=True))
                out = [part.column(0)] + ([pa.array(cols[0], pa.binary())] if keep_media else []) + [pa.array(c, f.type) for c, f in zip(cols[1:], SCHEMA, strict=True)]
                yield pa.RecordBatch.from_arrays(out, names=["k"] + ["media"] * keep_media + SCHEMA.names)

    return src.mapInArrow(run, f"k {kind}, " + "media binary, " * keep_media + _DDL).withColumnRenamed("k", key)


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_media(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_media=False)


QUERIES = {"op10_ogg": op10_ogg}
ORACLES: dict[str, str] = {}
