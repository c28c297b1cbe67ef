"""MPEG audio columns: read frames, tags, variable-bitrate tables and checksums; write payloads as streams.

read() takes the bytes of a stream as they are found: it skips ID3v2 and ID3v1 tags, finds frame headers,
resynchronises over anything that is no frame, reads a Xing, Info or VBRI table (with its seek points, and the
encoder's delay and padding where they are told), verifies the CRC of protected frames of all layers, and gives the exact
duration (samples over rate) and the byte offset of every frame. write() stores any bytes losslessly: silent Layer III frames of one channel, with no main data, hold
them as ancillary data; an ID3v2 tag tells their number and a Xing table the frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared

# kbit/s by (MPEG 1, layer) and by layer of MPEG 2 and 2.5, for bitrate indices 1 to 14.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Hz by the header's version bits (0: MPEG 2.5, 2: MPEG 2, 3: MPEG 1).
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

# Bits of an allocation by subband in Layer II, ISO 11172-3 tables B.2a to B.2d, and ISO 13818-3 table B.1.
ALLOCATION_BITS = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "lsf": (4,) * 4 + (3,) * 7 + (2,) * 19,
}

UNIT = 64
#: Of the written streams: Layer III, 48 kHz, one channel: a frame has 3 bytes a kbit/s, no padding is needed.
_RATE, _SIDE, _HEAD = 48000, 17, 4 + 2 + 17
_SAMPLES = 1152


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    rate: int
    channels: int
    length: int
    samples: int
    side: int
    kbit: int
    #: subbands from here on share their allocation between the channels
    bound: int


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The frame header in these four bytes, or None. Free-format streams are not known."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer, bitrate, rate = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    first, padding = version == 3, four[2] >> 1 & 1
    kbit, hz, channels = BITRATES[1 if first else 2, layer][bitrate - 1], RATES[version][rate], 1 if four[3] >> 6 == 3 else 2
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12000 * kbit // hz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbit // hz + padding
    side = (32 if channels == 2 else 17) if first else (17 if channels == 2 else 9)
    bound = (four[3] >> 4 & 3) * 4 + 4 if four[3] >> 6 == 1 else 32
    return Header(version, layer, not four[1] & 1, hz, channels, length, samples, side, kbit, bound)


_CRC = []
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1 ^ 0x8005 if _c & 0x8000 else _c << 1) & 0xFFFF
    _CRC.append(_c)


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The CRC of MPEG audio: polynomial 0x8005 from 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


def crc16_bits(value: int, n_bits: int, crc: int = 0xFFFF) -> int:
    """The same CRC over the n_bits bits of value, first ones first."""
    for i in range(n_bits - 1, -1, -1):
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ (value >> i & 1) else 0)
    return crc


def _layer2_bits(h: Header) -> tuple[int, ...]:
    each = h.kbit // h.channels
    if h.version != 3:
        return ALLOCATION_BITS["lsf"]
    if each <= 48:
        return ALLOCATION_BITS["d" if h.rate == 32000 else "c"]
    return ALLOCATION_BITS["a" if h.rate == 48000 or each <= 80 else "b"]


def crc_holds(frame: bytes, h: Header) -> bool:
    """Whether the checksum of a protected frame is that of what it covers.

    That is the header's last two bytes and: in Layer I the allocations, in Layer II these and the scale factor selections,
    in Layer III the side information.
    """
    stated = int.from_bytes(frame[4:6], "big")
    if h.layer == 3:
        return crc16(frame[2:4] + frame[6 : 6 + h.side]) == stated
    body = int.from_bytes(frame[6:70].ljust(64, b"\0"), "big")  # more than either layer covers
    at, chosen = 0, 0

    def take(n: int) -> int:
        nonlocal at
        at += n
        return body >> (512 - at) & (1 << n) - 1

    if h.layer == 1:
        at = 4 * (h.channels * min(h.bound, 32) + max(0, 32 - h.bound))
    else:
        for band, n in enumerate(_layer2_bits(h)):
            if band < h.bound:
                chosen += sum(take(n) > 0 for _ in range(h.channels))
            else:
                chosen += h.channels * (take(n) > 0)
        at += 2 * chosen
    return crc16_bits(body >> (512 - at), at, crc16(frame[2:4])) == stated


@dataclass
class Stream:
    """What read() found; offsets has a byte offset for each audio frame, a table's frame is none."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    crc_good: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    skipped: int = 0

    @property
    def samples(self) -> int:
        """Of all frames; the encoder's delay and padding, where the table tells them, are among them."""
        return sum(h.samples for h in self.headers)

    @property
    def played_samples(self) -> int:
        """Without the encoder's delay and padding."""
        table = self.table or {}
        return max(0, self.samples - table.get("delay", 0) - table.get("padding", 0))

    @property
    def rate(self) -> int:
        return self.headers[0].rate if self.headers else 0

    @property
    def duration_ns(self) -> int:
        """Rounded down; exact is the sum of samples over rate."""
        by: dict[int, int] = {}
        for h in self.headers:
            by[h.rate] = by.get(h.rate, 0) + h.samples
        return sum(n * 1_000_000_000 // r for r, n in by.items())


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(b: bytes) -> str:
    coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(b[0] if b else 0, "latin-1")
    return b[1:].decode(coding, "replace").rstrip("\0")


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Read the tag that starts here, version 2.2 to 2.4; where it ends.

    Unsynchronisation is undone, for the whole tag or (2.4) by frame; an extended header is passed over. Frames that are
    compressed or encrypted are left out.
    """
    major, flags, size = data[at + 3], data[at + 5], _synchsafe(data[at + 6 : at + 10])
    end = min(len(data), at + 10 + size + (10 if major == 4 and flags & 0x10 else 0))
    body = data[at + 10 : min(len(data), at + 10 + size)]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    i = 0
    if flags & 0x40 and major > 2:
        i = _synchsafe(body[:4]) if major == 4 and len(body) >= 4 else int.from_bytes(body[:4], "big") + 4
    wide = 3 if major == 2 else 4
    head = 6 if major == 2 else 10
    while major in (2, 3, 4) and i + head <= len(body) and body[i : i + wide].isalnum():
        name, stated = body[i : i + wide].decode("ascii"), body[i + wide : i + 2 * wide]
        n = _synchsafe(stated) if major == 4 else int.from_bytes(stated, "big")
        how = body[i + 9] if major > 2 else 0
        content = body[i + head : i + head + n]
        i += head + n
        if how & (0xC0 if major == 3 else 0x0C):
            continue
        if major == 4:
            content = content[4:] if how & 0x01 else content
            content = content.replace(b"\xff\x00", b"\xff") if how & 0x02 else content
        if name in ("TXXX", "TXX"):
            key, _, value = _text(content).partition("\0")
            tags[f"TXXX:{key}"] = value
        elif name[0] == "T":
            tags[name] = _text(content)
    return end


def _table(frame: bytes, h: Header) -> dict | None:
    """The variable-bitrate table in a Layer III frame, or None."""
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        kind, flags = frame[at : at + 4].decode(), int.from_bytes(frame[at + 4 : at + 8], "big")
        out, at = {"kind": kind}, at + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4:
            out["toc"], at = frame[at : at + 100], at + 100
        if flags & 8:
            out["quality"], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if frame[at : at + 1].isalpha() and at + 24 <= len(frame):  # the encoder's name, its settings, then delay and padding
            both = int.from_bytes(frame[at + 21 : at + 24], "big")
            out |= {"encoder": frame[at : at + 9].decode("latin-1").strip(" \0"), "delay": both >> 12, "padding": both & 0xFFF}
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        quality, n_bytes, frames, points, scale, wide, each = struct.unpack(">HIIHHHH", frame[44:62])
        out = {"kind": "VBRI", "frames": frames, "bytes": n_bytes, "quality": quality, "frames_per_point": each}
        if 1 <= wide <= 4 and 62 + points * wide <= len(frame):
            out["points"] = [scale * int.from_bytes(frame[62 + wide * k : 62 + wide * (k + 1)], "big") for k in range(points)]
        return out
    return None


def _fills(data: bytes, at: int) -> bool:
    """Whether frames of one version, layer and rate follow one another from here to the very end."""
    kind = None
    while h := header(data[at : at + 4]):
        if kind not in (None, (h.version, h.layer, h.rate)):
            return False
        kind, at = (h.version, h.layer, h.rate), at + h.length
    return kind is not None and at == len(data)


def read(data: bytes) -> Stream:
    """Read a stream. Bytes that are no tag and no frame are skipped and counted, each run as one resync.

    A header counts only if its frame fits and is followed by another header of the same version, layer and
    rate, by a tag, or by the end; so marks that stand in a frame's data by chance don't lead astray. A cut
    last frame is skipped. "TAG" before the last 125 bytes is a tag, unless a frame spans it and frames go on to the end.
    """
    out, at, end, lost = Stream(), 0, len(data), False
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    while at < end:
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at, lost = _id3v2(data, at, out.tags), False
            continue
        h = header(data[at : at + 4])
        if h and not lost and end < len(data) and at + h.length > end and _fills(data, at):
            end = len(data)
        if h and at + h.length <= end:
            after = at + h.length
            follows = header(data[after : after + 4]) if after + 4 <= end else None
            same = follows and (follows.version, follows.layer, follows.rate) == (h.version, h.layer, h.rate)
            if after == end or same or data[after : after + 3] == b"ID3" or (not lost and out.headers and (out.headers[-1].version, out.headers[-1].layer, out.headers[-1].rate) == (h.version, h.layer, h.rate)):
                if h.protected:
                    good = crc_holds(data[at:after], h)
                    out.crc_good, out.crc_bad = out.crc_good + good, out.crc_bad + (not good)
                table = _table(data[at:after], h) if h.layer == 3 and not out.headers and out.table is None else None
                if table:
                    out.table = table
                else:
                    out.offsets.append(at)
                    out.headers.append(h)
                at, lost = after, False
                continue
        out.resyncs, lost = out.resyncs + (not lost), True
        found = data.find(b"\xff", at + 1, end)
        tag = data.find(b"ID3", at + 1, found if found >= 0 else end)
        to = tag if tag >= 0 else found if found >= 0 else end
        out.skipped, at = out.skipped + to - at, to
    if end < len(data):
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
            if value := data[end + a : end + b].rstrip(b"\0 ").decode("latin-1"):
                out.tags[f"v1:{name}"] = value
    return out


@lru_cache(maxsize=64)
def _head(kbit: int) -> bytes:
    """Header, CRC and side information of a protected silent frame."""
    top = bytes((0xFF, 0xFA, (BITRATES[1, 3].index(kbit) + 1) << 4 | 1 << 2, 0xC0))
    return top + crc16(top[2:] + bytes(_SIDE)).to_bytes(2, "big") + bytes(_SIDE)


def write(payload: bytes) -> bytes:
    """A stream that holds the payload: ID3v2 tag, frame with a Xing table, frames of as many bytes as needed."""
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        kbit = next((k for k in BITRATES[1, 3] if 3 * k - _HEAD >= left), 320)
        room = 3 * kbit - _HEAD
        frames.append(_head(kbit) + payload[at : at + room].ljust(room, b"\0"))
        at += room
    body = b"\0payload\0" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(body), 0) + body
    size = len(tag)
    id3 = b"ID3\x03\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + tag
    total = 3 * 64 + sum(map(len, frames))
    starts, here = [], 3 * 64
    for f in frames:
        starts.append(here)
        here += len(f)
    toc = bytes(min(255, starts[len(frames) * i // 100] * 256 // total) if frames else 0 for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return id3 + (_head(64) + xing).ljust(3 * 64, b"\0") + b"".join(frames)


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The bytes that write() stored. Raises ValueError if the stream is damaged."""
    n = int(stream.tags.get("TXXX:payload", -1))
    if n < 0 or stream.crc_bad or stream.skipped or stream.table is None or stream.table["frames"] != len(stream.offsets):
        raise ValueError("no whole payload in this stream")
    got = b"".join(data[o + _HEAD : o + h.length] for o, h in zip(stream.offsets, stream.headers, strict=True))
    if len(got) < n:
        raise ValueError("the stream ends within its payload")
    return got[:n]


def padded(text: bytes | None) -> bytes:
    """The text's bytes and bytes 0 up to a positive multiple of UNIT."""
    text = text or b""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def _encoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        texts = batch.column(1).to_pylist()
        yield pa.record_batch([batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([write(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as an MPEG stream, one row for each row of docs.

    n_bytes counts the text's UTF-8 bytes, media holds them padded. A null text is an empty one, of 64 bytes 0.
    """
    prepared(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_encoded, f"doc_id {kind}, n_bytes bigint, media binary")


FIELDS = (
    "frames bigint, samples bigint, sample_rate int, duration_ns bigint, crc_good bigint, crc_bad bigint, resyncs bigint, skipped_bytes bigint, "
    "vbr_kind string, vbr_frames bigint, vbr_bytes bigint, tags map<string,string>, seek_offsets array<bigint>"
)
_NAMES = [f.strip().split(" ")[0] for f in FIELDS.replace("map<string,string>", "map").split(",")]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64())]


def _fields(s: Stream) -> tuple:
    t = s.table or {}
    return (len(s.offsets), s.samples, s.rate, s.duration_ns, s.crc_good, s.crc_bad, s.resyncs, s.skipped, t.get("kind"), t.get("frames"), t.get("bytes"), list(s.tags.items()), s.offsets)


def _probed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = [_fields(read(m)) if m is not None else (None,) * len(_TYPES) for m in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.record_batch([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)]], names=["id", *_NAMES])


def probe(media: DataFrame, id_column: str, column: str = "media") -> DataFrame:
    """(id, FIELDS): what read() finds in each stream of a binary column. Null streams have null fields."""
    prepared(media.sparkSession)
    kind = dict(media.dtypes)[id_column]
    return media.select(F.col(id_column).alias("id"), F.col(column).alias("media_")).mapInArrow(_probed, f"id {kind}, {FIELDS}")


def _digested(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        out = []
        for m in batch.column(2).to_pylist():
            s = read(m)
            p = payload_of(m, s)
            seek = hashlib.sha256(struct.pack(f">{len(s.offsets)}Q", *s.offsets)).hexdigest()[:16]
            feature = f"mpeg1-layer3 {s.rate}Hz frames={len(s.offsets)} samples={s.samples} crc={s.crc_good}/{s.crc_good + s.crc_bad} resyncs={s.resyncs} xing={s.table['frames']}:{s.table['bytes']} seek={seek}"
            out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature, len(s.offsets), s.duration_ns, s.offsets))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "duration_ns", "seek_offsets"]
        yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array([o[i] for o in out], t) for i, t in enumerate(types)]], names=["doc_id", "n_bytes", *names])


def digest(encoded: DataFrame) -> DataFrame:
    """Read the streams of encode() back: payload and media digests, and features; a damaged stream raises.

    One row for each row; an empty table gives an empty result.
    """
    prepared(encoded.sparkSession)
    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "n_bytes", "media").mapInArrow(
        _digested,
        f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, "
        "feature string, frames bigint, duration_ns bigint, seek_offsets array<bigint>",
    )
