"""Media columns: MPEG audio written from payload bytes and read back, frame by frame.

``encode`` carries bytes in the ancillary data of silent MPEG-1 Layer III frames (32 kHz, mono, checksummed): an ID3v2
tag, a variable-bitrate table, frames of 320 kbit/s with two units of 576 bytes each, one of 160 kbit/s for an odd last
unit, and an ID3v1 tag. ``parse`` reads any MPEG audio stream (versions 1, 2, 2.5; layers I to III): it reads the text
frames of ID3v2 tags (2.2 to 2.4) and the fields of ID3v1, finds frame headers again after foreign bytes, reads Xing,
Info and VBRI tables with their seek points, verifies the checksums of protected frames of every layer, and gives exact
durations and the offset of every frame.

Defined cases: null text is empty and makes one unit of filling; equal texts give equal bytes; bytes without any frame
parse to zero frames; a stream cut off in its last frame keeps the frames before it and counts the rest as skipped;
repeated rows and null ids each get their row; columns of the input other than the id and the text are not read.
"""

from __future__ import annotations

import binascii
import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT, FILL = 576, b"\xff"
TAIL = 32

# Fixed values of the MPEG audio format.
#: kbit/s by header index 1 to 14, for (MPEG-1?, layer).
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Samples a second by header index, for the version bits.
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Bytes of side information of Layer III, for (MPEG-1?, mono?).
SIDE = {(True, True): 17, (True, False): 32, (False, True): 9, (False, False): 17}
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF
#: Layer II: (first subband, bits of its allocation) by table; the number of subbands is chosen with the table.
ALLOCATION_HIGH, ALLOCATION_LOW, ALLOCATION_HALF = ((0, 4), (11, 3), (23, 2)), ((0, 4), (2, 3)), ((0, 4), (4, 3), (11, 2))
#: Fields of an ID3v1 tag: (name, first byte, length).
ID3V1 = (("title", 3, 30), ("artist", 33, 30), ("album", 63, 30), ("year", 93, 4), ("comment", 97, 30))
#: Codecs of ID3v2 text by its first byte.
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    bound: int
    length: int
    samples: int

    @property
    def side(self) -> int:
        return SIDE[self.version == 3, self.mono]


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """What four header bytes say; None if they are no header (free format is not taken)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    kbit, hz, padding = raw[2] >> 4, raw[2] >> 2 & 3, raw[2] >> 1 & 1
    if version == 1 or layer == 4 or kbit in (0, 15) or hz == 3 or raw[3] & 3 == 2:
        return None
    first = version == 3
    kbps, rate = BITRATES[first, layer][kbit - 1], RATES[version][hz]
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    slot = 4 if layer == 1 else 1
    length = (samples // 8 // slot * kbps * 1000 // rate + padding) * slot
    joint = raw[3] >> 6 == 1 and layer < 3  # subbands from the bound on share their allocation
    return Header(version, layer, not raw[1] & 1, kbps, rate, raw[3] >> 6 == 3, 4 * (raw[3] >> 4 & 3) + 4 if joint else 32, length, samples)


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The format's checksum, most significant bit first."""
    crc = CRC_START
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _subbands(h: Header) -> list[int]:
    """Bits of each subband's allocation in a Layer II frame."""
    kbps = h.kbps if h.mono else h.kbps // 2
    if h.version != 3:
        n, steps = 30, ALLOCATION_HALF
    elif kbps < 56:
        n, steps = 12 if h.rate == 32000 else 8, ALLOCATION_LOW
    else:
        n, steps = 30 if kbps >= 96 and h.rate != 48000 else 27, ALLOCATION_HIGH
    return [next(bits for first, bits in reversed(steps) if first <= sb) for sb in range(n)]


def protected_bits(frame: bytes, h: Header) -> int:
    """How many bits after the checksum it covers: side information, or allocations (and, in Layer II, scale factor selections)."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    if h.layer == 1:
        return 4 * sum(channels if sb < h.bound else 1 for sb in range(32))
    value, at, used = int.from_bytes(frame[6:66].ljust(60, b"\0"), "big"), 0, 0
    for sb, bits in enumerate(_subbands(h)):
        for _ in range(channels if sb < h.bound else 1):
            at += bits
            if value >> 480 - at & (1 << bits) - 1:
                used += 1 if sb < h.bound else channels
    return at + 2 * used


def checksum(frame: bytes, h: Header) -> int:
    """The checksum that a protected frame should have."""
    n = protected_bits(frame, h)
    crc = crc16(frame[2:4] + frame[6 : 6 + n // 8])
    for k in range(n % 8):
        bit = frame[6 + n // 8] >> 7 - k & 1
        crc = (crc << 1 ^ (CRC_POLYNOMIAL if (crc >> 15) ^ bit else 0)) & 0xFFFF
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the payload: those bytes and filling up to a positive multiple of UNIT)."""
    data = (text or "").encode("utf-8")
    return len(data), data + FILL * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


@lru_cache(maxsize=8)
def _frame_start(units: int) -> bytes:
    """Header, checksum and silent side information of a frame that carries ``units`` units."""
    head = bytes((0xFF, 0xFA, (14 if units == 2 else 10) << 4 | 2 << 2, 3 << 6))
    side = bytes(17)
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


def encode(payload: bytes) -> bytes:
    """An MPEG audio stream that carries ``payload`` (a positive multiple of UNIT bytes)."""
    units = len(payload) // UNIT
    sizes = [2] * (units // 2) + [1] * (units % 2)
    frames, at = [], 0
    for n in sizes:
        body = _frame_start(n) + payload[at : at + n * UNIT]
        frames.append(body.ljust(720 * n, b"\0"))
        at += n * UNIT
    head = bytes((0xFF, 0xFB, 10 << 4 | 2 << 2, 3 << 6))
    total = 720 + 720 * units
    starts = [720 + 1440 * i for i in range(len(frames))]
    toc = bytes(min(255, 256 * starts[len(starts) * p // 100] // total) for p in range(100))
    table = (head + bytes(17) + b"Xing" + struct.pack(">III", 15, len(frames), total) + toc + struct.pack(">I", 0)).ljust(720, b"\0")
    note = b"\0payload\0" + f"bytes={len(payload)};crc32={zlib.crc32(payload):08x}".encode()
    tag = b"TXXX" + struct.pack(">IH", len(note), 0) + note
    return b"".join((b"ID3\3\0\0", _syncsafe(len(tag)), tag, table, *frames, b"TAG".ljust(128, b"\0")))


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int = 0
    table_bytes: int = 0
    toc: bytes = b""
    seek: list[int] = field(default_factory=list)
    skipped: int = 0
    checked: int = 0
    broken: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def duration_us(self) -> int:
        """Exact to the microsecond below; frames of unlike rates count by their own."""
        by_rate: dict[int, int] = {}
        for h in self.headers:
            by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
        return sum(n * 1_000_000 // rate for rate, n in by_rate.items())


def _number(raw: bytes, syncsafe: bool) -> int:
    out = 0
    for b in raw:
        out = out << 7 | b & 0x7F if syncsafe else out << 8 | b
    return out


def _id3v2(data: bytes, at: int, out: Stream) -> int:
    """Reads the tag at ``at`` and gives the place after it; text frames go into ``out.tags`` by id or, user texts, by name."""
    major, flags, size = data[at + 3], data[at + 5], _number(data[at + 6 : at + 10], True)
    body = data[at + 10 : at + 10 + size]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    place = 0
    if flags & 0x40 and major > 2:  # an extended header
        place = _number(body[:4], True) if major == 4 else 4 + _number(body[:4], False)
    head, name_size = (6, 3) if major == 2 else (10, 4)
    while place + head <= len(body) and body[place]:
        name = body[place : place + name_size].decode("latin-1")
        length = _number(body[place + name_size : place + 2 * name_size], major == 4)
        raw = body[place + head : place + head + length]
        if major == 4 and flags & 0x80:
            raw = raw.replace(b"\xff\0", b"\xff")
        if name.startswith("T") and raw and raw[0] < len(ENCODINGS):
            text = raw[1:].decode(ENCODINGS[raw[0]], "replace")
            if name in ("TXXX", "TXX"):
                name, _, text = text.partition("\0")
                text = text.removeprefix("\ufeff")
            out.tags[name] = text.rstrip("\0")
        place += head + length
    return at + 10 + size + (10 if major == 4 and flags & 0x10 else 0)


def _id3v1(raw: bytes, out: Stream) -> None:
    for name, first, n in ID3V1:
        if text := raw[first : first + n].partition(b"\0")[0].decode("latin-1").rstrip():
            out.tags[f"v1.{name}"] = text
    if raw[125] == 0 and raw[126]:
        out.tags["v1.track"] = str(raw[126])


def _table(frame: bytes, h: Header, out: Stream) -> bool:
    """Reads a variable-bitrate table, if the frame has one; ``out.seek`` gets byte places counted from the frame."""
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.table, (out.table_bytes, out.table_frames, entries, scale, width) = "VBRI", struct.unpack(">IIHHH", frame[46:60])
        place = 0
        for k in range(entries if width else 0):
            place += _number(frame[62 + k * width : 62 + (k + 1) * width], False) * scale
            out.seek.append(place)
        return True
    at = 4 + h.side
    name = frame[at : at + 4]
    if h.layer != 3 or name not in (b"Xing", b"Info"):
        return False
    out.table, flags, at = name.decode(), int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
    for bit, what, n in ((1, "table_frames", 4), (2, "table_bytes", 4), (4, "toc", 100)):
        if flags & bit:
            raw, at = frame[at : at + n], at + n
            setattr(out, what, raw if bit == 4 else int.from_bytes(raw, "big"))
    out.seek = [b * out.table_bytes // 256 for b in out.toc] if out.table_bytes else []
    return True


def parse(data: bytes) -> Stream:
    """Tags, table and frames of a stream."""
    out, at = Stream(), 0
    while data[at : at + 3] == b"ID3":
        at = _id3v2(data, at, out)
    end = len(data)
    if data[-128:-125] == b"TAG" and end - 128 >= at:
        end -= 128
        _id3v1(data[end:], out)
    while at + 4 <= end:
        h = header(data[at : at + 4])
        follows = h and (at + h.length == end or at + h.length + 4 <= end and header(data[at + h.length : at + h.length + 4]))
        if not follows:  # foreign bytes: look for the next header that another one follows
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            out.skipped += found - at
            at = found
            continue
        if not out.offsets and not out.table and _table(data[at : at + h.length], h, out):
            at += h.length
            continue
        if h.protected:
            out.checked += 1
            out.broken += checksum(data[at : at + h.length], h) != int.from_bytes(data[at + 4 : at + 6], "big")
        out.offsets.append(at)
        out.headers.append(h)
        at += h.length
    out.skipped += max(0, end - at)
    return out


def payload_in(data: bytes, stream: Stream) -> bytes:
    """The payload that ``encode`` stored, taken from the frames; an error if its tag's checksum does not match."""
    parts = []
    for at, h in zip(stream.offsets, stream.headers, strict=True):
        start = at + 6 + h.side
        parts.append(data[start : start + h.length // 720 * UNIT])
    payload = b"".join(parts)
    said = dict(x.split("=") for x in stream.tags.get("payload", "").split(";") if x)
    if said and (int(said["bytes"]) != len(payload) or int(said["crc32"], 16) != binascii.crc32(payload)):
        raise ValueError("the frames do not hold the payload that the tag describes")
    return payload


def _mpeg_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: encode(payload_of(t)[1]))


#: What ``described`` finds in a stream.
FOUND = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, frame_offsets array<long>"


def _described(media: pd.Series) -> pd.DataFrame:
    rows = []
    for data in media:
        data = bytes(data)
        s = parse(data)
        payload = payload_in(data, s)
        feature = f"frames={len(s.offsets)};table={s.table}:{s.table_frames}:{s.table_bytes};duration_us={s.duration_us};crc={s.checked - s.broken}/{s.checked};skipped={s.skipped};seek50={s.toc[50] if s.toc else ''};first={s.offsets[0] if s.offsets else ''}"
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(data), hashlib.sha256(data).hexdigest(), feature, s.duration_us, s.offsets))
    return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_us", "frame_offsets"])


def media_column(text: Column) -> Column:
    """The text's bytes as an MPEG audio stream."""
    return F.pandas_udf(_mpeg_of, "binary")(text)


def described(media: Column) -> Column:
    """The stream read back: payload, checksums, duration and frame offsets, as a struct."""
    return F.pandas_udf(_described, FOUND)(media)


def media_features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as MPEG audio, read back, and described; one row for each row of ``documents``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = documents.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), described(media_column(text)).alias("m"))
    return made.select("doc_id", "n_bytes", "m.*")
