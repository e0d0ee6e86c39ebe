"""Ogg container: pages with checksums, lacing, multiplexed logical streams, granule positions.

A payload of bytes is stored as 8-bit samples of two channels, each channel a
logical stream of its own. Reading verifies every page's checksum, sorts pages
by serial number, reassembles packets from lacing values (also across pages) and
takes times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytewren.llm.common import map_rows, utf8

MULTIPLE, RATE, PACKET, SEGMENTS = 192, 8000, 4096, 255
HEAD = struct.Struct("<4sBBqIIIB")
IDENT = struct.Struct("<8sBBHIQ")  # magic, version, channel, reserved, rate, samples
MAGIC = b"BWPCM8\0\0"
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


class DamagedPage(ValueError):
    """A page is cut short, out of sequence or fails its checksum."""


def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04c11db7, most significant bit first, start 0 and no final inversion.

    It is zlib's CRC with the bits of every byte and of the result reversed.
    """
    return int(f"{zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def pages(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """The pages of one logical stream; the first packet gets a page of its own. granules: position after each packet."""
    segments: list[tuple[int, bool, int]] = []  # lacing value, starts a packet, packet
    out: list[bytes] = []

    def flush(part: list[tuple[int, bool, int]], body: bytes, last: bool) -> None:
        ended = [k for n, _, k in part if n < 255]
        flags = (CONTINUED if part and not part[0][1] else 0) | (0 if out else FIRST) | (LAST if last else 0)
        lacing = bytes(n for n, _, _ in part)
        head = HEAD.pack(b"OggS", 0, flags, granules[ended[-1]] if ended else -1, serial, len(out), 0, len(part))
        page = head + lacing + body
        out.append(page[:22] + struct.pack("<I", checksum(page)) + page[26:])

    def lace(k: int) -> list[tuple[int, bool, int]]:
        full, rest = divmod(len(packets[k]), 255)
        return [(255, i == 0, k) for i in range(full)] + [(rest, full == 0, k)]

    flush(lace(0), packets[0], len(packets) == 1)
    data = b"".join(packets[1:])
    for k in range(1, len(packets)):
        segments += lace(k)
    at = 0
    for i in range(0, len(segments), SEGMENTS):
        part = segments[i : i + SEGMENTS]
        n = sum(x[0] for x in part)
        flush(part, data[at : at + n], i + SEGMENTS >= len(segments))
        at += n
    return out


def write(payload: bytes) -> bytes:
    """The payload's even and odd bytes as two multiplexed streams; equal payloads make equal files."""
    base, streams = zlib.crc32(payload), []
    for channel in (0, 1):
        samples = payload[channel::2]
        cuts = range(0, len(samples), PACKET)
        packets = [IDENT.pack(MAGIC, 1, channel, 0, RATE, len(samples)), *(samples[i : i + PACKET] for i in cuts)]
        granules = [0, *(min(i + PACKET, len(samples)) for i in cuts)]
        streams.append(pages((base + channel) & 0xFFFFFFFF, packets, granules))
    return b"".join(page for i in range(max(map(len, streams))) for s in streams if i < len(s) for page in s[i : i + 1])


@dataclass
class Stream:
    """A logical stream: its whole packets, with the granule position of the page in which each ended."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    partial: bytes | None = None


def read(data: bytes) -> dict[int, Stream]:
    """All logical streams by serial number. Raises DamagedPage; b"" has no streams."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEAD.size:
            raise DamagedPage("a page header is cut short")
        magic, version, flags, granule, serial, number, crc, count = HEAD.unpack_from(data, at)
        lacing = data[at + HEAD.size : at + HEAD.size + count]
        body, end = at + HEAD.size + count, at + HEAD.size + count + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < count or end > len(data):
            raise DamagedPage(f"no whole page at byte {at}")
        if checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise DamagedPage(f"the page at byte {at} fails its checksum")
        if bool(flags & FIRST) != (serial not in streams):
            raise DamagedPage(f"stream {serial} begins twice or not at all")
        s = streams.setdefault(serial, Stream())
        if number != s.pages or bool(flags & CONTINUED) != (s.partial is not None) or s.ended:
            raise DamagedPage(f"page {number} of stream {serial} is out of sequence")
        s.pages, s.ended = s.pages + 1, bool(flags & LAST)
        start = body
        for n in lacing:
            body += n
            if n < 255:
                s.packets.append((s.partial or b"") + data[start:body])
                s.granules.append(granule)
                s.partial, start = None, body
        if start < body or (lacing and lacing[-1] == 255):
            s.partial = (s.partial or b"") + data[start:body]
        at = end
    if any(not s.ended or s.partial is not None for s in streams.values()):
        raise DamagedPage("a stream has no end")
    return streams


def samples(data: bytes) -> tuple[bytes, dict[str, float]]:
    """The payload of ``write`` read back, and what the container tells: streams, pages, packets, seconds."""
    channels, facts = {}, {"streams": 0, "pages": 0, "packets": 0, "seconds": 0.0}
    for s in read(data).values():
        magic, _, channel, _, rate, n = IDENT.unpack(s.packets[0])
        channels[channel] = b"".join(s.packets[1:])
        if magic != MAGIC or len(channels[channel]) != n or s.granules[-1] != n:
            raise DamagedPage(f"channel {channel} does not hold {n} samples")
        facts["streams"] += 1
        facts["pages"] += s.pages
        facts["packets"] += len(s.packets)
        facts["seconds"] = max(facts["seconds"], s.granules[-1] / rate)
    both = np.empty(sum(map(len, channels.values())), np.uint8)
    for channel, part in channels.items():
        both[channel::2] = np.frombuffer(part, np.uint8)
    return both.tobytes(), facts


def digest(text: bytes) -> tuple:
    """Store a text padded with blanks to a positive multiple of MULTIPLE, read it back, and describe both forms."""
    padded = text + b" " * (max(1, -(-len(text) // MULTIPLE)) * MULTIPLE - len(text))
    media = write(padded)
    back, facts = samples(media)
    wave = np.frombuffer(back, np.uint8)
    crossings = int(np.count_nonzero((wave[1:] < 128) != (wave[:-1] < 128)))
    feature = f"streams={facts['streams']};pages={facts['pages']};packets={facts['packets']};seconds={facts['seconds']:.6f};mean={wave.mean():.6f};peak={wave.max()};crossings={crossings}"
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


SCHEMA = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary): each text as an Ogg file. Null texts count as empty; an empty text is one block of blanks."""

    def make():
        return lambda row: (row[0], write(row[1] + b" " * (max(1, -(-len(row[1]) // MULTIPLE)) * MULTIPLE - len(row[1]))))

    return map_rows(docs.select(F.col(id_col).cast("long"), utf8(text_col)), make, "id long, media binary")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with SCHEMA; equal texts give equal values, null texts count as empty."""
    return map_rows(docs.select(F.col(id_col).cast("long"), utf8(text_col)), lambda: lambda row: (row[0], *digest(row[1])), SCHEMA)
