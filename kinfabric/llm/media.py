"""Media columns: lossless storage and signature sniffing.

A payload is stored as 8-bit mono PCM samples in a WAV container, in a table that is written and read back.
Sniffing runs an Aho-Corasick automaton over the bytes to locate magic numbers; a validator per format walks its
structure and gives its length. The type at offset 0 corrects the declared one; valid media further in are carved,
leftmost first, without overlap; media inside the samples of a container are carved from the samples.

What validators look for behind a magic number (ends and tables of a PDF, directories of a ZIP, ends of a JPEG) is
found once per text, so a magic number that repeats does not read the rest of the text again each time.

Defined cases: null and empty texts are one block of 576 filler bytes; bytes without any valid media have
type ``application/octet-stream``; a magic number without a valid structure is no medium; texts of any length are one
value, in memory one at a time with their stored form; rows that repeat are stored each on their own; columns of the
input that have the name of a new one are kept, the new one gets an underscore; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinfabric.llm.shared import documents, free_name, materialize, small_batches

BLOCK, FILL, RATE = 576, b"\xff", 8000
UNKNOWN = "application/octet-stream"
#: Magic bytes, how far into the file they stand, and the type they hint at.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"WAVEfmt ", 8, "audio/wav"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS\x00", 0, "audio/ogg"),
    (b"ID3", 0, "audio/mpeg"),
    (b"%PDF-1.", 0, "application/pdf"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"PK\x03\x04", 0, "application/zip"),
)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, back, kind in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic) + back - 1, kind))
    found.make_automaton()
    return found


class Seen:
    """What was found in one text, by pattern: each is searched for once."""

    def __init__(self, data: bytes):
        self.data, self.known = data, {}

    def places(self, mark: bytes) -> list[int]:
        """Where ``mark`` stands, in order."""
        if mark not in self.known:
            self.known[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        return self.known[mark]

    def next(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` at or behind ``at``, or -1."""
        places = self.places(mark)
        i = bisect_left(places, at)
        return places[i] if i < len(places) else -1

    def pdf_ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the ``startxref`` ends, the offsets they name, and where a table stands in the text."""
        if "pdf" not in self.known:
            ends = list(_PDF_END.finditer(self.data))
            tables = np.zeros(len(self.data) + 1, bool)
            for m in _XREF.finditer(self.data):
                tables[m.start()] = True
                i = m.start() - 1  # white space before a table belongs to it
                while i >= 0 and self.data[i] in b" \t\n\r\f\v" and not tables[i]:
                    tables[i] = True
                    i -= 1
            columns = ([m.start() for m in ends], [m.end() for m in ends], [min(int(m[1]), 1 << 62) for m in ends])
            self.known["pdf"] = (*(np.array(c, np.int64) for c in columns), tables)
        return self.known["pdf"]


def _png(b: bytes, at: int, seen: Seen) -> int | None:
    i, first = at + 8, True
    while i + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or (first and (name != b"IHDR" or n != 13)):
            return None
        if zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return None
        i, first = i + 12 + n, False
        if name == b"IEND":
            return i - at
    return None


def _jpeg(b: bytes, at: int, seen: Seen) -> int | None:
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        mark, n = b[i + 1], struct.unpack_from(">H", b, i + 2)[0]
        if mark < 0xC0 or n < 2:
            return None
        i += 2 + n
        if mark == 0xDA:
            end = seen.next(b"\xff\xd9", i)
            return end + 2 - at if end >= 0 else None
    return None


def _gif(b: bytes, at: int, seen: Seen) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    i = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    while i < len(b):
        kind = b[i]
        if kind == 0x3B:
            return i + 1 - at
        if kind == 0x21:
            i += 2
        elif kind == 0x2C and i + 10 <= len(b):
            i += 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 128 else 0)
        else:
            return None
        while i < len(b) and b[i]:
            i += b[i] + 1
        i += 1
    return None


def _bmp(b: bytes, at: int, seen: Seen) -> int | None:
    if at + 30 > len(b):
        return None
    n, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    ok = zero == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= n and at + n <= len(b)
    return n if ok else None


def _chunks(b: bytes, at: int) -> dict[bytes, tuple[int, int]] | None:
    """Chunks of a RIFF container: name to place and length, if the lengths add up."""
    if at < 0 or b[at : at + 4] != b"RIFF":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    i, out = at + 12, {}
    while i + 8 <= end <= len(b):
        name, n = struct.unpack_from("<4sI", b, i)
        if i + 8 + n > end:
            return None
        out.setdefault(name, (i + 8, n))
        i += 8 + n + (n & 1)
    return out if i >= end else None


def _wav(b: bytes, at: int, seen: Seen) -> int | None:
    chunks = _chunks(b, at)
    if not chunks or b"data" not in chunks or chunks.get(b"fmt ", (0, 0))[1] < 16:
        return None
    return 8 + struct.unpack_from("<I", b, at + 4)[0]


def _crc(poly: int, width: int) -> list[int]:
    """Table of a CRC, highest bit first."""
    table = []
    for x in range(256):
        x <<= width - 8
        for _ in range(8):
            x = (x << 1) ^ (poly if x >> (width - 1) else 0)
        table.append(x & ((1 << width) - 1))
    return table


_CRC8, _CRC16 = _crc(0x107, 8), _crc(0x18005, 16)
#: Each byte with its bits in the other order.
_MIRROR = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))
#: Bits a sample by a frame header's code; 0 stands for the stream's own.
_DEPTHS = {0: 0, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


class _Bits:
    """Reads bits, highest first; raises IndexError behind the end."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tobytes(), 0

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > len(self.bits):
            raise IndexError

    def take(self, n: int) -> int:
        self.skip(n)
        return int(self.bits[self.at - n : self.at].translate(_DIGITS) or b"0", 2)

    def ones(self, count: int, low: int) -> None:
        """Skips ``count`` unary numbers with ``low`` bits behind each."""
        find, bits, at = self.bits.find, self.bits, self.at
        for _ in range(count):
            at = find(b"\1", at) + 1
            if not at:
                raise IndexError
            at += low
        self.at = at
        self.skip(0)


_DIGITS = bytes([48, 49]) + bytes(range(2, 256))


def _residual(bits: _Bits, block: int, order: int) -> None:
    method, parts = bits.take(2), bits.take(4)
    if method > 1 or block % (1 << parts) or block >> parts < order:
        raise ValueError
    for part in range(1 << parts):
        n, low = (block >> parts) - (0 if part else order), bits.take(4 + method)
        if low == (31 if method else 15):
            bits.skip(n * bits.take(5))
        else:
            bits.ones(n, low)


def _subframe(bits: _Bits, block: int, depth: int) -> None:
    head = bits.take(8)
    kind = head >> 1
    if head & 1:
        wasted = bits.bits.find(b"\1", bits.at) - bits.at + 1
        if wasted < 1 or wasted >= depth:
            raise ValueError
        bits.skip(wasted)
        depth -= wasted
    if kind == 0:
        bits.skip(depth)
    elif kind == 1:
        bits.skip(depth * block)
    elif 8 <= kind <= 12:
        bits.skip(depth * (kind - 8))
        _residual(bits, block, kind - 8)
    elif 32 <= kind < 64:
        order = kind - 31
        bits.skip(depth * order)
        precision = bits.take(4) + 1
        bits.skip(5 + precision * order)
        _residual(bits, block, order)
    else:
        raise ValueError


def _flac_frame(b: bytes, at: int, depth: int) -> tuple[int, int] | None:
    """Bytes and samples of the frame at ``at``: header, subframes, and both checksums."""
    head = b[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8 or head[3] & 1:
        return None
    size, rate, channels = head[2] >> 4, head[2] & 15, head[3] >> 4
    depth = _DEPTHS.get(head[3] >> 1 & 7, -1) or depth
    wide = 8 - (head[4] ^ 255).bit_length()  # leading ones: bytes of the coded number
    i = 4 + max(1, wide)
    if size == 0 or rate == 15 or channels > 10 or depth < 0 or wide in (1, 8) or any(x & 0xC0 != 0x80 for x in head[5:i]):
        return None
    after = 1 if size == 6 else 2 if size == 7 else 0
    block = 192 if size == 1 else 576 << (size - 2) if size < 6 else int.from_bytes(head[i : i + after]) + 1 if after else 256 << (size - 8)
    i += after + (1 if rate == 12 else 2 if rate in (13, 14) else 0)
    check = 0
    for x in head[: i + 1]:
        check = _CRC8[check ^ x]
    if check or len(head) <= i:
        return None
    count, side = (channels + 1, -1) if channels < 8 else (2, {8: 1, 9: 0, 10: 1}[channels])
    start, room = at + i + 1, count * (block * (depth + 1) // 4 + 1024)
    while True:
        bits = _Bits(b[start : start + room])
        try:
            for c in range(count):
                _subframe(bits, block, depth + (c == side))
            break
        except ValueError:
            return None
        except IndexError:
            if start + room >= len(b) or room >= 1 << 23:
                return None
            room *= 8
    end = start + (bits.at + 7) // 8 + 2
    check = 0
    for x in b[at:end]:
        check = (check << 8 & 0xFFFF) ^ _CRC16[check >> 8 ^ x]
    return (end - at, block) if end <= len(b) and not check else None


def _flac(b: bytes, at: int, seen: Seen) -> int | None:
    i = at + 4
    if i + 38 > len(b) or b[i] & 127 or int.from_bytes(b[i + 1 : i + 4]) != 34:
        return None
    info = int.from_bytes(b[i + 14 : i + 22])
    depth, samples = (info >> 36 & 31) + 1, info & ((1 << 36) - 1)
    while i + 4 <= len(b):
        last, n = b[i] & 128, int.from_bytes(b[i + 1 : i + 4])
        i += 4 + n
        if last:
            break
    else:
        return None
    if i > len(b):
        return None
    done = 0
    while (not samples or done < samples) and (frame := _flac_frame(b, i, depth)):
        i, done = i + frame[0], done + frame[1]
    return i - at


def _ogg(b: bytes, at: int, seen: Seen) -> int | None:
    """Pages in a row whose checksums are right."""
    i = at
    while b[i : i + 5] == b"OggS\x00" and i + 27 <= len(b):
        table = b[i + 27 : i + 27 + b[i + 26]]
        end = i + 27 + len(table) + sum(table)
        if end > len(b) or len(table) < b[i + 26]:
            break
        page = b[i : i + 22] + bytes(4) + b[i + 26 : end]
        # zlib reads bits from the other end, and turns all of them before and after
        check = (zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF).to_bytes(4, "little").translate(_MIRROR)
        if int.from_bytes(check) != struct.unpack_from("<I", b, i + 22)[0]:
            break
        i = end
    return i - at if i > at else None


#: kbit/s by version (1, or 2 and 2.5) and layer.
_RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}


def _mpeg_frame(b: bytes, i: int) -> tuple[int, int] | None:
    """(bytes, what all frames of a stream share) of the MPEG or ADTS frame at ``i``; 0 bytes for a free bit rate."""
    if i + 4 > len(b) or b[i] != 0xFF or b[i + 1] < 0xE0:
        return None
    version, layer = b[i + 1] >> 3 & 3, 4 - (b[i + 1] >> 1 & 3)
    if layer == 4:  # ADTS
        if b[i + 1] < 0xF0 or i + 6 > len(b) or b[i + 2] >> 2 & 15 > 12:
            return None
        n = (b[i + 3] & 3) << 11 | b[i + 4] << 3 | b[i + 5] >> 5
        return (n, b[i + 1] << 8 | b[i + 2] & 0xFC) if n >= 7 else None
    rate, hertz, pad = b[i + 2] >> 4, b[i + 2] >> 2 & 3, b[i + 2] >> 1 & 1
    if version == 1 or rate == 15 or hertz == 3:
        return None
    same = (b[i + 1] & 0xFE) << 8 | hertz
    if rate == 0:
        return 0, same
    hertz = (44100, 48000, 32000)[hertz] >> {3: 0, 2: 1, 0: 2}[version]
    bits = _RATES[1 if version == 3 else 2, layer][rate - 1] * 1000
    if layer == 1:
        return (12 * bits // hertz + pad) * 4, same
    return (72 if layer == 3 and version != 3 else 144) * bits // hertz + pad, same


def _free(b: bytes, i: int, same: int) -> int:
    """Bytes of the frame of a free bit rate at ``i``: up to the next header like its own, or 0."""
    at = b.find(b[i : i + 2], i + 4)
    while at >= 0:
        if _mpeg_frame(b, at) == (0, same):
            return at - i
        at = b.find(b[i : i + 2], at + 1)
    return 0


def _mp3(b: bytes, at: int, seen: Seen) -> int | None:
    if at + 10 > len(b) or b[at + 3] not in (2, 3, 4) or max(b[at + 6 : at + 10]) > 127:
        return None
    i = at + 10 + sum(x << s for x, s in zip(b[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
    if b[at + 3] == 4 and b[at + 5] & 16:
        i += 10  # the tag's footer
    first, free, begun = _mpeg_frame(b, i), 0, i
    while first and (frame := _mpeg_frame(b, i)) and frame[1] == first[1]:
        n = frame[0]
        if not n:  # all frames of a free bit rate are alike but for a byte of padding
            pad = (b[i + 2] >> 1 & 1) * (4 if first[1] >> 9 & 3 == 3 else 1)
            free = free or _free(b, i, first[1]) - pad
            n = free + pad
        if n < 4 or i + n > len(b):
            break
        i += n
    if i == begun:
        return None
    if b[i : i + 8] == b"APETAGEX" and i + 32 <= len(b):
        n = struct.unpack_from("<I", b, i + 12)[0] + 32
        i += n if i + n <= len(b) else 0
    return (i + 128 if b[i : i + 3] == b"TAG" and i + 128 <= len(b) else i) - at


_PDF_END = re.compile(rb"startxref\s+(\d{1,19})\s+%%EOF")
_XREF = re.compile(rb"xref\b|(?<!\d)\d+\s+\d+\s+obj\b")


def _pdf(b: bytes, at: int, seen: Seen) -> int | None:
    """Up to the last %%EOF whose startxref leads to a table of this file; if none does, the last before another file.

    An update's table stands behind the %%EOF before it. Only the first startxref that leads anywhere may lead back
    behind another %%EOF, as in linearized files.
    """
    starts, stops, offsets, tables = seen.pdf_ends()
    first, end = int(np.searchsorted(starts, at)), 0
    places = at + offsets[first:]
    right = np.flatnonzero((places > at) & (places < starts[first:]))
    for i in right[tables[places[right]]].tolist():
        if places[i] >= end:
            end = int(stops[first + i])
    if not end:
        other = seen.next(b"%PDF-1.", at + 1)
        last = len(stops) if other < 0 else int(np.searchsorted(stops, other, "right"))
        end = int(stops[last - 1]) if last > first else 0
    return end - at if end else None


def _gzip(b: bytes, at: int, seen: Seen) -> int | None:
    unpack = zlib.decompressobj(31)
    try:
        view, i = memoryview(b), at
        while i < len(b) and not unpack.eof:
            rest = view[i : i + 65536]
            while rest and not unpack.eof:
                unpack.decompress(rest, 1 << 20)  # bounded output, thrown away
                rest = unpack.unconsumed_tail
            i += 65536
        return min(i, len(b)) - len(unpack.unused_data) - at if unpack.eof else None
    except zlib.error:
        return None


def _zip(b: bytes, at: int, seen: Seen) -> int | None:
    end = seen.next(b"PK\x05\x06", at)
    if at + 30 > len(b) or end < 0 or end + 22 > len(b):
        return None
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    ok = at + start + size == end and b[at + start : at + start + 4] == b"PK\x01\x02"
    return end + 22 + note - at if ok and end + 22 + note <= len(b) else None


VALIDATORS = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _wav, "audio/flac": _flac,
    "audio/ogg": _ogg, "audio/mpeg": _mp3, "application/pdf": _pdf, "application/gzip": _gzip, "application/zip": _zip,
}


def find_media(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the valid media, leftmost first, without overlap."""
    out, free, last, seen = [], 0, None, Seen(data)
    hits = sorted((end - span, kind) for end, (span, kind) in automaton().iter(data.decode("latin-1")))
    for at, kind in hits:
        if at < free or (at, kind) == last:
            continue
        last = (at, kind)
        if n := VALIDATORS[kind](data, at, seen):
            out.append((at, n, kind))
            free = at + n
    return out


def encode_wav(payload: bytes) -> bytes:
    """8-bit mono PCM; the payload's length is even, so no chunk is padded."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def decode_wav(media: bytes) -> bytes:
    at, n = _chunks(media, 0)[b"data"]
    return media[at : at + n]


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + FILL * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data)), len(data)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, media): every text as a stored medium."""

    def run(batches):
        for batch in batches:
            pairs = [payload_of(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for _, n in pairs], pa.int64()),
                    pa.array(["text/plain"] * len(pairs)),
                    pa.array([encode_wav(p) for p, _ in pairs], pa.binary()),
                ],
                ["doc_id", "n_bytes", "declared", "media"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def sniff(media: bytes | None, declared: str | None) -> dict:
    """The type found, whether it corrects the declared one, and the embedded media with their offsets."""
    data = media or b""
    found = find_media(data)
    head = next((x for x in found if x[0] == 0), None)
    kind = head[2] if head else UNKNOWN
    inside = [x for x in found if x is not head]
    if kind == "audio/wav":
        at = _chunks(data, 0)[b"data"][0]
        inside = [(i + at, n, k) for i, n, k in find_media(decode_wav(data))] + inside
    return {"type": kind, "corrected": kind != declared, "embedded": inside}


def sniff_media(rows: DataFrame, media: str = "media", declared: str = "declared") -> DataFrame:
    """``rows`` with type, corrected and carved (array of offset, type, bytes); a name that is taken gets an underscore."""
    names = []
    for name in ("type", "corrected", "carved"):
        names.append(free_name(rows, name))

    def run(batches):
        for batch in batches:
            found = [
                (sniff(m.as_py(), d.as_py()), m.as_py() or b"")
                for m, d in zip(batch.column(media), batch.column(declared), strict=True)
            ]
            carved = [[{"offset": i, "type": k, "bytes": m[i : i + n]} for i, n, k in x["embedded"]] for x, m in found]
            new = [pa.array([x["type"] for x, _ in found], pa.string()), pa.array([x["corrected"] for x, _ in found], pa.bool_()), pa.array(carved, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    kinds = pa.list_(pa.struct([("offset", pa.int64()), ("type", pa.string()), ("bytes", pa.binary())]))
    added = f"{names[0]} string, {names[1]} boolean, {names[2]} array<struct<offset: long, type: string, bytes: binary>>"
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL(added).fields]))


def features(stored: DataFrame) -> DataFrame:
    """Digests and features of stored media, from their bytes as read back."""

    def run(batches):
        for batch in batches:
            rows = []
            for n, declared, media in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                media = media.as_py()
                seen, payload = sniff(media, declared.as_py()), decode_wav(media)
                samples = np.frombuffer(payload, np.uint8)
                carved = ",".join(f"{k}@{i}+{m}" for i, m, k in seen["embedded"])
                said = f"{declared.as_py()}>{seen['type']};n={len(samples)};sum={int(samples.sum(dtype=np.int64))};min={samples.min()};max={samples.max()};{carved}"
                digest = (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
                rows.append((n.as_py(), len(payload), *digest, len(media), hashlib.sha256(media).hexdigest(), said))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            data = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *data], ["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, schema)


def stored_features(docs: DataFrame) -> DataFrame:
    """:func:`features` of the media column of a written table."""
    small_batches(docs.sparkSession)
    return features(materialize(store(docs), "media"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_features(documents(spark, sf_dir))
