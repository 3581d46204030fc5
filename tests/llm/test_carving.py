"""Whole files of each format are carved from between other bytes."""

import gzip
import io
import struct
import time
import wave
import zipfile
import zlib

import numpy as np
import pytest

from kinfabric.llm import media


def crc(data, poly, width):
    value = 0
    for byte in data:
        value ^= byte << (width - 8)
        for _ in range(8):
            value = (value << 1) ^ (poly if value >> (width - 1) else 0)
    return value.to_bytes(width // 8)


def rice(values, low):
    folded = [2 * v if v >= 0 else -2 * v - 1 for v in values]
    return "".join("0" * (v >> low) + "1" + format(v & ((1 << low) - 1), f"0{low}b") for v in folded)


def sub(kind, samples, depth):
    raw = lambda xs, d: "".join(format(int(x) & ((1 << d) - 1), f"0{d}b") for x in xs)
    if kind == "constant":
        return "00000000" + raw(samples[:1], depth)
    if kind == "verbatim":
        return "00000010" + raw(samples, depth)
    if kind == "wasted":
        return "00000011" + "01" + raw(samples, depth - 2)
    if kind == "lpc":  # order 1, coefficient 1 of 2 bits, shift 0
        return "01000000" + raw(samples[:1], depth) + "0001" + "00000" + "01" + "00" + "0000" + "0110" + rice(np.diff(samples), 6)
    if kind == "escape":
        return "00010000" + "00" + "0000" + "1111" + format(depth, "05b") + raw(samples, depth)
    return "00010010" + raw(samples[:1], depth) + "00" + "0001" + "0101" + rice(np.diff(samples[: len(samples) // 2]), 5) + "0111" + rice(np.diff(samples[len(samples) // 2 - 1 :]), 7)


def flac(known):
    rng = np.random.default_rng(1)
    frames = b""
    kinds = [("constant", "fixed"), ("fixed", "verbatim"), ("lpc", "escape"), ("wasted", "lpc"), ("fixed", "fixed")]
    for number, (left, right) in enumerate(kinds):
        samples = np.cumsum(rng.integers(-20, 20, 576))
        head = bytes([0xFF, 0xF8, 0x29, 0x88, number])  # 576 samples, 44.1 kHz, left and side, 16 bits
        head += crc(head, 0x107, 8)
        bits = sub(left, samples, 16) + sub(right, samples, 17)
        frame = head + int(bits + "0" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8)
        frames += frame + crc(frame, 0x18005, 16)
    info = struct.pack(">HH", 576, 576) + bytes(6) + (44100 << 44 | 1 << 41 | 15 << 36 | (576 * 5 if known else 0)).to_bytes(8) + bytes(16)
    return b"fLaC" + b"\0\0\0\x22" + info + b"\x81\0\0\x03abc" + frames


def mp3(head, size, more=b""):
    body = bytes(range(200)) * 30
    return b"ID3\x04\0\0\0\0\x01\x05" + b"t" * 133 + b"".join(head + bytes([i]) + body[: size - 4] for i in range(0, 80, 8)) + more


def pdf(updates, linear=False):
    out = b"%PDF-1.7\n"
    if linear:
        out += b"1 0 obj <<>> endobj\n"
        first = len(out)
        out += b"xref\n0 1\ntrailer <<>>\nstartxref\n0\n%%EOF\n2 0 obj <<>> endobj\nxref\n"
        out += b"trailer <<>>\nstartxref\n%d\n%%%%EOF\n" % first
    for i in range(updates):
        out += b"3 0 obj << /Stream %PDF-1.4 startxref 7 %%EOF >> endobj\n"
        at = len(out)
        out += (b"xref\n0 1\n" if i % 2 else b"9 0 obj <</Type /XRef>> ") + b"trailer <<>>\nstartxref\n%d\n%%%%EOF\n" % at
    return out[:-1]


def riff():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(b"\x80" * 100)
    return out.getvalue()


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"hello" * 9)
    return out.getvalue()


def ogg():
    pages = b""
    for i in range(3):
        page = b"OggS\0" + bytes(13) + i.to_bytes(4, "little") + bytes(4) + bytes([2, 255, 7]) + b"o" * 262
        pages += page[:22] + crc(page, 0x104C11DB7, 32)[::-1] + page[26:]
    return pages


FILES = {
    "flac": (flac(True), "audio/flac"),
    "flac of unknown length": (flac(False), "audio/flac"),
    "mpeg 1 layer 3": (mp3(b"\xff\xfb\x90", 417), "audio/mpeg"),
    "mpeg 2 layer 3 and tag": (mp3(b"\xff\xf3\x80", 208, b"TAG" + bytes(125)), "audio/mpeg"),
    "mpeg 1 layer 2": (mp3(b"\xff\xfd\x84", 384), "audio/mpeg"),
    "free bit rate": (mp3(b"\xff\xfb\x00", 500), "audio/mpeg"),
    "adts": (mp3(b"\xff\xf1\x50", 0)[:143] + (b"\xff\xf1\x50\x80\x08\x1f\xfc" + b"a" * 57) * 9, "audio/mpeg"),
    "pdf": (pdf(1), "application/pdf"),
    "updated pdf": (pdf(3), "application/pdf"),
    "linearized pdf": (pdf(0, True), "application/pdf"),
    "updated linearized pdf": (pdf(2, True), "application/pdf"),
    "gzip": (gzip.compress(b"hello" * 50), "application/gzip"),
    "zip": (zipped(), "application/zip"),
    "wav": (riff(), "audio/wav"),
    "ogg": (ogg(), "audio/ogg"),
    "png": (b"\x89PNG\r\n\x1a\n" + b"".join(len(x).to_bytes(4) + n + x + zlib.crc32(n + x).to_bytes(4) for n, x in ((b"IHDR", bytes(13)), (b"IDAT", bytes(99)), (b"IEND", b""))), "image/png"),
    "bmp": (b"BM" + struct.pack("<IIIII", 200, 0, 54, 40, 1) + bytes(178), "image/bmp"),
    "gif": (b"GIF89a" + bytes(7) + b"\x2c" + bytes(9) + b"\x02\x03abc\0\x3b", "image/gif"),
    "jpeg": (b"\xff\xd8\xff\xe0\0\x06abcd\xff\xda\0\x04ab" + b"z" * 50 + b"\xff\xd9", "image/jpeg"),
}


@pytest.mark.parametrize("name", FILES)
def test_whole_file_is_carved(name):
    data, kind = FILES[name]
    for other in (b"\0" * 50, b"text \xff\xfe\n" * 9):
        assert media.find_media(other + data + other) == [(len(other), len(data), kind)]
        two = media.find_media(other + data + b"\n" + data + other)
        assert two == [(len(other), len(data), kind), (len(other) + len(data) + 1, len(data), kind)]


@pytest.mark.parametrize("magic", [m for m, _, _ in media.SIGNATURES] + [b"%PDF-1.xref startxref 9 %%EOF ", b"\xff\xd8\xff\xd9"])
def test_repeated_magic_is_read_once(magic):
    began = time.time()
    media.find_media(magic * 60_000)
    assert time.time() - began < 20  # each one reading the rest takes minutes


def test_a_damaged_page_ends_the_stream():
    data = bytearray(ogg())
    data[-5] ^= 1
    assert media.find_media(bytes(data)) == [(0, len(data) // 3 * 2, "audio/ogg")]


def test_cut_files_end_with_their_last_whole_frame():
    data = flac(True)
    assert 0 < media.find_media(data[:-1])[0][1] < len(data) - 1
    data = mp3(b"\xff\xfb\x90", 417)
    assert media.find_media(data[:-1]) == [(0, len(data) - 417, "audio/mpeg")]
