"""The reader of MPEG audio on streams built by hand, not by the writer of the module."""

import struct
import zlib
from hashlib import sha256

from shelfwatch.llm import audio, queries


def crc16(bits):
    """Bit by bit, as the standard draws it."""
    register = [1] * 16
    for bit in bits:
        carry = register[0] ^ bit
        register = register[1:] + [0]
        if carry:
            for k in (0, 13, 15):  # x^15, x^2, 1
                register[k] ^= 1
    return int("".join(map(str, register)), 2)


def bits_of(octets):
    return [x >> k & 1 for x in octets for k in range(7, -1, -1)]


def frame(layer, mode=3, bitrate=8, allocation=(), chosen=0, size=None, extension=0, rate=0, protected=True):
    """A frame of version 1 with the given bits of allocation and so many scale factor choices."""
    word = 0x7FF << 21 | 3 << 19 | (4 - layer) << 17 | (not protected) << 16 | bitrate << 12 | rate << 10 | mode << 6 | extension << 4
    head = struct.pack(">I", word)
    body = list(allocation) + [1, 0] * chosen
    crc = crc16(bits_of(head[2:]) + body)
    body += [1] * (-len(body) % 8)
    octets = bytes(int("".join(map(str, body[k : k + 8])), 2) for k in range(0, len(body), 8))
    out = head + (struct.pack(">H", crc) if protected else b"") + octets
    return out.ljust(audio.frame_header(head)[0], b"\x55")


def test_checksums_of_layers_one_and_two():
    mono = [x for band in range(32) for x in bits_of([band % 16])[4:]]
    for stream in (
        frame(1, allocation=mono) * 3,
        frame(1, mode=0, allocation=mono + mono) * 3,
        frame(1, mode=1, extension=1, allocation=mono[:64] + mono[:96]) * 3,  # 8 bands of both channels, 24 in common
        # 112 kbit/s of one channel at 44.1 kHz: 11 bands of 4 bits, 12 of 3 and 7 of 2; bands 0, 11 and 29 are used
        frame(2, bitrate=7, allocation=[0, 0, 0, 1] + [0] * 40 + [0, 1, 0] + [0] * 33 + [0] * 12 + [1, 1], chosen=3) * 3,
        # 32 kbit/s at 32 kHz: 2 bands of 4 bits and 10 of 3
        frame(2, bitrate=1, rate=2, allocation=[1] * 8 + [0] * 30, chosen=2) * 3,
        # joint stereo, 192 kbit/s: 4 bands of both channels, 26 in common; a common band counts for both
        frame(2, mode=1, bitrate=10, allocation=[0] * 32 + [0, 0, 1, 0] + [0] * 24 + [0] * 36 + [0] * 14, chosen=2) * 3,
    ):
        found = audio.read_stream(stream)
        assert (found["good"], found["bad"], found["lost"], len(found["offsets"])) == (3, 0, 0, 3)
        hurt = bytearray(stream)
        hurt[6] ^= 0x10  # the allocation is covered
        assert audio.read_stream(bytes(hurt))["bad"] == 1
        hurt = bytearray(stream)
        hurt[-1] ^= 1  # samples are not
        assert audio.read_stream(bytes(hurt))["good"] == 3


def plain_frames(n, kbits=9):
    head = struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | 1 << 16 | kbits << 12 | 3 << 6)  # 128 kbit/s, 44.1 kHz, mono
    return [head.ljust(audio.frame_header(head)[0], b"\0")] * n


def test_vbri_and_xing_tables_are_read_and_checked():
    frames = plain_frames(40)
    size = len(frames[0])
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, size * 41, 40, 10, 1, 2, 4) + struct.pack(">10H", size * 5, *[size * 4] * 9)
    first = (frames[0][:36] + table).ljust(size, b"\0")
    found = audio.read_stream(first + b"".join(frames))
    assert (found["stated"], found["stated_bytes"], found["samples"], len(found["offsets"])) == (40, size * 41, 40 * 1152, 40)
    assert found["seek_error"] == size  # the first place is the table's own frame
    toc = bytes((size + k * 40 // 100 * size) * 256 // (size * 41) for k in range(100))
    first = (frames[0][:4] + bytes(17) + b"Xing" + struct.pack(">III", 7, 40, size * 41) + toc).ljust(size, b"\0")
    found = audio.read_stream(first + b"".join(frames))
    assert (found["stated"], found["stated_bytes"]) == (40, size * 41) and 0 <= found["seek_error"] <= size * 41 / 256 + 1
    assert audio.read_stream(b"".join(frames))["seek_error"] == -1


def test_tags_of_all_kinds():
    sync = lambda n: bytes(n >> s & 127 for s in (21, 14, 7, 0))
    text = b"\x03" + "Tïtel".encode()
    long_text = b"\x00" + b"x" * 200
    v4 = b"TIT2" + sync(len(text)) + b"\0\0" + text + b"TXXX" + sync(len(long_text) + 3) + b"\0\0" + b"\x00ab\0" + long_text[1:] + b"\0" * 5
    extended = sync(6) + b"\x01\0"
    v4 = b"ID3\x04\0\x50" + sync(len(extended + v4)) + extended + v4 + b"3DI\x04\0\x50" + sync(len(extended + v4))
    v2 = b"TP1" + (5).to_bytes(3, "big") + b"\0Duo " + b"TAL" + (7).to_bytes(3, "big") + b"\x01" + "Ü!".encode("utf-16")[:6]
    v2 = b"ID3\x02\0\0" + sync(len(v2)) + v2
    item = struct.pack("<II", 4, 0) + b"Genre\0" + b"Folk"
    ape = item + b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, 0) + bytes(8)
    v1 = b"TAG" + b"Song".ljust(30, b"\0") + b"Band".ljust(30) + b"\0" * 30 + b"1999" + b"\0" * 31
    frames = b"".join(plain_frames(3))
    found = audio.read_stream(v4 + v2 + frames + ape + v1)
    assert dict(found["tags"]) == {"TIT2": "Tïtel", "TXXX:ab": "x" * 199 + "x", "TP1": "Duo ", "TAL": "Ü!", "APE:Genre": "Folk", "ID3v1:title": "Song", "ID3v1:artist": "Band", "ID3v1:year": "1999"}
    assert (found["lost"], len(found["offsets"])) == (0, 3)


def test_query_equals_brute_force(spark, sf_dir):
    """Every column of the contract from the texts alone, with the stored form made anew by the writer."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2_mpeg_audio(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = audio.write_stream(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), sha256(media).hexdigest())
        told = dict(x.split("=") for x in r.feature.split(";"))
        frames = []
        at = 10 + int.from_bytes(media[6:10], "big")  # sizes under 128 read alike
        while at < len(media):
            frames.append(at)
            at += 144000 * audio.BITRATES["1", 3][(media[at + 2] >> 4) - 1] // 32000
        assert at == len(media) and int(told["frames"]) == len(frames) - 1 == int(told["stated"]) == int(told["crc_ok"]) and int(told["samples"]) == 1152 * (len(frames) - 1)
        assert int(told["seek"]) == zlib.crc32(",".join(map(str, frames[1:])).encode()) and (told["rate"], told["lost"], told["crc_bad"]) == ("32000", "0", "0")
