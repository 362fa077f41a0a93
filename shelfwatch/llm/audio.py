"""MPEG audio columns: payloads stored in frames, and a reader for frames, tags, seek tables and checksums.

The writer makes a variable-bitrate layer III stream: an ID3v2 tag, a frame with the seek table, then protected
frames whose side information is silent and whose main data is the payload (ancillary data to a player). The
reader takes any stream of layers I to III: it parses ID3 and APE tags and seek tables (Xing, Info, VBRI), finds
frame headers anew after damage, checks checksums and counts samples exactly. A checksum covers the side information
in layer III, the bit allocation in layer I, and that and the scale factor choices in layer II.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed values of the MPEG audio standards. kbit/s by bitrate index 1 to 14; Hz by rate index; samples of a frame.
BITRATES = {
    ("1", 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    ("1", 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    ("1", 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    ("2", 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    ("2", 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    ("2", 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
VERSIONS = {0: "2.5", 2: "2", 3: "1"}
LAYERS = {1: 3, 2: 2, 3: 1}
SAMPLES = {("1", 1): 384, ("1", 2): 1152, ("1", 3): 1152, ("2", 1): 384, ("2", 2): 1152, ("2", 3): 576}

#: Bits of the allocation by subband in layer II, as (subbands, bits), and the tables by use.
ALLOCATION = {"A": ((11, 4), (12, 3), (4, 2)), "B": ((11, 4), (12, 3), (7, 2)), "C": ((2, 4), (6, 3)), "D": ((2, 4), (10, 3)), "LSF": ((4, 4), (7, 3), (19, 2))}

UNIT = 64
LENGTH_TAG = "payload_bytes"
#: The writer's frames: version 1, layer III, 32 kHz, one channel.
RATE, SIDE, CRC = 32000, 17, 2


#: Headers and checksums seen before; emptied when full.
_HEADERS: dict[bytes, tuple | None] = {}
_CHECKSUMS: dict[bytes, int] = {}


def _remembered(cache: dict, key: bytes, make):
    if key not in cache:
        if len(cache) >= 4096:
            cache.clear()
        cache[key] = make(key)
    return cache[key]


def frame_header(head: bytes) -> tuple | None:
    """(size, samples, rate, protected, side, kind) of a 4-byte frame header, None if it isn't one."""
    return _remembered(_HEADERS, head, _read_header)


def _read_header(head: bytes) -> tuple | None:
    (word,) = struct.unpack(">I", head)
    version, layer = VERSIONS.get(word >> 19 & 3), LAYERS.get(word >> 17 & 3)
    bitrate, rate = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version is None or layer is None or bitrate in (0, 15) or rate == 3:
        return None
    family = "1" if version == "1" else "2"
    kbits, hertz, padding = BITRATES[family, layer][bitrate - 1], RATES[version][rate], word >> 9 & 1
    samples = SAMPLES[family, layer]
    size = (12000 * kbits // hertz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hertz + padding
    mono = word >> 6 & 3 == 3
    side = (17 if mono else 32) if family == "1" else (9 if mono else 17)
    return size, samples, hertz, not word >> 16 & 1, side if layer == 3 else 0, (version, layer, hertz)


def _allocated(head: bytes, body: bytes) -> int:
    """How many bits of the body of a layer I or II frame its checksum covers."""
    (word,) = struct.unpack(">I", head)
    version, layer, mode = VERSIONS[word >> 19 & 3], LAYERS[word >> 17 & 3], word >> 6 & 3
    channels, bound = (1 if mode == 3 else 2), (4 * ((word >> 4 & 3) + 1) if mode == 1 else 32)
    if layer == 1:
        return 4 * (channels * bound + 32 - bound)
    if version == "1":
        each, hertz = BITRATES["1", 2][(word >> 12 & 15) - 1] // channels, RATES["1"][word >> 10 & 3]
        table = ("D" if hertz == 32000 else "C") if each <= 48 else "A" if each <= 80 or hertz == 48000 else "B"
    else:
        table = "LSF"
    bits, n, at, chosen = int.from_bytes(body[:64], "big"), 8 * len(body[:64]), 0, 0
    widths = [width for count, width in ALLOCATION[table] for _ in range(count)]
    for band, width in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            at += width
            value = bits >> max(0, n - at) & (1 << width) - 1
            chosen += (1 if band < bound else channels) * (value != 0)
    return at + 2 * chosen


def right_checksum(head: bytes, frame: bytes, side: int) -> bool:
    """Whether the two bytes behind the header of a protected frame are the checksum of what they cover."""
    stated = int.from_bytes(frame[4:6], "big")
    if LAYERS[head[1] >> 1 & 3] == 3:
        return checksum(head[2:] + frame[6 : 6 + side]) == stated
    body = frame[6:]
    size = _allocated(head, body)
    covered = int.from_bytes(head[2:] + body[: -(-size // 8)], "big") >> -size % 8
    return len(body) * 8 >= size and divide_bits(covered, 16 + size) == stated


def divide_bits(covered: int, size: int) -> int:
    crc = 0xFFFF
    for k in range(size - 1, -1, -1):
        carry = crc >> 15 ^ covered >> k & 1
        crc = (crc << 1 ^ (0x8005 if carry else 0)) & 0xFFFF
    return crc


def checksum(covered: bytes) -> int:
    """CRC-16 with the polynomial 0x8005, all ones at first, highest bit first."""
    return _remembered(_CHECKSUMS, covered, _divide)


def _divide(covered: bytes) -> int:
    crc = 0xFFFF
    for octet in covered:
        crc ^= octet << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _header(kbits: int, protected: bool) -> bytes:
    index = BITRATES["1", 3].index(kbits) + 1
    return struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | (not protected) << 16 | index << 12 | 2 << 10 | 3 << 6)


def _sizes() -> list[tuple[int, int]]:
    """(payload bytes, kbit/s) of the writer's frames, smallest first."""
    return [(frame_header(_header(k, True))[0] - 4 - CRC - SIDE, k) for k in BITRATES["1", 3]]


_ROOM = _sizes()


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def write_stream(payload: bytes) -> bytes:
    """A stream that holds the payload; ``read_stream`` gives it back."""
    text = b"\0" + LENGTH_TAG.encode() + b"\0" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    out = [b"ID3\x03\0\0" + _syncsafe(len(tag)) + tag, b""]
    at, offsets, here = 0, [], 0
    largest = _ROOM[-1]
    while at < len(payload):
        left = len(payload) - at
        room, kbits = largest if left >= largest[0] else next(x for x in _ROOM if x[0] >= left)
        head = _header(kbits, True)
        frame = head + struct.pack(">H", checksum(head[2:] + bytes(SIDE))) + bytes(SIDE) + payload[at : at + room]
        frame += bytes(4 + CRC + SIDE + room - len(frame))
        offsets.append(here)
        here += len(frame)
        out.append(frame)
        at += room
    head = _header(64, False)
    size = frame_header(head)[0]
    total = here + size
    n = len(offsets)
    toc = bytes(min(255, (size + offsets[k * n // 100]) * 256 // total) for k in range(100)) if n else bytes(100)
    out[1] = (head + bytes(SIDE) + b"Xing" + struct.pack(">III", 7, n, total) + toc).ljust(size, b"\0")
    return b"".join(out)


def _words(octets: bytes) -> str:
    """A text of an ID3v2 frame: an encoding byte and the text up to its end."""
    kind, octets = octets[:1], octets[1:]
    code = {b"\0": "latin-1", b"\1": "utf-16", b"\2": "utf-16-be", b"\3": "utf-8"}.get(kind, "latin-1")
    return octets.decode(code, "replace").rstrip("\0")


def _id3v2(data: bytes, at: int, texts: dict[str, str]) -> int:
    """Where an ID3v2 tag at ``at`` ends (``at`` itself: there is none); its texts are added, by frame name or TXXX:description."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or data[at + 3] not in (2, 3, 4):
        return at
    version, flags = data[at + 3], data[at + 5]
    loose = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    size = loose(data[at + 6 : at + 10])
    end = at + 10 + size + (10 if version == 4 and flags & 16 else 0)
    body = data[at + 10 : at + 10 + size]
    if flags & 128 and version < 4:  # the whole tag is unsynchronised
        body = body.replace(b"\xff\0", b"\xff")
    here = 0
    if flags & 64 and version > 2 and len(body) >= 4:  # an extended header
        here = 4 + int.from_bytes(body[:4], "big") if version == 3 else loose(body[:4])
    head, name_size = (6, 3) if version == 2 else (10, 4)
    while here + head <= len(body) and body[here : here + name_size].isalnum():
        name, sized = body[here : here + name_size].decode("latin-1"), body[here + name_size : here + 2 * name_size]
        length = loose(sized) if version == 4 else int.from_bytes(sized, "big")
        content = body[here + head : here + head + length]
        if version == 4 and body[here + 9] & 1:  # a length stands in front
            content = content[4:]
        if version == 4 and body[here + 9] & 2:
            content = content.replace(b"\xff\0", b"\xff")
        if name in ("TXXX", "TXX"):
            label, _, value = _words(content).partition("\0")
            texts[f"TXXX:{label}"] = value.lstrip("\ufeff")
        elif name[0] == "T":
            texts[name] = _words(content)
        here += head + length
    return end


def _end_tags(data: bytes, texts: dict[str, str]) -> int:
    """Where the frames end: before ID3v1 and APE tags, whose texts are added."""
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        tag = data[end - 128 :]
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 125)):
            if value := tag[a:b].split(b"\0")[0].decode("latin-1").rstrip():
                texts[f"ID3v1:{name}"] = value
        end -= 128
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        version, size, items, flags = struct.unpack("<IIII", data[end - 24 : end - 8])
        here = end - size
        if size >= 32 and here >= 0:
            for _ in range(min(items, size // 11)):
                if here + 9 > end - 32:
                    break
                length, kind = struct.unpack("<II", data[here : here + 8])
                stop = data.find(b"\0", here + 8, end - 32)
                if stop < 0:
                    break
                if not kind & 6:
                    texts[f"APE:{data[here + 8 : stop].decode('latin-1')}"] = data[stop + 1 : stop + 1 + length].decode("utf-8", "replace")
                here = stop + 1 + length
            end = end - size - (32 if flags & 0x80000000 and version >= 2000 else 0)
    return max(0, end)


def _seek_table(frame: bytes, side: int) -> dict | None:
    """What a frame with a Xing, Info or VBRI table states: frames, bytes, and byte places from that frame on."""
    at = 4 + side
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        steps = [scale * int.from_bytes(frame[k : k + width], "big") for k in range(62, min(len(frame), 62 + width * entries), max(1, width))]
        places, here = [], 0
        for step in steps:
            places.append(here)
            here += step
        return {"frames": frames, "bytes": size, "places": places}
    if frame[at : at + 4] not in (b"Xing", b"Info"):
        return None
    flags, at, found = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            found[name] = int.from_bytes(frame[at : at + 4], "big")
            at += 4
    if flags & 4 and "bytes" in found:
        found["places"] = [x * found["bytes"] // 256 for x in frame[at : at + 100]]
    return found


def _seek_error(table: dict, first: int, offsets: list[int]) -> int:
    """How many bytes the seek table is off at most, against the exact offsets; -1 without a table."""
    places = table.get("places")
    if not places or not offsets:
        return -1
    exact = [offsets[k * len(offsets) // len(places)] - first for k in range(len(places))]
    return max(abs(a - b) for a, b in zip(places, exact, strict=True))


def read_stream(data: bytes) -> dict:
    """Frames of a stream: payload, samples, rate, offsets, good and bad checksums, lost bytes, the seek table's and tags' words.

    A header counts if its checksum is right, or if another header, the end or an end tag follows its frame;
    from anything else the search goes on byte by byte. A frame cut short by the end is lost. A frame that holds a
    seek table is no audio.
    """
    texts: dict[str, str] = {}
    end, at = _end_tags(data, texts), 0
    while (to := _id3v2(data, at, texts)) > at:
        at = to
    offsets, bodies, good, bad, lost, samples, table, kind, head_at = [], [], 0, 0, 0, 0, {}, None, 0
    while at + 4 <= end:
        head = frame_header(data[at : at + 4])
        fits = head is not None and at + head[0] <= end and (kind is None or head[5] == kind)
        right = False
        if fits:
            after = at + head[0]
            if head[3]:
                right = right_checksum(data[at : at + 4], data[at:after], head[4])
            follows = frame_header(data[after : after + 4]) if after + 4 <= end else None
            fits = right or after == end or follows is not None and follows[5] == head[5]
        if not fits:
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            lost, at = lost + step - at, step
            continue
        size, count, _, protected, side, _ = head
        first = kind is None
        kind = head[5]
        if first and (found := _seek_table(data[at : at + size], side)) is not None:
            table, head_at = found, at
        else:
            body = at + 4 + side + (CRC if protected else 0)
            if protected:
                good, bad = good + right, bad + (not right)
            offsets.append(at)
            bodies.append(data[body : at + size])
            samples += count
        at += size
    payload = b"".join(bodies)
    stated = texts.get(f"TXXX:{LENGTH_TAG}", "")
    if stated.isdigit():
        payload = payload[: int(stated)]
    return {
        "payload": payload, "samples": samples, "rate": kind[2] if kind else 0, "offsets": offsets, "good": good,
        "bad": bad, "lost": lost + max(0, end - at), "stated": table.get("frames", -1), "stated_bytes": table.get("bytes", -1),
        "seek_error": _seek_error(table, head_at, offsets), "tags": sorted(texts.items()),
    }


def padded(text: Column) -> Column:
    """The UTF-8 bytes of a text (null: none), with zero bytes up to a positive multiple of 64."""
    octets = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.lit(UNIT), F.ceil(F.length(octets) / UNIT) * UNIT).cast("int")
    return F.rpad(octets, size, F.lit(b"\0"))


@F.arrow_udf(T.BinaryType())
def to_media(payloads: pa.Array) -> pa.Array:
    return pa.array([None if p is None else write_stream(p) for p in payloads.to_pylist()], pa.binary())


_KINDS = {
    "payload": (pa.binary(), T.BinaryType()), "samples": (pa.int64(), T.LongType()), "rate": (pa.int32(), T.IntegerType()),
    "offsets": (pa.list_(pa.int64()), T.ArrayType(T.LongType())), "good": (pa.int32(), T.IntegerType()), "bad": (pa.int32(), T.IntegerType()),
    "lost": (pa.int64(), T.LongType()), "stated": (pa.int64(), T.LongType()), "stated_bytes": (pa.int64(), T.LongType()), "seek_error": (pa.int64(), T.LongType()),
    "tags": (pa.map_(pa.string(), pa.string()), T.MapType(T.StringType(), T.StringType())),
}


@F.arrow_udf(T.StructType([T.StructField(n, t) for n, (_, t) in _KINDS.items()]))
def from_media(streams: pa.Array) -> pa.Array:
    found = [read_stream(s or b"") for s in streams.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([f[n] for f in found], k) for n, (k, _) in _KINDS.items()], list(_KINDS))


def media_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_bytes, media, payload, samples, rate, offsets, good, bad, lost, stated,
    stated_bytes, seek_error, tags).

    A row for each input row. ``media`` is the stored stream; the rest is read from it: the payload, the exact
    duration (samples at rate), byte offsets of all frames with data, checks, what the seek table states and how far
    it is off, and the words of tags by name. A null or empty text gives a
    payload of 64 zero bytes. Equal texts give equal values. Other columns are ignored.
    """
    stored = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), to_media(padded(F.col("text"))).alias("media"))
    return stored.withColumn("_found", from_media("media")).select("doc_id", "n_bytes", "media", "_found.*")


def feature() -> Column:
    """What is told of a stream in one string: duration, frames, checks and a checksum of the seek offsets."""
    seek = F.crc32(F.array_join("offsets", ",").cast("binary"))
    parts = [("rate", F.col("rate")), ("samples", F.col("samples")), ("ms", F.floor(F.col("samples") * 1000 / F.greatest("rate", F.lit(1)))), ("frames", F.size("offsets")), ("stated", F.col("stated")), ("seek_error", F.col("seek_error")), ("crc_ok", F.col("good")), ("crc_bad", F.col("bad")), ("lost", F.col("lost")), ("seek", seek)]
    return F.concat_ws(";", *[F.concat(F.lit(f"{n}="), v.cast("string")) for n, v in parts])
