"""Ogg media columns: pages with checksums, lacing, logical streams, granule positions (RFC 3533).

encode() stores a payload losslessly as 8-bit samples in an Ogg file of two logical streams; packets()
and probe() read any Ogg column. Defined results: a null or empty text is a payload of one unit of
blanks; a page with a wrong checksum, or bytes that aren't a page, are skipped and counted; a packet of
which a page is missing is dropped and counted; a null file has no packets. Repeated rows give repeated
results, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import FLUSH_BYTES, arrow_map, id_and_text, small_batches, utf8

#: Samples of a payload are padded with blanks to a multiple of this.
UNIT = 192
#: Samples of a packet; a packet takes several lacing values, so packets cross pages.
PACKET = 10 * UNIT
#: Logical streams of a file; packet i belongs to stream i % STREAMS.
STREAMS = 2
#: Samples a second, for timestamps.
RATE = 8000
#: An identification packet: magic, sample rate, samples of a packet, stream number, number of streams, samples in the stream.
HEAD = struct.Struct("<8sIIBBQ")
MAGIC = b"PCM8BIT\0"
#: A page: capture pattern, version, flags, granule position, serial number, page number, checksum, lacing values.
PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4

# How first packets of common streams begin, the format and place of their rate, and Opus's fixed one.
HEADS = ((b"\x01vorbis", "<I", 12), (b"Speex   ", "<I", 36), (b"\x7fFLAC", ">I", 27))
OPUS, OPUS_RATE = b"OpusHead", 48_000

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """Ogg's CRC (polynomial 04C11DB7, most significant bit first, from zero), by way of zlib's mirrored one."""
    mirrored = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    whole = head + body
    return whole[:22] + struct.pack("<I", checksum(whole)) + whole[26:]


def stream_pages(serial: int, head: bytes, packets: list[bytes]) -> list[bytes]:
    """The pages of one logical stream. The granule position of a page counts the samples up to the last packet that ends on it, or is -1."""
    pages = [page(FIRST | (0 if packets else LAST), 0, serial, 0, bytes([len(head)]), head)]
    lacing, ends, total = bytearray(), {}, 0
    for packet in packets:
        lacing += b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        total += len(packet)
        ends[len(lacing) - 1] = total
    body, at = b"".join(packets), 0
    for start in range(0, len(lacing), 255):
        values = bytes(lacing[start : start + 255])
        size = sum(values)
        ended = [ends[i] for i in range(start, start + len(values)) if i in ends]
        flags = (CONTINUED if start and lacing[start - 1] == 255 else 0) | (LAST if start + 255 >= len(lacing) else 0)
        pages.append(page(flags, ended[-1] if ended else -1, serial, len(pages), values, body[at : at + size]))
        at += size
    return pages


def encode(payload: bytes) -> bytes:
    """payload as an Ogg file: packets dealt out to the streams in turn, pages of the streams interleaved."""
    cut = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    streams = []
    for k in range(STREAMS):
        own = cut[k::STREAMS]
        streams.append(stream_pages(0x7A00 + k, HEAD.pack(MAGIC, RATE, PACKET, k, STREAMS, sum(map(len, own))), own))
    return b"".join(s[i] for i in range(max(map(len, streams))) for s in streams if i < len(s))


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, int, int] | None]:
    """(flags, granule, serial, number, lacing values, start and end of the body) of each sound page; None for each place that is none."""
    at = 0
    while at < len(data):
        if data[at : at + 4] == b"OggS" and at + 27 <= len(data):
            _, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(data, at)
            body = at + 27 + n
            lacing = data[at + 27 : body]
            end = body + sum(lacing)
            if version == 0 and end <= len(data) and crc == checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]):
                yield flags, granule, serial, number, lacing, body, end
                at = end
                continue
        yield None
        found = data.find(b"OggS", at + 1)
        at = len(data) if found < 0 else found


def timing(head: bytes) -> tuple[int | None, int, bool]:
    """(granules a second, granule position at which time begins, whether one byte is one sample) of a stream by its first packet."""
    if len(head) == HEAD.size and head.startswith(MAGIC):
        return HEAD.unpack(head)[1] or None, 0, True
    if head.startswith(OPUS) and len(head) >= 12:
        return OPUS_RATE, int.from_bytes(head[10:12], "little"), False
    for begin, form, at in HEADS:
        if head.startswith(begin) and len(head) >= at + 4:
            rate = struct.unpack_from(form, head, at)[0]
            return (rate >> 12 if begin == b"\x7fFLAC" else rate) or None, 0, False  # FLAC's has 20 bits
    return None, 0, False


def read(data: bytes | None) -> tuple[list[tuple[int, int, bytes, int | None]], dict[str, int]]:
    """((serial, number of the packet in its stream, bytes, granule position of its end), ...) and counts of pages, bad places and lost packets.

    The end of a packet is known where its page gives it, so that of the last one that ends there. In streams of
    which one byte is one sample, packets before it end earlier by the lengths of those between.
    """
    out: list[tuple[int, int, bytes, int | None]] = []
    count = {"pages": 0, "bad": 0, "lost": 0, "streams": 0}
    state: dict[int, dict] = {}
    for found in pages(data or b""):
        if found is None:
            count["bad"] += 1
            continue
        flags, granule, serial, number, lacing, at, _ = found
        count["pages"] += 1
        s = state.get(serial)
        if s is None:
            s = state[serial] = {"next": number, "part": None, "packets": 0, "plain": False}
        if number != s["next"] and s["part"] is not None:
            s["part"] = None
            count["lost"] += 1
        s["next"] = number + 1
        part = s["part"]
        skip = bool(flags & CONTINUED) and part is None
        if part is not None and not flags & CONTINUED:
            part = None
            count["lost"] += 1
        part = part or b""
        ended: list[bytes] = []
        start = end = at
        for value in lacing:
            end += value
            if value < 255:
                if skip:
                    skip = False
                    count["lost"] += 1
                else:
                    ended.append(part + data[start:end])
                part, start = b"", end
        open_now = bool(lacing) and lacing[-1] == 255
        s["part"] = part + data[start:end] if open_now and not skip else None
        ends: list[int | None] = []
        left = granule if granule >= 0 else None
        if ended and not s["packets"]:
            s["plain"] = timing(ended[0])[2]
        for packet in reversed(ended):
            ends.append(left)
            left = left - len(packet) if left is not None and s["plain"] else None
        for packet, stop in zip(ended, reversed(ends), strict=True):
            out.append((serial, s["packets"], packet, stop))
            s["packets"] += 1
    count["streams"] = len(state)
    count["lost"] += sum(s["part"] is not None for s in state.values())
    return out, count


def decode(data: bytes | None) -> tuple[bytes, dict[str, int]]:
    """The payload of a file that encode() wrote: each packet goes where its stream and its start time put it. ms: the streams' lengths together, by their last granule positions."""
    packets, count = read(data)
    heads = {serial: HEAD.unpack(p) for serial, i, p, _ in packets if i == 0 and len(p) == HEAD.size and p.startswith(MAGIC)}
    placed, last = [], dict.fromkeys(heads, 0)
    for serial, i, p, end in packets:
        if i and serial in heads and end is not None:
            _, _, size, k, n, _ = heads[serial]
            placed.append(((end - len(p)) // size * n + k, p))
            last[serial] = max(last[serial], end)
    placed.sort(key=lambda x: x[0])
    ms = sum(end * 1000 / heads[serial][1] for serial, end in last.items() if heads[serial][1])
    return b"".join(p for _, p in placed), count | {"packets": len(placed), "ms": int(ms)}


def describe(payload: bytes, count: dict[str, int]) -> str:
    """Features of the samples, in whole numbers so that equal samples give equal text anywhere."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    if not len(x):
        return "samples=0"
    high = x >= 128
    return (
        f"streams={count['streams']};pages={count['pages']};packets={count['packets']};bad={count['bad']};lost={count['lost']};"
        f"ms={count['ms']};mean_milli={int(x.sum()) * 1000 // len(x)};energy={int(((x - 128) ** 2).sum()) // len(x)};"
        f"crossings={int((high[1:] != high[:-1]).sum())};peak={int(np.abs(x - 128).max())}"
    )


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text + b" " * ((-len(text)) % UNIT if text else UNIT)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded to whole units, as an Ogg file."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, texts = batch.column(0), utf8(batch.column(1))
            start = size = 0
            files: list[bytes] = []
            for i, text in enumerate(texts):
                files.append(encode(padded(text)))
                size += len(files[-1])
                if size >= FLUSH_BYTES or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(files)), pa.array([len(t or b"") for t in texts[start : i + 1]], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])
                    start, size, files = i + 1, 0, []

        return step

    return arrow_map(id_and_text(df, id_col, text_col), make, "doc_id long, n_bytes long, media binary")


def probe(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", bytes_col: str = "n_bytes") -> DataFrame:
    """One row a file that store_texts() wrote: sizes, digests of payload and file, features of the samples."""
    small_batches(df.sparkSession)

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for data in batch.column(2).to_pylist():
                payload, count = decode(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data or b""), hashlib.sha256(data or b"").hexdigest(), describe(payload, count)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

        return step

    return arrow_map(df.select(F.col(id_col).alias("doc_id"), F.col(bytes_col).alias("n_bytes"), F.col(media_col).alias("media")), make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a packet of any Ogg column: serial number of its stream, its number there, bytes, granule position and time of its end in seconds (null if its page gives none, or its stream no rate)."""
    small_batches(df.sparkSession)

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for i, data in enumerate(batch.column(1).to_pylist()):
                found, _ = read(data)
                if found:
                    serial, number, body, end = zip(*found, strict=True)
                    rates = {s: timing(p) for s, n, p, _ in found if n == 0}
                    seconds = [None if e is None or (t := rates.get(s, (None,)))[0] is None else (e - t[1]) / t[0] for s, e in zip(serial, end, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(found), pa.int64()), pa.array(serial, pa.int64()), pa.array(number, pa.int64()), pa.array(body, pa.binary()), pa.array(end, pa.int64()), pa.array(seconds, pa.float64())], ["doc_id", "serial", "packet", "data", "granule", "end_s"])

        return step

    return arrow_map(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")), make, "doc_id long, serial long, packet long, data binary, granule long, end_s double")
