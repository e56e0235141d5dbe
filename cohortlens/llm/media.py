"""Operator 3: media columns from ISO base media containers.

``media_columns`` walks the nested boxes of a container in a binary column and decodes the sample tables (durations,
chunk runs, sizes, chunk offsets, sync samples), so that codec, duration and the byte ranges of samples and
keyframes are columns; payload bytes are never decoded. ``stored_as_media`` writes the containers: a text's bytes,
zero-padded to a positive multiple of 64, as 8-bit PCM blocks of 64 samples in one track.

Defined results: null text is stored as the empty one; null or broken containers give null columns and the reason in
``error``; a container without a sync table has a keyframe at each sample; an empty table gives no rows; repeated
rows and equal texts get equal values; other columns are not looked at.
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

from cohortlens.llm import common

BLOCK = 64
RATE = 8000
KEY_EVERY = 16
#: Box types that hold boxes, with the bytes of fixed fields before these.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"stsd": 8, b"dref": 8}
COLUMNS = "codec string, timescale long, duration long, n_samples long, payload_bytes long, keyframes array<struct<offset:long,length:long>>, error string"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def container(payload: bytes) -> bytes:
    """A file with one track of 8-bit PCM; a sample is a block of 64 PCM values, a chunk holds KEY_EVERY of them."""
    blocks = len(payload) // BLOCK
    chunks = -(-blocks // KEY_EVERY)
    last = blocks - (chunks - 1) * KEY_EVERY
    runs = [(1, KEY_EVERY, 1)] if last == KEY_EVERY else [(1, last, 1)] if chunks == 1 else [(1, KEY_EVERY, 1), (chunks, last, 1)]
    unity = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(base: int) -> bytes:
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        table = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, blocks, BLOCK)),
            full(b"stss", struct.pack(f">I{chunks}I", chunks, *range(1, blocks + 1, KEY_EVERY))),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]), full(b"stsz", struct.pack(">II", BLOCK, blocks)),
            full(b"stco", struct.pack(">I", chunks), (base + BLOCK * KEY_EVERY * np.arange(chunks)).astype(">u4").tobytes()),
        )
        info = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        media = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, len(payload), 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"text\0"), info)
        track = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">hhHH", 0, 0, 0x100, 0), unity, bytes(8), flags=3), media)
        return box(b"moov", full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, len(payload)), struct.pack(">IH", 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2)), track)

    base = len(head) + len(moov(0)) + 8
    return head + moov(base) + box(b"mdat", payload)


def boxes(data: memoryview, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    """``(kind, first byte of its body, byte behind it)`` of each box in a range."""
    while lo < hi:
        if hi - lo < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        end = hi if size == 0 else lo + size
        if end > hi or end < body:
            raise ValueError(f"box {kind!r} does not fit its parent")
        yield kind, body, end
        lo = end


def tracks(data: bytes) -> list[dict[bytes, tuple[int, int]]]:
    """The boxes of each track, by kind."""
    view, found = memoryview(data), []

    open_ = [(boxes(view, 0, len(data)), {})]
    while open_:  # boxes may be nested to any depth
        siblings, into = open_[-1]
        x = next(siblings, None)
        if x is None:
            open_.pop()
            continue
        kind, a, b = x
        if kind == b"moof":
            raise ValueError("fragments are not read")
        if kind == b"trak":
            found.append(into := {})
        into.setdefault(kind, (a, b))
        if kind in CONTAINERS and kind != b"stsd":
            open_.append((boxes(view, a + CONTAINERS[kind], b), into))
    return found


def described(data: bytes) -> dict:
    """Codec, times and byte ranges of the first track that has samples."""
    for t in tracks(data):
        if b"stsd" not in t or b"mdhd" not in t:
            continue
        ints = lambda kind, at, n: np.frombuffer(data, ">u4", n, t[kind][0] + at).astype(np.int64)
        count = lambda kind, at=4: int(ints(kind, at, 1)[0])
        at = t[b"mdhd"][0]
        timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        (_, codec), = [struct.unpack_from(">I4s", data, t[b"stsd"][0] + 8)]
        size, n = ints(b"stsz", 4, 2).tolist()
        if not n:
            continue
        if size * n > len(data):
            raise ValueError("the samples are larger than the file")
        sizes = np.full(n, size, np.int64) if size else ints(b"stsz", 12, n)
        wide = b"co64" in t
        chunks = count(b"co64" if wide else b"stco")
        offsets = np.frombuffer(data, ">u8" if wide else ">u4", chunks, t[b"co64" if wide else b"stco"][0] + 8).astype(np.int64)
        runs = ints(b"stsc", 8, 3 * count(b"stsc")).reshape(-1, 3)
        per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], chunks + 1)))
        if int(per_chunk.sum()) != n:
            raise ValueError("chunks and samples disagree")
        chunk = np.repeat(np.arange(chunks), per_chunk)
        ends = np.cumsum(sizes)
        before = (ends - sizes)[np.cumsum(per_chunk) - per_chunk] if chunks else ends[:0]
        starts = offsets[chunk] + (ends - sizes) - before[chunk]
        keys = ints(b"stss", 8, count(b"stss")) - 1 if b"stss" in t else np.arange(n)
        if int((starts + sizes).max()) > len(data) or len(keys) and not 0 <= keys.min() <= keys.max() < n:
            raise ValueError("a sample lies outside the file, or a keyframe is none of the samples")
        return {"codec": codec.decode("latin-1"), "timescale": timescale, "duration": duration, "starts": starts, "sizes": sizes, "keys": keys}
    raise ValueError("no track with samples")


def payload_of(data: bytes, found: dict) -> bytes:
    """The samples' bytes in order; neighbours in the file are copied at once."""
    starts, ends = found["starts"], found["starts"] + found["sizes"]
    cut = np.flatnonzero(np.append(True, starts[1:] != ends[:-1])) if len(starts) else []
    last = np.append(cut[1:], len(starts)) - 1 if len(starts) else []
    return b"".join(data[starts[a]:ends[b]] for a, b in zip(cut, last))


def stored_as_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the container of each text."""
    kept = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 8 << 20):
            texts = batch.column("text").to_pylist()
            media = [container(t.ljust(max(BLOCK, -(-len(t) // BLOCK) * BLOCK), b"\0")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return kept.mapInArrow(rows, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_columns(df: DataFrame, column: str = "media") -> DataFrame:
    """``df`` with the struct column ``media_info`` (under a free name): codec, times, keyframe byte ranges, or an error."""

    @F.pandas_udf(COLUMNS)
    def info(media):
        import pandas as pd

        out = []
        for data in media:
            try:
                if data is None:
                    raise ValueError("null")
                x = described(data)
                ranges = [{"offset": int(x["starts"][k]), "length": int(x["sizes"][k])} for k in x["keys"]]
                out.append((x["codec"], x["timescale"], x["duration"], len(x["sizes"]), int(x["sizes"].sum()), ranges, None))
            except (ValueError, KeyError, IndexError, struct.error) as e:
                out.append((None, None, None, None, None, None, str(e)))
        table = pd.DataFrame(out, columns=["codec", "timescale", "duration", "n_samples", "payload_bytes", "keyframes", "error"])
        return table.astype({c: "Int64" for c in ("timescale", "duration", "n_samples", "payload_bytes")})

    return df.withColumn(common.fresh(df, "media_info"), info(common.col(df, column)))


def digest(media: DataFrame) -> DataFrame:
    """The stored bytes read back: digests of payload and container, the track's description as text, and its columns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "media", 8 << 20):
            out, keyframes = [], []
            for data in batch.column("media").to_pylist():
                x = described(data)
                payload = payload_of(data, x)
                keys = np.stack([x["starts"][x["keys"]], x["sizes"][x["keys"]]]).astype("<i8")
                feature = f"{x['codec'].strip()};{x['timescale']};{x['duration']};{len(x['sizes'])};{len(x['keys'])};{zlib.crc32(keys.tobytes()):08x}"
                keyframes.append(keys)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature, x["codec"].strip(), x["duration"]))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
            offset, length = np.concatenate(keyframes, axis=1)
            ends = np.cumsum([0, *(k.shape[1] for k in keyframes)]).astype(np.int32)
            ranges = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(offset), pa.array(length)], ["offset", "length"]))
            columns = [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*out), types)), ranges]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "keyframes"])

    doc_type = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(rows, f"doc_id {doc_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration long, keyframes array<struct<offset:long,length:long>>")
