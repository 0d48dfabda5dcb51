"""Media columns: a document's bytes as samples of an ISO base media file, and what a box walk tells of it.

`write_movie` lays out `ftyp`, `moov` and `mdat` boxes; `walk` finds nested boxes by their sizes alone, and
`sample_table` decodes stts, stsz, stsc, stco and stss to a byte range for each sample. No payload is decoded.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 576  # bytes of one sample: 24 x 24 pixels of 8 bits
TIMESCALE, TICKS = 25, 1  # samples a second; ticks a sample
KEY_EVERY, CHUNK = 12, 8  # a key sample each 12; samples in a chunk
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"))
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, codec string, duration double, n_samples long, keyframes array<struct<at:long,size:long>>"
)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(raw: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of a sample."""
    return raw + b"\xff" * (-len(raw) % SAMPLE or (0 if raw else SAMPLE))


def write_movie(payload: bytes) -> bytes:
    """An ISO media file with one track of raw 8-bit samples; deterministic, so equal payloads give equal files."""
    n = len(payload) // SAMPLE
    chunks, last = divmod(n, CHUNK)
    identity = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    span = n * TICKS
    entry = box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 24, 24, 72 << 16, 72 << 16, 0, 1),
        bytes(32), struct.pack(">Hh", 8, -1),
    )
    runs = ([(1, CHUNK)] if chunks else []) + ([(chunks + 1, last)] if last else [])
    keys = range(1, n + 1, KEY_EVERY)

    def head(at: int) -> bytes:
        step = CHUNK * SAMPLE
        offsets = [at + i * step for i in range(chunks + (last > 0))]
        wide = bool(offsets) and offsets[-1] >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, TICKS)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, each, 1) for first, each in runs)),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{len(offsets)}{'Q' if wide else 'I'}", len(offsets), *offsets)),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdia = box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, span, 0x55C4, 0)),
            full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"\0"),
            minf,
        )
        tkhd = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, span, 0, 0, 0, 0), identity, struct.pack(">II", 24 << 16, 24 << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, span, 1 << 16, 256), identity, bytes(24), struct.pack(">I", 2))
        return box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2") + box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    first = head(0)
    body = box(b"mdat", payload)
    at = len(first) + len(body) - len(payload)
    second = head(at)
    if len(second) != len(first):  # offsets need 64 bits
        second = head(at + len(second) - len(first))
    return second + body


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, first byte of the body, end) of every box, in order; containers come before what they hold."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has size {size}, beyond its parent")
        yield (*path, kind), body, start + size
        if kind in CONTAINERS:
            yield from walk(data, body, start + size, (*path, kind))
        start += size


def sample_table(data: bytes, found: dict[bytes, tuple[int, int]]) -> list[tuple[int, int]]:
    """(first byte, size) of each sample, from stsz, stsc and stco or co64."""
    at = found[b"stsz"][0] + 4
    same, n = struct.unpack_from(">II", data, at)
    sizes = [same] * n if same else list(struct.unpack_from(f">{n}I", data, at + 8))
    wide = b"co64" in found
    at = found[b"co64" if wide else b"stco"][0] + 4
    (chunks,) = struct.unpack_from(">I", data, at)
    offsets = struct.unpack_from(f">{chunks}{'Q' if wide else 'I'}", data, at + 4)
    at = found[b"stsc"][0] + 4
    (k,) = struct.unpack_from(">I", data, at)
    runs = [struct.unpack_from(">III", data, at + 4 + 12 * i)[:2] for i in range(k)]
    ranges, i = [], 0
    for r, (first, each) in enumerate(runs):
        stop = runs[r + 1][0] if r + 1 < k else chunks + 1
        for c in range(first - 1, stop - 1):
            at = offsets[c]
            for _ in range(each):
                ranges.append((at, sizes[i]))
                at += sizes[i]
                i += 1
    if i != n:
        raise ValueError(f"sample tables tell of {n} and of {i} samples")
    return ranges


def probe(data: bytes) -> dict:
    """Codec, duration and byte ranges of samples and key samples, from the boxes alone."""
    found, paths = {}, []
    for path, start, end in walk(data):
        paths.append(b"/".join(path).decode("latin-1"))
        found.setdefault(path[-1], (start, end))
    codec = data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16].decode("latin-1")
    scale, span = struct.unpack_from(">II", data, found[b"mdhd"][0] + 12)
    at = found[b"stts"][0] + 4
    (k,) = struct.unpack_from(">I", data, at)
    ticks = sum(c * d for c, d in (struct.unpack_from(">II", data, at + 4 + 8 * i) for i in range(k)))
    ranges = sample_table(data, found)
    at = found[b"stss"][0] + 4
    (k,) = struct.unpack_from(">I", data, at)
    keys = struct.unpack_from(f">{k}I", data, at + 4)
    return {
        "codec": codec, "duration": span / scale, "ticks": ticks, "n_samples": len(ranges), "samples": ranges,
        "keyframes": [ranges[i - 1] for i in keys], "boxes": paths,
    }


def describe(raw: bytes) -> dict:
    """The row of one document, computed from the stored file's own bytes."""
    stored = write_movie(pad(raw))
    tells = probe(stored)
    payload = b"".join(stored[a : a + n] for a, n in tells["samples"])
    keys = tells["keyframes"]
    feature = {
        "codec": tells["codec"], "duration": tells["duration"], "samples": tells["n_samples"], "boxes": len(tells["boxes"]),
        "keyframes": len(keys), "first_key": list(keys[0]), "last_key": list(keys[-1]),
        "keys_crc32": zlib.crc32(b"".join(struct.pack(">QQ", *r) for r in keys)),
    }
    return {
        "n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(),
        "feature": json.dumps(feature, separators=(",", ":")), "codec": tells["codec"], "duration": tells["duration"],
        "n_samples": tells["n_samples"], "keyframes": [{"at": a, "size": n} for a, n in keys],
    }


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`. Null texts count as empty; repeated rows and texts give equal values; no shuffle."""

    def rows(batches):
        for pdf in batches:
            made = pd.DataFrame([describe(b"" if t is None else bytes(t)) for t in pdf["raw"]])
            if len(pdf):
                made.insert(0, "doc_id", pdf["doc_id"].astype("Int64").values)
                yield made

    raw = F.encode(F.col(text_col), "UTF-8") if dict(docs.dtypes)[text_col] == "string" else F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw")).mapInPandas(rows, SCHEMA)


def media_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The files themselves: doc_id and the stored bytes, from which `payload_of` gives the text back."""
    store = F.udf(lambda t: write_movie(pad(b"" if t is None else t.encode())), "binary")
    return docs.select(F.col(id_col).alias("doc_id"), store(F.col(text_col)).alias("media"))


def payload_of(stored: bytes) -> bytes:
    return b"".join(stored[a : a + n] for a, n in probe(stored)["samples"])


def op3(spark, sf_dir):
    """The media columns of all rows of `documents`; nulls and repeated rows as media_columns() says, whole texts of any length."""
    from .common import documents

    return media_columns(documents(spark, sf_dir, "doc_id", "text"))
