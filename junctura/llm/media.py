"""Media columns: signature sniffing.

An Aho-Corasick automaton over magic bytes finds every place where a known format may begin; a
validator of that format then reads its structure and lengths, so a chance occurrence of the magic
does not count. A blob's type is that of the container at its first byte, whatever type was
declared; valid containers further inside are carved out. WAV, PGM, PNG, GIF, gzip and zip are known.

Defined cases: a null or empty blob has nothing embedded, and of types only a declared one that is not known here; a container whose declared
length exceeds the bytes present is not valid; containers inside a found one are reported too, as
they have an offset of their own; a null text counts as empty, repeated rows are stored one by one, very long texts are pieces of
their own, and an empty table gives an empty one; extra columns pass through, but for those that bear an output's name.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from junctura.llm import blocks


def wav_of(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM whose samples are the payload's bytes (of an even number)."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def _wav(data: memoryview) -> int:
    """Length of a valid file at the start of ``data``, 0 if there is none: plain, float or extensible samples of 8 to 64 bits, whole frames."""
    if len(data) < 44 or data[8:12] != b"WAVE":
        return 0
    end = 8 + int.from_bytes(data[4:8], "little")
    at, seen = 12, 0
    while at + 8 <= end <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"fmt ":
            kind, channels, frame, bits = (int.from_bytes(data[at + a : at + a + 2], "little") for a in (8, 10, 20, 22))
            seen |= size >= 16 and kind in (1, 3, 0xFFFE) and bits in (8, 16, 24, 32, 64) and frame == channels * bits // 8 > 0
        elif data[at : at + 4] == b"data":
            seen |= 2 * (at + 8 + size <= end)
        at += 8 + size + size % 2
    return end if seen == 3 else 0


def wav_samples(data: memoryview) -> memoryview:
    """The samples of a valid file."""
    at = 12
    while data[at : at + 4] != b"data":
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8 + size + size % 2
    return data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")]


#: Numbers of a header stand between white space and comments, which begin with "#" and end with their line.
_PGM = re.compile(rb"P5" + rb"(?:\s|#[^\r\n]*+[\r\n])++([0-9]{1,9})" * 3 + rb"(?:#[^\r\n]*+)?\s")


def _pgm(data: memoryview) -> int:
    head = _PGM.match(data)
    if not head:
        return 0
    width, height, most = map(int, head.groups())
    if not (width and height and 0 < most < 65536):
        return 0
    size = head.end() + width * height * (1 + (most > 255))
    return size if size <= len(data) else 0


def _png(data: memoryview) -> int:
    at, first = 8, True
    while at + 12 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), bytes(data[at + 4 : at + 8])
        if at + 12 + size > len(data) or first and (kind != b"IHDR" or size != 13):
            return 0
        if zlib.crc32(data[at + 4 : at + 8 + size]) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            return 0
        at, first = at + 12 + size, False
        if kind == b"IEND":
            return at
    return 0


def _gif(data: memoryview) -> int:
    if len(data) < 14:
        return 0
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    at = 13 + table(data[10])
    while at < len(data):
        if data[at] == 0x3B:
            return at + 1
        if data[at] == 0x21:
            at += 2
        elif data[at] == 0x2C and at + 10 < len(data):
            at += 11 + table(data[at + 9])
        else:
            return 0
        while at < len(data) and data[at]:
            at += data[at] + 1
        at += 1
    return 0


def _gzip(data: memoryview) -> int:
    reader = zlib.decompressobj(31)
    try:
        rest = data
        while len(rest) and not reader.eof:
            reader.decompress(rest, 1 << 20)
            rest = reader.unconsumed_tail
    except zlib.error:
        return 0
    return len(data) - len(reader.unused_data) if reader.eof else 0


def _zip(data: memoryview) -> int:
    """By the end record whose central directory lies where it says, so entries may have descriptors after their data."""
    raw, at = bytes(data), 0
    while (at := raw.find(b"PK\5\6", at)) >= 0 and at + 22 <= len(raw):
        entries, size, begin, note = struct.unpack_from("<HIIH", raw, at + 10)
        if begin + size == at and at + 22 + note <= len(raw):
            place = begin
            for _ in range(entries):
                if raw[place : place + 4] != b"PK\1\2" or place + 46 > at:
                    break
                if raw[(local := int.from_bytes(raw[place + 42 : place + 46], "little")) : local + 4] != b"PK\3\4":
                    break
                place += 46 + sum(struct.unpack_from("<HHH", raw, place + 28))
            else:
                if place == at and (entries or at == 0):
                    return at + 22 + note
        at += 4
    return 0


#: Magic bytes of the formats.
MAGIC = {
    b"RIFF": "audio/wav",
    b"P5\n": "image/x-portable-graymap",
    b"P5 ": "image/x-portable-graymap",
    b"P5\r": "image/x-portable-graymap",
    b"P5\t": "image/x-portable-graymap",
    b"P5#": "image/x-portable-graymap",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\x1f\x8b\x08": "application/gzip",
    b"PK\x03\x04": "application/zip",
}
VALIDATORS: dict[str, Callable[[memoryview], int]] = {
    "audio/wav": _wav,
    "image/x-portable-graymap": _pgm,
    "image/png": _png,
    "image/gif": _gif,
    "application/gzip": _gzip,
    "application/zip": _zip,
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(blob: bytes | None, magics: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every valid container, by offset."""
    view, found = memoryview(blob or b""), []
    for end, (size, kind) in magics.iter(str(view, "latin-1")):
        at = end - size + 1
        if length := VALIDATORS[kind](view[at:]):
            found.append((at, length, kind))
    return found


def sniff_media(table: DataFrame, column: str = "media", declared: str | None = None) -> DataFrame:
    """``table`` with `media_type`, `corrected` and `embedded`.

    `media_type` is that of the valid container at byte 0. Where there is none, a declared type that is not known here stays, as
    nothing speaks against it; one that is known does not hold, and the type is null. `corrected`: a declared type is there and
    differs. `embedded`: (offset, length, type, content) of every other container.
    """
    added = [T.StructField("media_type", T.StringType()), T.StructField("corrected", T.BooleanType())]
    part = T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType()), T.StructField("content", T.BinaryType())])
    kept = table.select([c for c in table.columns if c not in ("media_type", "corrected", "embedded")])
    arrow = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("content", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magics = automaton()
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                rows = batch.slice(begin, 64)
                types, wrong, inner = [], [], []
                said = rows.column(declared).to_pylist() if declared else [None] * rows.num_rows
                for blob, claim in zip(rows.column(column).to_pylist(), said, strict=True):
                    found = sniff(blob, magics)
                    at_first = next((k for a, _, k in found if a == 0), None)
                    types.append(at_first or (None if claim in VALIDATORS else claim))
                    wrong.append(claim is not None and claim != types[-1])
                    inner.append([{"offset": a, "length": n, "type": k, "content": blob[a : a + n]} for a, n, k in found if a])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(types, pa.string()), pa.array(wrong), pa.array(inner, arrow)], [*rows.schema.names, "media_type", "corrected", "embedded"])

    return kept.mapInArrow(blocks.released(run), T.StructType([*kept.schema.fields, *added, T.StructField("embedded", T.ArrayType(part))]))


def text_media(documents: DataFrame) -> DataFrame:
    """`media`: each whole text, padded with zero bytes to a positive multiple of 64, as 8-bit WAV samples; with `n_bytes` before padding."""
    kept = documents.select([c for c in documents.columns if c not in ("media", "n_bytes")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks.pieces(batch, "text"):
                data, offsets = blocks.bytes_of(piece.column("text"))
                raw, media = data.tobytes(), []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    media.append(wav_of(raw[a:b].ljust(max(64, -(-(b - a) // 64) * 64), b"\0")))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(media, pa.binary()), pa.array(np.diff(offsets))], [*piece.schema.names, "media", "n_bytes"])

    return kept.mapInArrow(blocks.released(run), T.StructType([*kept.schema.fields, T.StructField("media", T.BinaryType()), T.StructField("n_bytes", T.LongType())]))


def read_samples(media: DataFrame) -> DataFrame:
    """What the stored bytes of `media` hold, found by sniffing: the payload's digests and features; `media` itself goes.

    `feature` has the type found, the number of containers, and of the samples the sum, the smallest,
    the largest, the number of zeros and of changes of the high bit.
    """
    kept = media.select([c for c in media.columns if c not in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])
    left = [f for f in kept.schema.fields if f.name != "media"]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    long, text = T.LongType(), T.StringType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magics = automaton()
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                rows, out = batch.slice(begin, 64), []
                for blob in rows.column("media").to_pylist():
                    found = sniff(blob, magics)
                    length = next((n for a, n, k in found if a == 0 and k == "audio/wav"), 0)
                    if not length:
                        out.append((None,) * 4 + ((None, None) if blob is None else (len(blob), hashlib.sha256(blob).hexdigest())))
                        continue
                    samples = wav_samples(memoryview(blob)[:length])
                    x = np.frombuffer(samples, np.uint8)
                    feature = f"audio/wav;containers={len(found)};samples={len(x)};sum={int(x.sum(dtype=np.int64))};min={x.min()};max={x.max()};zeros={int((x == 0).sum())};turns={int(np.count_nonzero(np.diff(x >> 7)))}"
                    out.append((len(x), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
                a, b, c, d, e, f = zip(*out, strict=True)
                columns = [pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.string()), pa.array(f, pa.string())]
                yield pa.RecordBatch.from_arrays([*(rows.column(k.name) for k in left), *columns], [*(k.name for k in left), *names])

    return kept.mapInArrow(blocks.released(run), T.StructType([*left, *(T.StructField(n, t) for n, t in zip(names, (long, text, long, long, text, text), strict=True))]))


def op10_media(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_samples(text_media(documents).select("doc_id", "n_bytes", "media")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
