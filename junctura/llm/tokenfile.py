"""Token ids in files of bit planes.

Documents are dealt out by ranges of doc_id and sorted inside, so each task holds the next stretch of
the corpus. It encodes its texts, appends the end id to each and writes one file: fixed-size blocks of
ids, each transposed into bit planes (the n-th bits of all its ids side by side) or byte planes, every
plane compressed with zstandard on its own. Planes above a block's largest id are left out. A chunk index
at the end of the file gives place, number of ids, plane sizes and checksum of each block, so any span of
ids is read with the blocks that hold it and no others.

    file    = MAGIC, planes of block 0, planes of block 1, ..., index, its length (8 bytes), MAGIC
    index   = kind of planes (1 byte: 1 bit, 8 byte), ids a block (4), number of blocks (4), then for each
              block: place (8), ids (4), crc32 of the ids as 32-bit integers (4), planes (1), size of each (4)
    numbers are little-endian

Which documents lie where stands in a table of its own (part, file, doc_id, begin, n), written by Spark in
the order of the files. It is also the commit: files that it does not name come from lost attempts.

Words are encoded once for each Python worker, with the library, and kept by a 64-bit hash of their bytes (crafted
words could make two collide); words are told apart as in `bpe`.

Defined cases: a null text is empty and leaves the end id only; a null doc_id comes first; documents that
share a doc_id follow each other by a hash of their texts; equal rows are written one by one; a text of any
length is read back block by block; an empty table gives an empty one; extra columns are not carried.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from junctura.llm import blocks, bpe
from junctura.llm.scratch import free_name, scratch_dir, small, stored

MAGIC = b"JPLANES1"
#: Words that a worker remembers; beyond that it begins anew.
MOST_WORDS = 2_000_000


def planes_of(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """The planes of a block, from the lowest bit or byte up to the highest in use."""
    top = max(1, int(ids.max(initial=0)).bit_length())
    if kind == "byte":
        return [((ids >> np.uint32(8 * b)) & np.uint32(255)).astype(np.uint8).tobytes() for b in range(-(-top // 8))]
    return [np.packbits((ids >> np.uint32(b)) & np.uint32(1)).tobytes() for b in range(top)]


def ids_of(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    """The block of ``n`` ids that `planes_of` took apart."""
    out = np.zeros(n, np.uint32)
    for b, plane in enumerate(planes):
        values = np.frombuffer(plane, np.uint8)
        if kind == "byte":
            out |= values.astype(np.uint32) << np.uint32(8 * b)
        else:
            out |= np.unpackbits(values, count=n).astype(np.uint32) << np.uint32(b)
    return out


def opened(uri: str, mode: str):
    """A file of a store that pyarrow knows; paths without a scheme are local or mounted."""
    from pyarrow import fs

    if "://" not in uri or uri.startswith("file:"):
        store, path = fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    else:
        store, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return store.open_input_file(path)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


class Writer:
    """Writes ids to a file of planes, a block at a time."""

    def __init__(self, uri: str, block_ids: int, kind: str, level: int = 3) -> None:
        self.out, self.kind, self.block_ids = opened(uri, "w"), kind, block_ids
        self.press = zstandard.ZstdCompressor(level=level)
        self.at, self.n, self.held, self.index = len(MAGIC), 0, [], []
        self.waiting = 0
        self.out.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            whole = np.concatenate(self.held)
            cut = self.waiting // self.block_ids * self.block_ids
            for a in range(0, cut, self.block_ids):
                self._block(whole[a : a + self.block_ids])
            self.held, self.waiting = [whole[cut:].copy()], self.waiting - cut
        self.n += len(ids)

    def _block(self, ids: np.ndarray) -> None:
        frames = [self.press.compress(p) for p in planes_of(ids, self.kind)]
        entry = struct.pack("<QIIB", self.at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(frames))
        self.index.append(entry + struct.pack(f"<{len(frames)}I", *map(len, frames)))
        for frame in frames:
            self.out.write(frame)
        self.at += sum(map(len, frames))

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.held))
        index = struct.pack("<BII", 1 if self.kind == "bit" else 8, self.block_ids, len(self.index)) + b"".join(self.index)
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        self.out.close()


class Reader:
    """Spans of ids of a file of planes; keeps the last block that it took apart."""

    def __init__(self, uri: str) -> None:
        self.uri, self.file = uri, opened(uri, "r")
        size = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no file of planes")
        length = struct.unpack("<Q", tail[:8])[0]
        index = self.file.read_at(length, size - len(tail) - length)
        kind, self.block_ids, count = struct.unpack_from("<BII", index)
        self.kind, self.entries, at = "bit" if kind == 1 else "byte", [], 9
        for _ in range(count):
            place, n, crc, planes = struct.unpack_from("<QIIB", index, at)
            self.entries.append((place, n, crc, struct.unpack_from(f"<{planes}I", index, at + 17)))
            at += 17 + 4 * planes
        self.press, self.last, self.ids = zstandard.ZstdDecompressor(), -1, np.zeros(0, np.uint32)

    def block(self, k: int) -> np.ndarray:
        if k != self.last:
            place, n, crc, sizes = self.entries[k]
            raw, at, planes = self.file.read_at(sum(sizes), place), 0, []
            for s in sizes:
                planes.append(self.press.decompress(raw[at : at + s]))
                at += s
            ids = ids_of(planes, n, self.kind)
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError(f"block {k} of {self.uri} is damaged")
            self.last, self.ids = k, ids
        return self.ids

    def span(self, begin: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``begin`` on, in pieces no longer than a block."""
        while n > 0:
            k, inside = divmod(begin, self.block_ids)
            part = self.block(k)[inside : inside + n]
            yield part
            begin, n = begin + len(part), n - len(part)

    def close(self) -> None:
        self.file.close()


class _Words:
    """The ids of the words that a worker has met, by the hashes of the words."""

    def __init__(self, content: str) -> None:
        self.encoder = bpe._tokenizer(content)  # noqa: SLF001 - the one way to make the library's object
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        order = np.argsort(keys)
        found = [e.ids for at in range(0, len(words), 4096) for e in self.encoder.encode_batch([words[k] for k in order[at : at + 4096]], add_special_tokens=False)]
        size = np.array([len(f) for f in found], np.int64)
        flat = np.fromiter((i for f in found for i in f), np.uint32, int(size.sum()))
        place = np.searchsorted(self.keys, keys[order])
        begin = len(self.pool) + np.cumsum(size) - size
        self.keys, self.begin, self.size = np.insert(self.keys, place, keys[order]), np.insert(self.begin, place, begin), np.insert(self.size, place, size)
        self.pool = np.concatenate([self.pool, flat])

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, each text's followed by the end id, and their number by text."""
        data, rows, starts, ends = bpe.split(*blocks.bytes_of(texts))
        h = blocks.keys(data, starts, ends)
        codes, kinds = pd.factorize(h)
        if len(self.keys) + len(kinds) > MOST_WORDS:
            self.clear()
        new = np.flatnonzero(~self.find(kinds)[1])
        if len(new):
            first = np.empty(len(kinds), np.int64)
            first[codes[::-1]] = np.arange(len(h))[::-1]
            raw = data.tobytes()
            self.learn(kinds[new], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        at = self.find(kinds)[0][codes]
        size, begin = self.size[at], self.begin[at]
        upto = np.cumsum(size)
        ids = self.pool[np.repeat(begin - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
        bounds = np.concatenate([[0], upto])[blocks.counted(h, rows, len(texts))]
        counts = np.diff(bounds)
        if end_id is None:
            return ids, counts
        return np.insert(ids, bounds[1:], np.uint32(end_id)), counts + 1


@lru_cache(maxsize=1)
def _words(content: str) -> _Words:
    return _Words(content)


def write_tokens(documents: DataFrame, path: str, folder: str | None = None, end_id: int | None = 2, block_ids: int = 1 << 16, kind: str = "bit", part_bytes: int = 24 << 20) -> DataFrame:
    """Write the ids of all texts in ascending doc_id order; the table (part, file, doc_id, begin, n) of where they lie.

    ``folder`` must be one that all executors reach; by default the shared scratch folder. ``part_bytes`` is the text
    of a file, about. A range is cut by doc_id, a hash of the text and the row's number, so a doc_id that many
    rows share is spread over several files.
    """
    spark = documents.sparkSession
    with open(path, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    folder = folder or f"{scratch_dir(spark)}/planes-{uuid.uuid4().hex[:12]}"
    text = F.coalesce("text", F.lit(""))
    parts = max(1, math.ceil((documents.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0) / part_bytes))
    rows = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("doc_id").asc_nulls_first(), "_hash", "_row"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, writer = _words(content.value), TaskContext.get().partitionId(), None
        uri = f"{folder}/{part:07d}-{uuid.uuid4().hex}.planes"
        for batch in batches:
            for piece in blocks.pieces(batch, "text", 2 << 20):
                writer = writer or Writer(uri, block_ids, kind)
                ids, counts = words.encode(piece.column("text"), end_id)
                begin = writer.n + np.cumsum(counts) - counts
                writer.add(ids)
                fixed = [pa.array(np.full(len(counts), part, np.int32)), pa.array([uri] * len(counts), pa.string())]
                yield pa.RecordBatch.from_arrays([*fixed, piece.column("doc_id"), pa.array(begin), pa.array(counts)], ["part", "file", "doc_id", "begin", "n"])
        if writer:
            writer.close()

    long = T.LongType()
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), documents.schema["doc_id"], T.StructField("begin", long), T.StructField("n", long)])
    return stored(ranged.mapInArrow(blocks.released(written), schema), "places")


def placed(places: DataFrame) -> DataFrame:
    """``places`` with ``start``: the ids of all documents before each, over all files."""
    # One row a file: a running sum over files, not over documents.
    totals = places.groupBy("part").agg(F.sum("n").alias("_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = stored(totals.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_first")), "files")
    return places.join(small(first), "part").withColumn("start", F.col("_first") + F.col("begin")).drop("_first")


def read_tokens(places: DataFrame, ids: bool = True) -> DataFrame:
    """``places`` with ids_crc32 and, where asked for, the ids, as read from the files.

    A row needs only the blocks that hold its span, so the table may be filtered and split as one likes; in
    the order in which it was written each block is read once a task.
    """
    name, crc = free_name(places, "ids"), free_name(places, "ids_crc32")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            at, step = 0, 1024
            while at < batch.num_rows:
                rows = batch.slice(at, step)
                at += rows.num_rows
                crcs, held = [], []
                for uri, begin, n in zip(*(rows.column(c).to_pylist() for c in ("file", "begin", "n")), strict=True):
                    if reader is None or reader.uri != uri:
                        if reader:
                            reader.close()
                        reader = Reader(uri)
                    check, spans = 0, []
                    for part in reader.span(begin, n):
                        check = zlib.crc32(part.astype("<u4").tobytes(), check)
                        if ids:
                            spans.append(part)
                    crcs.append(check)
                    if ids:
                        held.append(np.concatenate(spans).astype(np.int64) if spans else np.zeros(0, np.int64))
                more = [pa.array(held, pa.list_(pa.int64()))] if ids else []
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(crcs, pa.int64()), *more], [*rows.schema.names, crc, *[name] * ids])
        if reader:
            reader.close()

    fields = [T.StructField(crc, T.LongType()), *[T.StructField(name, T.ArrayType(T.LongType()))] * ids]
    return places.mapInArrow(blocks.released(read), T.StructType([*places.schema.fields, *fields]))


def op13_bit_planes(spark, sf_dir: str) -> DataFrame:
    places = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe.default_path())
    return read_tokens(placed(places), ids=False).select("doc_id", "start", F.col("n").alias("n_tokens"), "ids_crc32")
