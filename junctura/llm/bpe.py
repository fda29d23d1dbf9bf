"""BPE encoding and decoding through a table of distinct words.

1. Split: texts fall into words inside Spark tasks. White space ends a word; so does the border
   between letters and digits or punctuation, as long as the word holds only ASCII (without
   apostrophes, control characters or "<|") and Latin-1 letters, where that border also ends a token
   of the vocabulary's own splitting. Any other word stays whole and as it is. Every word is thus
   encoded alone as it would be in its text; simple words are lower-cased (A-Z) first.
2. Each distinct word is encoded once: words that occur twice or more in a table of words, whose ids are
   joined there with the vocabulary's id-to-piece table to give the word's decoded text, which the table
   carries along; words that occur a single time in their only place, where their ids meet the same
   id-to-piece table, broadcast. (With these in the table too, the disk and memory of the tool's limits do
   not suffice: they are more than half of all distinct words.)
3. Ids and pieces go back to their positions: of the distinct-word table the ``most_words`` most frequent
   are broadcast, a bound that does not grow with the data; the table's other words travel as (block,
   position, word) rows through a join with the table and meet their block of documents again. A block is
   about a megabyte of neighbouring texts, compressed for that meeting.

Words are told apart inside a block by 64-bit hashes of their bytes, which crafted words could make collide;
the table itself and its joins compare whole words.

The vocabulary must lower-case its text, end words at white space and have no decoder of its own
(pieces are then joined by one space). Special tokens written out in a text count as such, as the
tokenizers library has it.

Defined cases: a null text counts as empty; texts without words have no tokens and an empty decoded
text; repeated rows are encoded one by one; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from junctura.llm import blocks
from junctura.llm.scratch import free, stored

_SPACE, _LETTER, _OTHER, _WHOLE = range(4)
_KIND = np.full(256, _WHOLE, np.uint8)
_KIND[33:127] = _OTHER
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[ord("'")] = _WHOLE
_KIND[blocks.SPACE] = _SPACE
#: Second bytes after 0xC3 of the Latin-1 letters (all but the signs for times and division).
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with simple words in lower case, row, start, end) of the words."""
    kind = _KIND[data]
    if len(data) > 1:
        latin = np.flatnonzero((data[:-1] == 0xC3) & _LATIN[data[1:]])
        kind[latin] = kind[latin + 1] = _LETTER
        kind[:-1][(data[:-1] == 60) & (data[1:] == 124)] = _WHOLE
    inside = kind != _SPACE
    starts, ends = blocks.runs(inside, offsets)
    hard = np.unique(np.searchsorted(starts, np.flatnonzero(kind == _WHOLE), "right") - 1)
    lower = blocks.LOWER[data]
    for a, b in zip(starts[hard].tolist(), ends[hard].tolist(), strict=True):
        kind[a:b] = _WHOLE
        lower[a:b] = data[a:b]
    cut = np.zeros(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    starts, ends = blocks.runs(inside, offsets, cut)
    return lower, blocks.row_of(starts, offsets), starts, ends


def _kinds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first occurrence of each distinct hash, and its frequency."""
    codes, kinds = pd.factorize(h)
    first = np.empty(len(kinds), np.int64)
    first[codes[::-1]] = np.arange(len(h))[::-1]
    return first, np.bincount(codes, minlength=len(kinds))


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a few megabytes of texts at a time, counted piece by piece: arrays over all their bytes would take hundreds of megabytes."""
    for batch in batches:
        for part in blocks.pieces(batch, "text", 4 << 20):
            hashes, counts, words = zip(*map(_counted_words, blocks.pieces(part, "text")), strict=True)
            codes, kinds = pd.factorize(np.concatenate(hashes))
            first = np.unique(codes, return_index=True)[1]
            n = np.zeros(len(kinds), np.int64)
            np.add.at(n, codes, np.concatenate(counts))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(words).take(pa.array(first)).cast(pa.string()), pa.array(n)], ["word", "n"])


def _counted_words(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Hash, frequency and bytes of each distinct word of a piece."""
    data, _, starts, ends = split(*blocks.bytes_of(piece.column("text")))
    h = blocks.hashes(data, starts, ends)
    at, counts = _kinds(h)
    raw = data.tobytes()
    return h[at], counts, pa.array([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.binary())


def _tokenizer(content: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of every entry of the vocabulary file, added tokens too."""
    with open(path, encoding="utf-8") as file:
        entries = _tokenizer(file.read()).get_vocab(with_added_tokens=True)
    # An Arrow table needs no Python workers to become a DataFrame.
    return spark.createDataFrame(pa.table({"id": pa.array(entries.values(), pa.int32()), "piece": pa.array(entries, pa.string())}))


def _by_id(vocabulary: DataFrame) -> pa.Array:
    """The id-to-piece table in the order of ids, for a look-up by id; ids that do not occur have empty pieces."""
    rows = vocabulary.toArrow()
    at = rows.column("id").to_numpy()
    pieces = np.full(at.max() + 1, "", object)
    pieces[at] = rows.column("piece").to_numpy(zero_copy_only=False)
    return pa.array(pieces, pa.string())


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) of each distinct word."""
    return documents.select("text").mapInArrow(blocks.released(_distinct_words), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=1)
def _encoder(content: str):
    """One tokenizer, made from the vocabulary file's content, for all tasks of a worker."""
    return _tokenizer(content)


def word_table(counts: DataFrame, content: Broadcast) -> DataFrame:
    """(word, n, ids) with every word of ``counts`` encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids = [e.ids for e in encoder.encode_batch(part.column("word").to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return counts.mapInArrow(blocks.released(encode), "word string, n long, ids array<int>")


def decode(sequences: DataFrame, vocabulary: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) of rows with an array of ids, by a join of ids and pieces; ids not in the vocabulary leave nothing."""
    flat = sequences.select(key, F.posexplode_outer(ids).alias("at", "id")).join(F.broadcast(vocabulary), "id", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece"))))
    return flat.groupBy(key).agg(parts.alias("parts")).select(key, F.array_join(F.col("parts.piece"), " ").alias("decoded"))


def decoded_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n, ids, size, decoded): the word table with its ids as decimals, joined with the vocabulary id by id.

    The vocabulary is broadcast and the join runs where the words are, in their order, so the pieces of a
    word come out one after the other and are put together without a shuffle.
    """
    entry = "transform(case when size(ids) = 0 then array(cast(null as int)) else ids end, (id, at) -> struct(id, at, case when at = 0 then word end as word, case when at = 0 then n end as n))"
    flat = words.selectExpr(f"inline({entry})").join(F.broadcast(vocabulary), "id", "left").select("at", "word", "n", "id", "piece")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("at").to_numpy() == 0)
            cut = int(starts[-1]) if len(starts) else 0  # the last word may go on in the next batch
            if cut:
                yield from _words_of([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        yield from _words_of(held)

    return flat.mapInArrow(blocks.released(together), "word string, n long, ids string, size int, decoded string")


def _words_of(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole words from their joined rows."""
    rows = pa.Table.from_batches(batches).combine_chunks() if batches else None
    if not rows or not rows.num_rows:
        return
    at = rows.column("at").to_numpy()
    first = np.flatnonzero(at == 0)
    bounds = np.append(first, len(at))
    if (at != np.arange(len(at)) - np.repeat(first, np.diff(bounds))).any():
        raise RuntimeError("the join of ids and pieces changed the order of a word's ids")
    joined = []
    for column, kind in (("id", pa.string()), ("piece", pa.string())):
        values = rows.column(column).combine_chunks().cast(kind).drop_null()
        there = np.concatenate([[0], np.cumsum(rows.column(column).combine_chunks().is_valid().to_numpy(zero_copy_only=False))])[bounds]
        joined.append((pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(there, pa.int32()), values), " "), np.diff(there)))
    words, n = (rows.column(c).combine_chunks().take(pa.array(first)) for c in ("word", "n"))
    yield pa.RecordBatch.from_arrays([words, n, joined[0][0], pa.array(joined[0][1].astype(np.int32)), joined[1][0]], ["word", "n", "ids", "size", "decoded"])


#: Bits of the filter that tells repeated words from most others, whatever their number.
FILTER_BITS = 1 << 25


def _repeated(words: DataFrame) -> np.ndarray:
    """A bit for each hashed word of a table, gathered by Spark; its size is fixed."""

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = blocks.bytes_of(batch.column("word"))
            spot = (blocks.hashes(data, offsets[:-1], offsets[1:]) % np.uint64(FILTER_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((spot >> 5).astype(np.int32)), pa.array(np.left_shift(np.uint32(1), (spot & 31).astype(np.uint32)).view(np.int32))], ["at", "bits"])

    rows = words.select("word").mapInArrow(spots, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS >> 5, np.uint32)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint32)
    return table


def _has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    spot = (h % np.uint64(FILTER_BITS)).astype(np.int64)
    return (table[spot >> 5] >> (spot & 31).astype(np.uint32) & 1).astype(bool)


class _Frequent:
    """The frequent part of the word table, sorted by the words' hashes."""

    def __init__(self, table: pa.Table) -> None:
        data, offsets = blocks.bytes_of(table.column("word"))
        h = blocks.hashes(data, offsets[:-1], offsets[1:])
        order = np.argsort(h)
        self.hashes = h[order]
        table = table.take(pa.array(order))
        self.size = table.column("size").to_numpy().astype(np.int32)
        self.texts = tuple(self._packed(table.column(c)) for c in ("ids", "decoded"))

    @staticmethod
    def _packed(words: pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
        """All words end to end, and where each begins: far smaller than as many objects."""
        data, offsets = blocks.bytes_of(words)
        return data.tobytes(), offsets

    def taken(self, at: np.ndarray, column: int) -> list[bytes]:
        """The ids (column 0) or pieces (1) of the words at these places."""
        blob, begin = self.texts[column]
        return [blob[a:b] for a, b in zip(begin[at].tolist(), begin[at + 1].tolist(), strict=True)]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table, and which words are there."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h


def _block_key(raw: np.ndarray, ids: list) -> int:
    """Names a block of documents by what it holds, so that every reading of it finds the same name."""
    h = hashlib.blake2b(raw.tobytes(), digest_size=8)
    h.update(repr(ids).encode())
    return int.from_bytes(h.digest(), "little", signed=True)


def _frequent_words(table: DataFrame, most: int) -> tuple[pa.Table, DataFrame]:
    """The words more frequent than a threshold under which at most ``most`` of them remain, and the rest of the table."""
    level = F.floor(F.log2("n") * 16).cast("int")
    room, floor = most, None
    for r in table.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        room -= r["words"]
        if room < 0:
            break
        floor = r["level"]
    kept = table.where(level >= floor) if floor is not None else table.limit(0)
    return kept.select("word", "ids", "size", "decoded").toArrow(), table.where(level < floor) if floor is not None else table


def encode_documents(documents: DataFrame, path: str, most_words: int = 400_000) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text")
    with open(path, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    table = vocabulary(spark, path)
    blocks.give_back()
    # Stored in between, so that a task needs one Python worker at a time.
    encoded = stored(word_table(word_counts(texts).where("n > 1"), content), "encoded")
    words = stored(decoded_words(encoded, table), "words")
    free(encoded)
    known, others = _frequent_words(words, most_words)
    frequent = spark.sparkContext.broadcast(_Frequent(known))
    del known
    blocks.give_back()
    repeated = spark.sparkContext.broadcast(_repeated(others))
    pieces = spark.sparkContext.broadcast(_by_id(table))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in blocks.pieces(batch, "text"):
                raw, offsets = blocks.bytes_of(piece.column("text"))
                data, _, starts, ends = split(raw, offsets)
                h = blocks.hashes(data, starts, ends)
                at = np.flatnonzero(~frequent.value.find(h)[1] & _has(repeated.value, h))
                at = at[_kinds(h[at])[0]]
                text, key = data.tobytes(), _block_key(raw, piece.column("doc_id").to_pylist())
                found = pa.array([text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key)), pa.array(at.astype(np.int32)), found.cast(pa.string())], ["block", "at", "word"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            for piece in blocks.pieces(batch, "text"):
                raw, offsets = blocks.bytes_of(piece.column("text"))
                ids = piece.column("doc_id")
                key, one = _block_key(raw, ids.to_pylist()), pa.array([0, piece.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(one, v) for v in (ids, pa.array(np.diff(offsets)))]
                yield pa.RecordBatch.from_arrays([pa.array([key]), *lists, pa.array([press.compress(raw.tobytes())], pa.binary())], ["block", "ids", "sizes", "blob"])

    ident, long = texts.schema["doc_id"].dataType, T.LongType()
    spots = texts.mapInArrow(blocks.released(rare), "block long, at int, word string")
    back = spots.join(others.select("word", "ids", "decoded"), "word").groupBy("block").agg(F.collect_list(F.struct("at", "ids", "decoded")).alias("rare"))
    packs = texts.mapInArrow(blocks.released(packed), T.StructType([T.StructField("block", long), T.StructField("ids", T.ArrayType(ident)), T.StructField("sizes", T.ArrayType(long)), T.StructField("blob", T.BinaryType())]))
    # Blocks are dealt out whether the join needs it or not: a task that both packs and finishes would take two Python workers, and executors keep each worker that they ever started.
    met = packs.repartition("block").join(back, "block", "left").select("ids", "sizes", "blob", "rare")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, unpress = _encoder(content.value), zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes, blob, rare = (batch.column(c)[k] for c in ("ids", "sizes", "blob", "rare"))
                yield _finished(ids.values, sizes.values.to_numpy(), unpress.decompress(blob.as_py()), rare, frequent.value, encoder, pieces.value)

    return met.mapInArrow(blocks.released(finish), T.StructType([texts.schema["doc_id"], T.StructField("n_tokens", long), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))


def _finished(ids: pa.Array, sizes: np.ndarray, raw: bytes, rare: pa.Scalar, words: _Frequent, encoder, pieces: pa.Array) -> pa.RecordBatch:
    """The rows of one block: ids and pieces of its words in their places."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data, rows, starts, ends = split(np.frombuffer(raw, np.uint8), offsets)
    h = blocks.hashes(data, starts, ends)
    at, known = words.find(h)
    size = words.size[at].astype(np.int64) if len(words.size) else np.zeros(len(h), np.int64)
    extra, place = [[], []], np.zeros(0, np.int64)
    missing = np.flatnonzero(~known)
    if len(missing):
        first, _ = _kinds(h[missing])  # the block's own words, each at its first place
        spots = missing[first]
        by_hash = np.argsort(h[spots])
        spots = spots[by_hash]
        place = np.searchsorted(h[spots], h[missing])
        extra, alone = [[b""] * len(spots), [b""] * len(spots)], np.ones(len(spots), bool)
        if rare.is_valid:  # as the join brought them back
            met = np.searchsorted(h[spots], h[rare.values.field("at").to_numpy()])
            alone[met] = False
            for column, name in zip(extra, ("ids", "decoded"), strict=True):
                for k, w in zip(met.tolist(), rare.values.field(name).to_pylist(), strict=True):
                    column[k] = w.encode()
        alone, text = np.flatnonzero(alone).tolist(), data.tobytes()  # words that occur nowhere else
        for k, e in zip(alone, encoder.encode_batch([text[starts[spots[k]] : ends[spots[k]]].decode() for k in alone], add_special_tokens=False), strict=True):
            extra[0][k] = b" ".join(b"%d" % i for i in e.ids)
            extra[1][k] = " ".join(pieces.take(pa.array(e.ids, pa.int32())).to_pylist()).encode()
        at[missing] = 0
        size[missing] = np.array([len(w.split()) for w in extra[0]])[place]
    first = blocks.counted(h, rows, len(ids))
    counts = np.diff(np.concatenate([[0], np.cumsum(size)])[first])
    codes, used = pd.factorize(at)
    codes, bounds, shas = codes.tolist(), first.tolist(), []
    for column, own in enumerate(extra):
        table = words.taken(used, column) if len(words.size) else [b""] * len(used)
        parts = [table[k] for k in codes]
        for k, p in zip(missing.tolist(), place.tolist(), strict=True):
            parts[k] = own[p]
        if not all(parts):  # words without any token, such as a lone space of another kind, leave nothing
            shas.append([hashlib.sha256(b" ".join(filter(None, parts[a:b]))).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        else:
            shas.append([hashlib.sha256(b" ".join(parts[a:b])).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    return pa.RecordBatch.from_arrays([ids, pa.array(counts), *map(pa.array, shas)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
