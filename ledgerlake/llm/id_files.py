"""Token ids in binary files of patched frame-of-reference blocks.

Documents are dealt by ranges of their ids, so that shards follow one another in
ascending order, and are encoded, packed and written shard by shard. Nothing but ids
of documents is ever compared on the driver.

A shard is a file of segments. A segment holds whole documents and is, in little-endian
numbers:

    magic, bytes of the segment, documents, those of them without an id, ids, blocks
    for each document: its id (int64) and its number of token ids (uint32)
    for each block: where it starts in the segment's data (uint64, the index), its
    smallest id (uint32), width in bits (uint8) and number of exceptions (uint16)
    data: for each block its packed ids, places (uint16) and values (uint32) of its exceptions
    a line feed

A block holds BLOCK ids whatever documents they belong to (the last one of a segment is
filled up). From each id the block's smallest is subtracted; the differences are packed
at the width that PERCENTILE of them need, and those that need more are patched from the
exception list. Ids lie in 64 lanes, so that packing is a few whole-array shifts.

Spark's text writer puts the segments into files (a row is a segment, the line feed
ends the row), so that its commit protocol keeps lost or repeated tasks from leaving
pieces behind, on every file system that Spark knows.
"""

from __future__ import annotations

import math
import re
import struct
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import Memo, Scratch, release, slices, spelling

MODEL, END = "word_bpe_49k.json", 2
BLOCK, PERCENTILE = 1_024, 90
#: A segment ends with the document that brings it to so many ids; a shard gets about so many bytes of text.
SEGMENT_IDS, SHARD_BYTES = 1 << 20, 32 << 20
#: Shards whose starts (one row each) are broadcast; more of them are joined by a shuffle.
BROADCAST_SHARDS = 500_000

_HEAD = struct.Struct("<8sQQQQQ")
_MAGIC = b"PFORIDS1"


# ---- blocks


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(starts, smallest, widths, exceptions, data) of the blocks of an array of uint32."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, "<u4"), np.zeros(0, "u1"), np.zeros(0, "<u2"), b""
    rows = np.concatenate([ids, np.repeat(ids[-1:], n * BLOCK - len(ids))]).reshape(n, BLOCK)
    least = rows.min(axis=1)
    rows = rows - least[:, None]
    at = (BLOCK - 1) * PERCENTILE // 100
    widths = np.frexp(np.partition(rows, at, axis=1)[:, at].astype(np.float64))[1].astype(np.uint8)
    over = rows >> widths[:, None].astype(np.uint64) != 0
    counts = over.sum(axis=1).astype("<u2")
    where = np.nonzero(over)
    places, values = where[1].astype("<u2"), rows[where].astype("<u4")
    ends = np.cumsum(counts, dtype=np.int64)
    packed: list[bytes] = [b""] * n
    for width in set(widths.tolist()) - {0}:
        own = np.flatnonzero(widths == width)
        words = _into_lanes(rows[own].astype(np.uint64) & np.uint64((1 << width) - 1), width)
        for k, row in zip(own.tolist(), words):
            packed[k] = row.tobytes()
    data = [packed[k] + places[e - c : e].tobytes() + values[e - c : e].tobytes() for k, (e, c) in enumerate(zip(ends.tolist(), counts.tolist()))]
    starts = np.cumsum([0, *map(len, data[:-1])], dtype="<u8")
    return starts, least.astype("<u4"), widths, counts, b"".join(data)


def _into_lanes(rows: np.ndarray, width: int) -> np.ndarray:
    """Each 64 numbers of a row as ``width`` words of 64 bits."""
    lanes = rows.reshape(len(rows), -1, 64)
    words = np.zeros((len(rows), lanes.shape[1], width), dtype="<u8")
    for k in range(64):
        word, shift = divmod(k * width, 64)
        words[:, :, word] |= lanes[:, :, k] << np.uint64(shift)
        if shift + width > 64:
            words[:, :, word + 1] |= lanes[:, :, k] >> np.uint64(64 - shift)
    return words.reshape(len(rows), -1)


def _from_lanes(words: np.ndarray, width: int) -> np.ndarray:
    words, mask = words.reshape(len(words), -1, width), np.uint64((1 << width) - 1)
    lanes = np.empty((len(words), words.shape[1], 64), dtype=np.uint32)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        value = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, :, word + 1] << np.uint64(64 - shift)
        lanes[:, :, k] = value & mask
    return lanes.reshape(len(words), -1)


def unpack(starts: np.ndarray, least: np.ndarray, widths: np.ndarray, counts: np.ndarray, data: memoryview, first: int = 0, end: int | None = None) -> np.ndarray:
    """The ids of the blocks first..end; the index says where each of them starts, so no other block is read."""
    end = len(starts) if end is None else end
    out = np.zeros((end - first, BLOCK), dtype=np.uint32)
    for width in set(widths[first:end].tolist()) - {0}:
        own = np.flatnonzero(widths[first:end] == width)
        size = width * BLOCK // 8
        words = np.frombuffer(b"".join([data[s : s + size] for s in starts[first + own].tolist()]), dtype="<u8")
        out[own] = _from_lanes(words.reshape(len(own), -1), width)
    for k in np.flatnonzero(counts[first:end]).tolist():
        n, at = int(counts[first + k]), int(starts[first + k]) + int(widths[first + k]) * BLOCK // 8
        out[k, np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data[at + 2 * n :], "<u4", n)
    out += least[first:end, None]
    return out.reshape(-1)


# ---- segments


def to_segment(doc_ids: list, tokens: list[bytes], dtype: str) -> bytes:
    """A segment without its line feed; documents without an id come first. ``tokens``: the ids of each document as ``dtype``."""
    ids = np.frombuffer(b"".join(tokens), dtype=dtype).astype(np.uint32)
    none, size = sum(d is None for d in doc_ids), np.dtype(dtype).itemsize
    starts, least, widths, counts, data = pack(ids)
    parts = [
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), np.array([len(t) // size for t in tokens], dtype="<u4").tobytes(),
        starts.tobytes(), least.tobytes(), widths.tobytes(), counts.tobytes(), data,
    ]
    total = _HEAD.size + sum(map(len, parts))
    return _HEAD.pack(_MAGIC, total, len(doc_ids), none, len(ids), len(starts)) + b"".join(parts)


class Segment:
    """A segment at a place of a file's bytes."""

    def __init__(self, content: memoryview, at: int):
        magic, total, docs, none, self.n_ids, blocks = _HEAD.unpack_from(content, at)
        if magic != _MAGIC or content[at + total] != 10:
            raise ValueError("no segment of token ids")
        self.end, at = at + total + 1, at + _HEAD.size

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        ids = column("<i8", docs)
        self.doc_ids = [None] * none + ids[none:].tolist()
        self.sizes = column("<u4", docs).astype(np.int64)
        self.blocks = [column(kind, blocks) for kind in ("<u8", "<u4", "u1", "<u2")]
        self.data = content[at : self.end - 1]

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from begin to end (exclusive), read from the blocks that hold them."""
        end = self.n_ids if end is None else end
        if end <= begin:
            return np.zeros(0, dtype=np.uint32)
        first, last = begin // BLOCK, -(-end // BLOCK)
        return unpack(*self.blocks, self.data, first, last)[begin - first * BLOCK : end - first * BLOCK]


def segments(content: bytes):
    """The segments of a file, one after the other."""
    view, at = memoryview(content), 0
    while at < len(view):
        segment = Segment(view, at)
        yield segment
        at = segment.end


# ---- encoding


#: Words of these characters need no normalising but lower case, and are cut by a plain pattern.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: How the tokenizer cuts words, for these characters.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class WordEncoder:
    """Ids of a text by the tokenizers library, which is asked for each new word only.

    This tokenizer drops white space, and no rule of it looks over white space: a text
    has the ids of its words, one after the other. So words, and the parts that the
    tokenizer cuts them into, are looked up in tables of bounded size. The library merges
    each new part; it also normalises and cuts words with other characters than the plain
    ones, and takes words with the string of a special token as a whole.
    """

    def __init__(self, path: str, highest: int = 0):
        """highest: the largest id that is put beside those of the vocabulary; the ids' bytes are of type ``dtype``."""
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.dtype = "<u2" if max(self.library.get_vocab_size(), highest) <= 0xFFFF else "<u4"
        self.library.no_truncation(), self.library.no_padding()
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.model, self.cut, self.level = self.library.model, self.library.pre_tokenizer.pre_tokenize_str, self.library.normalizer.normalize_str
        self.spelled = spelling()
        self.kind = {"<u2": "H", "<u4": "I"}[self.dtype]
        self.part = Memo(self._of_part, 1 << 18)
        self.word = Memo(self._of_word, 600_000)

    def _of_part(self, part: str) -> bytes:
        """The ids of a part in the vocabulary's spelling."""
        ids = array(self.kind, [t.id for t in self.model.tokenize(part)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _of_word(self, word: bytes) -> bytes:
        text = word.decode()
        if any([x in text for x in self.special]):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        if _PLAIN.fullmatch(text):
            parts = _PARTS.findall(text.lower())
            if not text.isascii():
                parts = ["".join([self.spelled[b] for b in part.encode()]) for part in parts]
            return self.part[parts[0]] if len(parts) == 1 else b"".join([self.part[x] for x in parts])
        return b"".join([self.part[x] for x, _ in self.cut(self.level(text))])

    def _lowered(self, text: str) -> str:
        """The text in lower case, if all its characters are of Latin-1, for which that is all that the library changes: fewer words to learn."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        return text if any([x.lower() in low for x in self.special]) else low

    def __call__(self, text: str) -> bytes:
        data = self._lowered(text).encode()
        if len(data) <= SHARD_BYTES:
            return b"".join(map(self.word.__getitem__, data.split()))
        out, at = [], 0
        while at < len(data):  # a very long text: words of one piece after the other
            cut = data.find(b" ", at + SHARD_BYTES // 4)
            cut = len(data) if cut < 0 else cut
            out.append(b"".join(map(self.word.__getitem__, data[at:cut].split())))
            at = cut
        return b"".join(out)


@lru_cache(maxsize=2)
def _encoder(path: str, highest: int) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path, highest)


# ---- tables


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int | None = END, shards: int | None = None) -> None:
    """Write the token ids of all texts to files below ``path``, in ascending order of the documents' ids.

    ``end`` is put after each document's ids (None: nothing). A null or empty text has no
    other ids. Rows without an id come first; rows that share an id stay next to one
    another, in any order, as do equal rows. Other columns are dropped, whatever their
    names. An empty table gives files without segments. The tokenizer is one that drops
    white space between words. A very long text takes about 60 bytes of a worker's memory
    for each word of 8 MB of it, and 2 to 4 bytes for each of its ids.
    """
    tokenizer = tokenizer or public_tokenizers.path(MODEL)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if shards is None:
        shards = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / SHARD_BYTES))
    # Hashes and places part rows that share an id, so that no range has to take all of them.
    order = [F.asc_nulls_first("id"), F.col("tie"), F.col("place")]
    ranged = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def encode(batches):
        encoder = _encoder(tokenizer, end or 0)
        dtype = encoder.dtype
        last = b"" if end is None else np.array([end], dtype=dtype).tobytes()
        ids, tokens, n = [], [], 0
        for batch in (part for whole in batches for part in slices(whole, 1)):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                tokens.append(encoder(text) + last)
                n += len(tokens[-1])
                if n >= SEGMENT_IDS * np.dtype(dtype).itemsize:
                    yield pa.RecordBatch.from_arrays([pa.array([to_segment(ids, tokens, dtype)], pa.binary())], names=["segment"])
                    ids, tokens, n = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([to_segment(ids, tokens, dtype)], pa.binary())], names=["segment"])
        release()

    packed = ranged.select("id", "text").mapInArrow(encode, "segment binary")
    packed.select(F.col("segment").cast("string").alias("value")).write.mode("overwrite").option("compression", "none").option("lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int").alias("shard"), "content")


def _starts(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """(shard, before): the ids of all shards before each, from (shard, n). Shards are summed up in groups first."""
    group = (F.col("shard") / 1024).cast("int")
    sizes = sizes.withColumn("g", group)
    groups = sizes.groupBy("g").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = sizes.withColumn("within", within).join(groups.select("g", before.alias("base")).hint("merge"), "g")
    return own.select("shard", (F.col("base") + F.col("within")).alias("before"))


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): what the files below ``path`` hold, one row for each document.

    start: the ids of all documents before it; ids_crc32: checksum of its ids as
    little-endian unsigned 32-bit numbers; ids (array, in order) only if asked for.
    Files are unpacked once, into a table of the shared folder.
    """
    names = ["shard", "doc_id", "local", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int64())] if ids else [])]

    def decode(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                done = 0
                for segment in segments(content.as_buffer()):
                    flat = np.ascontiguousarray(segment.ids(), dtype="<u4")
                    ends = np.cumsum(segment.sizes)
                    bounds = list(zip((ends - segment.sizes).tolist(), ends.tolist()))
                    crc = [zlib.crc32(flat[a:b]) for a, b in bounds]
                    local = done + ends - segment.sizes
                    columns = [[shard] * len(bounds), segment.doc_ids, local, segment.sizes, crc]
                    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                    if ids:
                        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                        arrays.append(pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
                    done += segment.n_ids
        release()

    schema = "shard int, doc_id long, local long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    scratch = Scratch(spark, "id-files")
    rows = scratch.table(_files(spark, path).mapInArrow(decode, schema), "rows")
    sizes = scratch.table(rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")), "sizes")
    starts = _starts(spark, sizes)
    few = sizes.count() <= BROADCAST_SHARDS
    placed = rows.join(F.broadcast(starts) if few else starts.hint("merge"), "shard")
    return placed.select("doc_id", (F.col("before") + F.col("local")).alias("start"), *names[3:])


def read_slice(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """(at, ids): the ids from place ``begin`` to ``end`` (exclusive) of all files, in runs, each with the place of its first id.

    Only blocks that hold some of them are unpacked: what a trainer needs that starts in
    the middle of a corpus. Places outside the files give no rows.
    """

    def sizes(batches):
        for batch in batches:
            totals = [sum(s.n_ids for s in segments(content.as_buffer())) for content in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64())], names=["shard", "n"])

    def cut(batches):
        for batch in batches:
            for content, before in zip(batch.column(0), batch.column(1).to_pylist()):
                for segment in segments(content.as_buffer()):
                    a, b = max(begin - before, 0), min(end - before, segment.n_ids)
                    if a < b:
                        run = segment.ids(a, b).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([before + a]), pa.array([run], pa.list_(pa.int64()))], names=["at", "ids"])
                    before += segment.n_ids
        release()

    files = _files(spark, path)
    known = Scratch(spark, "id-slice").table(files.mapInArrow(sizes, "shard int, n long"), "sizes")
    starts = _starts(spark, known).join(known.hint("merge"), "shard").where((F.col("before") < end) & (F.col("before") + F.col("n") > begin))
    few = known.count() <= BROADCAST_SHARDS
    wanted = files.join(F.broadcast(starts) if few else starts.hint("merge"), "shard")
    return wanted.select("content", "before").mapInArrow(cut, "at long, ids array<long>")


def op12_id_files(spark, sf_dir: str) -> DataFrame:
    """Every document's place, size and checksum in the files of all token ids, as read back from them."""
    scratch = Scratch(spark, "op12")
    path = f"{scratch.root}/files"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_ids(spark, path, ids=False)
