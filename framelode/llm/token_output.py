"""Token ids as binary files: one zstandard dictionary, each document compressed by itself, an index of offsets.

A file is a run of blocks, each ended by a line feed. A block, little-endian:

    magic "ZIDB", version u8, bytes of an id u8, dictionary hash 8 bytes, shard u32, block u32, documents u32,
    payload bytes u64, then for each document: doc_id i64, whether it is null u8, offset in the payload u64, ids u64,
    then the payload: each document's ids as one zstandard frame

so that one document is read from its block by its offset alone. Blocks follow one another by (shard, block), documents by
ascending doc_id, null first. The dictionary is a file beside them and is known by its hash (the first 8 bytes
of its SHA-256). It is trained on the serialised ids of ``SAMPLE_DOCS`` documents at most, of up to ``SAMPLE_BYTES`` of
text each, those with the smallest hashes of their ids; with too few to train on there is none, and its hash is of nothing.

Ids come from the tokenizers library's own model, once for each distinct unit of text (see ``bpe``), kept in a cache that is
bounded in number and length. Files are written by Spark's own writer, with its commit protocol,
and read by its own reader, so any file system that Spark knows will do, and a lost executor costs only its own tasks.

Defined cases: null text is empty and has only the end id; repeated rows are documents of their own, side by side;
an empty table gives no files but the dictionary's; texts of any length are encoded whole, a block by itself if they are longer than one; columns
other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import gc
import struct
import zlib
from collections import ChainMap
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelode.llm import common
from framelode.llm.bpe import CACHE_LENGTH, Splitter, default_vocabulary, pieces, units

END_ID = 2
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1000, 16384, 65536, 3
#: A block is closed at so many bytes or documents; so many blocks make a file.
BLOCK_BYTES, BLOCK_DOCS, FILE_BLOCKS = 1 << 20, 4096, 4
MOST_SHARDS = 2000
#: Units whose ids a worker keeps, at most twice over.
CACHE_UNITS = 200_000

_HEAD = struct.Struct("<4sBB8sIIIQ")
_ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("ids", "<u8")])


class Encoder:
    """Texts to serialised ids, the end id last."""

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.split, self.tokenize = Splitter(self.library), self.library.model.tokenize
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() < 1 << 16 else "<u4")
        self.pack = {n: struct.Struct(f"<{n}{'H' if self.kind.itemsize == 2 else 'I'}").pack for n in range(64)}
        self.end = self.packed([end_id])
        self.codes: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return self.pack[len(ids)](*ids) if len(ids) < 64 else np.array(ids, self.kind).tobytes()

    def learn(self, wanted: set[str]) -> dict[str, bytes]:
        """Put the ids of these units into the cache, where those that were there before may go; those of the units that are too
        long for it are returned. A distinct word of them goes to the library's model once."""
        if len(self.codes) > CACHE_UNITS:
            self.older, self.codes = self.codes, {}
        known: dict[str, bytes] = {}
        tokenize, packed, split, get, older, codes, long = self.tokenize, self.packed, self.split, known.get, self.older.get, self.codes, {}
        for unit in wanted.difference(codes):
            if (code := older(unit)) is None:
                if unit.isascii() and unit.isalpha():  # such a unit is one word
                    code = packed([t.id for t in tokenize(unit.lower())])
                else:
                    own = split(unit)
                    for word in own:
                        if get(word) is None:
                            known[word] = packed([t.id for t in tokenize(word)])
                    code = b"".join(map(known.__getitem__, own))
            if len(unit) > CACHE_LENGTH:
                long[unit] = code
            else:
                codes[unit] = code
        return long

    def encode(self, texts: list[str]) -> list[bytes]:
        odd: dict[str, bytes] = {}
        parts = []
        for text in texts:
            if any(s in text for s in self.special):
                parts.append(pieces(text))
                odd.update((p, self.packed(self.library.encode(p, add_special_tokens=False).ids)) for p in parts[-1] if any(s in p for s in self.special))
            else:
                parts.append(units(text))
        odd |= self.learn(set().union(*parts) - odd.keys())
        code = (ChainMap(odd, self.codes) if odd else self.codes).__getitem__
        return [b"".join([*map(code, p), self.end]) for p in parts]


def _dictionary(docs: DataFrame, path: str) -> bytes:
    """Trained on a bounded sample; empty if the sample is too small for that."""
    import zstandard

    size = F.octet_length("text") <= SAMPLE_BYTES
    # ids first, so that few texts travel
    ids = docs.where(size & F.col("doc_id").isNotNull()).select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h")).orderBy("h", "doc_id").limit(SAMPLE_DOCS).select("doc_id").distinct()
    rows = docs.where(size).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    samples = Encoder(path).encode([r.text for r in sorted(rows, key=lambda r: r.doc_id)])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _zstd(dictionary: bytes, compress: bool = False) -> dict:
    import zstandard

    if not dictionary:
        return {}
    data = zstandard.ZstdCompressionDict(dictionary)
    if compress:
        data.precompute_compress(level=LEVEL)  # once, not for every document
    return {"dict_data": data}


def _mark(dictionary: bytes) -> bytes:
    return sha256(dictionary).digest()[:8]


def _blocks(batches: Iterator[pa.RecordBatch], mark: bytes, width: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by shard and doc_id to blocks."""
    shard, number, entries, held, size = None, 0, [], [], 0

    def closed() -> pa.RecordBatch:
        head = _HEAD.pack(b"ZIDB", 1, width, mark, shard, number, len(entries), size)
        return pa.RecordBatch.from_arrays([pa.array([b"".join([head, np.array(entries, _ENTRY).tobytes(), *held])], pa.binary())], ["block"])

    for batch in batches:
        for own, doc_id, ids, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "blob")), strict=True):
            if entries and (own != shard or size >= BLOCK_BYTES or len(entries) >= BLOCK_DOCS):
                yield closed()
                number = number + 1 if own == shard else 0
                entries, held, size = [], [], 0
            elif own != shard:
                number = 0
            shard = own
            entries.append((doc_id or 0, doc_id is None, size, ids))
            held.append(blob)
            size += len(blob)
    if entries:
        yield closed()


def read_blocks(content: bytes, dictionary: bytes) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """(shard, block, entries, ids of each document) of a file's blocks."""
    import zstandard

    at, decompress = 0, zstandard.ZstdDecompressor(**_zstd(dictionary)).decompress
    while at < len(content):
        magic, version, width, mark, shard, number, count, size = _HEAD.unpack_from(content, at)
        if magic != b"ZIDB" or version != 1 or mark != _mark(dictionary):
            raise ValueError("not a block of this format and dictionary")
        at += _HEAD.size
        entries = np.frombuffer(content, _ENTRY, count, at)
        at += entries.nbytes
        ends = [*entries["offset"][1:].tolist(), size]
        ids = [np.frombuffer(decompress(content[at + a : at + b], max_output_size=n * width), f"<u{width}") for a, b, n in zip(entries["offset"].tolist(), ends, entries["ids"].tolist(), strict=True)]
        at += size
        if content[at : at + 1] != b"\n" or any(len(i) != n for i, n in zip(ids, entries["ids"].tolist(), strict=True)):
            raise ValueError("a block that ends elsewhere than it says")
        at += 1
        yield shard, number, entries, ids


def write(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write the ids of ``docs`` (doc_id, text) under ``path``: ids/ and dictionary/. ``vocabulary``: a path on every executor."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary = _dictionary(docs, vocabulary)
    width = Encoder(vocabulary).kind.itemsize
    spark.range(1).select(F.lit(dictionary).cast("string")).coalesce(1).write.text(f"{path}/dictionary")

    n = max(1, min(MOST_SHARDS, common.partitions(docs)))
    # the shards' first ids: as many as there are shards at most
    firsts = docs.select(F.percentile_approx("doc_id", F.lit([i / n for i in range(1, n)]) if n > 1 else F.lit([0.5]), 10_000).alias("p")).first().p or []
    firsts = sorted(set(firsts)) if n > 1 else []
    shard = F.lit(0)
    if firsts:
        shard = F.size(F.filter(F.lit(firsts), lambda x: x <= F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, compress = Encoder(vocabulary), zstandard.ZstdCompressor(level=LEVEL, **_zstd(dictionary, compress=True)).compress
        gc.disable()  # nothing here has cycles
        try:
            for batch in common.by_text_bytes(batches, most=2 << 20):
                ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
                counts = pa.array([len(i) // width for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_id"), counts, pa.array(map(compress, ids), pa.binary())], ["shard", "doc_id", "n_tokens", "blob"])
        finally:
            gc.enable()

    encoded = docs.select(shard.cast("int").alias("shard"), "doc_id", "text").mapInArrow(encode, "shard int, doc_id long, n_tokens long, blob binary")
    # by the number itself: hashes of a few numbers would leave some tasks empty and give others several shards
    ordered = encoded.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n_tokens", "blob")
    blocks = ordered.mapInArrow(lambda b: _blocks(b, _mark(dictionary), width), "block binary")
    # a string of any bytes, which the writer puts out as they are
    blocks.select(F.col("block").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files under ``path``."""
    found = [bytes(r.content) for r in spark.read.format("binaryFile").load(f"{path}/dictionary").select("content").collect()]
    dictionary = next((d[:-1] for d in found if d), b"")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for shard, number, entries, ids in read_blocks(content.as_py(), dictionary):
                    count = len(entries)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(count, shard, np.int32)),
                            pa.array(np.full(count, number, np.int32)),
                            pa.array(np.arange(count, dtype=np.int32)),
                            pa.array(entries["doc_id"].astype(np.int64), mask=entries["null"].astype(bool)),
                            pa.array(entries["ids"].astype(np.int64)),
                            pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                        ],
                        ["shard", "block", "at", "doc_id", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(f"{path}/ids").select("content")
    rows = common.written(files.mapInArrow(parse, "shard int, block int, at int, doc_id long, n_tokens long, ids_crc32 long"), "read")
    # one row for each shard, MOST_SHARDS at most
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(F.broadcast(shards), "shard").select("doc_id", (F.col("first") + F.col("own")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.light_batches(spark)
    path = common.new_path(spark, "token-ids")
    write(common.documents(spark, sf_dir), path)
    return read(spark, path)
