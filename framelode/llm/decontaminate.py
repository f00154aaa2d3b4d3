"""Benchmark decontamination: MinHash containment search by size classes, verified on exact shingles.

Items are dealt to size classes, powers of two of their number of shingles. Documents are cut, for each class in
use, into windows of as many shingles as its largest item has, so that the sets compared are of like size however
long the document is. A hash function's minimum over an item is the minimum of the window that holds that shingle
with a probability of n / (n + w) at least for an item of n and windows of w shingles, wherever in the document the
item's shingles lie; each class has as many functions as leave a chance below ``MISS`` that an item of which 0.8 is
held agrees in none. Every agreement is a candidate; candidates are verified on the whole sets, by the words themselves.

An item of fewer than ``SHINGLE`` words is one shingle of all its words; a document holds it if they stand there in a row.

The items go out in blocks of bounded size, ``PASS_BLOCKS`` of them for each pass over the documents, which are never shuffled.

Defined cases: null and empty documents and items hold nothing; items of equal texts are searched as one and all listed; repeated
documents each get their rows; a null doc_id or item_id stays null; texts of any length are searched whole; an empty table of documents gives no rows, one of items finds
nothing and drops nothing; other columns keep their names and values.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelode.llm import common, shingles
from framelode.llm.near_dedup import shingle_set

SHINGLE, PERCENT = 5, 80
MISS = 1e-7
#: Items, and bytes of their text, of a block.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 4 << 20
#: Blocks whose items are searched in one pass.
PASS_BLOCKS = 4

_MOST = 64
_random = np.random.default_rng(20240301)
_FACTORS = _random.integers(0, 1 << 31, _MOST, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _random.integers(0, 1 << 32, _MOST, dtype=np.uint32)


def functions_for(level: int) -> int:
    """Hash functions that a class of items of up to 2**level shingles needs."""
    window, least = 1 << level, (1 << level) // 2 + 1 if level else 1
    chance = min((-(-n * PERCENT // 100) / n) * n / (n + window) for n in range(least, window + 1)) if level else 1.0
    return 1 if chance >= 1 else min(_MOST, math.ceil(math.log(MISS) / math.log(1 - chance)))


def _values(hashes: np.ndarray, count: int) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)[:, None] * _FACTORS[:count] + _TERMS[:count]


class ItemIndex:
    """The items of one block: their sets, and for each class a table of which minima occur in which function."""

    def __init__(self, items: list[tuple[list[int | None], str]]):
        self.ids = [ids for ids, _ in items]
        self.sets = [shingle_set(text, SHINGLE) for _, text in items]
        data, offsets = shingles.utf8(pa.array([t for _, t in items], pa.string()))
        hashes, _, bounds = shingles.words(data, offsets)
        self.hashes = [np.unique(s) for s in shingles.shingles(hashes, bounds, SHINGLE)]
        #: By number of words, for items that are too short for a full shingle: those of each shingle.
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for n, own in enumerate(self.sets):
            if own and (size := len(next(iter(own)))) < SHINGLE:
                self.short[size][int(shingles.rolled(hashes[bounds[n] : bounds[n + 1]], size)[0])].append(n)
        self.short = {size: dict(own) for size, own in self.short.items()}
        self.levels: dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]] = {}
        by_level = defaultdict(list)
        for n, (exact, own) in enumerate(zip(self.sets, self.hashes, strict=True)):
            if exact and len(next(iter(exact))) == SHINGLE:
                by_level[(len(own) - 1).bit_length()].append(n)
        self.bits = max(16, min(20, (max(map(len, by_level.values()), default=1)).bit_length() + 7))
        for level, own in sorted(by_level.items()):
            count = functions_for(level)
            keys = np.concatenate([_values(self.hashes[n], count).min(axis=0).astype(np.uint64) | (np.arange(count, dtype=np.uint64) << np.uint64(32)) for n in own])
            order = np.argsort(keys, kind="stable")
            table = np.zeros((count, 1 << self.bits), bool)
            table[(keys >> np.uint64(32)).astype(np.int64), ((keys & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - self.bits)).astype(np.int64)] = True
            self.levels[level] = count, keys[order], np.repeat(own, count)[order], table

    def candidates(self, hashes: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) for all agreements; hashes: the shingles of many documents, which begin at ``bounds``."""
        out: set[tuple[int, int]] = set()
        if not self.levels or not len(hashes):
            return out
        most = max(count for count, *_ in self.levels.values())
        least = min(self.levels)
        width = 1 << least
        starts = np.concatenate([np.arange(a, b, width) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)] or [np.zeros(0, np.int64)])
        document = np.searchsorted(bounds, starts, side="right") - 1
        step = max(1, 8192 >> least)
        parts = []
        for at in range(0, len(starts), step):
            end = int(starts[at + step]) if at + step < len(starts) else len(hashes)
            begin = int(starts[at])
            parts.append(np.minimum.reduceat(_values(hashes[begin:end], most), starts[at : at + step] - begin, axis=0))
        minima = np.concatenate(parts)
        for level, (count, keys, items, table) in self.levels.items():
            while least < level:  # two neighbouring windows of a document make one of the next class
                first = np.searchsorted(document, document)
                heads = np.flatnonzero((np.arange(len(document)) - first) % 2 == 0)
                minima, document, least = np.minimum.reduceat(minima, heads, axis=0), document[heads], least + 1
            row, function = np.nonzero(table[np.arange(count), minima[:, :count] >> np.uint32(32 - self.bits)])
            key = minima[row, function].astype(np.uint64) | (function.astype(np.uint64) << np.uint64(32))
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            for a, b, doc in {(int(a), int(b), int(d)) for a, b, d in zip(low, high, document[row], strict=True) if b > a}:
                out.update((doc, int(item)) for item in set(items[a:b].tolist()))
        return out


_SCHEMA = "doc_id long, item_id long, item_ids array<long>, n_shared long, n_item long"


def _held(batch: pa.RecordBatch, indexes: list[ItemIndex]) -> Iterator[tuple[int, ItemIndex, int, int]]:
    """(row, index, item, shared shingles) for the items that the batch's documents hold, verified. Documents are shingled once for all indexes."""
    text = batch.column("text")
    data, offsets = shingles.utf8(text)
    hashes, _, words = shingles.words(data, offsets)
    every = shingles.shingles(hashes, words, SHINGLE)
    # a shorter text is a single shingle of another size; no longer item is
    every = [s if b - a >= SHINGLE else s[:0] for s, a, b in zip(every, words[:-1], words[1:], strict=True)]
    bounds = np.cumsum([0, *map(len, every)])
    joined = np.concatenate(every) if every else hashes[:0]
    runs = {size: shingles.rolled(hashes, size) for size in {size for index in indexes for size in index.short}}
    texts: dict[int, str] = {}

    def exact_set(row: int, size: int) -> set[tuple[str, ...]]:
        if row not in texts:
            texts.clear()
            texts[row] = text[row].as_py()
        return shingle_set(texts[row], size)

    for index in indexes:
        found = defaultdict(list)
        for row, item in sorted(index.candidates(joined, bounds)):
            found[row].append(item)
        for row, items in found.items():
            own, exact = np.unique(every[row]), None
            for item in items:
                if np.isin(index.hashes[item], own, assume_unique=True).sum() * 100 >= len(index.hashes[item]) * PERCENT:
                    exact = exact_set(row, SHINGLE) if exact is None else exact
                    shared = len(index.sets[item] & exact)
                    if shared * 100 >= len(index.sets[item]) * PERCENT:
                        yield row, index, item, shared
        for size, wanted in index.short.items():
            # a run counts if it ends within the text in which it begins
            at = np.flatnonzero(np.isin(runs[size], np.array(list(wanted), np.uint64)))
            row = np.searchsorted(words, at, side="right") - 1
            inside = at + size <= words[row + 1]
            for row, value in sorted(set(zip(row[inside].tolist(), runs[size][at[inside]].tolist(), strict=True))):
                for item in wanted[value]:
                    if index.sets[item] <= exact_set(row, size):
                        yield row, index, item, 1


def _leaks(batches: Iterator[pa.RecordBatch], indexes: list[ItemIndex]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64())
    for batch in common.by_text_bytes(batches):
        rows = []
        for row, index, item, shared in _held(batch, indexes):
            ids = index.ids[item]
            rows.append((batch.column("doc_id")[row].as_py(), ids[0], ids, shared, len(index.sets[item])))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "item_ids", "n_shared", "n_item"])


def _clean(batches: Iterator[pa.RecordBatch], indexes: list[ItemIndex]) -> Iterator[pa.RecordBatch]:
    for batch in common.by_text_bytes(batches):
        stays = np.ones(batch.num_rows, bool)
        stays[[row for row, *_ in _held(batch, indexes)]] = False
        yield batch.filter(pa.array(stays))


def _indexes(items: DataFrame) -> Iterator[list[Broadcast]]:
    """The items' indexes, block by block, those of a pass together; a block's size is bounded, so that it may go to the driver and out to all."""
    spark = items.sparkSession
    items = items.where("text is not null").groupBy("text").agg(F.sort_array(F.collect_list(F.col("item_id").cast("long"))).alias("ids"))
    items = common.written(items, "items")
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-total.n // BLOCK_ITEMS), -(-total.bytes // BLOCK_BYTES))
    held = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("text").collect()
        held.append(spark.sparkContext.broadcast(ItemIndex([(list(r.ids) or [None], r.text) for r in rows])))
        if len(held) == PASS_BLOCKS or block == blocks - 1:
            yield held
            held = []
    common.dropped(spark, items)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, item_ids, n_shared, n_item: one row for each document and each distinct item (by text; item_id is the
    smallest of those in item_ids) of whose shingles the document holds 80 of 100 or more."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return reduce(DataFrame.union, [docs.mapInArrow(lambda batches, own=own: _leaks(batches, [i.value for i in own]), _SCHEMA) for own in _indexes(items)])


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold an item, each row judged by its own text."""
    return reduce(lambda left, own: left.mapInArrow(lambda batches: _clean(batches, [i.value for i in own]), docs.schema), _indexes(items), docs)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
