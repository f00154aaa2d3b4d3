"""SimHash near-duplicates found by deletion-variant signatures.

1. A document's fingerprint has a bit where over half of its word shingles' XXH64 (seed 42) have it. Documents of one fingerprint fall together first,
   so that from here on a group of copies is one member, however large.
2. Fingerprints at ``DISTANCE`` or fewer differing bits, cut into ``DISTANCE // 2 + 1`` segments, differ by at most one bit in one of them at least. A
   segment is filed once for each of its bits with that bit left out: 64 variants a fingerprint. Two segments that differ by at most one bit share the
   variant without it, so an equality join on (bit left out, rest of the segment) meets every link, where segments that must be equal would have to be
   shorter, and their buckets larger.
3. A bucket's members are compared by counting differing bits; it yields a spanning forest of the links, not the pairs, and of that only the links that
   no earlier bucket has too. A bucket of more than ``BLOCK`` members is dealt to all pairs of its blocks: no task holds more than two blocks of it, and every
   pair still meets. Components of all forests are the classes.

Defined cases: null and empty texts, and texts of white space, have fingerprint zero, which links like any other. A text of fewer words than a shingle is
one shingle. Rows are documents: a repeated doc_id keeps all its rows, each with its own fingerprint's class. A row without a doc_id is shown with the class
of its fingerprint if any row with an id has that, else with a null one, and links nothing itself. An empty table gives no rows; columns other
than doc_id and text are not read, whatever their names. Texts of any length are taken whole; a worker holds one slice of about a megabyte of texts, or one
longer text and the hashes of ``_CHUNK`` shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from framelode.llm import cc, common, near_dedup

DISTANCE, SEED = 4, 42
#: Members of a bucket that one block holds.
BLOCK = 8192
_CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = 4) -> int:
    """Unsigned, of the text's word shingles."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z alone, and white space 0x09-0x0D and 0x20
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    ends = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """doc_id and ``bits``, the fingerprint as a signed long, of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_text_bytes(batches):
            bits = np.array([fingerprint(t, shingle_words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, bits long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment. ``distance`` is 2 at least."""
    cuts = np.linspace(0, 64, distance // 2 + 2).astype(int).tolist()
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _variants(bits: Column, distance: int) -> Column:
    """The keys of a fingerprint: for each bit its number, above the other bits of its segment."""
    keys = []
    for first, width in segments(distance):
        own = F.shiftrightunsigned(bits, first).bitwiseAND(F.lit((1 << width) - 1 if width < 63 else -1))
        keys += [F.struct(F.lit(first + i).alias("out"), own.bitwiseAND(F.lit(~(1 << i))).alias("rest")) for i in range(width)]
    return F.array(*keys)


def _first_shared(apart: np.ndarray, distance: int) -> np.ndarray:
    """The number of the first variant that fingerprints share which differ in the bits ``apart``: that of the lowest bit of the first segment in
    which they are equal, or of the bit in which they differ alone."""
    out = np.full(len(apart), 64)
    for first, width in reversed(segments(distance)):
        own = (apart >> np.uint64(first)) & np.uint64((1 << width) - 1)
        count = np.bitwise_count(own)
        bit = np.bitwise_count((own & (~own + np.uint64(1))) - np.uint64(1))
        out = np.where(count == 0, first, np.where(count == 1, first + bit.astype(np.int64), out))
    return out


_KEY = ("out", "rest", "i", "j")


def _bucket_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links of each bucket, rows of which are adjacent; a bucket that ends a batch is held for the next."""
    held: list[pa.RecordBatch] = []

    def of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        key = np.stack([table.column(k).to_numpy() for k in _KEY], axis=1)
        bits = table.column("id").to_numpy().view(np.uint64)
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        size = np.diff(np.r_[first, len(bits)])
        near = lambda i, others: np.bitwise_count(bits[i] ^ bits[others]) <= distance
        pairs = [p for b in np.flatnonzero(size > 1).tolist() for p in near_dedup._forest(np.arange(first[b], first[b] + size[b]), near)]
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        # the forest's links lead to the seed: one that is no link itself is left to no other bucket
        apart = bits[a] ^ bits[b]
        own = (np.bitwise_count(apart) > distance) | (_first_shared(apart, distance) >= key[a, 0])
        a, b = bits[a[own]].view(np.int64), bits[b[own]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in _KEY], axis=1)
        others = np.flatnonzero((keys != keys[-1]).any(axis=1))
        tail = int(others[-1]) + 1 if len(others) else 0
        if held and (tail or any(held[-1].column(k)[-1].as_py() != keys[0][n] for n, k in enumerate(_KEY))):
            yield of([*held, batch.slice(0, tail)])
            held = []
        elif tail:
            yield of([batch.slice(0, tail)])
        held.append(batch.slice(tail))
    if held:
        yield of(held)


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (``a``, ``b``) that connect the fingerprints ``id`` of a table, each there once, as all links of ``distance`` bits or fewer do."""
    n = common.partitions(classes)
    filed = classes.select("id", F.explode(_variants(F.col("id"), distance)).alias("key")).select("id", "key.out", "key.rest")
    many = filed.groupBy("out", "rest").count().where(F.col("count") > BLOCK)
    heavy = common.small(common.written(many.select("out", "rest", F.ceil(F.col("count") / BLOCK).alias("blocks")), "heavy"))
    dealt = near_dedup._dealt(filed, ["out", "rest"], heavy).repartition(n, *_KEY).sortWithinPartitions(*_KEY)
    return dealt.mapInArrow(lambda b: _bucket_links(b, distance), "a long, b long")


def components(docs: DataFrame, shingle_words: int = 4, distance: int = DISTANCE) -> DataFrame:
    """doc_id, ``bits`` (the fingerprint as a signed long) and component_id, the smallest doc_id that links reach, for each row of ``docs``."""
    sketch = common.written(fingerprints(docs, shingle_words), "fingerprints")
    classes = common.written(sketch.where("doc_id is not null").groupBy(F.col("bits").alias("id")).agg(F.min("doc_id").alias("least")), "classes")
    linked = common.written(cc.components(links(classes.select("id"), distance)), "linked")
    # the smallest doc_id of each component of fingerprints
    named = linked.join(classes, "id").groupBy("component").agg(F.min("least").alias("least"))
    together = linked.join(named, "component").select("id", F.col("least").alias("together"))
    found = common.written(classes.join(together, "id", "left").select(F.col("id").alias("bits"), F.coalesce("together", "least").alias("component_id")), "found")
    common.dropped(docs.sparkSession, linked)
    return sketch.join(found, "bits", "left").select("doc_id", "bits", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(common.documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
