"""MinHash near-duplicates with b-bit signatures.

1. Each document's set of word shingles gives ``BANDS * ROWS`` minima. Of each minimum the low ``BITS`` bits are
   kept, packed; the whole minima of a band, mixed, are its key. Documents with equal sets fall together first, so
   that from here on a group of copies is one member, however large.
2. Members that share a band's key are candidates if the share of equal low bits, corrected for chance
   collisions, puts their similarity at ``LEAST_ESTIMATE`` or more. A bucket yields a spanning forest of its
   candidate pairs, not the pairs. Components of all forests hold every possible link in one of them.
3. Within a component, links are confirmed on the full sets of shingles themselves, word by word. Again a spanning
   forest is enough for the classes. A bucket or component of more than a block of members is dealt to all
   pairs of its blocks, so that no task holds more than two blocks and every pair still meets.

A link of similarity 0.8 shares no band with probability (1 - 0.8**6)**40 < 1e-5, and an estimate below
``LEAST_ESTIMATE`` then is 4.5 standard errors off. Links are only lost if their ends, besides, are not joined by others.

Defined cases: null and empty texts, and texts of white space, have empty sets and are linked with nothing, not
even with each other. A text with fewer words than a shingle is one shingle. Repeated rows of one doc_id stay rows,
of one component; a null doc_id keeps its row, with its own component null unless copies have an id. An empty table gives no
rows; columns other than doc_id and text are not read, whatever their names. Texts of any length are taken whole; what confirms links holds the words of two blocks, about fifteen bytes for
each byte of their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelode.llm import cc, common, shingles

BANDS, ROWS, BITS = 40, 6, 2
LEAST_ESTIMATE = 0.65
#: Members of a bucket, and members and bytes of text of a component, that one block holds.
BUCKET_BLOCK, BLOCK_DOCS, BLOCK_BYTES = 8192, 1500, 8 << 20

_HASHES = BANDS * ROWS
_SIGNATURE = -(-_HASHES * BITS // 64)
_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 1 << 31, _HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _random.integers(0, 1 << 32, _HASHES, dtype=np.uint32)
_MIXERS = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD_BITS = np.uint64(0x5555555555555555)

_SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, n_bytes long, band array<long>, signature binary"


def minima(values: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set of 64-bit values."""
    values = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(_HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), 256):
        np.minimum(out, (values[at : at + 256, None] * _FACTORS + _TERMS).min(axis=0), out=out)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """Minima, one set a row, to signatures: the low bits side by side in 64-bit words."""
    bits = np.unpackbits(low.astype("<u4").view(np.uint8).reshape(len(low), _HASHES, 4)[:, :, 0], axis=1, bitorder="little").reshape(len(low), _HASHES, 8)[:, :, :BITS]
    flat = np.zeros((len(low), _SIGNATURE * 64), np.uint8)
    flat[:, : _HASHES * BITS] = bits.reshape(len(low), -1)
    return np.packbits(flat, axis=1, bitorder="little").view("<u8")


def estimated(signature: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The similarity that equal low bits speak for, corrected for those that agree by chance (1 in 2**BITS)."""
    apart = signature ^ others
    apart = (apart | (apart >> np.uint64(1))) & _ODD_BITS
    equal = 1 - np.bitwise_count(apart).sum(axis=-1) / _HASHES
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def _sketches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in common.by_text_bytes(batches):
        data, offsets = shingles.utf8(batch.column("text"))
        hashes, _, bounds = shingles.words(data, offsets)
        sets = [np.unique(s) for s in shingles.shingles(hashes, bounds, size)]
        low = np.stack([minima(s) for s in sets])
        with np.errstate(over="ignore"):
            ids = [(int(shingles.mixed(s).sum(dtype=np.uint64)), int(shingles.mixed(s ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64))) for s in sets]
            bands = shingles.mixed((low.reshape(-1, BANDS, ROWS) * _MIXERS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
        identity = np.array(ids, np.uint64).reshape(-1, 2).view(np.int64)
        signature = packed(low)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(identity[:, 0]),
                pa.array(identity[:, 1]),
                pa.array(np.diff(offsets)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel())),
                pa.array([s.tobytes() for s in signature], pa.binary()),
            ],
            [f.split()[0] for f in _SKETCH.split(", ")],
        )


def _forest(starts_from: np.ndarray, near) -> list[tuple[int, int]]:
    """Pairs (seed, member) that connect what ``near`` connects. near(i, others): those of ``others`` that are linked with i."""
    pairs, left = [], starts_from
    while len(left):
        seed, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            hit = near(queue.pop(), left)
            found = left[hit]
            pairs += [(int(seed), int(x)) for x in found]
            queue += found.tolist()
            left = left[~hit]
    return pairs


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], schema=_EDGES)


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the buckets' candidate pairs. Rows of a bucket are adjacent; a bucket that ends a batch is held for the next."""
    held: list[pa.RecordBatch] = []

    def of(table: pa.Table) -> set[tuple[int, int]]:
        key = np.stack([table.column(k).to_numpy() for k in ("key", "i", "j")], axis=1)
        ids = table.column("id").to_numpy()
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u8").reshape(len(ids), _SIGNATURE)
        new = np.ones(len(ids), bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        size = np.diff([*first, len(ids)])
        head = np.repeat(first, size)
        linked = estimated(signature, signature[head]) >= LEAST_ESTIMATE
        star = linked & (head != np.arange(len(ids)))
        pairs = set(zip(ids[head[star]].tolist(), ids[star].tolist(), strict=True))
        # buckets of three or more in which some are not linked with the first: all that are left meet all others
        for b in np.flatnonzero((size > 2) & (np.add.reduceat((~linked).astype(np.int64), first) > 0) if len(first) else []):
            rows = np.arange(first[b], first[b] + size[b])
            order = [*rows[linked[rows]], *rows[~linked[rows]]]
            near = lambda i, others: estimated(signature[i], signature[others]) >= LEAST_ESTIMATE
            pairs.update((int(ids[x]), int(ids[y])) for x, y in _forest(np.array(order), near))
        return {(a, b) for a, b in pairs if a != b}

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in ("key", "i", "j")], axis=1)
        tail = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
        if held and (tail or any(held[-1].column(k)[-1].as_py() != keys[0][n] for n, k in enumerate(("key", "i", "j")))):
            yield _edges(of(pa.Table.from_batches([*held, batch.slice(0, tail)])))
            held = []
        elif tail:
            yield _edges(of(pa.Table.from_batches([batch.slice(0, tail)])))
        held.append(batch.slice(tail))
    if held:
        yield _edges(of(pa.Table.from_batches(held)))


_WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text: str | None, size: int) -> set[tuple[str, ...]]:
    words = _WORD.findall((text or "").translate(_LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[n:] for n in range(size)), strict=False))


def _confirmed(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links, on full sets, within each block or pair of blocks of a component."""
    for table in common.in_groups(batches, ["component", "i", "j"]):
        ids, known, flat, starts = table.column("id").to_numpy(), {}, [], [0]
        for text in table.column("text").to_pylist():
            flat += [known.setdefault(s, len(known)) for s in shingle_set(text, size)]
            starts.append(len(flat))
        held, sizes = np.array(flat, np.int32), np.diff(starts)
        starts = np.array(starts[:-1])
        marked = np.zeros(len(known), np.int32)

        def near(i: int, others: np.ndarray, held=held, starts=starts, sizes=sizes, marked=marked) -> np.ndarray:
            fits = (np.minimum(sizes[others], sizes[i]) * 100 >= np.maximum(sizes[others], sizes[i]) * percent) & (sizes[others] > 0)
            out = np.zeros(len(others), bool)
            if not fits.any():
                return out
            mine = held[starts[i] : starts[i] + sizes[i]]
            marked[mine] = 1
            rows = others[fits]
            if len(rows) * 3 > len(sizes):
                both = np.add.reduceat(marked[held], starts)[rows]
            else:
                both = np.array([marked[held[starts[r] : starts[r] + sizes[r]]].sum() for r in rows])
            marked[mine] = 0
            out[fits] = both * 100 >= (sizes[i] + sizes[rows] - both) * percent
            return out

        pairs = _forest(np.flatnonzero(sizes > 0), near)
        if pairs:
            yield _edges({(int(ids[x]), int(ids[y])) for x, y in pairs if ids[x] != ids[y]})


def _dealt(rows: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """``rows`` with ``i`` and ``j``: (0, 0), or for the keys of ``blocks`` (key, blocks) a copy for each pair of blocks that holds the row's own."""
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1), lambda b: F.struct(F.least(own, b).alias("i"), F.greatest(own, b).alias("j")))
    every = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(pairs)
    return rows.join(blocks, key, "left").withColumn("_at", F.explode(every)).select(*rows.columns, "_at.i", "_at.j")


def components(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach, for each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = common.written(rows.mapInArrow(lambda b: _sketches(b, shingle_words), _SKETCH), "sketches")

    # one member for each distinct set; the member is its smallest doc_id
    classes = common.written(
        sketch.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").alias("id"), F.max("n_bytes").alias("n_bytes")),
        "classes",
    )
    members = sketch.where("n_shingles > 0").join(classes.select("id", "set_a", "set_b"), (F.col("doc_id") == F.col("id")) & sketch["set_a"].eqNullSafe(classes["set_a"]) & sketch["set_b"].eqNullSafe(classes["set_b"]), "left_semi").select(F.col("doc_id").alias("id"), "band", "signature")
    buckets = members.select("id", "signature", F.explode("band").alias("key"))
    heavy = common.written(
        sketch.where("n_shingles > 0").join(classes.select("id"), F.col("doc_id") == F.col("id"), "left_semi").select(F.explode("band").alias("key")).groupBy("key").count().where(F.col("count") > BUCKET_BLOCK).select("key", F.ceil(F.col("count") / BUCKET_BLOCK).alias("blocks")),
        "heavy",
    )
    n = common.partitions(docs)
    dealt = _dealt(buckets, "key", common.small(heavy)).repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    candidates = cc.components(dealt.mapInArrow(_bucket_edges, "a long, b long"))

    groups = candidates.join(classes.select("id", "n_bytes"), "id").select("id", "component", "n_bytes")
    groups = common.written(groups, "candidates")
    size = groups.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("bytes") / BLOCK_BYTES))
    heavy = common.written(size.withColumn("blocks", blocks).where("blocks > 1").select("component", "blocks"), "heavy")
    # texts of documents that are no candidates stay where they are
    texts = common.may_hold(rows, "doc_id", groups, "id").join(groups.select("id", "component"), F.col("doc_id") == F.col("id")).select("id", "component", "text")
    exact = _dealt(texts, "component", common.small(heavy)).repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j", "id")
    links = exact.mapInArrow(lambda b: _confirmed(b, shingle_words, percent), "a long, b long")
    linked = cc.components(links)

    found = classes.join(linked, "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("component_id"))
    found = common.written(found, "found")
    common.dropped(docs.sparkSession, groups)
    full = sketch.where("n_shingles > 0").select("doc_id", "n_shingles", "set_a", "set_b").join(found, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", "component_id")
    return full.union(sketch.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def deduplicated(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their group, which are those of its smallest doc_id. Rows that repeat a doc_id
    and text leave one. Documents without words, which are linked with nothing, and rows without a doc_id all stay. Other columns may have any names."""
    own, n = common.fresh(docs, "gone"), common.fresh(docs, "n")
    gone = components(docs, shingle_words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    left = docs.join(common.small(common.written(gone, "gone")), F.col("doc_id") == F.col(own), "left_anti")
    ids = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(own)
    again = common.small(common.written(ids, "again"))
    once = left.join(again, F.col("doc_id") == F.col(own), "left_anti")
    return once.union(left.join(again, F.col("doc_id") == F.col(own), "left_semi").dropDuplicates(["doc_id", "text"]))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(common.documents(spark, sf_dir), shingle_words=4)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
