"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (``SIZES`` code points of the lower-cased text, white space as spaces) of the whole text,
hashed to 2**``BUCKET_BITS`` buckets. A feature counts as its log ratio of document
frequencies in the two classes; a logistic regression with a ridge weighs the ``FEATURES`` most telling ones. It is fitted on
a bounded sample of the labelled rows: the ``SAMPLE_PER_CLASS`` of each class with the smallest hashes of their ids, of
texts up to ``SAMPLE_BYTES``. Spark counts the sample's document frequencies and picks the features; what comes to the driver is which
of those each row of the sample has, no texts. The intercept is moved to the classes' shares among all training rows.

Defined cases: null and empty texts have no features and get the intercept's score; if no labelled row of one class can be
used, every score is the share of class 1, 0.5 without any; repeated rows each get their row; texts of any length are
scored whole; an empty table of documents gives no rows; columns that clash are not read. The ``FEATURES`` buckets of the grams that tell the classes apart best decide every score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from framelode.llm import common, shingles

SIZES = (3, 4, 5, 6)
BUCKET_BITS = 20
SAMPLE_PER_CLASS, SAMPLE_BYTES = 4000, 32768
#: RIDGE is for a training set of one row and shrinks as it grows.
FEATURES, LEAST_TELLING, RIDGE, STEPS = 1024, 4.0, 9.0, 12
THRESHOLD = 0.3
#: Bytes of text whose code points, values and n-grams, some hundred times as much, a worker holds at once.
SLICE = 1 << 19


#: By code point below 2**16: itself, or a space if it is white space; and a random value.
_FOLD = np.arange(1 << 16, dtype=np.uint32)
_FOLD[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 32
_VALUE = shingles.mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1 << 20))


def points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all lower-cased texts, one after another, and where each begins (and the end). Null texts are empty."""
    low = pc.utf8_lower(pc.fill_null(column, ""))
    offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(low)), dtype=np.int64)])
    return np.frombuffer("".join(low.to_pylist()).encode("utf-32-le"), np.uint32), offsets


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the code points at which an n-gram of one text begins, and its bucket."""
    n = len(data)
    low = np.minimum(data, np.uint32((1 << 16) - 1))
    values = _VALUE[_FOLD[low]]
    if (high := data >= 1 << 16).any():
        values[high] = shingles.mixed(data[high].astype(np.uint64) + np.uint64(1 << 20))
    up, down = shingles.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for size in SIZES:
        at = np.flatnonzero(np.arange(size, n + size) <= ends)
        yield at, (shingles.mixed((sums[at + size] - sums[at]) * down[at] + np.uint64(size)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def present(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs; wanted: which buckets count."""
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keys = []
    for at, bucket in grams(data, offsets):
        if wanted is not None:
            hit = np.flatnonzero(wanted[bucket])
            at, bucket = at[hit], bucket[hit]
        keys.append(texts[at] << BUCKET_BITS | bucket)
    pairs = np.concatenate(keys)
    if len(offsets) <= 1 << (32 - BUCKET_BITS):
        pairs = pairs.astype(np.uint32)
    pairs.sort()
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]].astype(np.int64)
    return pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def scores(self, column: pa.Array) -> np.ndarray:
        data, offsets = points(column)
        logit = np.full(len(column), self.intercept)
        if len(data):
            text, bucket = present(data, offsets, self.weights != 0)
            logit += np.bincount(text, self.weights[bucket], len(column))
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def constant(shares: tuple[int, int]) -> Model:
    """The model of one class alone: the share of class 1."""
    share = (shares[1] + 0.5) / (sum(shares) + 1)
    return Model(np.zeros(1 << BUCKET_BITS), float(np.log(share / (1 - share))))


def fitted(buckets: np.ndarray, scale: np.ndarray, row: np.ndarray, col: np.ndarray, label: np.ndarray, shares: tuple[int, int]) -> Model:
    """buckets and scale: the features and their log ratios; (row, col): which of them each row has; label: of each row; shares: rows of class
    0 and 1 in the whole training set."""
    weights = np.zeros(1 << BUCKET_BITS, np.float64)
    ones = int(label.sum())
    total = np.array([len(label) - ones, ones])
    value = scale[col]
    beta, bias = np.zeros(len(buckets)), float(np.log(total[1] / total[0]))
    # Newton steps on the mean log loss with a ridge, each solved by conjugate gradients
    n, ridge = len(label), RIDGE / len(label)
    for _ in range(STEPS):
        chance = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * beta[col], n) + bias, -60, 60)))
        miss, bend = (chance - label) / n, np.maximum(chance * (1 - chance), 1e-6) / n
        left = -np.append(np.bincount(col, value * miss[row], len(buckets)) + ridge * beta, miss.sum())
        step, way, size = np.zeros(len(left)), left.copy(), float(left @ left)
        for _ in range(30):
            if size < 1e-14:
                break
            moved = bend * (np.bincount(row, value * way[col], n) + way[-1])
            curve = np.append(np.bincount(col, value * moved[row], len(buckets)) + ridge * way[:-1], moved.sum() + 1e-9 * way[-1])
            length = size / float(way @ curve)
            step += length * way
            left = left - length * curve
            before, size = size, float(left @ left)
            way = left + size / before * way
        beta, bias = beta + step[:-1], bias + float(step[-1])
    weights[buckets] = beta * scale
    return Model(weights, float(bias + np.log(shares[1] / shares[0]) - np.log(total[1] / total[0])))


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, held: int = 2) -> Model:
    """The model of ``labels[label]`` from the rows outside the held-out fold."""
    known = labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id"), parts) != held)).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    usable = common.written(docs.select(F.col("doc_id").cast("long").alias("_id"), F.octet_length("text").alias("_n")).join(known, "_id").select("_id", "y", "_n"), "labelled")
    counts = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        own = usable.where((F.col("y") == y) & (F.coalesce("_n", F.lit(0)) <= SAMPLE_BYTES)).select("_id", "y").distinct().orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id").limit(SAMPLE_PER_CLASS)
        picked = own if picked is None else picked.union(own)
    # at most 2 * SAMPLE_PER_CLASS ids, so that they may go out to all
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).join(F.broadcast(picked), "_id").dropDuplicates(["_id"]).select("_id", "text", "y")
    sample = common.written(rows, "sample")
    total = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    shares = counts.get(0, 0), counts.get(1, 0)
    if len(total) < 2:
        return constant(shares)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in common.by_text_bytes(batches, most=SLICE // 2):
            label = np.asarray(batch.column("y"))
            text, bucket = present(*points(batch.column("text")))
            for c in (0, 1):
                known[c] += np.bincount(bucket[label[text] == c], minlength=1 << BUCKET_BITS)
        held = np.flatnonzero(known.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(known[0][held]), pa.array(known[1][held])], ["bucket", "n0", "n1"])

    share = [(F.col(f"n{c}") + 1) / F.lit(total[c] + 2.0) for c in (0, 1)]
    rate = (F.col("n0") + F.col("n1") + 1) / F.lit(total[0] + total[1] + 2.0)
    # how far the two frequencies are apart, against what chance allows
    telling = F.abs(share[1] - share[0]) / F.sqrt(rate * (1 - rate) * (1 / total[0] + 1 / total[1]))
    every = sample.mapInArrow(frequencies, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    best = every.select("bucket", F.log(share[1] / share[0]).alias("scale"), telling.alias("telling")).where(F.col("telling") > LEAST_TELLING).orderBy(F.desc("telling"), "bucket").limit(FEATURES).collect()
    best = sorted((r.bucket, r.scale) for r in best)
    buckets, scale = np.array([b for b, _ in best], np.int64), np.array([s for _, s in best], float)
    wanted, index = np.zeros(1 << BUCKET_BITS, bool), np.zeros(1 << BUCKET_BITS, np.int32)
    wanted[buckets], index[buckets] = True, np.arange(len(buckets))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_text_bytes(batches, most=SLICE // 2):
            text, bucket = present(*points(batch.column("text")), wanted)
            ends = np.searchsorted(text, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("y"), pa.ListArray.from_arrays(pa.array(ends), pa.array(index[bucket]))], ["_id", "y", "has"])

    # a row of the sample has FEATURES of them at most
    table = sample.mapInArrow(features, "_id long, y int, has array<int>").toArrow().sort_by([("_id", "ascending")])
    has = table.column("has").combine_chunks()
    row = np.repeat(np.arange(len(has)), np.asarray(has.value_lengths()))
    return fitted(buckets, scale, row, np.asarray(has.flatten()).astype(np.int64), np.asarray(table.column("y")).astype(np.int64), shares)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, of class 1."""
    docs = common.clear_of(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_text_bytes(batches, most=SLICE):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch.column("text")))], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
