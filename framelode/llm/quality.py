"""Quality: regularised quadratic discriminant analysis over transformed document statistics.

``STATISTICS`` of the whole text, shares as arcsine square roots and sizes as logarithms, are taken once for every
document. The two classes' means and covariances come from all labelled rows outside the held-out fold, as sums that
Spark adds up; no row is sampled. Each covariance is shrunk towards the pooled one's diagonal and factored once. The score is
the logistic of the difference of the two log densities (half the difference of squared Mahalanobis distances and of log
determinants) and of the log of the classes' shares, divided by ``TEMPER``, as the statistics depend on one another.

Defined cases: null and empty texts have the statistics of no words; with no usable row of one class every score is the
share of class 1, 0.5 without any; repeated rows each get their row; texts of any length are
measured whole; an empty table of documents gives no rows; columns that clash are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelode.llm import common, shingles
from framelode.llm.toxicity import fold

STATISTICS = (
    "words", "word_length", "word_length_spread", "line_length", "distinct_words", "distinct_triples", "top_word", "repeated_lines", "lines",
    "upper", "digits", "punctuation", "symbols", "loud", "white", "letters_beyond_ascii", "short_words", "odd_words", "sentence_ends",
)
SHRINK, TEMPER = 0.15, 4.0
THRESHOLD = 0.5


def _member(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _member(bytes(range(65, 91))), _member(b"0123456789")
_LETTER = _member(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_MARKS, _SYMBOLS, _LOUD, _ENDS = _member(b".,;:'\"()-"), _member(b"#$%&*@^~|<>{}[]\\_=+/`"), _member(b"!?"), _member(b".!?")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each text."""
    data, offsets = shingles.utf8(column)
    hashes, starts, bounds = shingles.words(data, offsets)
    size, count = np.diff(offsets), np.diff(bounds)

    def inside(mask: np.ndarray, edges: np.ndarray = offsets) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.float64)])
        return sums[edges[1:]] - sums[edges[:-1]]

    space = shingles._SPACE[data]
    solid = np.concatenate([[0], np.cumsum(~space)])
    edges = np.append(starts, len(data))
    length = (solid[edges[1:]] - solid[edges[:-1]]).astype(np.float64)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    odd = (letters[edges[1:]] - letters[edges[:-1]]) < length - 1
    mean = inside(length, bounds) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(inside(length**2, bounds) / np.maximum(count, 1) - mean**2, 0))

    # lines, by the mixed sum of their words' hashes: a word begins a line if a line end stands before it
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[starts] if len(starts) else np.zeros(0, np.int64)
    begins = np.append(True, line[1:] != line[:-1])[: len(line)]
    begins[bounds[:-1][bounds[:-1] < len(line)]] = True
    heads = np.flatnonzero(begins)
    place = np.arange(len(hashes)) - np.repeat(heads, np.diff([*heads, len(hashes)])) if len(hashes) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        content = np.add.reduceat(shingles.mixed(hashes + place.astype(np.uint64)), heads) if len(heads) else hashes
    line_bounds = np.searchsorted(heads, bounds)
    lines = np.diff(line_bounds)

    triples = shingles.rolled(hashes, 3)
    distinct, top, distinct_triples, distinct_lines = (np.zeros(len(size)) for _ in range(4))
    for n in np.flatnonzero(count):
        a, b = bounds[n], bounds[n + 1]
        _, times = np.unique(hashes[a:b], return_counts=True)
        distinct[n], top[n] = len(times), times.max()
        distinct_triples[n] = len(np.unique(triples[a : b - 2])) if b - a > 2 else 1
        distinct_lines[n] = len(np.unique(content[line_bounds[n] : line_bounds[n + 1]]))
    return np.stack(
        [
            np.log1p(count), np.log1p(mean), np.log1p(spread), np.log1p(count / np.maximum(lines, 1)), _share(distinct, count),
            _share(distinct_triples, np.maximum(count - 2, 1)), _share(top, count), _share(lines - distinct_lines, lines), np.log1p(lines),
            _share(inside(_UPPER[data]), inside(_LETTER[data])), _share(inside(_DIGIT[data]), size), _share(inside(_MARKS[data]), size),
            _share(inside(_SYMBOLS[data]), size), _share(inside(_LOUD[data]), size), _share(inside(space), size), _share(inside(data >= 128), size),
            _share(inside(length <= 3, bounds), count), _share(inside(odd, bounds), count), _share(inside(_ENDS[data]), count),
        ],
        axis=1,
    )


def solved(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x of factor @ x = right, for a lower triangular factor."""
    out = np.empty_like(right)
    for n in range(len(factor)):
        out[n] = (right[n] - factor[n, :n] @ out[:n]) / factor[n, n]
    return out


class Discriminant:
    """rows, sums and sums of products of each class's statistics, to scores."""

    def __init__(self, count: np.ndarray, sums: np.ndarray, products: np.ndarray):
        self.share = (count[1] + 0.5) / (count.sum() + 1)
        self.classes = None
        if min(count) < 2:
            return
        means = sums / count[:, None]
        covariance = products / count[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = (covariance * count[:, None, None]).sum(axis=0) / count.sum()
        target = np.diag(np.diagonal(pooled) + 1e-6)
        self.classes = []
        for c in (0, 1):
            # the fewer the rows, the more is shrunk away
            shrink = min(1.0, SHRINK + sums.shape[1] / (sums.shape[1] + count[c]))
            factor = np.linalg.cholesky((1 - shrink) * covariance[c] + shrink * target)
            self.classes.append((means[c], factor, np.log(np.diagonal(factor)).sum(), np.log(count[c] / count.sum())))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(rows), self.share)
        density = [prior - volume - 0.5 * (solved(factor, (rows - mean).T) ** 2).sum(axis=0) for mean, factor, volume, prior in self.classes]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPER, -60, 60)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats`` array<double> of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_text_bytes(batches):
            rows = statistics(batch.column("text"))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), stats], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, stats array<double>")


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, held: int = 1) -> Discriminant:
    """From all rows of ``stats`` that are labelled outside the held-out fold."""
    known = labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id"), parts) != held)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    size = len(STATISTICS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, first, second = np.zeros(2), np.zeros((2, size)), np.zeros((2, size, size))
        for batch in batches:
            y = np.asarray(batch.column("y"))
            rows = batch.column("stats").flatten().to_numpy().reshape(-1, size)
            for c in (0, 1):
                own = rows[y == c]
                count[c] += len(own)
                first[c] += own.sum(axis=0)
                second[c] += own.T @ own
        for c in (0, 1):
            flat = np.concatenate([[count[c]], first[c], second[c].ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(flat), pa.int32()), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["y", "at", "value"])

    partial = stats.join(known, "doc_id").select("y", "stats").mapInArrow(sums, "y int, at int, value double")
    # two classes' sums, a fixed number of rows
    total = np.zeros((2, 1 + size + size * size))
    for r in partial.groupBy("y", "at").agg(F.sum("value").alias("value")).collect():
        total[r.y, r["at"]] = r.value
    return Discriminant(total[:, 0], total[:, 1 : 1 + size], total[:, 1 + size :].reshape(2, size, size))


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and ``score``, of class 1."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("stats").flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(rows))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = common.written(measured(common.documents(spark, sf_dir)), "statistics")
    out = scored(stats, train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
