"""Ranked lexical search by hierarchical max trees and best-first branch-and-bound.

1. The index has one row a document, with its distinct terms and how often each occurs; it knows no query and is written once. Documents are counted
   once for all queries, and the documents of a term for the terms of a block of queries.
2. A task takes documents in blocks. For each term asked for, a block has a tree over ranges of its documents, which are in order of length: a leaf is the impact
   of the term in a document, a range's node the greatest impact among its ``FAN`` children. Only ranges that hold the term are there.
3. A query starts at the root. The node with the highest sum of weighted maxima is opened next and gives its children's sums; a document's sum is its score. A
   node whose sum is below the k-th best score so far can hold no result; one with an equal sum is opened, as it may hold a smaller doc_id. What is known
   from a task's earlier blocks prunes later ones. Each task passes on the k best of each query, which are merged.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case.

Defined cases: null and empty texts have no terms: as documents they count nowhere, as queries they give no rows. Rows without a doc_id take no part, and rows
without an item_id ask nothing. Rows that repeat a doc_id are documents of their own, so that an id may be listed again, at another rank; rows that repeat an
item_id are one query, of the terms of all. Equal scores of one doc_id keep any order, which can't be seen. An empty table gives no rows. Only
doc_id, item_id and text are read, whatever other columns are called. Texts of any length are taken whole; a query's own terms are held whole by each task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush, heappushpop

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelode.llm import common

#: Children of a node; documents and occurrences (terms of a document) of a block that a task holds.
FAN, BLOCK_DOCS, BLOCK_TERMS = 16, 4096, 2_000_000
#: Terms of the queries that are searched for in one pass.
QUERY_TERMS = 1_000_000

#: Bytes to what terms are cut from: A-Z in lower case, all ASCII but letters and digits a space. Bytes beyond ASCII only occur in characters beyond it.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

Index = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def terms(text: str | None) -> list[bytes]:
    """All terms of a text, in order."""
    return (text or "").encode().translate(_FOLDED).split()


def indexed(docs: DataFrame) -> DataFrame:
    """doc_id, ``n`` (terms with repeats), ``terms`` (distinct) and ``tf`` of each row of ``docs`` (doc_id, text) that has terms, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_text_bytes(batches):
            each = [Counter(terms(t)) for t in batch.column("text").to_pylist()]
            starts = pa.array(np.cumsum([0, *map(len, each)]), pa.int32())
            names = pa.array([t for c in each for t in c], pa.binary()).cast(pa.string())
            tf = np.fromiter((n for c in each for n in c.values()), np.int64)
            n = np.fromiter((c.total() for c in each), np.int64)
            out = [batch.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(starts, names), pa.ListArray.from_arrays(starts, pa.array(tf))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "terms", "tf"]).filter(pa.array(n > 0))

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.written(rows.mapInArrow(run, "doc_id long, n long, terms array<string>, tf array<long>"), "index")


def weight(documents: int, df: int) -> int:
    """Of a term that ``df`` of so many documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """Of terms that occur ``tf`` times in documents of ``n`` terms."""
    m = 10 + 90 * n * documents // max(occurrences, 1)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class MaxTrees:
    """The trees of one block: level 0 has the impacts, each level above the maxima over ranges ``FAN`` times as long, up to one range.

    A level is three arrays over its nodes, by term, then range: ranges, maxima, and where each node's children begin in the level below."""

    def __init__(self, term: np.ndarray, place: np.ndarray, impact: np.ndarray, documents: int):
        order = np.lexsort((place, term))
        term, place, top = term[order], place[order], impact[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(place, top, np.zeros(0, np.int64))]
        ranges = documents
        while ranges > 1 or len(self.levels) == 1:
            ranges = -(-ranges // FAN)
            above = place // FAN
            first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (above[1:] != above[:-1])])
            top = np.maximum.reduceat(top, first)
            self.levels.append((above[first], top, np.r_[first, len(term)]))
            term, place = term[first], above[first]
        #: the root of each term that occurs
        self.roots = dict(zip(term.tolist(), range(len(term)), strict=True))

    def best(self, asked: dict[int, int], k: int, ids: np.ndarray, so_far: list[tuple[int, int]]) -> None:
        """Put a query's (score, -doc_id) into ``so_far``, a heap of the k best. asked: the weight of each of its terms."""
        mine = [(self.roots[t], w) for t, w in asked.items() if w > 0 and t in self.roots]
        if not mine:
            return
        nodes, weights = np.array(mine, np.int64).T
        level = len(self.levels) - 1
        tie = 0
        heap = [(-int((self.levels[level][1][nodes] * weights).sum()), tie, level, nodes, weights)]
        while heap:
            bound, _, level, nodes, weights = heappop(heap)
            if len(so_far) == k and -bound < so_far[0][0]:
                return
            starts, ends = self.levels[level][2][nodes], self.levels[level][2][nodes + 1]
            count = ends - starts
            # the children of all nodes, one after another
            below = np.arange(count.sum()) + np.repeat(starts - np.r_[0, np.cumsum(count[:-1])], count)
            places, tops, _ = self.levels[level - 1]
            sums = tops[below] * (own := np.repeat(weights, count))
            child = places[below] % FAN
            total = np.zeros(FAN, np.int64)
            np.add.at(total, child, sums)
            least = so_far[0][0] if len(so_far) == k else 1
            base = int(places[below[0]]) // FAN * FAN
            for c in np.flatnonzero(total >= least).tolist():
                score = int(total[c])
                if level == 1:
                    entry = (score, -int(ids[base + c]))
                    if len(so_far) < k:
                        heappush(so_far, entry)
                    elif entry > so_far[0]:
                        heappushpop(so_far, entry)
                else:
                    here = child == c
                    tie += 1
                    heappush(heap, (-score, tie, level - 1, below[here], own[here]))


def _blocks(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array) -> Iterator[Index]:
    """doc_ids and, of the occurrences of terms of ``vocabulary``, terms, places of documents and (tf, n), block by block."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    docs = occurrences = 0

    def out() -> Index:
        ids, n = (np.concatenate([h[x] for h in held]) for x in (0, 1))
        order = np.lexsort((ids, n))
        place_of = np.empty(len(ids), np.int64)
        place_of[order] = np.arange(len(ids))
        starts = np.cumsum([0, *(len(h[0]) for h in held[:-1])])
        row = np.concatenate([h[2] + s for h, s in zip(held, starts, strict=True)])
        term, tf = (np.concatenate([h[x] for h in held]) for x in (3, 4))
        return ids[order], term, place_of[row], np.stack([tf, n[row]])

    for batch in batches:
        at, ends = 0, np.cumsum(np.asarray(pc.list_value_length(batch.column("terms"))))
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(at + BLOCK_DOCS - docs, max(at + 1, int(np.searchsorted(ends, before + BLOCK_TERMS - occurrences, side="right"))))
            part = batch.slice(at, to - at)
            at += len(part)
            column = part.column("terms")
            row = np.repeat(np.arange(len(part)), np.asarray(pc.list_value_length(column)))
            code = pc.index_in(column.flatten(), value_set=vocabulary)
            known = np.asarray(pc.is_valid(code))
            tf = np.asarray(part.column("tf").flatten())[known]
            held.append((np.asarray(part.column("doc_id")), np.asarray(part.column("n")), row[known], np.asarray(pc.drop_null(code)).astype(np.int64), tf))
            docs, occurrences = docs + len(part), occurrences + len(tf)
            if docs >= BLOCK_DOCS or at < batch.num_rows or occurrences >= BLOCK_TERMS:
                yield out()
                held, docs, occurrences = [], 0, 0
    if docs:
        yield out()


def _held_by(index: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents hold each term that any does; counts are added up in the tasks first."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = pa.array(shared.value, pa.string()), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            code = pc.drop_null(pc.index_in(batch.column("terms").flatten(), value_set=known))
            count += np.bincount(np.asarray(code), minlength=len(count))
        here = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(count[here])], ["term", "df"])

    counted = index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {vocabulary[r.term]: r.df for r in counted.collect()}  # as many as the block of queries has terms


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: for each item_id of ``queries`` (item_id, text) the ``k`` documents of ``index`` with
    the highest scores above 0, equal scores by ascending doc_id."""
    spark = index.sparkSession
    totals = index.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences")).first()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_text_bytes(batches):
            each = [sorted(set(terms(t))) for t in batch.column("text").to_pylist()]
            items = batch.column("item_id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([i for i, c in zip(items, each, strict=True) for _ in c], pa.int64()), pa.array([t.decode() for c in each for t in c], pa.string())], ["item_id", "term"])

    rows = queries.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = common.written(rows.mapInArrow(cut, "item_id long, term string").distinct(), "asked")
    blocks = max(1, -(-asked.count() // QUERY_TERMS))
    found = []
    for block in range(blocks):
        # QUERY_TERMS rows, about
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if own:
            found.append(_searched(index, [(r.item_id, r.term) for r in own], totals, k))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searched(index: DataFrame, asked: list[tuple[int, str]], totals, k: int) -> DataFrame:
    """item_id, doc_id and score of the k best of each task for each item."""
    vocabulary = sorted({t for _, t in asked})
    held = _held_by(index, vocabulary)
    weights = {t: weight(totals.documents, held[t]) for t in vocabulary if t in held}
    number = {t: n for n, t in enumerate(vocabulary)}
    items: dict[int, dict[int, int]] = {}
    for item, t in asked:
        if t in weights:
            items.setdefault(item, {})[number[t]] = weights[t]
    shared = index.sparkSession.sparkContext.broadcast((vocabulary, items, totals.documents, totals.occurrences))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, items, documents, occurrences = shared.value
        best: dict[int, list[tuple[int, int]]] = {i: [] for i in items}
        for ids, term, place, (tf, n) in _blocks(batches, pa.array(vocabulary, pa.string())):
            if len(term):
                trees = MaxTrees(term, place, impacts(tf, n, documents, occurrences), len(ids))
                for item, wanted in items.items():
                    trees.best(wanted, k, ids, best[item])
        rows = [(i, -d, s) for i, heap in best.items() for s, d in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indexed(common.documents(spark, sf_dir))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CUT = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + _TERM + "')) AS term"

SQL = f"""
WITH words AS (SELECT doc_id, {_CUT} FROM documents WHERE doc_id IS NOT NULL),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
totals AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS occurrences FROM sizes),
asked AS (SELECT DISTINCT item_id, {_CUT} FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(documents) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // occurrences)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
