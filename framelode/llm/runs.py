"""Periodic runs of words by bit-parallel lags.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends, of at least ``max(LEAST, FOLDS * q)`` words.

1. The words of a text are numbered; bit b of all numbers, side by side, is one big integer, a bit plane. A plane XORed with itself shifted by q
   marks words whose bit differs from the word's q further on; the OR of all planes marks the mismatches of lag q.
2. In the complement, ANDs with itself shifted by 1, 2, 4 ... leave the places where matches begin that go on for long enough: nothing, for nearly every
   lag, and that mostly after the first planes. What is left gives the runs with their ends.
3. A run of lag q whose words have a period that divides q belongs to that lag and is dropped.

All lags below ``ANCHORED`` are tried. Of those from 2**j to 2**(j+1) a run holds the 2**j words that begin at some multiple t of 2**j, and again q words
further on, in the next block of 2**j places: one comparison of hashes of 2**j words (each made from two of half the length) finds all lags that are worth
trying, so that a text of n words takes about n log n steps and the planes are shifted only for lags that may give a run. A lag is not tried for a place
that a shorter period, which divides it, explains.

Defined cases: null and empty texts, and texts of white space, have no words and no runs. Texts of any length are taken whole; a worker holds one slice of
about a megabyte of texts, or one longer text. Repeated rows stay rows. An empty table gives no rows. Columns other than doc_id and text are not read,
whatever their names; a null doc_id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelode.llm import common, shingles

#: Words of the shortest run, and its length in periods.
LEAST, FOLDS = 6, 4
#: The first lag (a power of two) of which only those are tried that an anchor speaks for.
ANCHORED = 64
#: Planes that are compared before a lag is first given up.
_STEP = 3

Run = tuple[int, int, int]


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of all ids as one integer, the first id's lowest."""
    width = max(1, int(ids.max()).bit_length())
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(width)]


def beginnings(bits: int, length: int) -> int:
    """The places of ``bits`` at which at least ``length`` ones begin."""
    have = 1
    while have < length and bits:
        step = min(have, length - have)
        bits &= bits >> step
        have += step
    return bits


def repeats(of: list[int], n: int, lag: int, length: int) -> int:
    """The places at which ``length`` words or more begin that equal those ``lag`` further on."""
    within, apart, left = (1 << (n - lag)) - 1, 0, 0
    for at in range(0, len(of), _STEP):
        for plane in of[at : at + _STEP]:
            apart |= plane ^ (plane >> lag)
        if not (left := beginnings(~apart & within, length)):
            break
    return left


def stretches(bits: int, n: int) -> np.ndarray:
    """First and last place of each stretch of ones."""
    if bits.bit_count() == 1:
        return np.array([[bits.bit_length() - 1] * 2])
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little"))
    cut = np.flatnonzero(np.diff(ones) > 1)
    return np.stack([ones[np.r_[0, cut + 1]], ones[np.r_[cut, len(ones) - 1]]], axis=1)


def _shorter(lag: int) -> list[int]:
    """``lag`` divided by each of its prime factors."""
    out, rest, p = [], lag, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(lag // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return [*out, lag // rest] if rest > 1 else out


def _worth_trying(ids: np.ndarray, found: list[Run], folds: int) -> Iterator[list[int]]:
    """Of each octave of lags from ``ANCHORED`` on those that may give a run. ``found`` holds all runs of lower octaves when the next is asked for."""
    n, size = len(ids), 1
    grams = shingles.mixed(ids.astype(np.uint64))
    while folds * size <= n:
        if size >= ANCHORED:
            blocks = len(grams) // size
            rows = np.zeros((blocks + 1, size), grams.dtype)
            rows.ravel()[: len(grams)] = grams[: (blocks + 1) * size]
            block, off = np.nonzero(rows[1:] == rows[:-1, :1])
            at, lags = block * size, off + size
            real = at + lags < len(grams)
            at, lags = at[real], lags[real]
            for start, length, period in found:
                if length >= size and len(at):
                    a, b = np.searchsorted(at, [start, start + length])
                    if a < b:
                        told = (at[a:b] + lags[a:b] <= start + length) & (lags[a:b] % period == 0)
                        kept = np.r_[np.arange(a), a + np.flatnonzero(~told), np.arange(b, len(at))]
                        at, lags = at[kept], lags[kept]
            yield np.unique(lags[lags * folds <= n]).tolist()
        with np.errstate(over="ignore"):
            grams = shingles.mixed(grams[:-size] * np.uint64(2 * size + 1) + shingles.mixed(grams[size:]))
        size *= 2


def runs(words: list[bytes], least: int = LEAST, folds: int = FOLDS) -> list[Run]:
    """(start, length, period) of every run, by start, then period. ``folds`` is 3 at least, so that a shorter period of a run divides its lag."""
    n = len(words)
    known: dict[bytes, int] = {}
    if n < least:
        return []
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    of, found = planes(ids), []

    def tried(lag: int) -> None:
        length = max(least, folds * lag) - lag
        if not (left := repeats(of, n, lag, length)):
            return
        shorter = _shorter(lag)
        for first, last in stretches(left, n).tolist():
            if not any((ids[first : first + lag] == ids[first + d : first + d + lag]).all() for d in shorter):
                found.append((first, last - first + length + lag, lag))

    for lag in range(1, min(n // folds, ANCHORED - 1) + 1):
        tried(lag)
    for lags in _worth_trying(ids, found, folds):
        for lag in lags:
            tried(lag)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapsed_runs(docs: DataFrame, least: int = LEAST, folds: int = FOLDS) -> DataFrame:
    """doc_id, ``runs`` array<struct<start, length, period>> by start and period, and ``collapsed``, the words that stay joined by one space
    (empty for a null text), for each row of ``docs`` (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_text_bytes(batches):
            each, texts = [], []
            for text in batch.column("text").to_pylist():
                # bytes.split cuts at space and 0x09-0x0D, which UTF-8 has nowhere else
                words = (text or "").encode().split()
                found = runs(words, least, folds)
                each.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(b" ".join(collapsed(words, found)).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(each, _RUN), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a loop put into one text in ten: with h the crc32 of the decimal doc_id, g = h div 10, where h mod 10 = 0 each of the n words
    from a = g mod n on is replaced by word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). A null doc_id has no loop."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    hashed = F.crc32(F.col("doc_id").cast("string"))
    long = lambda c: c.cast("long")
    chosen = docs.where((hashed % 10 == 0)).select("doc_id", words.alias("w"), F.floor(hashed / 10).alias("g")).where(F.size("w") > 0)
    n = long(F.size("w"))
    placed = chosen.withColumn("a", long(F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    loop = F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    made = placed.select("doc_id", F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), loop), " ").alias("text"))
    rest = docs.where(F.coalesce(hashed % 10 != 0, F.lit(True)) | (F.size(words) == 0))
    return rest.select("doc_id", "text").union(made)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.light_batches(spark)  # texts go to the workers and come back
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # greatest length, then smallest start, then smallest period
    order: Column = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.sign(y["length"] - x["length"])).when(x["start"] != y["start"], F.sign(x["start"] - y["start"])).otherwise(F.sign(x["period"] - y["period"])).cast("int"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = collapsed_runs(looped(docs)).withColumn("top", F.get(order, F.lit(0)))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("top.length") * 1000 / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
