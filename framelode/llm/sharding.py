"""Sharding: minimax contiguous partition of ordered atomic groups, native DataFrame operations throughout.

Groups are the rows of equal text, ordered by the text's MD5; a shard is a run of that order. The shard capacity is the
smallest under which a greedy walk fills at most as many shards as there are, found by binary search; the order is
cut where that walk cuts.

The walk needs the groups' sizes in order, of which there may be billions. It runs over a histogram of the digests
instead, which is refined only where it matters: first bins that are heavy, until a hot group stands alone in its bin,
then bins in which a cut may fall for any capacity still possible, until those bins are single groups. A level is
one aggregation whose result has at most ``BINS`` rows for each refined bin; at the end the histogram gives the exact
capacity and cuts. Rows then find their shard by comparing their digest with the cuts, and their slot by counts of
(shard, digest bin, salt) cells and a rank within the cell, so that no task holds a shard, or a hot group, as a whole.

Law: ``bytes``, sizes as near to equal as whole groups allow. Defined cases: null text is of size 1, crc32 0, and in
the group of empty texts; repeated rows are rows of their own in one group, each with its own slot; a null doc_id
is ordered first; an empty table gives no rows; a text of any length is one size and one
digest, which Spark takes of it where it stands; fewer groups than shards leave shards empty;
columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelode.llm import common

SHARDS = 8
#: Hexadecimal digits that a level adds to a bin's prefix, and so its bins.
DIGITS = 3
BINS = 16**DIGITS
#: Bins of more than this many times the mean size of a bin of the first level are heavy.
HEAVY = 4
SALTS = 16


@dataclass(frozen=True)
class Bin:
    """The groups whose digests begin with ``prefix``: how many bytes, and the first and last of those digests."""

    prefix: str
    size: int
    first: str
    last: str

    @property
    def single(self) -> bool:
        return self.first == self.last


def _bins(rows: DataFrame, digits: int, inside: list[str] | None) -> list[Bin]:
    """The bins of prefixes of so many digits, of the rows under the prefixes of ``inside``."""
    if inside is not None:
        rows = rows.where(F.substring("digest", 1, len(inside[0])).isin(inside))
    out = rows.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"), F.min("digest").alias("first"), F.max("digest").alias("last"))
    return [Bin(*r) for r in out.collect()]


def _cuts(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where a greedy walk over atoms with these running sums ends its shards, or None if it needs more of them."""
    out, at = [0], 0
    for _ in range(shards):
        at = bisect.bisect_right(sums, sums[at] + capacity) - 1
        out.append(at)
        if at == len(sums) - 1:
            return out
    return None


def _fluid(bins: list[Bin], sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """The same in bytes, if bins that are not single groups could be cut anywhere: never behind the true walk."""
    at, out = 0, [0]
    for _ in range(shards):
        to = at + capacity
        if to >= sums[-1]:
            return [*out, sums[-1]]
        n = bisect.bisect_right(sums, to) - 1
        if bins[n].single and sums[n] > at:
            to = sums[n]
        elif bins[n].single and sums[n] < to < sums[n + 1]:
            return None
        out.append(to)
        at = to
    return None


def _least(low: int, high: int, fits) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def plan(rows: DataFrame, shards: int = SHARDS) -> list[str]:
    """The digests at which shards 1, 2, ... begin, for rows of ``digest`` (hexadecimal) and ``size``. Fewer, if the rest are empty."""
    bins = sorted(_bins(rows, DIGITS, None), key=lambda b: b.prefix)
    total = sum(b.size for b in bins)
    if not total:
        return []

    def refine(which: list[Bin]) -> None:
        nonlocal bins
        for digits in sorted({len(b.prefix) for b in which}):
            own = [b for b in which if len(b.prefix) == digits]
            finer = _bins(rows, digits + DIGITS, [b.prefix for b in own])
            gone = {b.prefix for b in own}
            bins = sorted([b for b in bins if b.prefix not in gone] + finer, key=lambda b: b.first)

    while heavy := [b for b in bins if not b.single and b.size * BINS > HEAVY * total]:
        refine(heavy)
    while True:
        sums = [0]
        for b in bins:
            sums.append(sums[-1] + b.size)
        top = _least(-(-total // shards), total, lambda c: _cuts(sums, c, shards) is not None)
        low = _least(-(-total // shards), top, lambda c: _fluid(bins, sums, c, shards) is not None)
        # for any capacity from low to top, the n-th cut lies between these two
        early, late = _walk(sums, low, shards), _fluid(bins, sums, top, shards)[1:]
        late += [total] * (shards - len(late))
        open_bins = []
        for a, b in zip(early, late, strict=True):
            open_bins += [x for x in bins[bisect.bisect_right(sums, a) - 1 : bisect.bisect_left(sums, b)] if not x.single]
        if not open_bins:
            break
        refine(list(dict.fromkeys(open_bins)))
    return [bins[at].first for at in _cuts(sums, top, shards)[1:-1] if at < len(bins)]


def _walk(sums: list[int], capacity: int, shards: int) -> list[int]:
    """Bytes at which the greedy walk over whole bins ends each shard; it may be stopped by a bin that is too large."""
    out, at = [], 0
    for _ in range(shards):
        at = bisect.bisect_right(sums, sums[at] + capacity) - 1
        out.append(sums[at])
    return out


def _text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of ``docs`` (doc_id, text)."""
    text = _text().cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"))
    rows = common.written(rows, "sizes")
    cuts = plan(rows.select("digest", "size"), shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("digest") >= cut).cast("int")
    placed = rows.select("*", shard.cast("int").alias("shard"), F.substring("digest", 1, DIGITS).alias("bin"))
    # a heavy bin, as that of a hot group, is split by its documents into cells of about the mean size of a bin
    counts = {r["bin"]: r["count"] for r in placed.groupBy("bin").count().collect()}
    total = sum(counts.values())
    salts = {b: -(-n * BINS // total) for b, n in counts.items() if n * BINS > HEAVY * total}
    salt = F.lit(0)
    if salts:
        parts = F.try_element_at(F.create_map(*[F.lit(x) for pair in salts.items() for x in pair]), F.col("bin"))
        salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), parts), F.lit(0)).cast("int")
    placed = placed.withColumn("salt", salt)
    before = Window.partitionBy("shard").orderBy("bin", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("shard", "bin", "salt").count()
    offsets = cells.select("shard", "bin", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bin", "salt").orderBy("digest", F.col("doc_id").asc_nulls_first())
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1)
    # about two cells for each bin, whatever the number of rows
    return ranked.join(F.broadcast(offsets), ["shard", "bin", "salt"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(common.documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
