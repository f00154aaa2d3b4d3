"""Approximate nearest neighbours by cross-polytope hashing.

A vector on the unit sphere goes through ``ROUNDS`` rounds of random signs and a fast Hadamard transform; its hash is the
signed axis that is nearest to the result. There are ``TABLES`` such hashes. Every vector is filed under its one bucket
in each table. A query probes several buckets of each, in two rounds, and what it finds there is ranked by exact distance on the
original vectors, in double precision.

The first round looks into the ``FIRST_PROBES`` nearest axes of ``FIRST_TABLES`` tables, and so finds how far off the k nearest
are at most. A vector that far off in a random direction falls into each bucket of a table with a chance that follows from the
rotated query alone; the second round probes, of every table, the likeliest buckets that together hold such a vector with a chance
of ``CATCH``. A query for which the first round found too few to tell looks into all buckets. Where a vector's neighbours are near, that is one bucket or two; where there is no structure, many. A neighbour is
missed by all tables with a chance of about (1 - CATCH)**TABLES, at any size of the table and any dimension.

The search is one of a stated set of queries against all rows, in blocks: a bucket's vectors and the queries that look
into it meet in one task, block by block, and only each query's ``k`` best of a block leave it. Equal vectors are one
entry of the index with the ``k + 1`` smallest ids, which are all that a ranking by distance and id can show; equal
queries are searched once.

Defined cases: vectors that are null, zero, empty or hold a null or a value that is not finite take no part, nor do rows
without an id; so do vectors of another length than the query's. Ties go to the smaller id. A repeated id is the same candidate
again, and the query's own id is left out whatever its vector. Distance 0 to a copy counts. Empty tables give no rows; columns other
than vec_id and embedding are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from framelode.llm import common

TABLES, ROUNDS, FIRST_TABLES, FIRST_PROBES, CATCH = 8, 3, 3, 2, 0.35
#: Vectors of a bucket that one task compares at once, and queries.
BLOCK, QUERY_BLOCK = 4096, 256
_SEED = 8191


class CrossPolytope:
    """The hash functions for one dimension, which a seed fixes."""

    def __init__(self, dimension: int, tables: int = TABLES):
        self.width = 1 << max(1, (dimension - 1).bit_length())
        rng = np.random.default_rng([_SEED, dimension])
        self.signs = rng.choice(np.array([-1.0, 1.0]), (tables, ROUNDS, self.width))

    def rotated(self, vectors: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros((len(vectors), self.width))
        out[:, : vectors.shape[1]] = vectors
        for signs in self.signs[table]:
            out *= signs
            half = 1
            while half < self.width:  # the fast Hadamard transform
                parts = out.reshape(len(out), -1, 2, half)
                out = np.stack([parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]], axis=2).reshape(len(out), self.width)
                half *= 2
            out /= np.sqrt(self.width)
        return out

    def signed(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """The rotated vectors' values along all signed axes."""
        rotated = self.rotated(vectors, table)
        return np.concatenate([rotated, -rotated], axis=1)

    def nearest(self, vectors: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
        """The numbers of the nearest signed axes, nearest first."""
        both = self.signed(vectors, table)
        return both.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-both, axis=1, kind="stable")[:, :probes]

    def likely(self, vectors: np.ndarray, table: int, apart: np.ndarray, catch: float | np.ndarray) -> list[np.ndarray]:
        """For each unit vector the likeliest buckets of a unit vector ``apart`` from it (the chord) in a random direction, so many that they
        hold it with a chance of ``catch``, one for all or one each (from 1 on: all buckets). An axis is the nearest where its value passes a level that on average one axis passes."""
        middle = self.signed(vectors, table) * (1 - apart**2 / 2)[:, None]
        spread = np.sqrt(np.maximum(apart**2 - apart**4 / 4, 0) / self.width)[:, None] + 1e-9

        def chance(level: np.ndarray) -> np.ndarray:
            x = np.clip((middle - level) / spread, -20, 20)
            return 1 / (1 + np.exp(-np.clip(1.5976 * x + 0.07056 * x**3, -60, 60)))  # the normal distribution, closely

        low, high = np.full((len(vectors), 1), -1.0), np.full((len(vectors), 1), 2.0)
        for _ in range(30):
            level = (low + high) / 2
            over = chance(level).sum(axis=1, keepdims=True) > 1
            low, high = np.where(over, level, low), np.where(over, high, level)
        share = chance(high)
        order = np.argsort(-share, axis=1, kind="stable")
        held = np.cumsum(np.take_along_axis(share, order, axis=1), axis=1)
        wanted = np.broadcast_to(catch, len(vectors)).tolist()
        return [row[: len(row) if w >= 1 else int(np.searchsorted(sums, w)) + 1] for row, sums, w in zip(order, held, wanted, strict=True)]


def _vectors(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _on_sphere(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, CrossPolytope, np.ndarray]]:
    """The batches' rows with vectors of one length, that length's hash functions, and the vectors."""
    known: dict[int, CrossPolytope] = {}
    for batch in batches:
        sizes = np.asarray(batch.column("size"))
        for size in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == size))
            for at in range(0, len(part), BLOCK):
                own = part.slice(at, BLOCK)
                yield own, known.setdefault(size, CrossPolytope(size)), _vectors(own.column("vector"))


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With ``buckets``, one of each table."""
    for part, polytope, rows in _by_size(batches):
        rows = _on_sphere(rows)
        buckets = np.concatenate([polytope.nearest(rows, table) for table in range(TABLES)], axis=1).astype(np.int32)
        column = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * TABLES), pa.array(buckets.ravel()))
        yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, "buckets"])


def _probes(batches: Iterator[pa.RecordBatch], first: bool, catch: float = CATCH) -> Iterator[pa.RecordBatch]:
    """(row, table, bucket) for the buckets of the first round, or those of the second that the first has not probed; ``reach`` is the
    distance found, null where too few were found."""
    for part, polytope, vectors in _by_size(batches):
        rows = _on_sphere(vectors)
        if not first:
            reach = part.column("reach").to_numpy(zero_copy_only=False).astype(float)
            with np.errstate(over="ignore"):
                apart = reach / np.linalg.norm(vectors, axis=1)
            apart = np.where(np.isfinite(apart), np.minimum(apart, np.sqrt(2)), np.sqrt(2))
            wanted = np.where(np.isnan(reach), 1.0, catch)
        for table in range(FIRST_TABLES if first else TABLES):
            found = list(polytope.nearest(rows, table, FIRST_PROBES)) if first or table < FIRST_TABLES else None
            if not first:
                likely = polytope.likely(rows, table, apart, wanted)
                found = likely if found is None else [a[~np.isin(a, b)] for a, b in zip(likely, found, strict=True)]
            at = np.repeat(np.arange(len(rows)), [len(f) for f in found])
            picked = part.select(["code", "vector", "size"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.full(len(at), table, np.int32)), pa.array(np.concatenate(found).astype(np.int32))], ["code", "vector", "size", "table", "bucket"])


def _nearest_of(rows: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the rows among which its k nearest are, with their exact distances. Rows are proposed by products of matrices,
    within what rounding can do to those."""
    with np.errstate(over="ignore", invalid="ignore"):
        own, asked = (rows**2).sum(axis=1), (queries**2).sum(axis=1)
        for at in range(0, len(queries), QUERY_BLOCK):
            about = own[None] + asked[at : at + QUERY_BLOCK, None] - 2 * (queries[at : at + QUERY_BLOCK] @ rows.T)
            for n, line in enumerate(about, at):
                near = np.arange(len(rows))
                if len(rows) > k and np.isfinite(line).all():
                    slack = 1e-12 * rows.shape[1] * (own.max() + asked[n])
                    near = np.flatnonzero(line <= np.partition(line, k - 1)[k - 1] + 2 * slack)
                distance = np.sqrt(((rows[near] - queries[n]) ** 2).sum(axis=1))
                if len(near) > k:
                    least = distance <= np.partition(distance, k - 1)[k - 1]
                    near, distance = near[least], distance[least]
                yield n, near, distance


def _ranked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each block for each query; a block's queries (side 0) come before its vectors (side 1)."""
    key = None
    codes: list[str] = []
    parts: list[np.ndarray] = []
    best: dict[int, list[tuple[float, int, list[int]]]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        rows = [(codes[n], ids, d) for n, found in best.items() for d, _, ids in found]
        if rows:
            code, ids, distance = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.string()), pa.array(ids, pa.list_(pa.int64())), pa.array(distance, pa.float64())], ["code", "ids", "distance"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(c)) for c in ("size", "table", "bucket", "block", "side")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if tuple(keys[a, :4]) != key:
                yield from out()
                key, codes, parts, best = tuple(keys[a, :4]), [], [], {}
            rows = _vectors(batch.column("vector").slice(a, b - a))
            if keys[a, 4] == 0:
                codes += batch.column("code").slice(a, b - a).to_pylist()
                parts.append(rows)
                continue
            if not codes:
                continue
            ids = batch.column("ids").slice(a, b - a).to_pylist()
            parts = [np.concatenate(parts)]
            for n, near, distance in _nearest_of(rows, parts[0], k):
                best[n] = sorted([*best.get(n, []), *((d, ids[x][0], ids[x]) for x, d in zip(near.tolist(), distance.tolist(), strict=True))])[:k]
    yield from out()


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, catch: float = CATCH) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of ``queries`` the ``k`` nearest found among ``vectors`` (both vec_id, embedding).
    ``catch``: the chance of a neighbour to be met in one table; from 1 on, all buckets are probed and the search is exact."""
    n = common.partitions(vectors)
    narrow = all(isinstance(df.schema["embedding"].dataType, ArrayType) and isinstance(df.schema["embedding"].dataType.elementType, FloatType) for df in (vectors, queries))
    number = "float" if narrow else "double"

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast(f"array<{number}>")
        whole = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
        # 0.0 and -0.0 are one value
        rows = df.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0).cast(number)).alias("vector"))
        return rows.withColumn("code", F.concat(F.hex(F.xxhash64("vector")), F.lit("."), F.hex(F.xxhash64(F.lit(_SEED), F.size("vector"), "vector"))))

    # the k + 1 smallest ids of each distinct vector; the limit applies before the shuffle too
    first = Window.partitionBy("code").orderBy("vec_id")
    kept = usable(vectors).dropDuplicates(["code", "vec_id"]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    index = kept.groupBy("code").agg(F.any_value("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("size", F.size("vector"))
    index = common.written(index.mapInArrow(_filed, f"code string, vector array<{number}>, ids array<long>, size int, buckets array<int>"), "index")
    asked = common.written(usable(queries), "queries")
    wanted = common.written(asked.select("code", "vector").dropDuplicates(["code"]).withColumn("size", F.size("vector")), "wanted")

    key = ["size", "table", "bucket"]
    # a bucket's vectors in blocks of about BLOCK; the buckets are a fixed number for each length of vector
    counted = index.select("size", F.posexplode("buckets").alias("table", "bucket")).groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = common.small(common.written(counted, "blocks"))

    def searched(probes: DataFrame, tables: int) -> DataFrame:
        """code, ids, distance of the k + 1 best of each block that a query meets."""
        filed = index.select("code", "vector", "ids", "size", F.posexplode(F.slice("buckets", 1, tables)).alias("table", "bucket"))
        held = filed.join(blocks, key).select(*key, F.pmod(F.xxhash64("code", F.lit(3)), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("side"), "code", "vector", "ids")
        looking = probes.join(blocks, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), "code", "vector", F.array().cast("array<long>").alias("ids"))
        met = held.union(looking).repartition(n, *key, "block").sortWithinPartitions(*key, "block", "side")
        return met.mapInArrow(lambda b: _ranked(b, k + 1), "code string, ids array<long>, distance double")

    def best(found: DataFrame) -> DataFrame:
        """The k + 1 best ids of each distinct query. Tables find the same vectors again: one row for each."""
        each = found.select("code", "distance", F.explode("ids").alias("vec_id")).distinct()
        order = Window.partitionBy("code").orderBy("distance", "vec_id")
        return each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list(F.struct("distance", "vec_id"))).alias("found"))

    probe = f"code string, vector array<{number}>, size int, table int, bucket int"
    near = common.written(best(searched(wanted.mapInArrow(lambda b: _probes(b, True), probe), FIRST_TABLES)), "near")
    reach = near.where(F.size("found") > k).select("code", F.element_at("found", -1)["distance"].alias("reach"))
    further = wanted.join(reach, "code", "left").mapInArrow(lambda b: _probes(b, False, catch), probe)
    before = near.select("code", F.explode("found").alias("x")).select("code", F.array("x.vec_id").alias("ids"), "x.distance")
    lists = best(searched(further, TABLES).union(before))
    shown = asked.select(F.col("vec_id").alias("query_id"), "code").join(lists, "code")
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return shown.select("query_id", F.posexplode(own).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.distance").alias("score"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))
