"""What the corpus operators share: the shared folder, written tables, checked broadcasts, streamed groups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a few numbers a row (at most about 32 bytes) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


#: The folder that stands in where the session names none.
_OWN: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, which
    is only so on one machine, a temporary folder, removed at exit."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("dir")):
        found = _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="framelode-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
    return found.rstrip("/")


#: Folders of the shared store that this process has made and not yet deleted.
_MADE: dict[str, None] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = None
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(spark: SparkSession, *what: DataFrame | str) -> None:
    """Delete written tables, or folders, of the shared store that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in (w if isinstance(w, str) else w._written_to for w in what):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _MADE.pop(path, None)


def cleaned(spark: SparkSession) -> None:
    """Delete all that the operators of this process have left in the shared folder, once their results, which are read from there,
    have been written elsewhere."""
    dropped(spark, *list(_MADE))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if it has at most ``rows`` rows; as it is otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_groups(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each key as one table, from batches in which equal keys are adjacent. Keys are not null."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        changes = np.zeros(batch.num_rows, bool)
        for column in columns:
            changes[1:] |= column[1:] != column[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in key):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(changes).tolist(), batch.num_rows]
        for at, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            held.append(batch.slice(a, b - a))
            if at < len(cuts) - 2:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)
    del held
    given_back()


def given_back() -> None:
    """Let a worker, which the next stage's tasks will use, give the memory back that it has freed."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def by_text_bytes(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text at most, so that a worker's arrays stay bounded
    by that or by the longest single text."""
    import numpy as np

    for batch in batches:
        text = batch.column(column)
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0)))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    given_back()


#: Rows and bytes of a batch that goes to a Python worker, where a whole pipeline of text stages shares an executor's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def light_batches(spark: SparkSession) -> None:
    """Lower the session's own limits of batches for Python workers, which count rows that may each be long, to ``BATCH_ROWS`` and ``BATCH_BYTES``
    if they are higher. For applications, as the pipeline's stages and the queries that carry texts through are; operators change no setting."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = (spark.conf.get(key, None) or "").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def may_hold(rows: DataFrame, column: str, keys: DataFrame, key: str, bits: int = 26) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not among the values of ``keys[key]``; none of the others is lost. A filter of 2**bits
    bits, a table of 2**bits / 64 rows at most, goes to the rows, so that those that are not wanted need no shuffle."""
    place = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(11)), F.lit(1 << bits))
    own, word, mask = (fresh(rows, n) for n in ("place", "word", "mask"))
    shift = lambda p: F.expr(f"shiftleft(1L, cast({p} & 63 as int))")
    table = keys.select(place(key).alias(own)).select(F.shiftright(own, 6).alias(word), shift(own).alias(mask)).groupBy(word).agg(F.bit_or(mask).alias(mask))
    marked = rows.withColumn(own, place(column)).withColumn(word, F.shiftright(own, 6)).join(F.broadcast(table), word)
    return marked.where(F.col(mask).bitwiseAND(shift(own)) != 0).select(*rows.columns)


def flagged(rows: DataFrame, column: str, keys: DataFrame, key: str, flag: str, bits: int = 26) -> DataFrame:
    """``rows`` with ``flag``: false where ``column`` is surely not among the values of ``keys[key]``, by the filter of ``may_hold``."""
    place = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(11)), F.lit(1 << bits))
    shift = lambda p: F.expr(f"shiftleft(1L, cast({p} & 63 as int))")
    table = keys.select(place(key).alias("_place")).select(F.shiftright("_place", 6).alias("_word"), shift("_place").alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_mask"))
    marked = rows.withColumn("_place", place(column)).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(table), "_word", "left")
    return marked.withColumn(flag, F.coalesce(F.col("_mask").bitwiseAND(shift("_place")) != 0, F.lit(False))).select(*rows.columns, flag)


def clear_of(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names, whatever their case, clash with those an operator adds."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])
