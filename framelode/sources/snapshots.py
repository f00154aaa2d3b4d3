"""Several tables of many videos committed at once.

A commit writes its tables, partitioned by video, to a folder of its own, and then one small file in the log: from then on, and not before, its rows stand in place of what its videos had before, in all tables.
A reader takes the log as it is at one moment and keeps to it, so that it sees all tables as of one commit, whatever is written meanwhile; what a writer that was killed has left is in no log. A video that no commit
holds is read from the plain store, table by table. ``compacted`` makes one commit of all.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelode.operators import joins
from framelode.sources import schemas
from framelode.sources.store import Store


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, store: Store | None = None):
        self.spark, self.root, self.store = spark, root.rstrip("/"), store
        self._jvm = spark.sparkContext._jvm

    def _path(self, at: str):
        target = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def versions(self) -> list[int]:
        files, log = self._path("log")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in files.listStatus(log) if s.getPath().getName().endswith(".json")) if files.exists(log) else []

    def _entry(self, version: int) -> dict:
        files, path = self._path(f"log/{version:012d}.json")
        stream = files.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, tables: dict[str, DataFrame], base: bool = False) -> int:
        """Put the rows of ``tables`` (by name, as ``sources/schemas.py`` has them) in place of all that their videos have, in every table. base: in place of all commits before. Returns the version."""
        batch = uuid.uuid4().hex
        for name, rows in tables.items():
            kind = schemas.schema(name)
            if unknown := set(rows.columns) - set(kind.names):
                raise ValueError(f"{name} has no columns {sorted(unknown)}")
            whole = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])
            whole.write.partitionBy("video_id").parquet(f"{self.root}/data/{batch}/{name}")
        written = [self._rows(batch, name).select("video_id") for name in tables]
        reduce(DataFrame.union, written).distinct().write.parquet(f"{self.root}/data/{batch}/_videos")
        text = json.dumps({"batch": batch, "tables": sorted(tables), "base": base})
        while True:
            version = max(self.versions(), default=-1) + 1
            files, path = self._path(f"log/{version:012d}.json")
            try:
                stream = files.create(path, False)  # fails if another writer was first
            except Exception as e:  # noqa: BLE001 - whatever store it is; the next number is tried if that one exists now
                if not files.exists(path):
                    raise
                del e
                continue
            stream.write(bytearray(text.encode()))
            stream.close()
            return version

    def _rows(self, batch: str, name: str) -> DataFrame:
        # a table without rows leaves no files
        files, path = self._path(f"data/{batch}/{name}")
        kind = schemas.schema(name)
        return self.spark.read.schema(kind).parquet(f"{self.root}/data/{batch}/{name}").select(*kind.names) if files.exists(path) else self.spark.createDataFrame([], kind)

    def at(self, version: int | None = None) -> Snapshot:
        """The snapshot of a version, the newest without one."""
        entries = [self._entry(v) for v in self.versions() if version is None or v <= version]
        first = max((n for n, e in enumerate(entries) if e["base"]), default=0)
        return Snapshot(self, entries[first:])

    def compacted(self) -> int:
        """All that stands as one commit, from which readers start."""
        now = self.at()
        return self.commit({name: now.committed(name) for name in sorted({t for e in now.entries for t in e["tables"]})}, base=True)


class Snapshot:
    """The tables as of one moment."""

    def __init__(self, of: Snapshots, entries: list[dict]):
        self.of, self.entries = of, entries

    def _videos(self, entries: list[dict]) -> DataFrame | None:
        parts = [self.of.spark.read.schema("video_id string").parquet(f"{self.of.root}/data/{e['batch']}/_videos") for e in entries]
        return reduce(DataFrame.union, parts).distinct() if parts else None

    def committed(self, name: str, video_id: str | None = None) -> DataFrame:
        """The rows of commits: of each video those of its last."""
        if video_id is not None:
            own = [e for e in self.entries if not self._videos([e]).where(F.col("video_id") == video_id).isEmpty()][-1:]
            rows = [self.of._rows(e["batch"], name).where(F.col("video_id") == video_id) for e in own if name in e["tables"]]
            return rows[0] if rows else self.of.spark.createDataFrame([], schemas.schema(name))
        out = []
        for n, e in enumerate(self.entries):
            if name in e["tables"]:
                rows, later = self.of._rows(e["batch"], name), self._videos(self.entries[n + 1 :])
                out.append(rows if later is None else rows.join(joins.small(later), "video_id", "left_anti").select(*rows.columns))
        return reduce(DataFrame.union, out) if out else self.of.spark.createDataFrame([], schemas.schema(name))

    def read(self, name: str, video_id: str | None = None) -> DataFrame:
        """The table, or one video's rows: those of commits, and of the plain store for videos that no commit holds."""
        rows = self.committed(name, video_id)
        if self.of.store is None:
            return rows
        known = self._videos(self.entries)
        if video_id is not None:
            there = known is not None and not known.where(F.col("video_id") == video_id).isEmpty()
            return rows if there else self.of.store.read(name, video_id)
        rest = self.of.store.read(name)
        return rows.unionByName((rest if known is None else rest.join(joins.small(known), "video_id", "left_anti")).select(*rows.columns))

    def memory(self, video_id: str) -> dict[str, DataFrame]:
        """All tables of one video; an error for a video that nothing knows."""
        tables = {name: self.read(name, video_id) for name in schemas.TABLES if name not in schemas.INDEXES}
        if tables["video_meta"].isEmpty() and tables["shot"].isEmpty():
            raise LookupError(f"no video {video_id!r}")
        scored = tables["character"].where(F.col("importance_score").isNotNull())
        return tables | ({} if scored.isEmpty() else {"character": scored})

    def register(self) -> None:
        """Every table as a temporary view, to be asked in SQL."""
        for name in schemas.TABLES:
            self.read(name).createOrReplaceTempView(name)
