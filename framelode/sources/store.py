"""The store of a collection of videos: one Parquet table an entity, partitioned by video; import of JSON lists; a step ledger.

Writing a video's rows replaces that video's partition alone, and is a no-op for a step that is done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelode.sources import schemas


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        schemas.TABLES[name]  # an unknown name is an error
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def read(self, name: str, video_id: str | None = None) -> DataFrame:
        """The table, or one video's rows of it (the other partitions aren't read); without files an empty table."""
        kind = schemas.schema(name)
        rows = self.spark.read.schema(kind).parquet(self.path(name)) if self.exists(name) else self.spark.createDataFrame([], kind)
        return rows if video_id is None else rows.where(F.col("video_id") == video_id)

    def video(self, video_id: str) -> DataFrame:
        """The row of a video that the store knows; an error for one that it doesn't."""
        found = self.read("video_meta", video_id)
        if found.isEmpty():
            raise LookupError(f"no video {video_id!r}")
        return found

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace the partitions of the videos in ``rows``. Missing columns are null, others are refused."""
        kind = schemas.schema(name)
        if unknown := set(rows.columns) - set(kind.names):
            raise ValueError(f"{name} has no columns {sorted(unknown)}")
        whole = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(self.path(name))

    def write_indexes(self, video_id: str, tables: dict[str, DataFrame]) -> None:
        """Replace the video's part of each index; vectors are stored as floats."""
        for name, rows in tables.items():
            if name not in schemas.INDEXES:
                raise ValueError(f"{name} is no index")
            self.write(name, rows.withColumn("video_id", F.lit(video_id)))

    def index(self, name: str, video_id: str) -> DataFrame | None:
        """The video's part of an index, or None where there is none or its files can't be read: the search then goes without it."""
        if name not in schemas.INDEXES:
            raise ValueError(f"{name} is no index")
        try:
            rows = self.read(name, video_id)
            return None if rows.isEmpty() else rows
        except Exception:  # noqa: BLE001 - whatever the reason, an index can be built again
            return None

    def list_videos(self) -> DataFrame:
        """Videos in order of their ids, and whether they have units to be searched."""
        ready = self.read("memory_unit").select("video_id").distinct().withColumn("memory_ready", F.lit(True))
        rows = self.read("video_meta").join(ready, "video_id", "left")
        return rows.select("video_id", "filename", "duration", "status", F.coalesce("memory_ready", F.lit(False)).alias("memory_ready")).orderBy("video_id")

    def done(self, video_id: str) -> DataFrame:
        return self.read("progress", video_id).select("step").distinct()

    def step(self, video_id: str, name: str, table: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The rows of ``table`` for the video: read if the step is in the ledger, else made, written and entered there."""
        if not self.done(video_id).where(F.col("step") == name).isEmpty():
            return self.read(table, video_id)
        self.write(table, make())
        entry = self.spark.range(1).select(F.lit(video_id).alias("video_id"), F.lit(name).alias("step"), F.current_timestamp().alias("at"))
        entry.write.mode("append").partitionBy("video_id").parquet(self.path("progress"))
        return self.read(table, video_id)

    def characters(self, video_id: str) -> DataFrame:
        """The video's characters with an importance score, or, if nobody has scored them, as they were found."""
        rows = self.read("character", video_id)
        deep = rows.where(F.col("importance_score").isNotNull())
        return rows if deep.isEmpty() else deep

    def register(self) -> None:
        """Every table as a temporary view, to be asked in SQL."""
        for name in schemas.TABLES:
            self.read(name).createOrReplaceTempView(name)


def read_json_list(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The objects of files that each hold one JSON list. A file that is no list, is cut off, or has an item that doesn't fit ``columns`` counts as empty,
    as a whole; so does a path without files."""
    try:
        files = spark.read.text(path, wholetext=True)
    except Exception as e:  # noqa: BLE001 - Spark reports a missing path by its error class only
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], columns)
    items = F.from_json("value", f"array<struct<{_as_fields(columns)}>>", {"mode": "PERMISSIVE"})
    checked = files.select("value", items.alias("items")).where(F.col("value").rlike(r"^\s*\[") & F.col("items").isNotNull() & F.try_parse_json("value").isNotNull())
    # an item that doesn't fit turns null, or loses the column that doesn't
    whole = checked.where(~F.exists("items", lambda x: x.isNull()) & (F.size("items") == F.json_array_length("value")))
    return whole.select(F.explode("items").alias("item")).select("item.*")


def _as_fields(columns: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(columns))


def ingest_id(name, path, size):
    """A video's id: its name as an identifier and eight digits of a hash of its path and size."""
    from framelode.functions import text as T

    return F.concat(T.slug(F.regexp_replace(name, r"\.[^.]*$", "")), F.lit("_"), T.short_hash(F.concat(path, F.lit(":"), size)))
