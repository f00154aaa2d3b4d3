"""Steps of a loop and small results that several plans read, written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder that stands in where the session names none, which is only so on one machine.
_OWN: dict[str, str] = {}
#: What this process has written and not yet deleted.
_MADE: dict[str, None] = {}


def folder(spark: SparkSession) -> str:
    if not (found := spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("dir")):
        found = _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="framelode-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: lineage ends here, and a lost executor costs no recomputation."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = None
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(spark: SparkSession, *what: DataFrame | str) -> None:
    """Delete written tables that nothing reads any more; other tables stay."""
    jvm = spark.sparkContext._jvm
    for path in (w if isinstance(w, str) else getattr(w, "_written_to", None) for w in what):
        if path is not None:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            _MADE.pop(path, None)


def cleaned(spark: SparkSession) -> None:
    """Delete all that the operators of this process have written for themselves, once their results, which may be read from there, have been written elsewhere."""
    dropped(spark, *list(_MADE))
