"""Checked broadcasts and keep-first/keep-last dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a stated query set, or another side of a few columns, is broadcast.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, as it is (Catalyst then chooses) otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def place(*sides: DataFrame) -> list[str]:
    """The column within which keys are keys: video_id where all sides have it, as those of a collection, none for a single video's."""
    return ["video_id"] if all("video_id" in side.columns for side in sides) else []


def keep(df: DataFrame, key: list[str], order: list[Column | str], last: bool = True) -> DataFrame:
    """One row for each key: the last (a map built in order) or the first (a search that stops) by ``order``."""
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    window = Window.partitionBy(*key).orderBy(*[o.desc() if last else o.asc() for o in by])
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
