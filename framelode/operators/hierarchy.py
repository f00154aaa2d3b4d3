"""Fixed grouping and roll-ups of shots to beats, scenes and chapters, and the links back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grouped(df: DataFrame, key: str, order: str, size: int, name: str) -> DataFrame:
    """``name``: the number of the row's group of ``size`` in order."""
    return df.withColumn(name, F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size).cast("int"))


def rolled_up(children: DataFrame, parent: str, child: str, lists: tuple[str, ...] = (), spans: bool = False) -> DataFrame:
    """Parents of ``children`` (video_id, parent, child, start_cs, end_cs, dur_cs): times, sorted child ids, distinct sorted union of the array
    columns in ``lists``, and the duration: the children's sum, or with ``spans`` end less start where a video has one parent only."""
    # lists are of one parent's children
    more = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
    out = children.groupBy("video_id", parent).agg(F.min("start_cs").alias("start_cs"), F.max("end_cs").alias("end_cs"), F.sum("dur_cs").alias("dur_cs"), F.array_sort(F.collect_list(child)).alias(f"{child}_ids"), *more)
    if spans:
        alone = F.count("*").over(Window.partitionBy("video_id")) == 1
        out = out.withColumn("dur_cs", F.when(alone, F.col("end_cs") - F.col("start_cs")).otherwise(F.col("dur_cs")))
    return out


def linked_back(children: DataFrame, parents: DataFrame, parent: str, child: str) -> DataFrame:
    """``children`` with the ``parent`` that lists them; of several the last one, by its number, counts; null without any."""
    links = parents.select("video_id", parent, F.explode(f"{child}_ids").alias(child)).groupBy("video_id", child).agg(F.max(parent).alias(parent))
    return children.join(links, ["video_id", child], "left")


def members(parents: DataFrame, children: DataFrame, parent: str, child: str) -> DataFrame:
    """(video_id, parent, child) for listed children that exist; unknown numbers in a list are dropped."""
    listed = parents.select("video_id", parent, F.explode(f"{child}_ids").alias(child)).distinct()
    return listed.join(children.select("video_id", child).distinct(), ["video_id", child], "left_semi").select("video_id", parent, child)


def missing(anchor: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the anchor that nothing covers."""
    return anchor.join(present.select(*key).distinct(), key, "left_anti")


def completed(present: DataFrame, anchor: DataFrame, key: list[str], defaults: dict) -> DataFrame:
    """``present`` and a row of ``defaults``, null for all else, for each key of the anchor that it doesn't cover, which ``filled`` tells apart."""
    bare = missing(anchor.select(*key).distinct(), present, key)
    holes = bare.select(*key, *[F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in present.schema if f.name not in key])
    return present.withColumn("filled", F.lit(False)).unionByName(holes.withColumn("filled", F.lit(True)))
