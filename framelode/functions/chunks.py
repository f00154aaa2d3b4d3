"""Rules for what a model answers about one chunk: times and shot numbers that may be the chunk's own or the whole's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelode.functions import numbers as N


def time_modes(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk, mode) from items (chunk, start, end) and chunks (chunk, start_time, end_time, duration): absolute if more of the ends lie in the chunk's own
    stretch of the whole than in one of its length from 0, and none before it; relative else, and for a chunk that begins at 0."""
    times = items.select("chunk", F.explode(F.array("start", "end")).alias("t")).where("t >= 0")
    rows = times.join(chunks, "chunk")
    length = F.greatest("duration", F.col("end_time") - F.col("start_time"))
    scores = rows.groupBy("chunk").agg(F.count_if(F.col("t") <= length + 1).alias("own"), F.count_if(F.col("t").between(F.col("start_time") - 1, F.col("end_time") + 1)).alias("whole"), F.min("t").alias("least"))
    out = chunks.join(scores, "chunk", "left")
    absolute = (F.col("start_time") > 0.5) & (F.col("whole") > F.col("own")) & (F.col("least") >= F.col("start_time") - 1)
    return out.select("chunk", F.when(absolute, "absolute").otherwise("relative").alias("mode"))


def time_mode(times: Column, start: Column, end: Column, length: Column) -> Column:
    """The same from the list of a chunk's times that are 0 or more, within its row."""
    own = F.size(F.filter(times, lambda t: t <= length + 1))
    whole = F.size(F.filter(times, lambda t: (t >= start - 1) & (t <= end + 1)))
    absolute = (start > 0.5) & (whole > own) & (F.array_min(times) >= start - 1)
    return F.when(absolute, "absolute").otherwise("relative")


def whole_time(value: Column, start: Column, mode: Column) -> Column:
    """A time of the whole, to a tenth."""
    return N.half_even(F.when(mode == "absolute", value).otherwise(value + start), 1)


def scene_index_mode(local_hits: Column, global_hits: Column) -> Column:
    return F.when(local_hits > global_hits, "local").otherwise("global")


def resolved_scene(by_local: Column, scene: Column, scene_as_local: Column, mode: Column) -> Column:
    """The shot that an answer means. by_local: what its local number stands for; scene: its scene number if there is such a shot;
    scene_as_local: what that number stands for if it is a local one. All are null where there is none."""
    local = mode == "local"
    return (
        F.when(by_local.isNotNull() & scene.isNotNull(), F.when(local, by_local).otherwise(scene))
        .when(scene.isNotNull(), F.when(local & scene_as_local.isNotNull(), scene_as_local).otherwise(scene))
        .when(by_local.isNotNull(), by_local)
        .otherwise(scene_as_local)
    )


def answer_quality(text_lengths: Column, n_items: Column, n_flags: Column) -> Column:
    """How much an answer says, to choose between several for one shot."""
    return text_lengths + 8 * n_items + 5 * n_flags
