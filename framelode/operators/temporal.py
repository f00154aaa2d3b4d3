"""Interval and nearest-in-time joins, segments and folds over ordered timelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int, spans: tuple[str, str, str, str] = ("l_start", "l_end", "r_start", "r_end")) -> DataFrame:
    """Pairs of one ``key`` whose intervals overlap strictly (touching ends don't). Both sides are dealt to bins of ``width``,
    so that it is an equi-join; a pair that shares several bins counts in the first of them alone. Empty intervals that lie
    inside another one overlap it."""
    ls, le, rs, re = spans

    def binned(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
        first = F.floor(F.col(start) / width)
        return df.withColumn(f"{name}_first", first).withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, F.floor(F.col(end) / width)))))

    both = binned(left, ls, le, "_l").join(binned(right, rs, re, "_r"), [key, "_bin"])
    return both.where((F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs)) & (F.col("_bin") == F.greatest("_l_first", "_r_first"))).drop("_bin", "_l_first", "_r_first")


def assigned(segments: DataFrame, shots: DataFrame, width: int = 30_000) -> DataFrame:
    """segments (video_id, segment_id, start_cs, end_cs) with the ``scene_index`` of the shot that holds their midpoint, or else of the shot
    whose start is nearest to it (ties to the earlier one; one video's segments that no shot holds are one sorted walk), and ``cross_shot``: whether they reach beyond that shot."""
    doubled = F.col("start_cs") + F.col("end_cs")
    own = segments.withColumn("twice", doubled).withColumn("_bin", F.floor(F.col("twice") / (2 * width)))
    ends = shots.select("video_id", "scene_index", F.col("start_cs").alias("shot_start"), F.col("end_cs").alias("shot_end"))
    dealt = ends.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("shot_start") / width), F.floor(F.col("shot_end") / width))))
    inside = own.join(dealt, ["video_id", "_bin"]).where((2 * F.col("shot_start") <= F.col("twice")) & (F.col("twice") < 2 * F.col("shot_end")))
    inside = inside.select("video_id", "segment_id", "start_cs", "end_cs", "scene_index", "shot_start", "shot_end")
    rest = own.join(inside.select("video_id", "segment_id"), ["video_id", "segment_id"], "left_anti")
    # as of the midpoint: the last start before it and the first behind it, in one walk over both in order of time
    starts = ends.groupBy("video_id", "shot_start").agg(F.min(F.struct("scene_index", "shot_start", "shot_end")).alias("s"))
    marks = starts.select("video_id", (2 * F.col("shot_start")).alias("at"), F.lit(0).alias("kind"), "s", F.lit(None).cast(rest.select(F.struct("segment_id", "start_cs", "end_cs")).schema[0].dataType).alias("segment"))
    points = rest.select("video_id", F.col("twice").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["s"].dataType).alias("s"), F.struct("segment_id", "start_cs", "end_cs").alias("segment"))
    order = Window.partitionBy("video_id").orderBy("at", "kind")
    before = F.last("s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("s", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    walked = marks.unionByName(points).withColumns({"before": before, "after": after}).where("kind = 1")
    earlier = F.col("after").isNull() | (F.col("at") - 2 * F.col("before.shot_start") <= 2 * F.col("after.shot_start") - F.col("at"))
    near = walked.withColumn("s", F.when(F.col("before").isNull(), F.col("after")).when(earlier, F.col("before")).otherwise(F.col("after"))).where("s is not null")
    near = near.select("video_id", "segment.*", "s.*")
    return inside.union(near).select("video_id", "segment_id", "scene_index", ((F.col("start_cs") < F.col("shot_start")) | (F.col("end_cs") > F.col("shot_end"))).alias("cross_shot"))


def holding(points: DataFrame, shots: DataFrame, width: int = 30_000) -> DataFrame:
    """points (video_id, at_cs) with the first shot that holds them, start included and end not; others are dropped."""
    own = points.withColumn("_bin", F.floor(F.col("at_cs") / width))
    dealt = shots.select("video_id", "scene_index", F.col("start_cs").alias("_s"), F.col("end_cs").alias("_e")).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width))))
    found = own.join(dealt, ["video_id", "_bin"]).where((F.col("_s") <= F.col("at_cs")) & (F.col("at_cs") < F.col("_e")))
    return found.groupBy(*points.columns).agg(F.min("scene_index").alias("scene_index"))


def windows(df: DataFrame, start: str, end: str, width: int, name: str = "window_index") -> DataFrame:
    """A row for each tumbling window that the row's interval reaches into; an interval that only touches a window's start doesn't."""
    last = F.floor(F.greatest(F.col(end) - 1, F.col(start)) / width)
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), last)))


def segment(at: Column, width: int) -> Column:
    return F.floor(at / width)


def folded(df: DataFrame, key: str, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``step`` over each key's rows, for walks in which each row depends on all before it. Keys run side by side."""
    return df.groupBy(key).applyInPandas(step, schema)


def greedy_groups(durations: Iterator[int], target: int, least: int) -> list[int]:
    """The group of each duration: a group closes once it holds ``target``; a rest of under ``least`` joins the group before."""
    out, group, held = [], 0, 0
    for d in durations:
        out.append(group)
        held += d
        if held >= target:
            group, held = group + 1, 0
    if held < least and group and out and out[-1] == group:
        out = [g - 1 if g == group else g for g in out]
    return out


def chunks(shots: DataFrame, target: int = 15_000, least: int = 3_000) -> DataFrame:
    """video_id, chunk_index, first_scene, n_shots, start_cs, end_cs, duration_cs of greedy runs of shots. The duration is the shots' sum, but
    that of a chunk which took in a rest is its end less its start."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("scene_index")
        plain = greedy_groups(rows["dur_cs"], target, 0)
        rows["chunk_index"] = greedy_groups(rows["dur_cs"], target, least)
        merged = plain[-1] != rows["chunk_index"].iloc[-1]
        out = rows.groupby("chunk_index").agg(first_scene=("scene_index", "min"), n_shots=("scene_index", "size"), start_cs=("start_cs", "min"), end_cs=("end_cs", "max"), duration_cs=("dur_cs", "sum")).reset_index()
        if merged:
            out.loc[out.index[-1], "duration_cs"] = out["end_cs"].iloc[-1] - out["start_cs"].iloc[-1]
        out.insert(0, "video_id", rows["video_id"].iloc[0])
        return out

    return folded(shots.select("video_id", "scene_index", "start_cs", "end_cs", "dur_cs"), "video_id", step, "video_id long, chunk_index long, first_scene long, n_shots long, start_cs long, end_cs long, duration_cs long")


def split_points(starts: list[int], duration: int, least: int = 30_000, even: int = 60_000) -> list[int]:
    """Where chapters begin and the last one ends: at each start at least ``least`` after the last cut; without any, if the whole is longer
    than two ``even`` lengths, every ``even``, the last not within ``least`` of the end."""
    cuts = [0]
    for s in sorted(starts):
        if s - cuts[-1] >= least:
            cuts.append(s)
    if len(cuts) == 1 and duration > 2 * even:
        cuts += range(even, duration - least, even)
    return [*cuts, duration]


def chapters(events: DataFrame, durations: DataFrame, important: int = 6, least: int = 30_000, even: int = 60_000) -> DataFrame:
    """video_id, chapter, start_cs, end_cs for each video of ``durations`` (video_id, duration_cs), cut at its important events."""
    own = durations.join(events.where(F.col("importance") >= important).select("video_id", F.col("start_cs").alias("at")), "video_id", "left")

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        cuts = split_points([int(x) for x in rows["at"].dropna()], int(rows["duration_cs"].iloc[0]), least, even)
        return pd.DataFrame({"video_id": rows["video_id"].iloc[0], "chapter": range(len(cuts) - 1), "start_cs": cuts[:-1], "end_cs": cuts[1:]})

    return folded(own, "video_id", step, "video_id long, chapter long, start_cs long, end_cs long")


def sample_grid(start: Column, end: Column, most: int = 6) -> Column:
    """Times of the key frames of a shot, evenly over the middle eight tenths: one to ``most`` of them by its length in centiseconds."""
    size = end - start
    n = F.when(size < 200, 1).when(size < 500, 2).when(size < 1_500, 3).otherwise(F.least(F.greatest(F.lit(3), F.floor(size / 500)), F.lit(most))).cast("int")
    low, high = start + size * 0.1, start + size * 0.9
    middle = F.array(start + size * 0.5)
    return F.when(n == 1, middle).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: low + (high - low) * i / (n - 1)))


def renumbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Dense numbers from 0 in order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
