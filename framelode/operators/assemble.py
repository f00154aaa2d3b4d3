"""Model answers to beats, events and edges: what is asked, batch by batch, and what an answer counts for.

An answer is text that should hold a JSON list. Its items are checked and typed here; one that can't be read leaves a default grouping of
its shots, or no rows, as each function says. A number that is missing or null counts as its default; one that can't be read voids its whole answer, as any other item that doesn't fit does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions import coerce, lists
from framelode.functions import text as T

#: Shots of a batch, of a default group, and that group's type.
SEGMENT, GROUP, UNKNOWN = 30, 4, "unknown"

_BEAT = "array<struct<shot_indices: array<int>, beat_type: string, description: string, emotion: string, intensity: string, characters: array<string>>>"
_EVENT = "array<struct<event_index: string, start_time: string, end_time: string, event_type: string, description: string, characters: array<string>, emotion: string, importance: string, confidence: string, evidence: array<string>>>"
_EDGE = "array<struct<source_event: string, target_event: string, relation_type: string, description: string, strength: string, confidence: string>>"


def _items(answer: str, kind: str) -> Column:
    """The answer's list, or null if it has none."""
    block = T.json_block(F.col(answer))
    return F.when(F.trim(block).startswith("["), F.from_json(block, kind))


def _readable(items: Column, numbers: tuple[str, ...]) -> Column:
    """The items, null if a number of any of them, or an item itself, can't be read."""
    wrong = lambda x: x.isNull() | F.array_contains(F.array(*[F.coalesce(x[n], F.lit("0")).try_cast("double").isNull() for n in numbers]), True)
    return F.when(~F.exists(items, wrong), items)


def _number(value: Column, default: float) -> Column:
    return F.coalesce(F.trim(value).try_cast("double"), F.lit(default))


def segmented(shots: DataFrame, size: int = SEGMENT) -> DataFrame:
    """shots (video_id, scene_index, ...) with their ``segment`` of ``size`` in order and their ``local`` number in it, from 0: what goes out at once."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("scene_index")) - 1
    return shots.withColumn("segment", F.floor(n / size).cast("int")).withColumn("local", (n % size).cast("int"))


def beats_from_answers(shots: DataFrame, answers: DataFrame, rosters: DataFrame) -> DataFrame:
    """Beats of a video from the answers (video_id, segment, answer) about its segments of shots (video_id, scene_index, start_cs, end_cs, dur_cs).

    Shots may be named by their number or their local number in the segment; an item that names none of the segment's is left out. Characters
    are those of the video's roster (video_id, roster) or unknown_N. Beats are numbered over the whole video. A segment without a readable answer has
    groups of four shots."""
    own = segmented(shots)
    local = own.groupBy("video_id", "segment").agg(F.map_from_entries(F.collect_list(F.struct("local", "scene_index"))).alias("of"))
    read = local.join(answers, ["video_id", "segment"], "left").withColumn("items", _readable(_items("answer", _BEAT), ("intensity",))).join(rosters, "video_id", "left")
    told = read.where("items is not null and size(items) > 0").select("video_id", "segment", "of", "roster", F.posexplode("items").alias("position", "item"))
    number = lambda i: F.coalesce(F.try_element_at("of", i), i)
    told = told.where("size(item.shot_indices) > 0").select(
        "video_id", "segment", "position", F.array_sort(F.transform("item.shot_indices", number)).alias("shot_indices"), F.coalesce("item.beat_type", F.lit("")).alias("beat_type"), F.coalesce("item.description", F.lit("")).alias("description"),
        F.coalesce("item.emotion", F.lit("")).alias("emotion"), _number(F.col("item.intensity"), 0.0).alias("intensity"), lists.whitelisted(F.col("item.characters"), F.col("roster")).alias("characters"),
    )
    key = ["video_id", "segment", "position"]
    held = told.select(*key, F.explode(F.array_distinct("shot_indices")).alias("scene_index")).join(own, ["video_id", "segment", "scene_index"])
    times = held.groupBy(*key).agg(F.min("start_cs").alias("start_cs"), F.max("end_cs").alias("end_cs"), F.sum("dur_cs").alias("dur_cs"))
    told = told.join(times, key)
    bare = own.join(read.where("items is null or size(items) = 0").select("video_id", "segment"), ["video_id", "segment"], "left_semi").withColumn("position", F.floor(F.col("local") / GROUP).cast("int"))
    none = F.array().cast("array<string>")
    grouped = bare.groupBy(*key).agg(F.array_sort(F.collect_list("scene_index")).alias("shot_indices"), F.min("start_cs").alias("start_cs"), F.max("end_cs").alias("end_cs"), F.sum("dur_cs").alias("dur_cs"))
    grouped = grouped.withColumns({"beat_type": F.lit(UNKNOWN), "description": F.lit(""), "emotion": F.lit(""), "intensity": F.lit(0.0), "characters": none})
    order = Window.partitionBy("video_id").orderBy("segment", "position")
    return told.unionByName(grouped.select(*told.columns)).withColumn("beat_index", (F.row_number().over(order) - 1).cast("int")).drop("segment", "position")


def events_from_answers(answers: DataFrame) -> DataFrame:
    """Events of each video (video_id, answer): typed, with their evidence and the defaults of what an item leaves out; no rows where the answer can't be read."""
    items = _readable(_items("answer", _EVENT), ("event_index", "start_time", "end_time", "importance", "confidence"))
    rows = answers.select("video_id", F.posexplode(items).alias("position", "item"))
    text = lambda c: F.coalesce(f"item.{c}", F.lit("")).alias(c)
    return rows.select(
        "video_id", F.coalesce(coerce.safe_int(F.col("item.event_index")), F.lit(0)).alias("event_index"), _number(F.col("item.start_time"), 0.0).alias("start_time"), _number(F.col("item.end_time"), 0.0).alias("end_time"), text("event_type"),
        text("description"), lists.whitelisted(F.col("item.characters"), F.lit(None).cast("array<string>")).alias("characters"), text("emotion"), F.coalesce(coerce.safe_int(F.col("item.importance")), F.lit(5)).alias("importance"),
        F.coalesce("item.evidence", F.array().cast("array<string>")).alias("evidence"), _number(F.col("item.confidence"), 0.8).alias("confidence"), "position",
    )


def edges_from_answers(answers: DataFrame, events: DataFrame) -> DataFrame:
    """Edges between two different known events (video_id, event_index) of each video; others are left out."""
    rows = answers.select("video_id", F.explode(_items("answer", _EDGE)).alias("item"))
    end = lambda c: F.coalesce(coerce.safe_int(F.col(f"item.{c}_event")), F.lit(-1)).alias(c)
    rows = rows.select("video_id", end("source"), end("target"), F.coalesce("item.relation_type", F.lit("")).alias("relation_type"), F.coalesce("item.description", F.lit("")).alias("description"), _number(F.col("item.strength"), 0.5).alias("strength"), _number(F.col("item.confidence"), 0.5).alias("confidence"))
    known = events.select("video_id", "event_index").distinct()
    for c in ("source", "target"):
        rows = rows.join(known.withColumnRenamed("event_index", c), ["video_id", c], "left_semi")
    return rows.where("source <> target")
