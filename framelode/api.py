"""The engine over a store: what a user asks for, in a call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.operators import plan, search
from framelode.sources.snapshots import Snapshot, Snapshots
from framelode.sources.store import Store


def opened(store: Store) -> Snapshot:
    """The tables of a store as of now: its snapshots, and the plain tables of videos that no snapshot holds."""
    return Snapshots(store.spark, f"{store.root}/_snapshots", store).at()


def memory(tables: Snapshot) -> dict[str, DataFrame]:
    """The tables as ``search.search_memory`` reads them, of all videos."""
    read, col = tables.read, F.col
    cs = lambda c: F.round(F.col(c) * 100).cast("long")
    index = read("text_index").select("video_id", "scene_index", "combined_text", "keywords", "transcript", "vision_description")
    told = index.select("video_id", "scene_index", col("combined_text").alias("_text"), "transcript", col("vision_description").alias("vision"))
    units = read("memory_unit").select("video_id", "scene_index", "combined_text", "embedding").join(told, ["video_id", "scene_index"], "full")
    events = read("event").select("video_id", F.get("scene_indices", F.lit(0)).alias("scene_index"), col("event_index").cast("long").alias("pos"), "description", "event_type", "emotion", "importance")
    return {
        "units": units.select("video_id", "scene_index", F.coalesce("combined_text", "_text").alias("combined_text"), "transcript", "vision", "embedding"), "index": index, "events": events.where("scene_index is not null"),
        "transcripts": read("transcript").select("video_id", "scene_index", "pos", "text"), "vision": read("vision").select("video_id", "scene_index", "description", "mood", "scene_type", "objects"),
        "shots": read("shot").select("video_id", "scene_index", cs("start_time").alias("start_cs"), cs("end_time").alias("end_cs")),
        "appearances": read("character").select("video_id", col("character_id").alias("character"), F.explode("appearance_scenes").alias("shot")),
    }


def searched(store: Store, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """The whole funnel for queries (query_id, video_id, query and, if there are any, embedding and the columns of ``search.FILTERS``), each over its own video."""
    if "embedding" not in queries.columns:
        queries = queries.withColumn("embedding", F.lit(None).cast("array<double>"))
    return search.search_memory(memory(opened(store)), queries, top_k)


def cut_list(store: Store, plan_id: str) -> DataFrame:
    """What a media tool has to do for a stored plan, clip by clip; an error for a plan that nothing knows."""
    tables = opened(store)
    clips = tables.read("edit_clip").where(F.col("plan_id") == plan_id)
    if clips.isEmpty():
        raise LookupError(f"no plan {plan_id!r}")
    source = tables.read("video_meta").select("video_id", "storage_path")
    rows = clips.join(source, "video_id", "left").withColumns({"source_start": F.col("source_start") * 100, "source_end": F.col("source_end") * 100, "volume": F.col("audio_volume")})
    return plan.cut_list(rows, F.col("storage_path")).orderBy("clip_index")
