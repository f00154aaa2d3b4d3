"""Which shots, beats, events and faces go on to what is asked of a model, and how chapters' plans become one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.operators import entity, joins

#: Fixed values of the rules.
IMPORTANT, STRONG_TYPES, LEAST_INTENSITY, FALLBACK_BEATS = 7, ("confrontation", "resolution"), 0.5, 10
FIRST_EVENTS, MOST_EVENTS, SAMPLES = 20, 60, 20


def important_shots(shots: DataFrame, beats: DataFrame, events: DataFrame) -> DataFrame:
    """Shots (video_id, scene_index) that begin or end a beat (shot_indices) or belong to an event of importance 7 or more (scene_indices)."""
    ends = F.when(F.size("shot_indices") > 0, F.array(F.element_at("shot_indices", 1), F.element_at("shot_indices", -1)))
    wanted = beats.select("video_id", F.explode(ends).alias("scene_index")).union(events.where(F.col("importance") >= IMPORTANT).select("video_id", F.explode("scene_indices").alias("scene_index")))
    return shots.join(wanted.distinct(), ["video_id", "scene_index"], "left_semi")


def important_beats(beats: DataFrame) -> DataFrame:
    """Beats (video_id, beat_index, intensity, beat_type) of intensity 0.5 or more or of a strong type; of a video without any the first ten."""
    good = F.coalesce((F.col("intensity") >= LEAST_INTENSITY) | F.col("beat_type").isin(*STRONG_TYPES), F.lit(False))
    of = Window.partitionBy("video_id")
    rows = beats.withColumns({"_good": good, "_any": F.max(good).over(of), "_n": F.row_number().over(of.orderBy("beat_index"))})
    return rows.where(F.col("_good") | (~F.col("_any") & (F.col("_n") <= FALLBACK_BEATS))).drop("_good", "_any", "_n")


def events_for_prompt(events: DataFrame) -> DataFrame:
    """Events (video_id, event_index, start_cs, importance, characters) to be told, with their ``place``: a video's first 20 and all that are important or
    have two characters or more, in order of time, 60 at most. Of rows that repeat an event_index the first by time that is told stays."""
    of = Window.partitionBy("video_id")
    rows = events.withColumn("_n", F.row_number().over(of.orderBy("event_index")))
    rows = rows.where((F.col("_n") <= FIRST_EVENTS) | (F.col("importance") >= IMPORTANT) | (F.size("characters") >= 2))
    again = F.row_number().over(Window.partitionBy("video_id", "event_index").orderBy("_n"))
    rows = rows.withColumn("_again", again).where("_again = 1").drop("_again")
    return rows.withColumn("place", F.row_number().over(of.orderBy("start_cs", "_n"))).where(F.col("place") <= MOST_EVENTS).drop("_n")


def every_kth(rows: DataFrame, key: str, order: str, samples: int = SAMPLES) -> DataFrame:
    """Every k-th row of each key in order from the first on, k so that about ``samples`` are left."""
    of = Window.partitionBy(key)
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(of) / samples))
    return rows.withColumn("_step", step).withColumn("_n", F.row_number().over(of.orderBy(order)) - 1).where(F.col("_n") % F.col("_step") == 0).drop("_step", "_n")


def face_order(timestamp: Column, scene: Column, path: Column, box: Column) -> Column:
    """The key in whose order faces are walked: time, scene, key frame, box to two digits; what can't be read counts as 0, -1, "" and an empty box."""
    numbers = F.transform(box, lambda v: F.round(v.try_cast("double"), 2))
    whole = F.when(box.isNull() | F.exists(numbers, lambda v: v.isNull()), F.array().cast("array<double>")).otherwise(numbers)
    return F.struct(F.coalesce(timestamp.try_cast("double"), F.lit(0.0)).alias("time"), F.coalesce(scene.try_cast("int"), F.lit(-1)).alias("scene"), F.coalesce(path, F.lit("")).alias("path"), whole.alias("box"))


def gallery_faces(faces: DataFrame, key: str, tiers: DataFrame, most: int = 6) -> DataFrame:
    """The faces of each cluster with the highest scores: one of a passerby, ``most`` of all others, with their place; ties to the smaller face."""
    order = Window.partitionBy(key).orderBy(F.desc("det_score"), "face_id")
    rows = faces.join(tiers.select(key, "tier"), key).withColumn("place", F.row_number().over(order))
    return rows.where(F.col("place") <= F.when(F.col("tier") == "passerby", 1).otherwise(most))


def tier_counts(tiers: DataFrame) -> DataFrame:
    """One row: how many are major, minor and passerby, and all."""
    return tiers.agg(*[F.count_if(F.col("tier") == t).alias(t) for t in entity.TIERS], F.count("*").alias("total"))


def shot_stats(shots: DataFrame) -> DataFrame:
    """n, min_cs, max_cs and avg_cs (to four digits) of each video's shots (video_id, dur_cs)."""
    return shots.groupBy("video_id").agg(F.count("*").alias("n"), F.min("dur_cs").alias("min_cs"), F.max("dur_cs").alias("max_cs"), F.round(F.avg("dur_cs"), 4).alias("avg_cs"))


def event_counts(events: DataFrame) -> DataFrame:
    """n_events, n_important and n_types of each video's events (video_id, event_type, importance)."""
    return events.groupBy("video_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("importance") >= IMPORTANT).alias("n_important"), F.countDistinct("event_type").alias("n_types"))


def without_passersby(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.col("tier") != "passerby", F.lit(True)))


def relation_graph(relations: DataFrame, characters: DataFrame, appearances: DataFrame) -> DataFrame:
    """relations (character_a, character_b, ...) between characters (video_id, character) that are known and, where a video has others, not temporary,
    with ``co_appearance_shots``, the shots (character, shot) that both are in, in order. If all tables have video_id, a character is one of its video."""
    place = joins.place(relations, characters, appearances)
    known = entity.stable_only(characters).select(*place, "character").distinct()
    rows = relations.join(known.withColumnRenamed("character", "character_a"), [*place, "character_a"], "left_semi").join(known.withColumnRenamed("character", "character_b"), [*place, "character_b"], "left_semi")
    key = [*place, "character_a", "character_b"]
    pairs = rows.select(*key).distinct()
    own = appearances.select(*place, "character", "shot").distinct()
    both = pairs.join(own.withColumnRenamed("character", "character_a"), [*place, "character_a"]).join(own.withColumnRenamed("character", "character_b"), [*place, "character_b", "shot"])
    shots = both.groupBy(*key).agg(F.array_sort(F.collect_list("shot")).alias("co_appearance_shots"))
    out = rows.join(shots, key, "left")
    return out.withColumn("co_appearance_shots", F.coalesce("co_appearance_shots", F.array().cast(shots.schema["co_appearance_shots"].dataType)))


def companions(appearances: DataFrame) -> DataFrame:
    """(character, others): who shares a shot with each character, itself left out, in order."""
    place = joins.place(appearances)
    own, tasks = entity.by_shot(appearances)
    pairs = entity.pairs_of_shots(own, tasks).select(*place, "a", "b")
    each = pairs.select(*place, F.col("a").alias("character"), F.col("b").alias("other")).union(pairs.select(*place, F.col("b").alias("character"), F.col("a").alias("other")))
    # a pair is there once, so that a list of them is a set
    return each.repartition(tasks, *place, "character").groupBy(*place, "character").agg(F.array_sort(F.collect_list("other")).alias("others"))


def chapters_merged(clips: DataFrame, shots: DataFrame) -> DataFrame:
    """The clips of chapters' plans (plan_id, chapter_index, position, scene_index, source_start, source_end, speed) as one plan: clips of unknown shots (scene_index, start_cs,
    end_cs) go, sources are clamped to their shot, or are the whole shot where nothing is left, and clips are numbered and placed one after another."""
    rows = clips.join(shots.select("scene_index", "start_cs", "end_cs"), "scene_index")
    low, high = F.greatest(F.coalesce("source_start", "start_cs"), F.col("start_cs")), F.least(F.coalesce("source_end", "end_cs"), F.col("end_cs"))
    rows = rows.withColumns({"_low": low, "_high": high})
    rows = rows.withColumns({"source_start": F.when(F.col("_high") <= F.col("_low"), F.col("start_cs")).otherwise(F.col("_low")), "source_end": F.when(F.col("_high") <= F.col("_low"), F.col("end_cs")).otherwise(F.col("_high"))})
    order = Window.partitionBy("plan_id").orderBy("chapter_index", "position")
    length = (F.col("source_end") - F.col("source_start")) / F.col("speed")
    end = F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("plan_id", (F.row_number().over(order) - 1).alias("clip_index"), "chapter_index", "scene_index", "source_start", "source_end", "speed", (end - length).alias("timeline_start"), end.alias("timeline_end"))


def shot_boundaries(frames: DataFrame, threshold: float = 27.0, least: int = 1) -> DataFrame:
    """frames (video_id, frame, metric) with the number of their shot: a new one begins where the metric differs from the frame before by more than the threshold, and ``least`` frames or more after the
    last one did (or the video). Cuts alone, of which a video has few, are walked in order."""
    order = Window.partitionBy("video_id").orderBy("frame")
    jumps = F.coalesce((F.abs(F.col("metric") - F.lag("metric").over(order)) > threshold).cast("int"), F.lit(0))
    frames = frames.withColumn("_cut", jumps)
    if least > 1:
        begins = frames.groupBy("video_id").agg(F.min("frame").alias("_from"), F.array_sort(F.collect_list(F.when(F.col("_cut") == 1, F.col("frame")))).alias("_all"))
        none = F.array().cast(begins.schema["_all"].dataType)
        last = lambda kept: F.coalesce(F.try_element_at(kept, F.lit(-1)), F.col("_from"))
        kept = F.aggregate("_all", none, lambda kept, at: F.when(at - last(kept) >= least, F.concat(kept, F.array(at))).otherwise(kept))
        cuts = begins.select("video_id", F.explode(kept).alias("frame"), F.lit(1).alias("_kept"))
        frames = frames.join(cuts, ["video_id", "frame"], "left").withColumn("_cut", F.coalesce("_kept", F.lit(0))).drop("_kept")
    return frames.withColumn("scene_index", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_cut")
