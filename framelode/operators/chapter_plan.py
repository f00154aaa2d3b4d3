"""Planning of long videos by chapters: where they begin, what is searched for in each, and one plan from all chapters' answers.

All chapters of all plans are searched in one pass: each is a query with its own time range. A plan's clips are put one after another in the order of chapters and of the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions import numbers as N
from framelode.functions import text as T
from framelode.functions import variants as V
from framelode.operators.plan import UNCHECKED

#: Seconds of a chapter, at least and where time alone cuts; importance from which an event may begin one.
LEAST, EVEN, IMPORTANT = 300.0, 600.0, 6
#: Candidates of a chapter; references and characters of text with which a clip without evidence is filled from them.
CANDIDATES, REFERENCES, QUOTED = 15, 3, 200


def split(videos: DataFrame, events: DataFrame) -> DataFrame:
    """video_id, chapter_index, start_time and end_time for videos (video_id, duration). A chapter begins with each important event (video_id, start_time, importance) that starts
    ``LEAST`` seconds or more after the last one did; a video of more than two even chapters without such events is cut evenly."""
    times = F.array_sort(F.collect_list("start_time"))
    important = events.where((F.col("importance") >= IMPORTANT) & F.col("start_time").isNotNull()).groupBy("video_id").agg(times.alias("times"))
    rows = videos.join(important, "video_id", "left")
    none = F.array().cast("array<double>")
    last = lambda cuts: F.coalesce(F.try_element_at(cuts, F.lit(-1)), F.lit(0.0))
    told = F.aggregate(F.coalesce("times", none), none, lambda cuts, t: F.when(t - last(cuts) >= LEAST, F.concat(cuts, F.array(t))).otherwise(cuts))
    n = F.ceil((F.col("duration") - LEAST) / EVEN).cast("int") - 1  # cuts at EVEN, 2 * EVEN ... before the last LEAST seconds
    even = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i * EVEN)).otherwise(none)
    cuts = F.when((F.size("told") == 0) & (F.col("duration") > 2 * EVEN), even).otherwise(F.col("told"))
    ends = F.concat(F.array(F.lit(0.0)), F.col("cuts"), F.array(F.col("duration")))
    rows = rows.withColumn("told", told).withColumn("cuts", cuts).withColumn("ends", ends)
    return rows.select("video_id", F.posexplode(F.slice("ends", F.lit(1), F.size("ends") - 1)).alias("chapter_index", "start_time"), "ends").select("video_id", "chapter_index", "start_time", F.get("ends", F.col("chapter_index") + 1).alias("end_time"))


def query_id(plan: Column, chapter: Column) -> Column:
    return F.concat(plan.cast("string"), F.lit("#"), chapter.cast("string"))


def queries(plans: DataFrame, chapters: DataFrame) -> DataFrame:
    """A query for each chapter of each plan (plan_id, video_id, query, embedding, target_duration) with its time range in centiseconds and its ``budget`` in seconds, the
    plan's target by the number of its chapters."""
    n = F.count("*").over(Window.partitionBy("plan_id"))
    rows = plans.join(chapters, "video_id").withColumn("budget", F.col("target_duration") / n)
    cs = lambda c: F.round(F.col(c) * 100).cast("long")
    return rows.select(query_id(F.col("plan_id"), F.col("chapter_index")).alias("query_id"), "plan_id", "chapter_index", "video_id", "query", "embedding", cs("start_time").alias("start_cs"), cs("end_time").alias("end_cs"), "budget")


def clips(answers: DataFrame, candidates: DataFrame, shots: DataFrame, unchecked: bool = False) -> DataFrame:
    """The clips of each plan from the answers (plan_id, chapter_index, video_id, answer) of its chapters, numbered and placed one after another, times in seconds to three digits.

    Clips of unknown shots (video_id, scene_index, start_time, end_time) go; a source is clamped to its shot, or is the whole shot where nothing is left. What an answer leaves out is filled from its
    chapter's candidates (query_id, scene_index, refs, transcript, vision): up to three references, or one to the search where the candidate has none, and the beginnings of its texts. A chapter without a candidate has been
    asked nothing and its answer counts for nothing, nor does one that holds no object; a speed that is no number above 0 is 1. unchecked: for plans that are not made by chapters, whose clips may be of shots that
    were no candidates; without evidence those are marked so. Answers that were parsed before have the object as ``v`` instead."""
    read = answers.withColumn("query_id", query_id(F.col("plan_id"), F.col("chapter_index")))
    read = (read if unchecked else read.join(candidates.select("query_id").distinct(), "query_id", "left_semi"))
    read = read if "v" in read.columns else read.withColumn("v", V.read_object(F.col("answer")))
    items = read.select("plan_id", "chapter_index", "video_id", "query_id", F.explode(V.objects(F.col("v"), "clips")).alias("x"))
    item = F.col("x.item")
    said = lambda path, default=None: F.coalesce(V.raw_text(item, path), F.lit(default)).alias(path)
    rows = items.select(
        "plan_id", "chapter_index", "video_id", "query_id", F.col("x.place").alias("place"), F.coalesce(V.whole(item, "source_scene_index"), F.lit(0)).alias("scene_index"), V.number(item, "source_start", None).alias("_from"),
        V.number(item, "source_end", None).alias("_to"), V.number(item, "speed", 1.0).alias("speed"), V.number(item, "audio_volume", 1.0).alias("audio_volume"), said("narrative_role", "rising_action"), said("selection_reason", ""),
        V.texts(item, "characters").alias("characters"), said("subtitle_text"), said("narration_suggestion"), said("transition_in", "cut"), said("transition_out", "cut"), V.texts(item, "evidence_refs").alias("evidence_refs"),
        said("matched_transcript"), said("matched_vision"),
    ).withColumn("speed", F.when(F.col("speed") > 0, F.col("speed")).otherwise(1.0))
    rows = rows.join(shots.select("video_id", "scene_index", "start_time", "end_time"), ["video_id", "scene_index"])
    low, high = F.greatest(F.coalesce("_from", "start_time"), F.col("start_time")), F.least(F.coalesce("_to", "end_time"), F.col("end_time"))
    rows = rows.withColumn("_low", low).withColumn("_high", high)
    gone = F.col("_high") <= F.col("_low")
    rows = rows.withColumn("source_start", F.when(gone, F.col("start_time")).otherwise(F.col("_low"))).withColumn("source_end", F.when(gone, F.col("end_time")).otherwise(F.col("_high")))
    found = candidates.select("query_id", "scene_index", "refs", F.col("transcript").alias("_said"), F.col("vision").alias("_seen"), F.lit(True).alias("_found"))
    rows = rows.join(found, ["query_id", "scene_index"], "left")
    none = F.array(F.concat(F.lit("search_result#scene_"), F.col("scene_index").cast("string")))
    refs = F.when(F.size("evidence_refs") > 0, F.col("evidence_refs")).when(F.col("_found"), F.when(F.size(F.coalesce("refs", F.array().cast("array<string>"))) > 0, F.slice("refs", 1, REFERENCES)).otherwise(none))
    mark = F.array(F.concat(F.lit("scene#"), F.col("scene_index").cast("string"), F.lit(f"_{UNCHECKED}")))
    refs = refs.otherwise(mark if unchecked else F.col("evidence_refs"))
    filled = lambda own, other: F.coalesce(F.nullif(F.col(own), F.lit("")), F.nullif(T.prefix(F.col(other), QUOTED), F.lit("")), F.col(own)).alias(own)
    order = Window.partitionBy("plan_id").orderBy("chapter_index", "place")
    length = (F.col("source_end") - F.col("source_start")) / F.col("speed")
    end = F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begin = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    milli = lambda c: N.half_even(c, 3)
    return rows.select(
        "plan_id", "video_id", (F.row_number().over(order) - 1).alias("clip_index"), "chapter_index", F.col("scene_index").alias("source_scene_index"), milli(F.col("source_start")).alias("source_start"), milli(F.col("source_end")).alias("source_end"),
        milli(begin).alias("timeline_start"), milli(end).alias("timeline_end"), "narrative_role", "selection_reason", "characters", "subtitle_text", "narration_suggestion", "transition_in", "transition_out", "speed", "audio_volume",
        refs.alias("evidence_refs"), filled("matched_transcript", "_said"), filled("matched_vision", "_seen"),
    )
