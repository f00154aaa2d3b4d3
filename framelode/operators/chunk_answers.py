"""What a model answers about a chunk of shots, brought back to the shots.

An answer is text that should hold one JSON object with lists of lines and of views of shots. It is read once, as VARIANT; a chunk is one row with its shots in order, so
that shot numbers, of the whole or of the chunk, and times are found within the row, without a join or a shuffle. From there the lists are
exploded into typed tables: transcripts, vision, ocr, audio and alignments, and what concerns characters, which ``operators/profiles.py`` folds.

Defined cases: an answer that holds no object, or none at all, counts as no answer: its shots get placeholders. A list that is no list is empty, an item that is
no object is left out. Of several views of one shot the one that says most counts, the first of equals. Rows of answers for chunks that don't exist are left out;
of several answers for one chunk the greatest text counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelode.functions import chunks as K
from framelode.functions import coerce
from framelode.functions import numbers as N
from framelode.functions import variants as V
from framelode.operators import fusion, shared

#: The views and notes of shots that an answer leaves out, and the confidence in shots that it doesn't.
UNTOLD, UNSEEN, UNALIGNED = "无法判断", "模型未返回该镜头画面分析", "模型未返回该镜头 per_shot，写入占位对齐"
CONFIDENCE = 0.8

_KEY = ("video_id", "chunk_index")
_STRINGS = "array<string>"


@dataclass
class Backfilled:
    """The typed tables, each with video_id."""

    transcripts: DataFrame
    vision: DataFrame
    ocr: DataFrame
    audio: DataFrame
    alignments: DataFrame


def read(chunks: DataFrame, shots: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each chunk (video_id, chunk_index, start_time, end_time, duration, shot_indices) with its ``shots`` (scene_index, start_time, end_time) in order and
    the ``answer`` as VARIANT, null where there is none."""
    own = chunks.select(*_KEY, F.explode(F.array_distinct("shot_indices")).alias("scene_index")).join(shots.select("video_id", "scene_index", "start_time", "end_time"), ["video_id", "scene_index"])
    held = own.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("scene_index", "start_time", "end_time"))).alias("shots"))
    told = answers.groupBy(*_KEY).agg(F.max("answer").alias("answer")).withColumn("answer", V.read_object(F.col("answer")))
    rows = chunks.select(*_KEY, "start_time", "end_time", F.greatest("duration", F.col("end_time") - F.col("start_time")).alias("length"))
    return rows.join(held, list(_KEY), "left").join(told, list(_KEY), "left").withColumn("shots", F.coalesce("shots", F.array().cast("array<struct<scene_index: int, start_time: double, end_time: double>>")))


def _transcripts(read_chunks: DataFrame) -> DataFrame:
    items = V.objects(F.col("answer"), "transcripts")
    ends = F.flatten(F.transform(items, lambda x: F.array(V.number(x["item"], "start_time", -1.0), V.number(x["item"], "end_time", -1.0))))
    mode = K.time_mode(F.filter(ends, lambda t: t >= 0), F.col("start_time"), F.col("end_time"), F.col("length"))
    rows = read_chunks.where("answer is not null").withColumn("mode", mode).select(*_KEY, "start_time", "shots", "mode", F.explode(items).alias("x"))
    item = F.col("x.item")
    time = lambda end: K.whole_time(V.number(item, end), F.col("start_time"), F.col("mode"))
    rows = rows.select(*_KEY, "shots", F.col("x.place").alias("pos"), time("start_time").alias("start_time"), time("end_time").alias("stop"), V.text(item, "text").alias("text"), V.text(item, "speaker", "unknown").alias("speaker"), V.text(item, "type", "dialogue").alias("transcript_type")).where("text <> ''")
    rows = rows.withColumn("end_time", F.greatest("stop", "start_time")).withColumn("character_id", coerce.character_id(F.col("speaker"), F.col("chunk_index")))
    middle = (F.col("start_time") + F.col("end_time")) / 2
    within = F.get(F.filter("shots", lambda s: (s["start_time"] <= middle) & (middle < s["end_time"])), F.lit(0))
    nearest = F.array_min(F.transform("shots", lambda s, i: F.struct(F.abs(s["start_time"] - middle).alias("off"), i.alias("place"), s.alias("shot"))))["shot"]
    rows = rows.withColumn("shot", F.coalesce(within, nearest))
    crosses = F.coalesce((F.col("start_time") < F.col("shot.start_time")) | (F.col("end_time") > F.col("shot.end_time")), F.lit(False))
    named = F.when(F.col("speaker").startswith("unknown_"), F.coalesce("character_id", "speaker")).otherwise(F.col("speaker"))
    return rows.select(*_KEY, "pos", "start_time", "end_time", "text", named.alias("speaker"), "character_id", F.coalesce("shot.scene_index", F.lit(-1)).alias("scene_index"), "transcript_type", crosses.alias("cross_shot"))


def _views(read_chunks: DataFrame) -> DataFrame:
    """The best item of each shot that an answer speaks of: video_id, chunk_index, scene_index, start_time, end_time and ``item``."""
    items = V.objects(F.col("answer"), "per_shot")
    numbers = F.transform("shots", lambda s: s["scene_index"])
    told = F.filter(F.transform(items, lambda x: V.whole(x["item"], "scene_index")), lambda i: i.isNotNull())
    local = F.size(F.filter(told, lambda i: (i >= 0) & (i < F.size(F.col("shots")))))
    everywhere = F.size(F.filter(told, lambda i: F.array_contains(numbers, i)))
    rows = read_chunks.where("answer is not null").withColumn("mode", K.scene_index_mode(local, everywhere)).select(*_KEY, "shots", "mode", F.explode(items).alias("x"))
    item = F.col("x.item")
    rows = rows.withColumn("local", V.whole(item, "local_shot_index")).withColumn("scene", V.whole(item, "scene_index"))
    numbers = F.transform("shots", lambda s: s["scene_index"])
    at = lambda c: F.when(F.col(c) >= 0, F.get(numbers, F.col(c)))
    known = F.when(F.array_contains(numbers, F.col("scene")), F.col("scene"))
    rows = rows.withColumn("scene_index", K.resolved_scene(at("local"), known, at("scene"), F.col("mode"))).where("scene_index is not null")
    vision, audio = V.object_or_none(item, "vision"), V.object_or_none(item, "audio")
    size = lambda path: F.length(V.text(vision, path))
    said = K.answer_quality(size("description") + size("action_description"), F.size(V.texts(vision, "objects")) + F.size(V.texts(vision, "ocr_texts")), V.filled(audio, "speech_emotion").cast("int") + V.filled(audio, "music_mood").cast("int"))
    best = rows.groupBy(*_KEY, "scene_index").agg(F.max_by(F.struct("x.item", "shots"), F.struct(said, -F.col("x.place"))).alias("best"))
    shot = F.get(F.filter("best.shots", lambda s: s["scene_index"] == F.col("scene_index")), F.lit(0))
    return best.withColumn("shot", shot).select(*_KEY, "scene_index", "shot.start_time", "shot.end_time", "best.item")


def _named(item: Column) -> Column:
    """The ids that an item names as present, as written: of an object its character_id, or its id."""
    value = V.at(item, "characters_present")
    every = F.when(V.kind(value).isin("STRING", "OBJECT"), F.array(value)).otherwise(F.try_variant_get(item, "$.characters_present", "array<variant>"))
    first = lambda x: F.coalesce(F.nullif(V.raw_text(x, "character_id"), F.lit("")), V.raw_text(x, "id"))
    return F.transform(F.coalesce(every, F.array().cast("array<variant>")), lambda x: F.when(V.kind(x) == "OBJECT", first(x)).otherwise(F.try_variant_get(x, "$", "string")))


def _present(item: Column, chunk: Column) -> Column:
    """The characters that an item names, in order, each as often as it does."""
    return F.filter(F.transform(_named(item), lambda c: coerce.character_id(c, chunk)), lambda c: c.isNotNull())


def backfilled(chunks: DataFrame, shots: DataFrame, answers: DataFrame) -> Backfilled:
    """The tables of the shots (video_id, scene_index, start_time, end_time) from the answers (video_id, chunk_index, answer) about chunks. A shot of which no answer speaks has a
    placeholder in each table but the transcripts."""
    return backfilled_from(shared.written(read(chunks, shots, answers), "read"), shots)


def backfilled_from(rows: DataFrame, shots: DataFrame) -> Backfilled:
    """The same from ``read``, written. Lines and shots are written too, as several tables are made of them."""
    transcripts, views = shared.written(_transcripts(rows), "lines"), _views(rows)
    item = F.col("item")
    vision, audio = V.object_or_none(item, "vision"), V.object_or_none(item, "audio")
    spoken = transcripts.groupBy("video_id", "scene_index").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_set("character_id")).alias("speaking"))
    told = shots.select("video_id", "scene_index", "start_time", "end_time").join(views.select("video_id", "chunk_index", "scene_index", "item"), ["video_id", "scene_index"], "left").join(spoken, ["video_id", "scene_index"], "left")
    seen = F.col("item").isNotNull()
    own = lambda value, other: F.when(seen, value).otherwise(other)
    none = F.array().cast(_STRINGS)
    key = ("video_id", "scene_index")
    words = {c: own(V.text(vision, c), F.lit("")) for c in ("mood", "scene_type", "camera_motion", "shot_scale", "action_description")}
    every = told.select(
        *key, "start_time", "end_time", own(V.text(vision, "description", UNTOLD), F.lit(UNSEEN)).alias("description"), own(V.texts(vision, "objects"), none).alias("objects"), *[c.alias(n) for n, c in words.items()],
        own(V.texts(vision, "props"), none).alias("props"), own(V.texts(vision, "ocr_texts"), none).alias("texts"), own(V.flag(audio, "has_music"), F.lit(False)).alias("has_music"), own(V.text(audio, "music_mood"), F.lit("")).alias("music_mood"),
        own(V.flag(audio, "has_sfx"), F.lit(False)).alias("has_sfx"), own(V.texts(audio, "sfx_tags"), none).alias("sfx_tags"), own(V.share(audio, "silence_ratio"), F.lit(0.0)).alias("silence_ratio"),
        own(V.text(audio, "speech_rate"), F.when(F.col("n_lines") > 0, "unknown").otherwise("")).alias("speech_rate"), own(V.share(audio, "volume_peak"), F.lit(0.0)).alias("volume_peak"), own(V.text(audio, "speech_emotion"), F.lit("")).alias("speech_emotion"),
        own(_present(item, F.col("chunk_index")), none).alias("visible_characters"), F.coalesce("speaking", none).alias("speaking_characters"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), seen.alias("seen"),
    )
    every = shared.written(every, "told")
    n, music = F.col("n_lines"), F.col("has_music")
    active = F.array_compact(F.array(F.when(n > 0, "speech"), F.when(music, "music"), F.when(F.col("has_sfx"), "sfx")))
    return Backfilled(
        transcripts,
        every.select(*key, F.col("start_time").alias("timestamp"), "description", "objects", *words, "props"),
        every.select(*key, F.col("start_time").alias("timestamp"), "texts"),
        every.select(*key, "has_music", "music_mood", "has_sfx", "sfx_tags", "silence_ratio", "speech_rate", "volume_peak", "speech_emotion"),
        every.select(
            *key, "start_time", "end_time", "visible_characters", "speaking_characters", active.alias("active_modalities"), fusion.dominant_in_chunk(n, music).alias("dominant_modality"),
            F.when(F.col("seen"), CONFIDENCE).otherwise(0.0).alias("alignment_confidence"), F.when(F.col("seen"), "").otherwise(UNALIGNED).alias("notes"),
        ),
    )


def speaker_map(transcripts: DataFrame) -> DataFrame:
    """video_id, speaker and the character that the last of its lines has, in order of time."""
    last = F.struct("start_time", "chunk_index", "pos")
    return transcripts.where("character_id is not null").groupBy("video_id", "speaker").agg(F.max_by("character_id", last).alias("character_id"))


def boundaries(read_chunks: DataFrame) -> DataFrame:
    """video_id, chunk_index, n_shots and ``lines``: what a chunk's prompt says of its shots, a line each: their number in the chunk and in the whole, their times in the whole and from the chunk's start, and their length."""
    tenth = lambda c: F.format_string("%.1f", N.half_even(c, 1))
    start = F.col("start_time")
    line = lambda s, i: F.concat(
        F.lit("local_shot_index "), i.cast("string"), F.lit(" | scene_index "), s["scene_index"].cast("string"), F.lit(" | abs "), tenth(s["start_time"]), F.lit("s-"), tenth(s["end_time"]), F.lit("s | rel "), tenth(s["start_time"] - start),
        F.lit("s-"), tenth(s["end_time"] - start), F.lit("s | duration "), tenth(s["end_time"] - s["start_time"]), F.lit("s"),
    )
    return read_chunks.select(*_KEY, F.size("shots").alias("n_shots"), F.array_join(F.transform("shots", line), "\n").alias("lines"))


def unknown_names(answer: Column) -> Column:
    """The distinct unknown_N, as written, of the lines and views of an answer."""
    lines = F.transform(F.filter(V.objects(answer, "transcripts"), lambda x: V.text(x["item"], "text") != ""), lambda x: V.text(x["item"], "speaker", "unknown"))
    seen = F.flatten(F.transform(V.objects(answer, "per_shot"), lambda x: F.transform(_named(x["item"]), lambda c: F.trim(c))))
    return F.array_distinct(F.filter(F.concat(lines, seen), lambda c: c.startswith("unknown_")))


def updates(answer: Column) -> Column:
    """The updates of characters in an answer: place, id (as written), names, change and action."""
    one = lambda x: F.struct(x["place"], V.text(x["item"], "character_id").alias("id"), V.texts(x["item"], "new_names").alias("names"), V.text(x["item"], "appearance_change").alias("change"), V.text(x["item"], "key_action").alias("action"))
    return F.transform(V.objects(answer, "character_updates"), one)


def suggested(answer: Column) -> Column:
    """The merges that an answer suggests: place, primary, duplicate, confidence and reason; those of an id with itself or without one are left out."""
    raw = lambda x, path: F.coalesce(V.raw_text(x["item"], path), F.lit("")).alias(path)
    every = F.transform(V.objects(answer, "character_merge_suggestions"), lambda x: F.struct(x["place"], raw(x, "primary"), raw(x, "duplicate"), V.share(x["item"], "confidence").alias("confidence"), raw(x, "reason")))
    return F.filter(every, lambda s: (s["primary"] != "") & (s["duplicate"] != "") & (s["primary"] != s["duplicate"]))


def mentions(answers: DataFrame) -> DataFrame:
    """What ``answers`` (video_id, chunk_index, answer as VARIANT) say of characters, in the order in which it counts: video_id, chunk_index, ``phase`` (0 a name in a line or view, 1 an update), ``place``,
    character_id, ``raw`` (unknown_N, as written), names, change and action of an update. Only names of unknown ones are listed: known ones enter nothing by being named."""
    rows = answers.where("answer is not null").select(*_KEY, "answer")
    named = rows.select(*_KEY, F.explode(unknown_names(F.col("answer"))).alias("raw"))
    own = coerce.character_id(F.col("raw"), F.col("chunk_index")).alias("character_id")
    named = named.select(*_KEY, F.lit(0).alias("phase"), F.lit(0).alias("place"), own, "raw", F.array().cast(_STRINGS).alias("names"), F.lit("").alias("change"), F.lit("").alias("action"))
    told = rows.select(*_KEY, F.explode(updates(F.col("answer"))).alias("u"))
    told = told.select(*_KEY, F.lit(1).alias("phase"), "u.place", coerce.character_id(F.col("u.id"), F.col("chunk_index")).alias("character_id"), F.when(F.col("u.id").startswith("unknown_"), F.col("u.id")).alias("raw"), "u.names", "u.change", "u.action")
    return named.union(told.where("character_id is not null"))


def suggestions(answers: DataFrame) -> DataFrame:
    """``suggested`` of each answer as rows with video_id and chunk_index."""
    return answers.where("answer is not null").select(*_KEY, F.explode(suggested(F.col("answer"))).alias("s")).select(*_KEY, "s.*")
