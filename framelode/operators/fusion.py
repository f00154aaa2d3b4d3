"""Fusion of the modalities of a shot into one unit, and the rules on what speaks in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions import numbers as N
from framelode.functions import text as T
from framelode.operators import joins

#: Fixed values of the rules.
SILENT, BASE, SPEAKER_STEP, PRESENCE_STEP = 0.8, 0.5, 0.15, 0.1
SILENCE_TAG = 0.7
SEPARATOR = " | "
#: The labels of a unit's segments, in the order in which units show them.
LINES, VIEW, MOOD, KIND, OBJECTS, ACTION, WRITING, EVENT, WHO = "台词", "画面", "情绪", "类型", "物体", "动作", "文字", "事件", "人物"
AUDIO, MUSIC, SFX, SPEECH = "音频", "音乐", "音效", "语音情绪"
BEAT, SCENE, PLACE, FUNCTION, CHAPTER, CONTENT, THEME = "节拍", "场景", "地点", "功能", "章节", "内容", "主题"
UNSEEN, VOICE_OVER = "说话者不在画面中: ", "（可能是画外音/旁白）"

_SIDES = {
    "vision": {"description": "string", "mood": "string", "scene_type": "string", "objects": "array<string>", "action": "string"},
    "ocr": {"texts": "array<string>"},
    "audio": {"has_music": "boolean", "music_mood": "string", "has_sfx": "boolean", "sfx_tags": "array<string>", "speech_emotion": "string", "silence": "double"},
    "signals": {"scores": "map<string,double>", "suggested_usage": "array<string>"},
    "alignments": {"dominant_modality": "string", "alignment_confidence": "double", "notes": "string"},
}


def fused(shots: DataFrame, transcripts: DataFrame, characters: DataFrame, events: DataFrame, chapters: DataFrame | None = None, **sides: DataFrame) -> DataFrame:
    """Every shot (key scene_index) with its transcripts (pos, text) in order, its characters, its events (event_id, event_type, description) and, of
    each of ``sides`` (vision, ocr, audio, signals of shots, alignments), the columns of its last row by pos, null where there is none, and
    ``has_`` of the side; chapters (chapter_index, shot_indices) give the last one that lists it. Each side is one row a shot before it is joined. If all tables have video_id,
    scenes are those of their video."""
    given = [*sides.values(), *([] if chapters is None else [chapters])]
    place = joins.place(shots, transcripts, characters, events, *given)
    key = [*place, "scene_index"]
    ordered = lambda of, at: F.transform(F.array_sort(F.collect_list(F.struct(at, of))), lambda x: x[of])
    out = shots.join(transcripts.groupBy(*key).agg(ordered("text", "pos").alias("lines")), key, "left")
    out = out.join(characters.groupBy(*key).agg(F.array_sort(F.collect_set("character")).alias("characters")), key, "left")
    out = out.join(events.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "description"))).alias("events")), key, "left")
    for side, columns in _SIDES.items():
        if side in sides:
            own = joins.keep(sides[side], key, ["pos"])
            given = [(F.col(c) if c in own.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()]
            out = out.join(own.select(*key, *given, F.lit(True).alias(f"has_{side}")), key, "left")
        else:
            out = out.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items()} | {f"has_{side}": F.lit(False)})
        out = out.withColumn(f"has_{side}", F.coalesce(f"has_{side}", F.lit(False)))
    if chapters is not None:
        out = out.join(chapters.select(*place, "chapter_index", F.explode("shot_indices").alias("scene_index")).groupBy(*key).agg(F.max("chapter_index").alias("chapter_index")), key, "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    event = "array<struct<event_id:bigint,event_type:string,description:string>>"
    return out.withColumns({"lines": empty("lines", "array<string>"), "characters": empty("characters", "array<string>"), "events": empty(F.col("events").cast(event), event)})


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _named(label: str, text: Column) -> Column:
    """A segment, or null for an empty text, which ``concat_ws`` leaves out."""
    return F.when(_filled(text), F.concat(F.lit(f"{label}: "), text))


def _listed(label: str, texts: Column, most: int | None = None, between: str = ", ") -> Column:
    return F.when(F.size(F.coalesce(texts, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"{label}: "), F.array_join(texts if most is None else F.slice(texts, 1, most), between)))


def combined_text() -> Column:
    """The text of a fused unit: what is said, seen, written, what happens and who is there, joined by bars; what is heard comes last behind a bar
    of its own even if nothing stands before it. A view counts even if its description is empty."""
    c = F.col
    said = F.when(F.size("lines") > 0, F.concat(F.lit(f"{LINES}: "), F.array_join("lines", " ")))
    seen = F.when(c("has_vision"), F.concat(F.lit(f"{VIEW}: "), F.coalesce("description", F.lit(""))))
    happens = F.transform("events", lambda e: F.concat(F.lit(f"{EVENT}["), F.coalesce(e["event_type"], F.lit("")), F.lit("]: "), F.coalesce(e["description"], F.lit(""))))
    parts = F.concat_ws(
        SEPARATOR, said, seen, _named(MOOD, c("mood")), _named(KIND, c("scene_type")), _listed(OBJECTS, c("objects")), _named(ACTION, c("action")), _listed(WRITING, c("texts")), happens, _listed(WHO, c("characters")),
    )
    heard = F.array_compact(
        F.array(
            F.when(c("has_music"), F.concat(F.lit(f"{MUSIC}:"), F.coalesce("music_mood", F.lit("")))),
            F.when(c("has_sfx"), F.concat(F.lit(f"{SFX}:"), F.array_join(F.slice(F.coalesce("sfx_tags", F.array().cast("array<string>")), 1, 3), ","))),
            F.when(_filled(c("speech_emotion")), F.concat(F.lit(f"{SPEECH}:"), c("speech_emotion"))),
        )
    )
    return F.concat(parts, F.when(F.size(heard) > 0, F.concat(F.lit(f"{SEPARATOR}{AUDIO}: "), F.array_join(heard, ", "))).otherwise(""))


def heads(transcripts: DataFrame, most: int, size: int) -> DataFrame:
    """(scene_index, lines): of each scene its first ``most`` lines as structs of their number and text, in order, cut where together they have ``size`` characters; empty from there on, as they still count."""
    order = Window.partitionBy("scene_index").orderBy("pos", "text")
    first = transcripts.select("scene_index", "pos", "text").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("pos")
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("scene_index").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = first.withColumn("_left", F.greatest(F.lit(size) - before, F.lit(0)).cast("int")).select("scene_index", "n", F.substring("text", F.lit(1), F.col("_left")).alias("text"))
    return cut.groupBy("scene_index").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("lines"))


def beat_units(beats: DataFrame, transcripts: DataFrame, vision: DataFrame) -> DataFrame:
    """Beats (beat_index, shot_indices, beat_type, description, emotion, characters) with ``transcript_summary``, 500 characters of their shots' first
    ten lines, and ``combined_text``: of those lines 200 characters, of five of their shots' descriptions 50 each. Texts are cut before they are joined, and equal lists of shots are laid out once."""
    key = "shot_indices"
    shots = beats.select(key).distinct().select(key, F.posexplode(key).alias("place", "scene_index"))
    lines = shots.join(heads(transcripts, 10, 500), "scene_index").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "lines"))).alias("_lines"))
    seen = vision.select("scene_index", "pos", T.prefix(F.col("description"), 50).alias("description"))
    views = shots.join(joins.keep(seen, ["scene_index"], ["pos"]).select("scene_index", "description"), "scene_index").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "description"))).alias("_views"))
    first = F.slice(F.flatten(F.transform("_lines", lambda x: x["lines"])), 1, 10)
    said = T.prefix(F.array_join(F.transform(first, lambda x: x["text"]), " "), 500)
    told = lines.join(views, key, "full").select(key, said.alias("_said"), F.transform(F.slice("_views", 1, 5), lambda x: x["description"]).alias("_seen"))
    c = F.col
    parts = F.concat_ws(SEPARATOR, _named(BEAT, c("description")), _named(KIND, c("beat_type")), _named(LINES, T.prefix(c("_said"), 200)), _listed(VIEW, c("_seen"), between="; "), _named(MOOD, c("emotion")), _listed(WHO, c("characters")))
    return beats.join(told, key, "left").select(*beats.columns, F.coalesce("_said", F.lit("")).alias("transcript_summary"), parts.alias("combined_text"))


def _children(parents: DataFrame, parent: str, listed: str, child: str, children: DataFrame, label: str) -> DataFrame:
    """Per parent, from the children that it lists and that exist: ``_descs``, in the order of the list, "[label] description" of those that have one,
    and ``_cast``, all their characters."""
    rows = parents.select(parent, F.posexplode(listed).alias("place", child)).join(children.select(child, label, "description", "characters"), child)
    shown = F.when(_filled(F.col("description")), F.struct("place", F.concat(F.lit("["), F.coalesce(label, F.lit("")), F.lit("] "), F.col("description")).alias("text")))
    return rows.groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["text"]).alias("_descs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("characters")))).alias("_cast"))


def scene_units(scenes: DataFrame, beats: DataFrame) -> DataFrame:
    """Story scenes (story_scene_index, beat_indices, description, location, plot_function, characters) with ``combined_text``; the characters are
    those of their beats where a scene names none."""
    rows = scenes.join(_children(scenes, "story_scene_index", "beat_indices", "beat_index", beats, "beat_type"), "story_scene_index", "left")
    c = F.col
    parts = F.concat_ws(SEPARATOR, _named(SCENE, c("description")), _named(PLACE, c("location")), _named(FUNCTION, c("plot_function")), _listed(BEAT, c("_descs"), 5, "; "), _listed(WHO, c("characters")))
    own = F.when(F.size(F.coalesce("characters", F.array())) > 0, c("characters")).otherwise(F.coalesce("_cast", F.array().cast("array<string>")))
    return rows.select(*[n for n in scenes.columns if n != "characters"], own.alias("characters"), parts.alias("combined_text"))


def chapter_units(chapters: DataFrame, scenes: DataFrame) -> DataFrame:
    """Chapters (chapter_index, story_scene_indices, title, description, theme, chapter_type, characters, mood_progression) with ``combined_text``, which
    shows five scenes and five characters; the characters are those of their scenes where a chapter names none."""
    rows = chapters.join(_children(chapters, "chapter_index", "story_scene_indices", "story_scene_index", scenes, "plot_function"), "chapter_index", "left")
    c = F.col
    parts = F.concat_ws(
        SEPARATOR, _named(CHAPTER, c("title")), _named(CONTENT, c("description")), _named(THEME, c("theme")), _named(KIND, c("chapter_type")), _listed(SCENE, c("_descs"), 5, "; "), _listed(WHO, c("characters"), 5),
        _named(MOOD, c("mood_progression")),
    )
    own = F.when(F.size(F.coalesce("characters", F.array())) > 0, c("characters")).otherwise(F.coalesce("_cast", F.array().cast("array<string>")))
    return rows.select(*[n for n in chapters.columns if n != "characters"], own.alias("characters"), parts.alias("combined_text"))


def active_modalities(n_lines: Column, action: Column, music: Column, sfx: Column, silence: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(n_lines > 0, "speech"), F.when(F.coalesce(action, F.lit("")) != "", "visual_action"), F.when(music, "music"),
            F.when(sfx, "sfx"), F.when(silence > SILENT, "silence"),
        )
    )


def dominant_modality(n_lines: Column, action: Column, music: Column, silence: Column) -> Column:
    return (
        F.when(silence > SILENT, "silence").when(n_lines >= 2, "speech").when(music & (n_lines == 0), "music")
        .when(F.coalesce(action, F.lit("")) != "", "visual_action").when(n_lines > 0, "speech").otherwise("visual")
    )


def dominant_in_chunk(n_lines: Column, music: Column) -> Column:
    """The short form of the chunk path: speech, then music, then the picture."""
    return F.when(n_lines > 0, "speech").when(music, "music").otherwise("visual")


def alignment_confidence(speaking: Column, visible: Column, has_audio: Column, has_vision: Column, n_lines: Column) -> Column:
    """0.5, and more for each speaker in view and each modality that is there, to 1 at most."""
    steps = F.size(F.array_intersect(speaking, visible)) * SPEAKER_STEP + (has_audio.cast("int") + has_vision.cast("int") + (n_lines > 0).cast("int")) * PRESENCE_STEP
    return F.least(F.lit(1.0), BASE + steps)


def unseen_speakers(speaking: Column, visible: Column) -> Column:
    gone = F.array_except(speaking, visible)
    return F.when(F.size(gone) > 0, F.concat(F.lit(UNSEEN), F.array_join(gone, ","), F.lit(VOICE_OVER))).otherwise("")


def aligned(units: DataFrame, lines: DataFrame, speaker_map: DataFrame) -> DataFrame:
    """The alignment of each fused unit: speaker_to_character, speaking and visible characters, active and dominant modality, confidence to two
    digits, notes. lines: scene_index, pos, speaker, character; a speaker of speaker_map (speaker, mapped) speaks as the mapped character, a line of
    another counts for its own character. If all tables have video_id, scenes and speakers are those of their video."""
    place = joins.place(units, lines, speaker_map)
    key = [*place, "scene_index"]
    bound = speaker_map.where("mapped is not null").select(*place, "speaker", "mapped").dropDuplicates([*place, "speaker"])
    rows = lines.select(*key, "pos", "speaker", "character").join(bound, [*place, "speaker"], "left")
    who = F.coalesce("mapped", F.when(_filled(F.col("character")), F.col("character")))
    told = rows.withColumn("who", who).groupBy(*key).agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("who").isNotNull(), F.struct("pos", "who")))), lambda x: x["who"])).alias("speaking"),
        F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("mapped").isNotNull(), F.concat_ws("=", "speaker", "mapped"))))).alias("_pairs"),
    )
    rows = units.join(told, key, "left").withColumn("speaking", F.coalesce("speaking", F.array().cast("array<string>")))
    n, music = F.size("lines"), F.coalesce("has_music", F.lit(False))
    c = F.col
    return rows.select(
        *key, F.array_join(F.coalesce("_pairs", F.array().cast("array<string>")), ",").alias("speaker_to_character"), c("characters").alias("visible_characters"), c("speaking").alias("speaking_characters"),
        active_modalities(n, c("action"), music, F.coalesce("has_sfx", F.lit(False)), c("silence")).alias("active_modalities"), dominant_modality(n, c("action"), music, c("silence")).alias("dominant_modality"),
        N.half_even(alignment_confidence(c("speaking"), c("characters"), c("has_audio"), c("has_vision"), n), 2).alias("alignment_confidence"), unseen_speakers(c("speaking"), c("characters")).alias("notes"),
    )
