"""Inverted indexes over units, signals, events and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions import text as T
from framelode.functions import vector as V
from framelode.operators import entity, joins, temporal

#: The signals by which units are ranked.
SIGNALS = ("hook_score", "plot_importance", "emotional_intensity", "visual_impact", "independence_score", "boundary_quality")
#: Centiseconds of a bin in which times are joined.
BIN = 6000


def text_index(shots: DataFrame, units: DataFrame, transcripts: DataFrame, vision: DataFrame, events: DataFrame, characters: DataFrame) -> DataFrame:
    """An entry for each shot (scene_index, start_cs, end_cs and, where they have them, beat_index and story_scene_index): the text, transcript, description and characters of its unit (scene_index, combined_text,
    transcript, vision_description, characters), and for a shot without one what stands in the tables: the lines (start_cs, text) that begin in its time,
    its view (scene_index, description, mood), the events (event_id, start_cs, end_cs, description) that overlap it, and who (display_name, scene_index) is in it.
    With the shot's times and parents, the mood and scene_type of its view (the first by pos, where views have one), the events that overlap it in order, and the keywords of the text. If all tables have video_id, scenes
    are those of their video."""
    place = joins.place(shots, units, transcripts, vision, events, characters)
    key = [*place, "scene_index"]
    span = shots.select(*key, F.col("start_cs").alias("l_start"), F.col("end_cs").alias("l_end"))
    bare = shots.join(units.select(*key), key, "left_anti").select(*key)
    within = place[0] if place else "_v"
    of = lambda rows: rows if place else rows.withColumn("_v", F.lit(0))
    points = transcripts.select(*place, F.col("start_cs").alias("r_start"), (F.col("start_cs") + 1).alias("r_end"), "text")
    ordered = lambda at, of: F.transform(F.array_sort(F.collect_list(F.struct(at, of))), lambda x: x[of])
    said = temporal.overlapping(of(span.join(bare, key, "left_semi")), of(points), within, BIN).where("r_start >= l_start and r_start < l_end").groupBy(*key).agg(F.array_join(ordered("r_start", "text"), " ").alias("_said"))
    spans = events.select(*place, F.col("start_cs").alias("r_start"), F.col("end_cs").alias("r_end"), "event_id", "description")
    happens = temporal.overlapping(of(span), of(spans), within, BIN).groupBy(*key).agg(ordered("event_id", "description").alias("_events"), F.array_sort(F.collect_list("event_id")).alias("event_ids"))
    first = joins.keep(vision, key, ["pos" if "pos" in vision.columns else "description"], last=False)
    view = first.select(*key, F.col("description").alias("_view"), F.col("mood").alias("_mood"), (F.col("scene_type") if "scene_type" in vision.columns else F.lit(None).cast("string")).alias("_type"))
    who = characters.groupBy(*key).agg(F.array_sort(F.collect_set("display_name")).alias("_who"))
    rows = bare
    for side in (said, happens, view, who):
        rows = rows.join(side, key, "left")
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    none = F.array().cast("array<string>")
    collected = rows.select(
        *key, F.concat_ws(" ", filled("_said"), filled("_view"), filled("_mood"), F.coalesce("_events", none)).alias("combined_text"),
        F.coalesce("_said", F.lit("")).alias("transcript"), F.coalesce("_view", F.lit("")).alias("vision_description"), F.coalesce("_who", none).alias("characters"),
    )
    known = shots.select(*key).join(units.select(*collected.columns), key)
    parents = [F.col(c) if c in shots.columns else F.lit(None).cast("int").alias(c) for c in ("beat_index", "story_scene_index")]
    own = shots.select(*key, "start_cs", "end_cs", *parents)
    out = known.select(*collected.columns).union(collected).join(own, key).join(view.select(*key, "_mood", "_type"), key, "left").join(happens.select(*key, "event_ids"), key, "left")
    ids = F.coalesce("event_ids", F.array().cast(happens.schema["event_ids"].dataType)).alias("event_ids")
    return out.select(*collected.columns, "start_cs", "end_cs", F.coalesce("_mood", F.lit("")).alias("mood"), F.coalesce("_type", F.lit("")).alias("scene_type"), ids, "beat_index", "story_scene_index").withColumn("keywords", T.keywords(F.col("combined_text")))


def vector_index(units: DataFrame, embedded: DataFrame) -> DataFrame:
    """Units (scene_index, combined_text) whose text is not blank, with the unit vector of their embedding (scene_index, embedding); no rows
    if all texts are blank."""
    rows = units.where(F.trim("combined_text") != "").join(embedded.where("embedding is not null"), "scene_index")
    return rows.select("scene_index", V.unit(F.col("embedding").cast("array<double>")).alias("embedding"))


def relation_index(relations: DataFrame) -> DataFrame:
    """relations (character_a, character_b, pos, ...) by their key "a|b"; of several of one pair the last counts."""
    return joins.keep(relations, ["character_a", "character_b"], ["pos"]).withColumn("relation_key", F.concat_ws("|", "character_a", "character_b")).drop("pos")


def chapter_index(chapters: DataFrame) -> DataFrame:
    """chapters by the text of their number; of several of one number the last by start counts."""
    return joins.keep(chapters, ["chapter_index"], ["start_cs"]).withColumn("chapter_key", F.col("chapter_index").cast("string"))


def character_units(characters: DataFrame, units: DataFrame) -> DataFrame:
    """(character, unit_index) where a unit (unit_index, cast, shot_ids) lists the character or holds a shot that they are in; each pair once. Rows are dealt to as many tasks as their number asks for."""
    rows = characters.select("character", "shot").where("character is not null and shot is not null")
    tasks = entity.tasks_for(rows.sparkSession, rows.count())
    named = units.select("unit_index", F.explode("cast").alias("character")).repartition(tasks, "character").join(characters.select("character").distinct(), "character", "left_semi")
    at = units.select("unit_index", F.explode("shot_ids").alias("shot")).repartition(tasks, "shot")
    seen = rows.repartition(tasks, "shot").distinct().join(at, "shot")
    return named.select("character", "unit_index").union(seen.select("character", "unit_index")).repartition(2 * tasks, "unit_index").distinct()


def events_by_type(events: DataFrame) -> DataFrame:
    """event_type and its events, the most important first, then in order of event_id. The lists are of one video and type."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("less"), "event_id")))
    return events.groupBy("video_id", "event_type").agg(F.transform(rows, lambda x: x["event_id"]).alias("event_ids"))


def emotions(*sources: DataFrame) -> DataFrame:
    """(emotion, source, ref, intensity) of all sources under their lower-cased emotion; blank ones are left out."""
    out = None
    for rows in sources:
        rows = rows.select(F.lower(F.trim("emotion")).alias("emotion"), "source", "ref", "intensity").where("emotion <> ''")
        out = rows if out is None else out.unionByName(rows)
    return out


def top_signals(signals: DataFrame, names: list[str], n: int = 20, least: float = 0.3) -> DataFrame:
    """The n units with the highest score of each signal, ties to the smaller unit, then only those above ``least``."""
    each = signals.select("unit_index", F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("score")) for c in names])).alias("s")).select("unit_index", "s.*")
    order = Window.partitionBy("signal").orderBy(F.desc("score"), "unit_index")
    return each.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= n) & (F.col("score") > least))


def by_tag(rows: DataFrame, tags: Column, ref: str) -> DataFrame:
    """(tag, ref) for each tag of each row."""
    return rows.select(F.explode(tags).alias("tag"), ref)


def audio_tags(has_music: Column, music_mood: Column, has_sfx: Column, sfx: Column, silence: Column, emotion: Column, silent: float = 0.7) -> Column:
    """The tags of a shot's sound: music under its mood, "unknown" without one, effects, silence, the emotion of speech."""
    mood = F.coalesce(F.nullif(music_mood, F.lit("")), F.lit("unknown"))
    music = F.when(has_music, F.concat(F.lit("music:"), mood))
    effects = F.when(has_sfx, F.transform(F.coalesce(sfx, F.array().cast("array<string>")), lambda s: F.concat(F.lit("sfx:"), s))).otherwise(F.array().cast("array<string>"))
    rest = F.array_compact(F.array(F.when(silence > silent, F.lit("silence")), F.when(F.coalesce(emotion, F.lit("")) != "", F.concat(F.lit("speech_emotion:"), emotion))))
    return F.concat(F.array_compact(F.array(music)), effects, rest)
