"""Story scenes of beats, and chapters of story scenes, from a model's answers; arcs, relations and roles of characters from others.

One answer speaks of one video. An answer that is no list, is empty or holds an item that doesn't fit counts for nothing: its video gets groups of three children in order. Items that name none of the video's
children are left out.

Defined cases: a video without an answer is one whose answer counts for nothing; of several answers the greatest text counts; an item's own number stands, and one without takes the number of items accepted before it;
a repeated child of an item counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions import text as T
from framelode.functions import variants as V
from framelode.operators import entity, positional, selection

#: Children of a group without an answer; seconds and scenes up to which a video is one chapter, and that chapter's words.
GROUP, SHORT, FEW = 3, 600.0, 3
WHOLE, WHOLE_TEXT, WHOLE_TYPE, NUMBERED = "全篇", "完整视频内容", "act_1", "章节 "
#: What items say besides their children, and the roles of characters.
SCENE = {"location": "text", "description": "text", "characters": "texts", "plot_function": "text"}
CHAPTER = {"title": "text", "description": "text", "chapter_type": "text", "theme": "text", "characters": "texts", "mood_progression": "text"}
ROLES, OTHER = ("male_lead", "female_lead", "villain", "supporting", "minor"), "supporting"
ARC, RELATION = {"arc_type": "text", "arc_description": "text"}, {"relation_type": "text", "description": "text", "strength": "number"}


def _grouped(children: DataFrame, child: str, number: str, lists: tuple[str, ...]) -> DataFrame:
    """Parents (video_id, number, place) of ``children`` that have those columns: times, children, united lists, and the children's durations added up in their order."""
    own = F.array_sort(F.collect_list(F.struct(child, "start_time", "end_time", "duration")))
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
    out = children.groupBy("video_id", number).agg(own.alias("_own"), *united)
    return out.select(
        "video_id", number, F.array_min(F.transform("_own", lambda c: c["start_time"])).alias("start_time"), F.array_max(F.transform("_own", lambda c: c["end_time"])).alias("end_time"),
        F.aggregate("_own", F.lit(0.0), lambda s, c: s + c["duration"]).alias("duration"), F.transform("_own", lambda c: c[child]).alias("_children"), *lists,
    )


def from_answers(children: DataFrame, answers: DataFrame, child: str, parent: str, listed: str, fields: dict[str, str], lists: tuple[str, ...]) -> DataFrame:
    """Parents of the ``children`` (video_id, child, start_time, end_time, duration, lists) by answers (video_id, answer), whose items have ``listed``, the numbers of children, ``parent``, their own, and ``fields``:
    video_id, parent, times, listed (the item's numbers, in order), lists united, fields."""
    whole = lambda x: F.try_variant_get(x, f"$.{listed}", "array<int>")
    read = answers.groupBy("video_id").agg(F.max("answer").alias("answer")).withColumn("_items", F.try_variant_get(T.json_found(F.col("answer")), "$", "array<variant>"))
    numbers = lambda x: V.at(x, listed).isNull() | F.coalesce(F.forall(whole(x), lambda n: n.isNotNull()), F.lit(False))
    fits = F.forall("_items", lambda x: positional.fitting(x, fields) & numbers(x) & (V.at(x, parent).isNull() | V.whole(x, parent).isNotNull()))
    good = read.where((F.size("_items") > 0) & F.coalesce(fits, F.lit(False)))
    items = good.select("video_id", F.posexplode("_items").alias("_place", "_item")).withColumn("_listed", whole(F.col("_item"))).where(F.size("_listed") > 0)
    named = items.select("video_id", "_place", F.explode(F.array_distinct("_listed")).alias(child)).join(children, ["video_id", child])
    made = _grouped(named, child, "_place", lists).join(items, ["video_id", "_place"])
    before = F.row_number().over(Window.partitionBy("video_id").orderBy("_place")) - 1
    made = made.withColumn(parent, F.coalesce(V.whole(F.col("_item"), parent), before).cast("int"))
    told = made.select("video_id", parent, "start_time", "end_time", "duration", F.array_sort("_listed").alias(listed), *lists, *[positional._value(F.col("_item"), f, k) for f, k in fields.items()])
    rest = children.join(good.select("video_id"), "video_id", "left_anti")
    place = F.floor((F.row_number().over(Window.partitionBy("video_id").orderBy(child)) - 1) / GROUP).cast("int")
    groups = _grouped(rest.withColumn(parent, place), child, parent, lists).withColumnRenamed("_children", listed)
    empty = [(F.array().cast("array<string>") if k == "texts" else F.lit("")).alias(f) for f, k in fields.items()]
    return told.unionByName(groups.select("video_id", parent, "start_time", "end_time", "duration", listed, *lists, *empty))


def story_scenes(beats: DataFrame, answers: DataFrame) -> DataFrame:
    """Story scenes of beats (video_id, beat_index, start_time, end_time, duration, shot_indices)."""
    return from_answers(beats, answers, "beat_index", "story_scene_index", "beat_indices", SCENE, ("shot_indices",))


def chapters(scenes: DataFrame, answers: DataFrame, videos: DataFrame) -> DataFrame:
    """Chapters of story scenes (video_id, story_scene_index, start_time, end_time, duration, beat_indices, shot_indices, characters). A video (video_id, duration) below ten minutes, or of three scenes or
    fewer, is one chapter whatever is answered; one whose answer names no scene has groups, as one without an answer."""
    n = scenes.groupBy("video_id").agg(F.count("*").alias("_n"))
    single = n.join(videos.select("video_id", F.col("duration").alias("_length")), "video_id", "left").where((F.col("_length") < SHORT) | (F.col("_n") <= FEW)).select("video_id")
    lists = ("beat_indices", "shot_indices")
    many = scenes.join(single, "video_id", "left_anti")
    cast = many.withColumnRenamed("characters", "_cast")
    known = many.select("video_id", "story_scene_index").distinct()
    # an answer of which no item names a scene is none
    items = F.try_variant_get(T.json_found(F.col("answer")), "$", "array<variant>")
    named = answers.select("video_id", F.explode(items).alias("x")).select("video_id", F.explode(F.try_variant_get("x", "$.story_scene_indices", "array<int>")).alias("story_scene_index")).join(known, ["video_id", "story_scene_index"], "left_semi")
    heard = answers.join(named.select("video_id").distinct(), "video_id", "left_semi")
    told = from_answers(cast, heard, "story_scene_index", "chapter_index", "story_scene_indices", CHAPTER, (*lists, "_cast"))
    grouped = told.join(heard.select("video_id").distinct().withColumn("_heard", F.lit(True)), "video_id", "left")
    bare = F.col("_heard").isNull()
    told = grouped.withColumn("title", F.when(bare, F.concat(F.lit(NUMBERED), F.col("chapter_index") + 1)).otherwise(F.col("title"))).withColumn("characters", F.when(bare, F.col("_cast")).otherwise(F.col("characters"))).drop("_cast", "_heard")
    one = _grouped(scenes.join(single, "video_id", "left_semi").withColumn("chapter_index", F.lit(0)), "story_scene_index", "chapter_index", (*lists, "characters"))
    one = one.withColumn("duration", F.col("end_time") - F.col("start_time")).withColumnRenamed("_children", "story_scene_indices")
    words = {"title": WHOLE, "description": WHOLE_TEXT, "chapter_type": WHOLE_TYPE, "theme": "", "mood_progression": ""}
    return told.unionByName(one.withColumns({c: F.lit(w) for c, w in words.items()}).select(*told.columns))


def _items(answers: DataFrame, path: str) -> DataFrame:
    read = answers.groupBy("video_id").agg(F.max("answer").alias("answer")).withColumn("_v", V.read_object(F.col("answer")))
    return read.select("video_id", F.explode(V.objects(F.col("_v"), path)).alias("x")).select("video_id", F.col("x.place").alias("place"), F.col("x.item").alias("item"))


def arcs(answers: DataFrame, characters: DataFrame) -> DataFrame:
    """video_id, character_id, arc_type ("flat" where an item has none), arc_description and key_moments of the characters (video_id, character) of whom an answer tells; the last item of one counts."""
    rows = _items(answers, "arcs").withColumn("character_id", F.coalesce(V.raw_text(F.col("item"), "character_id"), F.lit(""))).where(positional.fitting(F.col("item"), ARC))
    item = F.col("item")
    moments = F.filter(F.coalesce(F.try_variant_get(item, "$.key_moments", "array<int>"), F.array().cast("array<int>")), lambda n: n.isNotNull())
    last = rows.groupBy("video_id", "character_id").agg(F.max_by("item", "place").alias("item"))
    out = last.select("video_id", "character_id", F.coalesce(V.raw_text(item, "arc_type"), F.lit("flat")).alias("arc_type"), V.text(item, "arc_description").alias("arc_description"), moments.alias("key_moments"))
    return out.join(characters.select("video_id", F.col("character").alias("character_id")).distinct(), ["video_id", "character_id"], "left_semi")


def relations(answers: DataFrame, characters: DataFrame, appearances: DataFrame) -> DataFrame:
    """Relations that answers tell between characters (video_id, character) that are known and, where a video has others, not temporary: character_a, character_b, place, relation_type ("stranger" where an item has
    none), description, strength (0.5) and the shots of ``appearances`` (video_id, character, shot) that both are in."""
    item = F.col("item")
    rows = _items(answers, "relations").where(positional.fitting(item, RELATION))
    strength = F.when(V.at(item, "strength").isNull(), 0.5).otherwise(V.number(item, "strength"))
    told = rows.select("video_id", V.raw_text(item, "character_a").alias("character_a"), V.raw_text(item, "character_b").alias("character_b"), "place", F.coalesce(V.raw_text(item, "relation_type"), F.lit("stranger")).alias("relation_type"), F.coalesce(V.raw_text(item, "description"), F.lit("")).alias("description"), strength.alias("strength"))
    return selection.relation_graph(told, characters, appearances)


def roles(screen: DataFrame, answers: DataFrame) -> DataFrame:
    """``screen`` (video_id, character, screen_cs) with ``role``: what the answer, an object of characters, says if it is a role, "supporting" else; the fallback by screen time where no answer can be read."""
    of = F.try_variant_get(F.col("_v"), "$", "map<string, variant>")
    read = answers.groupBy("video_id").agg(F.max("answer").alias("answer")).withColumn("_v", V.read_object(F.col("answer"))).where("_v is not null").select("video_id", F.transform_values(of, lambda _, v: F.when(V.kind(v) == "STRING", F.try_variant_get(v, "$", "string"))).alias("_roles"))
    rows = entity.roles(screen).withColumnRenamed("role", "_fallback").join(read, "video_id", "left")
    told = F.try_element_at("_roles", F.col("character").cast("string"))
    role: Column = F.when(F.col("_roles").isNull(), F.col("_fallback")).when(told.isin(*ROLES), told).otherwise(OTHER)
    return rows.withColumn("role", role).drop("_roles", "_fallback")
