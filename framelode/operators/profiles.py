"""Profiles of characters, folded from what the answers about a video's chunks say in their order.

A character that the galleries know is there from the start. One that an answer calls unknown_N enters with that answer, under an id in the scope of its chunk; another enters
with the first update that names it, whose action does not count. A suggested merge counts if both are known once its chunk's updates are in. The batch form is one aggregation a character
and two equi-joins for the suggestions; ``streaming/chunk_profiles.py`` folds the same chunk by chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelode.functions import lists
from framelode.functions import text as T
from framelode.operators import shared

#: Fixed value: the description of somebody whom no gallery knows.
TEMPORARY = "临时标注人物（无脸谱匹配）"

PROFILE = (
    "names array<string>, description string, appearance_changes array<struct<chunk_idx: int, description: string>>, key_actions array<struct<chunk_idx: int, action: string>>, "
    "tier string, is_human boolean, entity_type string, gallery_ref string, merge_suggestions array<struct<duplicate_id: string, reason: string, confidence: double, chunk_index: int>>"
)


def known_from(galleries: DataFrame, mentions: DataFrame) -> DataFrame:
    """video_id, character_id and ``first``, the chunk with whose answer it is known, -1 for those of ``galleries`` (video_id, character_id, tier)."""
    there = galleries.where("tier <> 'passerby'").select("video_id", "character_id", F.lit(-1).alias("first"))
    return there.union(mentions.select("video_id", "character_id", "chunk_index")).groupBy("video_id", "character_id").agg(F.min("first").alias("first"))


def accepted(suggestions: DataFrame, known: DataFrame) -> DataFrame:
    """The ``suggestions`` both of whose ids were known with their chunk."""
    rows = suggestions
    for end in ("primary", "duplicate"):
        own = known.select("video_id", F.col("character_id").alias(end), F.col("first").alias(f"_{end}"))
        rows = rows.join(own, ["video_id", end]).where(F.col(f"_{end}") <= F.col("chunk_index"))
    return rows.select(*suggestions.columns)


def folded(galleries: DataFrame, mentions: DataFrame, suggestions: DataFrame) -> DataFrame:
    """video_id, character_id and the columns of ``PROFILE`` from ``mentions`` and ``suggestions`` as ``operators/chunk_answers.py`` gives them."""
    key = ["video_id", "character_id"]
    mentions = shared.written(mentions, "mentions")
    told = mentions.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "phase", "place", "raw", "names", "change", "action"))).alias("told"))
    there = galleries.where("tier <> 'passerby'").groupBy(*key).agg(F.min("tier").alias("gallery_tier"))
    rows = there.join(told, key, "full").withColumn("told", F.coalesce("told", F.array().cast(told.schema["told"].dataType)))
    rows = rows.join(_suggested(accepted(suggestions, known_from(galleries, mentions))), key, "left")
    gallery, first = F.col("gallery_tier").isNotNull(), F.get("told", F.lit(0))
    temporary = ~gallery & first["raw"].isNotNull()
    made = ~gallery & first["raw"].isNull()  # by an update
    good = lambda texts: F.filter(texts, lambda n: ~T.is_placeholder(n))
    names = F.array_distinct(F.concat(F.when(temporary, F.array(first["raw"])).otherwise(F.array().cast("array<string>")), F.flatten(F.transform("told", lambda m: good(m["names"])))))
    changes = F.filter("told", lambda m: m["change"] != "")
    says = F.filter(changes, lambda m: ~T.is_placeholder(m["change"]))
    acts = F.filter(F.slice("told", F.when(made, 2).otherwise(1), F.size("told")), lambda m: ~T.is_placeholder(m["action"]))
    other = made & F.col("character_id").startswith("entity_")
    return rows.select(
        *key, names.alias("names"), F.coalesce(F.try_element_at(says, F.lit(-1))["change"], F.when(temporary, TEMPORARY).otherwise("")).alias("description"),
        F.transform(changes, lambda m: F.struct(m["chunk_index"].alias("chunk_idx"), m["change"].alias("description"))).alias("appearance_changes"),
        F.transform(acts, lambda m: F.struct(m["chunk_index"].alias("chunk_idx"), m["action"].alias("action"))).alias("key_actions"),
        F.coalesce("gallery_tier", F.lit("minor")).alias("tier"), (~other).alias("is_human"), F.when(other, "other").otherwise("human").alias("entity_type"), F.when(gallery, F.col("character_id")).otherwise("").alias("gallery_ref"),
        F.coalesce("merge_suggestions", F.array().cast("array<struct<duplicate_id: string, reason: string, confidence: double, chunk_index: int>>")).alias("merge_suggestions"),
    )


def _suggested(rows: DataFrame) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("chunk_index", "place", "duplicate", "reason", "confidence")))
    shown = F.transform(own, lambda s: F.struct(s["duplicate"].alias("duplicate_id"), s["reason"], s["confidence"], s["chunk_index"]))
    return rows.groupBy("video_id", F.col("primary").alias("character_id")).agg(shown.alias("merge_suggestions"))


def lines(profiles: DataFrame, galleries: DataFrame, chunk_index: Column | None = None) -> DataFrame:
    """video_id and ``lines``: what a chunk's prompt says of each known character of its galleries: name, description, the last two changes and the last three actions that say
    something. Before chunk ``chunk_index`` where that is given, a column of ``profiles``."""
    recent = lambda c, field, n: F.array_join(lists.last_valid(F.transform(c, lambda x: x[field]), n), "; ")
    before = lambda c: c if chunk_index is None else F.filter(c, lambda x: x["chunk_idx"] < chunk_index)
    changes, actions = recent(before(F.col("appearance_changes")), "description", 2), recent(before(F.col("key_actions")), "action", 3)
    extra = F.concat(F.when(changes != "", F.concat(F.lit(" | 近期外观变化: "), changes)).otherwise(""), F.when(actions != "", F.concat(F.lit(" | 近期行为: "), actions)).otherwise(""))
    name = F.coalesce(F.get("names", F.lit(0)), F.col("character_id"))
    shown = F.concat(F.lit("- "), "character_id", F.lit(" ("), name, F.lit("): "), F.coalesce(F.nullif(F.col("description"), F.lit("")), F.lit("（暂无描述）")), extra)
    rows = profiles.join(galleries.where("tier <> 'passerby'").select("video_id", "character_id").distinct(), ["video_id", "character_id"], "left_semi")
    return rows.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("character_id", shown.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def context(profiles: DataFrame) -> DataFrame:
    """video_id, character_id, ``description``, the profile's own or, if that says nothing, its last change that does, and ``lines``: up to five names, the last four changes and the last six actions that say something."""
    told = lambda c, field, n: lists.last_valid(F.transform(c, lambda x: x[field]), n)
    line = lambda label, values, between: F.when(F.size(values) > 0, F.concat(F.lit(f"  {label}: "), F.array_join(values, between)))
    names, changes = F.slice("names", 1, 5), told("appearance_changes", "description", 4)
    lines = F.concat_ws("\n", line("档案称呼/别名", names, ", "), line("有效外观线索", changes, "; "), line("关键行为线索", told("key_actions", "action", 6), "; "))
    own = F.when(T.is_placeholder(F.col("description")), F.coalesce(F.try_element_at(changes, F.lit(-1)), F.lit(""))).otherwise(F.trim("description"))
    return profiles.select("video_id", "character_id", own.alias("description"), lines.alias("lines"))


def votes(profiles: DataFrame) -> DataFrame:
    """video_id, primary, duplicate, chunk and confidence of each suggestion that counts, for ``entity.confirmed_merges``."""
    rows = profiles.select("video_id", F.col("character_id").alias("primary"), F.explode("merge_suggestions").alias("s"))
    return rows.select("video_id", "primary", F.col("s.duplicate_id").alias("duplicate"), F.col("s.chunk_index").alias("chunk"), F.col("s.confidence").alias("confidence"))


def characters(profiles: DataFrame, merged: DataFrame, alignments: DataFrame, galleries: DataFrame, shots: DataFrame) -> DataFrame:
    """The characters that profiles, which are not merged into others, stand for: display_name, description, the scenes in which they or those merged into them are seen by alignments or galleries
    (appearance_scenes), total_screen_time, first and last appearance by the times of ``shots``, to a tenth. merged: video_id, id, canonical."""
    from framelode.functions import numbers as N

    key = ["video_id", "character_id"]
    seen = alignments.select("video_id", F.explode("visible_characters").alias("character_id"), "scene_index").union(galleries.select("video_id", "character_id", F.explode("appearance_scenes").alias("scene_index")))
    names = merged.select("video_id", F.col("id").alias("character_id"), "canonical").dropDuplicates(key)
    seen = seen.join(names, key, "left").select("video_id", F.coalesce("canonical", "character_id").alias("character_id"), "scene_index").distinct()
    timed = seen.join(shots.select("video_id", "scene_index", "start_time", "end_time"), ["video_id", "scene_index"], "left")
    # a plain sum, in order of scenes
    spans = F.array_sort(F.collect_list(F.struct("scene_index", "start_time", "end_time")))
    own = timed.groupBy(*key).agg(spans.alias("spans"))
    real = F.filter("spans", lambda s: s["start_time"].isNotNull())
    whole = F.aggregate(real, F.lit(0.0), lambda a, s: a + (s["end_time"] - s["start_time"]))
    rows = profiles.join(names.select(*key), key, "left_anti").join(own, key, "left").withColumn("spans", F.coalesce("spans", F.array().cast(own.schema["spans"].dataType)))
    tenth = lambda c: N.half_even(F.coalesce(c, F.lit(0.0)), 1)
    return rows.select(
        *key, F.coalesce(F.get("names", F.lit(0)), F.col("character_id")).alias("display_name"), "description", F.transform("spans", lambda s: s["scene_index"]).alias("appearance_scenes"), tenth(whole).alias("total_screen_time"),
        tenth(F.array_min(F.transform(real, lambda s: s["start_time"]))).alias("first_appearance"), tenth(F.array_max(F.transform(real, lambda s: s["end_time"]))).alias("last_appearance"),
    )
