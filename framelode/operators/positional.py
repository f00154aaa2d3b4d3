"""Answers by position: units go to a model in batches of their order, and the items of its answer are those of the batch in that order.

An answer longer than its batch is cut, a shorter one leaves the last units without an item. An item that doesn't fit ends its answer: those before it count, it and those behind it don't. An answer that
is no list counts for nothing; its units may be asked for again one by one. A batch is one row while its answer is read: no window, no join by position across rows.

Defined cases: units without an answer, and those of an answer without a list or with an empty one, have no item; repeated answers of one batch count once, the greatest text; answers for batches that don't exist are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions import text as T
from framelode.functions import variants as V

#: Units of a batch, and the fields of an item with their kinds.
SIGNAL_BATCH, RECOMPOSITION_BATCH = 15, 10
EDIT = {c: "number" for c in ("hook_score", "plot_importance", "emotional_intensity", "visual_impact", "independence_score", "continuity_dependency", "boundary_quality", "spoiler_level")} | {"suggested_usage": "texts"}
NARRATIVE = {c: "number" for c in ("arc_position", "tension_level", "information_density", "theme_relevance")} | {"character_focus": "text", "narrative_function": "text"}
RECOMPOSITION = {c: "number" for c in ("meme_potential", "emotional_quotability", "context_freedom", "remix_flexibility")} | {"platform_fit": "shares", "suggested_formats": "texts"}
VIEW = {c: "text" for c in ("description", "mood", "scene_type", "camera_motion", "interaction_description", "shot_scale")} | {c: "texts" for c in ("objects", "props", "ocr_texts")}
#: Which beats may be used again, or how many of the first if none may.
REUSABLE, REUSABLE_INTENSITY, FIRST_BEATS = ("confrontation", "resolution"), 0.5, 10

_TYPES = {"number": "double", "text": "string", "texts": "array<string>", "shares": "map<string, double>"}


def batched(units: DataFrame, size: int, scope: tuple[str, ...] = ("video_id",), order: tuple[str, ...] = ("unit_index",)) -> DataFrame:
    """``units`` with their ``batch`` within the scope and their ``place`` in it, from 0."""
    n = F.row_number().over(Window.partitionBy(*scope).orderBy(*order)) - 1
    return units.withColumns({"batch": F.floor(n / size).cast("int"), "place": (n % size).cast("int")})


def _fits(item: Column, field: str, kind: str) -> Column:
    value = V.at(item, field)
    told = F.try_variant_get(item, f"$.{field}", _TYPES[kind])
    if kind == "number":
        good = told.isNotNull()
    elif kind == "text":
        good = V.kind(value) == "STRING"
    elif kind == "texts":
        good = F.coalesce(F.forall(F.try_variant_get(item, f"$.{field}", "array<variant>"), lambda x: V.kind(x) == "STRING"), F.lit(False))
    else:
        good = (V.kind(value) == "OBJECT") & told.isNotNull() & F.coalesce(F.forall(F.map_values(told), lambda x: x.isNotNull()), F.lit(False))
    return value.isNull() | F.coalesce(good, F.lit(False))


def _value(item: Column, field: str, kind: str) -> Column:
    none = {"number": F.lit(0.0), "text": F.lit(""), "texts": F.array().cast("array<string>"), "shares": F.create_map().cast("map<string, double>")}[kind]
    return F.coalesce(F.try_variant_get(item, f"$.{field}", _TYPES[kind]), none).alias(field)


def fitting(item: Column, fields: dict[str, str]) -> Column:
    """Whether an item is an object whose fields, where it has them, are of their kinds."""
    out = F.coalesce(V.kind(item) == "OBJECT", F.lit(False))
    for field, kind in fields.items():
        out = out & _fits(item, field, kind)
    return out


def zipped(units: DataFrame, answers: DataFrame, fields: dict[str, str], scope: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """``units`` (scope, batch, place, ...) with ``heard``, whether their batch's answer (scope, batch, answer) is a list with items, ``told``, whether one is theirs, and its fields, empty where none is."""
    key = [*scope, "batch"]
    items = F.try_variant_get(T.json_found(F.col("answer")), "$", "array<variant>")
    read = answers.groupBy(*key).agg(F.max("answer").alias("answer")).select(*key, F.coalesce(items, F.array().cast("array<variant>")).alias("_items"))
    bad = F.array_position(F.transform("_items", lambda x: ~fitting(x, fields)), True)
    read = read.withColumn("_n", F.when(bad > 0, bad - 1).otherwise(F.size("_items")))
    rows = units.join(read, key, "left").withColumn("_item", F.when(F.col("place") < F.col("_n"), F.get("_items", F.col("place"))))
    heard = F.coalesce(F.size("_items") > 0, F.lit(False))
    return rows.select(*units.columns, heard.alias("heard"), F.col("_item").isNotNull().alias("told"), *[_value(F.col("_item"), f, k) for f, k in fields.items()])


def signals(units: DataFrame, answers: DataFrame, fields: dict[str, str], size: int = SIGNAL_BATCH, scope: tuple[str, ...] = ("video_id", "unit_type"), order: tuple[str, ...] = ("unit_index",)) -> DataFrame:
    """The signals of units (video_id, unit_type, unit_index, start_time, end_time) that an answer (scope, batch, answer) tells; the others have none."""
    found = zipped(batched(units, size, scope, order), answers, fields, scope)
    return found.where("told").select("video_id", "unit_type", "unit_index", "start_time", "end_time", *fields)


def reusable_beats(beats: DataFrame) -> DataFrame:
    """The beats (video_id, beat_index, intensity, beat_type) of some intensity or of a kind that is used again; a video's first ten if it has no such."""
    of = Window.partitionBy("video_id")
    good = F.coalesce((F.col("intensity") >= REUSABLE_INTENSITY) | F.col("beat_type").isin(*REUSABLE), F.lit(False))
    rows = beats.withColumns({"_good": good, "_any": F.max(good).over(of), "_n": F.row_number().over(of.orderBy("beat_index"))})
    return rows.where(F.col("_good") | (~F.col("_any") & (F.col("_n") <= FIRST_BEATS))).drop("_good", "_any", "_n")


def to_ask_again(found: DataFrame) -> DataFrame:
    """The units of ``zipped`` whose batch's answer was no list, which are asked for one by one; units that a short answer leaves out are not."""
    return found.where(~F.col("heard"))


def completed(found: DataFrame, singles: DataFrame, fields: dict[str, str], key: tuple[str, ...], scope: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """``zipped`` with the units that were asked for again (singles: key, answer, one object each). If one of a batch's units gives no object that fits, none of the batch is told."""
    read = singles.groupBy(*key).agg(F.max("answer").alias("answer")).select(*key, V.read_object(F.col("answer")).alias("_item"))
    read = read.withColumn("_item", F.when(fitting(F.col("_item"), fields), F.col("_item")))
    again = to_ask_again(found).drop("told", *fields).join(read, list(key), "left")
    whole = F.min(F.col("_item").isNotNull()).over(Window.partitionBy(*scope, "batch"))
    again = again.withColumn("told", whole).withColumn("_item", F.when(F.col("told"), F.col("_item")))
    again = again.select(*[c for c in found.columns if c not in fields and c != "told"], "told", *[_value(F.col("_item"), f, k) for f, k in fields.items()])
    return found.where("heard").unionByName(again)
