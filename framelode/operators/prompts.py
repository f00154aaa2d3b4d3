"""Lines that tell a model about shots, beats, scenes, events, characters and candidates. A line is a column; a prompt joins a video's lines in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelode.functions import text as T
from framelode.operators import fusion as U

#: The words of the lines, and what stands for none.
RELEVANCE, MODALITIES, BEFORE, AFTER, EVIDENCE, WEIGHT = "相关度", "命中模态", "前文", "后文", "证据", "重要性"
NO_LINES, NO_VIEWS, NO_CHARACTERS, NO_CANDIDATES, NO_EVENTS = "（无台词）", "（无画面摘要）", "（未识别人物）", "（无候选片段）", "（无事件信息）"
#: How many lines of a kind a prompt has at most.
MOST_LINES, MOST_VIEWS, MOST_CANDIDATES = 100, 50, 20


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _span(start: str = "start_time", end: str = "end_time") -> Column:
    return F.format_string("[%.1fs-%.1fs]", F.col(start).cast("double"), F.col(end).cast("double"))


def shot_line() -> Column:
    """Of scene_index, start_time, end_time, lines (array<struct<speaker, text>> in order), has_vision, description, mood, scene_type: three lines of 50
    characters under the first one's speaker, 60 characters of the description."""
    said = F.array_join(F.transform(F.slice("lines", 1, 3), lambda x: T.prefix(x["text"], 50)), " ")
    speaker = F.coalesce(F.nullif(F.try_element_at("lines", F.lit(1))["speaker"], F.lit("")), F.lit("?"))
    return F.concat_ws(
        U.SEPARATOR, F.concat(F.lit("Shot "), F.col("scene_index"), F.lit(" "), _span()), F.when(F.size("lines") > 0, F.concat(F.lit(f"{U.LINES}["), speaker, F.lit("]: "), said)),
        F.when(F.col("has_vision"), F.concat(F.lit(f"{U.VIEW}: "), T.prefix(_text("description"), 60))), U._named(U.MOOD, F.when(F.col("has_vision"), F.col("mood"))), U._named(U.KIND, F.when(F.col("has_vision"), F.col("scene_type"))),
    )


def beat_line() -> Column:
    """Of beat_index, start_time, end_time, beat_type, description, emotion, characters."""
    c = F.col
    return F.concat_ws(U.SEPARATOR, F.concat(F.lit("Beat "), c("beat_index"), F.lit(" "), _span()), F.concat(F.lit(f"{U.KIND}: "), _text("beat_type")), U._named(U.CONTENT, c("description")), U._named(U.MOOD, c("emotion")), U._listed(U.WHO, c("characters")))


def scene_line() -> Column:
    """Of story_scene_index, start_time, end_time, location, plot_function, description (80 characters), characters (five)."""
    c = F.col
    return F.concat_ws(
        U.SEPARATOR, F.concat(F.lit("StoryScene "), c("story_scene_index"), F.lit(" "), _span()), U._named(U.PLACE, c("location")), U._named(U.FUNCTION, c("plot_function")), U._named(U.CONTENT, T.prefix(c("description"), 80)), U._listed(U.WHO, c("characters"), 5)
    )


def transcript_line() -> Column:
    """Of start_time, end_time, speaker, text."""
    speaker = F.when(_text("speaker") != "", F.concat(F.lit("["), "speaker", F.lit("]"))).otherwise("")
    return F.concat(_span(), F.lit(" "), speaker, F.lit(" "), _text("text"))


def view_line() -> Column:
    """Of timestamp, scene_type, mood, description."""
    return F.concat(F.format_string("[%.1fs]", F.col("timestamp").cast("double")), F.lit(" ["), _text("scene_type"), F.lit("] ["), _text("mood"), F.lit("] "), _text("description"))


def event_line() -> Column:
    """Of start_time, end_time, event_type, importance, emotion, scene_indices, description (60 characters)."""
    shown = F.array_join(F.col("scene_indices").cast("array<string>"), ",")
    scenes = F.when(F.size(F.coalesce("scene_indices", F.array())) > 0, F.concat(F.lit(" [scenes: "), shown, F.lit("]"))).otherwise("")
    return F.concat(F.lit("  "), _span(), F.lit(" ["), _text("event_type"), F.lit(f"] [{WEIGHT}:"), _text("importance"), F.lit("] ["), _text("emotion"), F.lit("]"), scenes, F.lit(" "), T.prefix(_text("description"), 60))


def character_line() -> Column:
    """Of character, display_name, role, speaker_ids, description, shots (array), total_screen_time."""
    role = F.when(_text("role") != "", F.concat(F.lit(" ["), "role", F.lit("]"))).otherwise("")
    speakers = F.when(F.size(F.coalesce("speaker_ids", F.array())) > 0, F.concat(F.lit(" (speakers: "), F.array_join("speaker_ids", ", "), F.lit(")"))).otherwise("")
    count = F.greatest(F.size(F.coalesce("shots", F.array())), F.lit(0)).cast("string")
    time = F.format_string("%.1f", F.col("total_screen_time").cast("double"))
    return F.concat(F.lit("- "), _text("character"), F.lit(" ("), _text("display_name"), F.lit(")"), role, speakers, F.lit(": "), _text("description"), F.lit(", 出场 "), count, F.lit(" 个镜头, 总时长 "), time, F.lit("s"))


def candidate_line() -> Column:
    """Of a found scene: index, scene_index, start_time, end_time, score, modalities, transcript, vision, context_before, context_after, refs."""
    c = F.col
    seconds = F.format_string("[%.1fs-%.1fs, %.1fs]", c("start_time").cast("double"), c("end_time").cast("double"), (c("end_time") - c("start_time")).cast("double"))
    part = lambda label, column, n: F.when(_text(column) != "", F.concat(F.lit(f"    {label}: "), T.prefix(_text(column), n)))
    return F.concat_ws(
        "\n", F.concat(F.lit("  ["), c("index"), F.lit("] Scene "), c("scene_index"), F.lit(" "), seconds), F.concat(F.format_string(f"    {RELEVANCE}=%.2f", c("score").cast("double")), F.lit(f", {MODALITIES}: "), F.array_join("modalities", ", ")),
        part(U.LINES, "transcript", 100), part(U.VIEW, "vision", 100), part(BEFORE, "context_before", 60), part(AFTER, "context_after", 60), F.when(F.size("refs") > 0, F.concat(F.lit(f"    {EVIDENCE}: "), F.array_join(F.slice("refs", 1, 3), ", "))),
    )


def prompt_of(rows: DataFrame, key: str, order: str, line: Column, most: int | None = None, none: str = "") -> DataFrame:
    """(key, lines): each key's lines in order, the first ``most`` of them, joined by line ends; ``none`` where there are none."""
    every = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("_line").alias("line")))), lambda x: x["line"])
    out = rows.withColumn("_line", line).groupBy(key).agg(every.alias("_every"))
    shown = F.array_join("_every" if most is None else F.slice("_every", 1, most), "\n")
    return out.select(key, F.coalesce(F.nullif(shown, F.lit("")), F.lit(none)).alias("lines"))
