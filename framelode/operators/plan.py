"""Cut lists: parsing against the timeline, running positions, review rules and validation.

Rules give a row for each violation: plan_id, rule, clip_index (null for the plan as a whole).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions import variants as V
from framelode.operators import joins

#: Fixed values of the rules.
LEAST_CLIPS, MOST_CLIPS, TARGET_OFF, TOLERANCE_CS = 3, 20, 0.15, 50
PENALTY, LEAST_SCORE, MOST_ISSUES, CRITICAL_SCORE, MODEL_SCORE = 0.15, 0.6, 2, 0.2, 0.7
VALID_TRANSITIONS = ("cut", "fade_in", "fade_out", "fade", "dissolve", "")
VALIDATOR_OFF, VALIDATOR_TOLERANCE_CS, GAP_CS, MOST_VOLUME = 0.20, 100, 100, 5.0
UNCHECKED = "unchecked"


def parsed(clips: DataFrame, shots: DataFrame, candidates: DataFrame) -> DataFrame:
    """clips (plan_id, clip_index, scene_index, source_start, source_end, evidence) on known scenes only, clamped to them (the whole scene if nothing is
    left), with evidence from the candidate (scene_index, refs) where they have none, or marked unchecked."""
    known = shots.select("scene_index", "start_cs", "end_cs")
    rows = clips.join(known, "scene_index").join(joins.keep(candidates, ["scene_index"], ["scene_index"]).select("scene_index", "refs"), "scene_index", "left")
    low, high = F.greatest(F.coalesce("source_start", "start_cs"), "start_cs"), F.least(F.coalesce("source_end", "end_cs"), "end_cs")
    whole = high <= low
    mark = F.when(F.col("refs").isNull(), F.array(F.concat(F.lit("scene#"), "scene_index", F.lit(f"_{UNCHECKED}")))).when(F.size("refs") > 0, F.slice("refs", 1, 3)).otherwise(F.array(F.concat(F.lit("search_result#scene_"), "scene_index")))
    evidence = F.when(F.size(F.coalesce("evidence", F.array().cast("array<string>"))) > 0, F.col("evidence")).otherwise(mark)
    return rows.withColumns({"evidence": evidence, "source_start": F.when(whole, F.col("start_cs")).otherwise(low), "source_end": F.when(whole, F.col("end_cs")).otherwise(high)}).drop("start_cs", "end_cs", "refs")


def placed(clips: DataFrame, duration: Column, speed: Column) -> DataFrame:
    """``timeline_start`` and ``timeline_end`` of each plan's clips one after another, in the unit of the duration, at their speed."""
    order = Window.partitionBy("plan_id").orderBy("clip_index")
    rows = clips.withColumn("_own", duration / speed)
    start = F.coalesce(F.sum("_own").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumns({"timeline_start": start, "timeline_end": start + F.col("_own")}).drop("_own")


def _rule(rows: DataFrame, rule: str, wrong: Column, clip: bool = True) -> DataFrame:
    return rows.where(wrong).select("plan_id", F.lit(rule).alias("rule"), (F.col("clip_index") if clip else F.lit(None)).cast("int").alias("clip_index"))


def repeated_roles(clips: DataFrame) -> DataFrame:
    """The first of every three clips in a row with one role."""
    order = Window.partitionBy("plan_id").orderBy("clip_index")
    rows = clips.withColumn("_same", (F.lead("role", 1).over(order) == F.col("role")) & (F.lead("role", 2).over(order) == F.col("role")))
    return rows.where("_same").drop("_same")


def review_rules(clips: DataFrame, targets: DataFrame, shots: DataFrame) -> DataFrame:
    """Violations of clips (with timeline and source times, role) of plans whose ``targets`` say how long they should be."""
    totals = clips.groupBy("plan_id").agg(F.count("*").alias("n"), F.sum(F.col("timeline_end") - F.col("timeline_start")).alias("actual"), F.count_if(F.col("role") == "hook").alias("hooks"))
    totals = totals.join(targets, "plan_id")
    off = (F.col("target") > 0) & (F.abs(F.col("actual") - F.col("target")) / F.col("target") > TARGET_OFF)
    most = shots.agg(F.max("scene_index").alias("_most"))  # one row
    seen = clips.crossJoin(F.broadcast(most)).join(shots.select("scene_index", "start_cs", "end_cs"), "scene_index", "left")
    inside = (F.col("scene_index") >= 0) & (F.col("scene_index") <= F.coalesce("_most", F.lit(-1)))
    rules = [
        _rule(totals, "too_few_clips", F.col("n") < LEAST_CLIPS, clip=False),
        _rule(totals, "too_many_clips", F.col("n") > MOST_CLIPS, clip=False),
        _rule(totals, "duration_off", off, clip=False),
        _rule(totals, "no_hook", (F.col("hooks") == 0) & (F.col("n") >= LEAST_CLIPS), clip=False),
        _rule(seen, "unknown_scene", ~inside),
        _rule(seen, "starts_before_scene", inside & (F.col("source_start") < F.col("start_cs") - TOLERANCE_CS)),
        _rule(seen, "ends_after_scene", inside & (F.col("source_end") > F.col("end_cs") + TOLERANCE_CS)),
        _rule(repeated_roles(clips), "three_same_roles", F.lit(True)),
    ]
    return reduce(DataFrame.union, rules)


def grounding_rules(clips: DataFrame, units: DataFrame, events: DataFrame) -> DataFrame:
    """Violations of what clips claim: evidence, times and characters of the unit (scene_index, start_cs, end_cs, characters) they cut from, and important
    events (plan_id, event_id, scene_indices) in none of their scenes, counted once a plan."""
    bad = (F.size("evidence") == 0) | F.forall("evidence", lambda r: F.contains(r, F.lit(UNCHECKED)))
    none = _rule(clips.groupBy("plan_id").agg(F.count_if(bad).alias("n")), "no_evidence", F.col("n") > 0, clip=False)
    own = clips.join(units.select("scene_index", "start_cs", "end_cs", F.col("characters").alias("_there")), "scene_index")
    stranger = own.where((F.size("characters") > 0) & (F.size("_there") > 0)).withColumn("_who", F.explode(F.array_except("characters", "_there")))
    cut = clips.select("plan_id", "scene_index").distinct()
    listed = events.select("plan_id", "event_id", F.explode_outer("scene_indices").alias("scene_index"))
    covered = listed.join(cut, ["plan_id", "scene_index"]).select("plan_id", "event_id").distinct()
    uncovered = events.join(covered, ["plan_id", "event_id"], "left_anti").select("plan_id").distinct()
    rules = [
        none,
        _rule(own, "before_unit", F.col("source_start") < F.col("start_cs") - TOLERANCE_CS),
        _rule(own, "after_unit", F.col("source_end") > F.col("end_cs") + TOLERANCE_CS),
        _rule(stranger, "character_not_there", F.lit(True)),
        _rule(uncovered, "event_not_covered", F.lit(True), clip=False),
    ]
    return reduce(DataFrame.union, rules)


def verdicts(plans: DataFrame, issues: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """approved, score and number of issues of each plan: critical rules fail it. Where a model's review (plan_id, answer) holds an object with readable values, its own issues are added and its approval (true
    where it says nothing) and score (0.7) stand; else each issue takes 0.15, and two and a score of 0.6 still pass."""
    counts = issues.groupBy("plan_id").agg(F.count("*").alias("n"), F.count_if(F.col("rule").isin("unknown_scene", "too_few_clips")).alias("critical"))
    rows = plans.select("plan_id").distinct().join(counts, "plan_id", "left").na.fill(0, ["n", "critical"])
    score = F.greatest(F.lit(0.0), 1.0 - F.col("n") * PENALTY)
    fails = F.col("critical") > 0
    rule = F.when(fails, False).otherwise((F.col("n") <= MOST_ISSUES) & (score >= LEAST_SCORE)), F.when(fails, CRITICAL_SCORE).otherwise(F.round(score, 2))
    if reviews is None:
        return rows.select("plan_id", "n", rule[0].alias("approved"), rule[1].alias("score"))
    v = F.col("_v")
    told = reviews.groupBy("plan_id").agg(F.max("answer").alias("answer")).select("plan_id", V.read_object(F.col("answer")).alias("_v"))
    more = F.coalesce(F.try_variant_get(v, "$.issues", "array<variant>"), F.array().cast("array<variant>"))
    given = F.when(V.at(v, "score").isNull(), MODEL_SCORE).otherwise(F.try_variant_get(v, "$.score", "double"))
    rows = rows.join(told, "plan_id", "left").withColumn("_score", given)
    heard = ~fails & v.isNotNull() & F.col("_score").isNotNull()
    approves = F.when(V.at(v, "approved").isNull(), True).otherwise(V.filled(v, "approved"))
    return rows.select(
        "plan_id", (F.col("n") + F.when(heard, F.size(more)).otherwise(0)).alias("n"), F.when(heard, approves).otherwise(rule[0]).alias("approved"), F.when(heard, F.col("_score")).otherwise(rule[1]).alias("score")
    )


def validation_errors(clips: DataFrame, plans: DataFrame, shots: DataFrame) -> DataFrame:
    """Violations that keep a plan from being rendered. plans: plan_id, target, duration (of the source), bgm_enabled, bgm_path."""
    n = Window.partitionBy("plan_id", "clip_index").orderBy("scene_index", "source_start")
    rows = clips.withColumn("_again", F.row_number().over(n) > 1).join(plans, "plan_id").join(shots.select("scene_index", "start_cs", "end_cs"), "scene_index", "left")
    known, c = F.col("start_cs").isNotNull(), F.col
    source, line = c("source_end") - c("source_start"), c("timeline_end") - c("timeline_start")
    wanted = F.when(c("speed") > 0, source / c("speed")).otherwise(0)
    totals = plans.join(clips.groupBy("plan_id").agg(F.sum(c("timeline_end") - c("timeline_start")).alias("actual"), F.count("*").alias("n")), "plan_id", "left")
    rules = [
        _rule(totals, "no_clips", c("n").isNull(), clip=False),
        _rule(totals, "duration_off", c("n").isNotNull() & (c("target") > 0) & (F.abs(c("actual") - c("target")) / c("target") > VALIDATOR_OFF), clip=False),
        _rule(totals, "bgm_without_path", c("n").isNotNull() & c("bgm_enabled") & (F.coalesce("bgm_path", F.lit("")) == ""), clip=False),
        _rule(rows, "repeated_clip_index", c("_again")),
        _rule(rows, "unknown_scene", ~known),
        _rule(rows, "negative_start", known & (c("source_start") < 0)),
        _rule(rows, "empty_source", known & (c("source_start") >= c("source_end"))),
        _rule(rows, "beyond_source", known & (c("source_end") > c("duration") + TOLERANCE_CS)),
        _rule(rows, "empty_timeline", known & (c("timeline_end") <= c("timeline_start"))),
        _rule(rows, "speed_mismatch", known & (wanted > 0) & (F.abs(line - wanted) > VALIDATOR_TOLERANCE_CS)),
        _rule(rows, "long_before_scene", known & (c("source_start") < c("start_cs") - VALIDATOR_TOLERANCE_CS)),
        _rule(rows, "long_after_scene", known & (c("source_end") > c("end_cs") + VALIDATOR_TOLERANCE_CS)),
        _rule(rows, "bad_speed", known & (c("speed") <= 0)),
        _rule(rows, "bad_volume", known & ((c("volume") < 0) | (c("volume") > MOST_VOLUME))),
        _rule(rows, "bad_transition_in", known & ~c("transition_in").isin(*VALID_TRANSITIONS)),
        _rule(rows, "bad_transition_out", known & ~c("transition_out").isin(*VALID_TRANSITIONS)),
    ]
    return reduce(DataFrame.union, rules)


def gaps(clips: DataFrame, most: int = GAP_CS) -> DataFrame:
    """Clips that the next one follows after more than a second, and the gap."""
    order = Window.partitionBy("plan_id").orderBy("clip_index")
    return clips.withColumn("gap", F.lead("timeline_start").over(order) - F.col("timeline_end")).where(F.col("gap") > most)


def tempo_stages(speed: float) -> list[float]:
    """A change of speed as factors of 0.5 to 2, which the audio filter takes."""
    out: list[float] = []
    while speed > 2:
        out.append(2.0)
        speed /= 2
    while 0 < speed < 0.5:
        out.append(0.5)
        speed /= 0.5
    return [*out, speed]


def cut_list(clips: DataFrame, source: str | Column) -> DataFrame:
    """What a media tool has to do for each clip, as a table; nothing is cut here. source: a path, or a column of paths."""
    return clips.select("plan_id", "clip_index", (F.lit(source) if isinstance(source, str) else source).alias("source"), (F.col("source_start") / 100).alias("from_s"), (F.col("source_end") / 100).alias("to_s"), "speed", "transition_in", "transition_out", "volume")
