"""Plans that are asked for, reviewed and asked for again, all at once.

A round asks for every plan that is still open, reads the answers, reviews them by the rules and, where there is one, by a model; plans that pass leave, the others go into the next round with what was found
wrong behind their prompt. An answer that can't be read leaves the prompt as it was. A plan is that of its last answer that could be read. Each round is written, so that a lost executor asks nobody again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.functions import variants as V
from framelode.operators import chapter_plan, plan, shared

ROUNDS = 3
#: What stands before the reasons for which a plan is asked for again.
FEEDBACK = "\n\n=== Review of the last plan ===\n"

Ask = Callable[[DataFrame], DataFrame]


def reviewable(clips: DataFrame) -> DataFrame:
    """Clips with times in centiseconds and the names that the rules know."""
    cs = lambda c: (F.col(c) * 100).alias(c)
    return clips.select(
        "plan_id", "clip_index", F.col("source_scene_index").alias("scene_index"), *map(cs, ("source_start", "source_end", "timeline_start", "timeline_end")), F.col("narrative_role").alias("role"), F.col("evidence_refs").alias("evidence"), "characters"
    )


def directed(plans: DataFrame, candidates: DataFrame, shots: DataFrame, units: DataFrame, events: DataFrame, ask: Ask, review: Ask | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(verdicts, clips) for plans (plan_id, video_id, prompt, target_duration in seconds).

    candidates: query_id, scene_index, refs, transcript and vision, as a search by ``chapter_plan.query_id(plan_id, 0)`` gives them; shots: video_id, scene_index, start_time, end_time; units and events as
    ``plan.grounding_rules`` reads them, for plans of one video. ask: from open plans (plan_id, video_id, attempt, prompt) to answers (plan_id, answer); review: from clips to reviews (plan_id, answer).
    Verdicts: plan_id, attempt (the one whose answer stands, null where none could be read), n, approved, score and prompt (the last one)."""
    now = plans.select("plan_id", "video_id", "prompt", "target_duration")
    made: list[DataFrame] = []
    told: list[DataFrame] = []
    scale = shots.select("scene_index", (F.col("start_time") * 100).alias("start_cs"), (F.col("end_time") * 100).alias("end_cs"))
    parallel = plans.sparkSession.sparkContext.defaultParallelism
    for attempt in range(rounds):
        # few bytes would be few tasks, and the answers take the time; they are parsed here and nowhere else
        dealt = now.repartition(parallel, "plan_id").withColumn("attempt", F.lit(attempt))
        read = shared.written(ask(dealt).select("plan_id", V.read_object(F.col("answer")).alias("v")), "answers").where("v is not null")
        own = read.join(now.select("plan_id", "video_id"), "plan_id").withColumn("chapter_index", F.lit(0))
        clips = shared.written(chapter_plan.clips(own, candidates, shots, unchecked=True).withColumn("attempt", F.lit(attempt)), "clips")
        parsed = shared.written(read.select("plan_id").distinct().join(now, "plan_id"), "parsed")
        rows = reviewable(clips)
        issues = plan.review_rules(rows, parsed.select("plan_id", (F.col("target_duration") * 100).alias("target")), scale).union(plan.grounding_rules(rows, units, events.join(parsed.select("plan_id"), "plan_id", "left_semi")))
        # a plan without a single clip has no rows for the rules to count
        empty = parsed.join(rows.select("plan_id"), "plan_id", "left_anti").select("plan_id", F.lit("too_few_clips").alias("rule"), F.lit(None).cast("int").alias("clip_index"))
        issues = shared.written(issues.union(empty), "issues")
        verdicts = shared.written(plan.verdicts(parsed, issues, None if review is None else review(clips)).withColumn("attempt", F.lit(attempt)), "verdicts")
        made.append(clips)
        listed = F.array_join(F.array_sort(F.collect_list(F.concat(F.col("rule"), F.coalesce(F.concat(F.lit(" in clip "), F.col("clip_index")), F.lit(""))))), "; ")
        wrong = verdicts.where("not approved").join(issues.groupBy("plan_id").agg(listed.alias("_wrong")), "plan_id", "left").select("plan_id", F.concat(F.lit(FEEDBACK), F.lit("score "), F.col("score"), F.lit(": "), F.coalesce("_wrong", F.lit(""))).alias("_more"))
        told.append(verdicts.join(now.select("plan_id", "prompt"), "plan_id"))
        left = now.join(verdicts.where("approved"), "plan_id", "left_anti").join(wrong, "plan_id", "left")
        now = shared.written(left.select("plan_id", "video_id", F.concat("prompt", F.coalesce("_more", F.lit(""))).alias("prompt"), "target_duration"), "open")
        if now.isEmpty():
            break
    every = reduce(DataFrame.union, told)
    last = every.groupBy("plan_id").agg(F.max_by(F.struct("attempt", "n", "approved", "score", "prompt"), "attempt").alias("v")).select("plan_id", "v.*")
    out = plans.select("plan_id", F.col("prompt").alias("_asked")).join(last, "plan_id", "left").withColumn("prompt", F.coalesce("prompt", "_asked")).withColumn("approved", F.coalesce("approved", F.lit(False))).drop("_asked")
    clips = reduce(DataFrame.union, made).join(last.select("plan_id", "attempt"), ["plan_id", "attempt"], "left_semi")
    return out, clips
