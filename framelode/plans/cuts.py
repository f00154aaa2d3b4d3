"""Queries over cut lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelode.operators import plan as P
from framelode.plans.registry import query
from framelode.sources import adapters as A

_RUN = """placed AS (SELECT *, coalesce(sum(own) OVER (PARTITION BY plan_id ORDER BY clip_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS timeline_start, sum(own) OVER (PARTITION BY plan_id ORDER BY clip_index) AS timeline_end FROM (SELECT *, dur_cs / (speed_pct / 100.0::DOUBLE) AS own FROM clips))"""


def placed(spark, sf_dir):
    return P.placed(A.clips(spark, sf_dir), F.col("dur_cs"), F.col("speed_pct") / 100)


@query("timeline_running", A.sql(["clips", _RUN], "SELECT plan_id, clip_index, clip_id, round(timeline_start, 3) AS timeline_start, round(timeline_end, 3) AS timeline_end FROM placed"))
def timeline_running(spark, sf_dir):
    return placed(spark, sf_dir).select("plan_id", "clip_index", "clip_id", F.round("timeline_start", 3).alias("timeline_start"), F.round("timeline_end", 3).alias("timeline_end"))


@query("three_same_roles", A.sql("clips", "SELECT plan_id, clip_index, status FROM (SELECT *, lead(status, 1) OVER w AS a, lead(status, 2) OVER w AS b FROM clips WINDOW w AS (PARTITION BY plan_id ORDER BY clip_index)) WHERE a = status AND b = status"))
def three_same_roles(spark, sf_dir):
    return P.repeated_roles(A.clips(spark, sf_dir).withColumn("role", F.col("status"))).select("plan_id", "clip_index", "status")


# Scenes of the cut lists: one for each customer, a minute long; every eleventh number is no scene's.
_SCENES = "places AS (SELECT n AS scene_index, n * 6000 AS start_cs, n * 6000 + 6000 AS end_cs, [c_mktsegment] AS characters FROM (SELECT *, c_custkey + c_custkey // 10 AS n FROM customer))"
_CUT = """cut AS (SELECT plan_id, clip_index, timeline_start, timeline_end, CASE WHEN clip_index = 0 AND plan_id % 3 > 0 THEN 'hook' ELSE status END AS role, clip_id % 200 AS scene_index,
  (clip_id % 200) * 6000 + (clip_id * 31) % 400 - 90 AS source_start, (clip_id % 200) * 6000 + (clip_id * 31) % 400 - 90 + dur_cs % 7000 AS source_end, speed_pct / 100.0::DOUBLE AS speed,
  CASE clip_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['scene#1_unchecked'] ELSE ['ref#' || clip_id] END AS evidence, CASE WHEN clip_id % 2 = 0 THEN ['BUILDING'] ELSE [] END AS characters,
  (clip_id % 60) / 10.0::DOUBLE AS volume, CASE clip_id % 9 WHEN 0 THEN 'wipe' ELSE 'cut' END AS transition_in, CASE clip_id % 8 WHEN 0 THEN 'fade_out' WHEN 1 THEN 'spin' ELSE '' END AS transition_out FROM placed)"""
_TARGETS = "goals AS (SELECT plan_id, (floor(sum(dur_cs) * (0.7::DOUBLE + (plan_id % 4) * 0.1::DOUBLE)))::DOUBLE AS target, plan_id % 5 = 0 AS bgm_enabled, CASE WHEN plan_id % 10 = 0 THEN 'a.mp3' ELSE '' END AS bgm_path, 900000 AS duration FROM clips GROUP BY plan_id)"


def scenes(spark, sf_dir):
    i = F.col("c_custkey") + F.floor(F.col("c_custkey") / 10)
    return A.table(spark, sf_dir, "customer").select(i.alias("scene_index"), (i * 6000).alias("start_cs"), (i * 6000 + 6000).alias("end_cs"), F.array("c_mktsegment").alias("characters"))


def cuts(spark, sf_dir):
    i = F.col("clip_id")
    start = (i % 200) * 6000 + (i * 31) % 400 - 90
    none = F.array().cast("array<string>")
    return placed(spark, sf_dir).select(
        "plan_id", "clip_index", "timeline_start", "timeline_end", F.when((F.col("clip_index") == 0) & (F.col("plan_id") % 3 > 0), "hook").otherwise(F.col("status")).alias("role"), (i % 200).alias("scene_index"), start.alias("source_start"),
        (start + F.col("dur_cs") % 7000).alias("source_end"), (F.col("speed_pct") / 100).alias("speed"), F.when(i % 4 == 0, none).when(i % 4 == 1, F.array(F.lit("scene#1_unchecked"))).otherwise(F.array(F.concat(F.lit("ref#"), i))).alias("evidence"),
        F.when(i % 2 == 0, F.array(F.lit("BUILDING"))).otherwise(none).alias("characters"), (i % 60 / 10).alias("volume"), F.when(i % 9 == 0, "wipe").otherwise("cut").alias("transition_in"), F.when(i % 8 == 0, "fade_out").when(i % 8 == 1, "spin").otherwise("").alias("transition_out"),
    )


def goals(spark, sf_dir):
    p = F.col("plan_id")
    total = F.floor(F.sum("dur_cs") * (F.lit(0.7) + (p % 4) * 0.1)).cast("double")
    return A.clips(spark, sf_dir).groupBy("plan_id").agg(total.alias("target")).select("plan_id", "target", (p % 5 == 0).alias("bgm_enabled"), F.when(p % 10 == 0, "a.mp3").otherwise("").alias("bgm_path"), F.lit(900_000).alias("duration"))


_PARSED = """SELECT plan_id, clip_index, scene_index, CASE WHEN high <= low THEN start_cs ELSE low END AS source_start, CASE WHEN high <= low THEN end_cs ELSE high END AS source_end, array_to_string(
    CASE WHEN len(evidence) > 0 THEN evidence WHEN refs IS NULL THEN ['scene#' || scene_index || '_unchecked'] WHEN len(refs) > 0 THEN refs[1:3] ELSE ['search_result#scene_' || scene_index] END, ',') AS evidence
  FROM (SELECT c.*, p.start_cs, p.end_cs, r.refs, greatest(source_start, start_cs) AS low, least(source_end, end_cs) AS high FROM cut c JOIN places p USING (scene_index) LEFT JOIN (SELECT s_suppkey AS scene_index, CASE WHEN s_suppkey % 2 = 0 THEN ['a', 'b', 'c', 'd'] ELSE [] END AS refs FROM supplier) r USING (scene_index))"""


@query("clip_clamp_evidence", A.sql(["clips", _RUN, _SCENES, _CUT], _PARSED))
def clip_clamp_evidence(spark, sf_dir):
    refs = F.when(F.col("s_suppkey") % 2 == 0, F.array(*map(F.lit, "abcd"))).otherwise(F.array().cast("array<string>"))
    candidates = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scene_index"), refs.alias("refs"))
    return P.parsed(cuts(spark, sf_dir), scenes(spark, sf_dir), candidates).select("plan_id", "clip_index", "scene_index", "source_start", "source_end", F.array_join("evidence", ",").alias("evidence"))


_TOTALS = "totals AS (SELECT plan_id, count(*) AS n, sum(timeline_end - timeline_start) AS actual, count(*) FILTER (role = 'hook') AS hooks, any_value(target) AS target FROM cut JOIN goals USING (plan_id) GROUP BY plan_id)"
_ISSUES = """issues AS (SELECT plan_id, 'too_few_clips' AS rule, NULL::INT AS clip_index FROM totals WHERE n < 3
  UNION ALL SELECT plan_id, 'too_many_clips', NULL FROM totals WHERE n > 20 UNION ALL SELECT plan_id, 'duration_off', NULL FROM totals WHERE target > 0 AND abs(actual - target) / target > 0.15
  UNION ALL SELECT plan_id, 'no_hook', NULL FROM totals WHERE hooks = 0 AND n >= 3
  UNION ALL SELECT plan_id, 'unknown_scene', clip_index FROM cut WHERE scene_index < 0 OR scene_index > (SELECT max(scene_index) FROM places)
  UNION ALL SELECT plan_id, 'starts_before_scene', clip_index FROM cut JOIN places USING (scene_index) WHERE source_start < start_cs - 50
  UNION ALL SELECT plan_id, 'ends_after_scene', clip_index FROM cut JOIN places USING (scene_index) WHERE source_end > end_cs + 50
  UNION ALL SELECT plan_id, 'three_same_roles', clip_index FROM (SELECT *, lead(role, 1) OVER w = role AND lead(role, 2) OVER w = role AS same FROM cut WINDOW w AS (PARTITION BY plan_id ORDER BY clip_index)) WHERE same)"""


@query("rule_violations", A.sql(["clips", _RUN, _SCENES, _CUT, _TARGETS, _TOTALS, _ISSUES], "SELECT * FROM issues"))
def rule_violations(spark, sf_dir):
    return P.review_rules(cuts(spark, sf_dir), goals(spark, sf_dir), scenes(spark, sf_dir))


_EVENTS = "important AS (SELECT o_custkey AS plan_id, o_orderkey AS event_id, CASE WHEN o_orderkey % 4 = 0 THEN [] ELSE [o_orderkey % 200, o_orderkey % 90] END AS scene_indices FROM orders)"
_GROUNDS = """grounds AS (SELECT plan_id, 'no_evidence' AS rule, NULL::INT AS clip_index FROM cut GROUP BY plan_id HAVING count(*) FILTER (len(list_filter(evidence, lambda r: NOT contains(r, 'unchecked'))) = 0) > 0
  UNION ALL SELECT plan_id, 'before_unit', clip_index FROM cut JOIN places USING (scene_index) WHERE source_start < start_cs - 50
  UNION ALL SELECT plan_id, 'after_unit', clip_index FROM cut JOIN places USING (scene_index) WHERE source_end > end_cs + 50
  UNION ALL SELECT plan_id, 'character_not_there', clip_index FROM (SELECT plan_id, clip_index, unnest(c.characters) AS who, p.characters AS there FROM cut c JOIN places p USING (scene_index)) WHERE NOT list_contains(there, who)
  UNION ALL SELECT DISTINCT plan_id, 'event_not_covered', NULL::INT FROM important i WHERE NOT EXISTS (FROM cut c WHERE c.plan_id = i.plan_id AND list_contains(i.scene_indices, c.scene_index)))"""


def _important(spark, sf_dir):
    i = F.col("o_orderkey")
    return A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan_id"), i.alias("event_id"), F.when(i % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(i % 200, i % 90)).alias("scene_indices"))


@query("grounding_violations", A.sql(["clips", _RUN, _SCENES, _CUT, _EVENTS, _GROUNDS], "SELECT * FROM grounds"))
def grounding_violations(spark, sf_dir):
    return P.grounding_rules(cuts(spark, sf_dir), scenes(spark, sf_dir), _important(spark, sf_dir))


@query(
    "verdict",
    A.sql(
        ["clips", _RUN, _SCENES, _CUT, _TARGETS, _TOTALS, _ISSUES],
        """SELECT plan_id, n, CASE WHEN critical > 0 THEN false ELSE n <= 2 AND greatest(0.0::DOUBLE, 1.0::DOUBLE - n * 0.15::DOUBLE) >= 0.6::DOUBLE END AS approved, CASE WHEN critical > 0 THEN 0.2::DOUBLE ELSE round(greatest(0.0::DOUBLE, 1.0::DOUBLE - n * 0.15::DOUBLE), 2) END AS score
        FROM (SELECT plan_id, count(rule) AS n, count(*) FILTER (rule IN ('unknown_scene', 'too_few_clips')) AS critical FROM goals LEFT JOIN issues USING (plan_id) GROUP BY plan_id)""",
    ),
)
def verdict(spark, sf_dir):
    rows = goals(spark, sf_dir)
    return P.verdicts(rows, P.review_rules(cuts(spark, sf_dir), rows, scenes(spark, sf_dir)))


@query(
    "validator_violations",
    A.sql(
        [
            "clips", _RUN, _SCENES, _CUT, _TARGETS, _TOTALS,
            "seen AS (SELECT c.*, g.duration, p.start_cs, p.end_cs, CASE WHEN speed > 0 THEN (source_end - source_start) / speed ELSE 0 END AS wanted FROM cut c JOIN goals g USING (plan_id) JOIN places p USING (scene_index))",
        ],
        """SELECT plan_id, 'duration_off' AS rule, NULL::INT AS clip_index FROM totals WHERE target > 0 AND abs(actual - target) / target > 0.2 UNION ALL SELECT plan_id, 'bgm_without_path', NULL FROM goals WHERE bgm_enabled AND bgm_path = ''
        UNION ALL SELECT plan_id, 'unknown_scene', clip_index FROM cut WHERE scene_index NOT IN (SELECT scene_index FROM places) UNION ALL SELECT plan_id, 'negative_start', clip_index FROM seen WHERE source_start < 0
        UNION ALL SELECT plan_id, 'empty_source', clip_index FROM seen WHERE source_start >= source_end UNION ALL SELECT plan_id, 'beyond_source', clip_index FROM seen WHERE source_end > duration + 50
        UNION ALL SELECT plan_id, 'empty_timeline', clip_index FROM seen WHERE timeline_end <= timeline_start UNION ALL SELECT plan_id, 'speed_mismatch', clip_index FROM seen WHERE wanted > 0 AND abs(timeline_end - timeline_start - wanted) > 100
        UNION ALL SELECT plan_id, 'long_before_scene', clip_index FROM seen WHERE source_start < start_cs - 100 UNION ALL SELECT plan_id, 'long_after_scene', clip_index FROM seen WHERE source_end > end_cs + 100
        UNION ALL SELECT plan_id, 'bad_volume', clip_index FROM seen WHERE volume > 5 UNION ALL SELECT plan_id, 'bad_transition_in', clip_index FROM seen WHERE transition_in = 'wipe' UNION ALL SELECT plan_id, 'bad_transition_out', clip_index FROM seen WHERE transition_out = 'spin'""",
    ),
)
def validator_violations(spark, sf_dir):
    return P.validation_errors(cuts(spark, sf_dir), goals(spark, sf_dir), scenes(spark, sf_dir))


@query("timeline_gaps", A.sql(["clips", _RUN], "SELECT plan_id, clip_index, round(gap, 3) AS gap FROM (SELECT *, lead(timeline_start + shift) OVER (PARTITION BY plan_id ORDER BY clip_index) - (timeline_end + shift) AS gap FROM (SELECT *, clip_index % 3 * 150 AS shift FROM placed)) WHERE gap > 100"))
def timeline_gaps(spark, sf_dir):
    """Cut lists whose clips begin 0, 150 and 300 later in turn."""
    shift = F.col("clip_index") % 3 * 150
    shifted = placed(spark, sf_dir).withColumns({"timeline_start": F.col("timeline_start") + shift, "timeline_end": F.col("timeline_end") + shift})
    return P.gaps(shifted).select("plan_id", "clip_index", F.round("gap", 3).alias("gap"))
