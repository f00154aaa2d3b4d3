"""Queries over answers by position. The units are the shots of the events; answers are short, long, broken, empty or spoilt by one item."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelode.operators import director as D
from framelode.operators import groupings as G
from framelode.operators import positional as P
from framelode.plans.registry import query
from framelode.sources import adapters as A


def _units(spark, sf_dir):
    rows = A.shots(spark, sf_dir)
    return rows.select("video_id", F.lit("shot").alias("unit_type"), F.col("scene_index").alias("unit_index"), (F.col("start_cs") / 100).alias("start_time"), (F.col("end_cs") / 100).alias("end_time"), "event_id", "event_type")


def _answers(units, size, item):
    """By (video + batch) % 7: 0 four items short, 1 two too many, 2 no list, 3 an empty one, else whole; the seventh item of every third whole batch doesn't fit."""
    own = P.batched(units, size)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("item")))), lambda x: x["item"])
    rows = own.groupBy("video_id", "batch").agg(listed.alias("items"))
    n = F.col("video_id") + F.col("batch")
    kind, spoilt = n % 7, (n % 7 > 3) & (n % 3 == 0)
    spoil = F.when(spoilt, F.transform("items", lambda x, i: F.when(i == 6, '{"hook_score": "high", "description": 5}').otherwise(x))).otherwise(F.col("items"))
    listed = F.when(kind == 0, F.slice("items", F.lit(1), F.greatest(F.size("items") - 4, F.lit(0)))).when(kind == 1, F.concat("items", F.array(F.lit("{}"), F.lit("3")))).otherwise(spoil)
    text = F.when(kind == 2, "none to give").when(kind == 3, "[]").otherwise(F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")))
    return rows.select("video_id", "batch", text.alias("answer"))


def _told(size: int) -> list[str]:
    return [
        "shots",
        f"un AS (SELECT video_id, scene_index AS unit_index, start_cs / 100 AS start_time, end_cs / 100 AS end_time, event_id AS i, event_type, scene_index // {size} AS batch, scene_index % {size} AS place, video_id + scene_index // {size} AS n FROM shots)",
        "sized AS (SELECT *, count(*) OVER (PARTITION BY video_id, batch) AS many FROM un)",
        "td AS (SELECT *, n % 7 NOT IN (2, 3) AND NOT (n % 7 = 0 AND many <= 4) AS heard, CASE n % 7 WHEN 0 THEN place < many - 4 WHEN 2 THEN FALSE WHEN 3 THEN FALSE ELSE NOT (n % 7 > 3 AND n % 3 = 0 AND place >= 6 AND many > 6) END AS told FROM sized)",
    ]


@query(
    "edit_signals",
    A.sql(
        _told(15),
        """SELECT video_id, 'shot' AS unit_type, unit_index, start_time, end_time, (i % 100) / 100.0::DOUBLE AS hook_score, CASE WHEN i % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS visual_impact, 0.0::DOUBLE AS spoiler_level, CASE WHEN i % 3 = 0 THEN 'hook,' || event_type ELSE '' END AS suggested_usage FROM td WHERE told""",
    ),
)
def edit_signals(spark, sf_dir):
    units = _units(spark, sf_dir)
    i = F.col("event_id")
    item = F.concat(F.lit('{"hook_score": '), F.when(i % 4 == 0, F.concat(F.lit('"'), i % 100 / 100, F.lit('"'))).otherwise((i % 100 / 100).cast("string")), F.when(i % 2 == 0, ', "visual_impact": 0.5').otherwise(""), F.when(i % 3 == 0, F.concat(F.lit(', "suggested_usage": ["hook", "'), "event_type", F.lit('"]'))).otherwise(""), F.lit("}"))
    found = P.signals(units, _answers(units, P.SIGNAL_BATCH, item), P.EDIT, scope=("video_id",))
    return found.select("video_id", "unit_type", "unit_index", "start_time", "end_time", "hook_score", "visual_impact", "spoiler_level", F.array_join("suggested_usage", ",").alias("suggested_usage"))


@query(
    "views_by_position",
    A.sql(
        [
            *_told(8),
            "ag AS (SELECT video_id, batch, bool_and(i % 61 > 0) AS whole FROM td WHERE NOT heard GROUP BY ALL)",
        ],
        """SELECT video_id, unit_index, heard, coalesce(told, FALSE) OR coalesce(whole, FALSE) AS told, CASE WHEN told THEN 'view of ' || event_type WHEN whole THEN 'single ' || i ELSE '' END AS description, CASE WHEN told AND i % 2 = 0 THEN 'a,b' ELSE '' END AS objects
      FROM td LEFT JOIN ag USING (video_id, batch)""",
    ),
)
def views_by_position(spark, sf_dir):
    """Views of batches of eight; where the answer is no list each shot is asked for, and every sixty-first of those gives nothing."""
    units = _units(spark, sf_dir)
    i = F.col("event_id")
    item = F.concat(F.lit('{"description": "view of '), "event_type", F.lit('"'), F.when(i % 2 == 0, ', "objects": ["a", "b"]').otherwise(""), F.lit("}"))
    found = P.zipped(P.batched(units, 8), _answers(units, 8, item), P.VIEW)
    singles = P.to_ask_again(found).select("video_id", "unit_index", F.when(i % 61 == 0, "[1]").otherwise(F.concat(F.lit('{"description": "single '), i, F.lit('"}'))).alias("answer"))
    out = P.completed(found, singles, P.VIEW, ("video_id", "unit_index"))
    return out.select("video_id", "unit_index", "heard", "told", "description", F.array_join("objects", ",").alias("objects"))


@query(
    "directed_plans",
    """WITH tried AS (SELECT c_custkey AS plan_id, k, (c_custkey + k) % 4 AS kind FROM customer, range(3) r(k)),
    judged AS (SELECT *, kind = 2 AND plan_id % 5 > 0 AS approved, CASE kind WHEN 1 THEN 0.2::DOUBLE WHEN 2 THEN CASE WHEN plan_id % 5 = 0 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END WHEN 3 THEN CASE WHEN plan_id % 5 = 0 THEN 0.4::DOUBLE ELSE 0.55::DOUBLE END END AS score,
      CASE kind WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 3 END + CASE WHEN plan_id % 5 = 0 AND kind > 1 THEN 1 ELSE 0 END AS n, CASE kind WHEN 1 THEN 2 ELSE 4 END AS n_clips FROM tried),
    ended AS (SELECT plan_id, coalesce(min(k) FILTER (approved), 2) AS last FROM judged GROUP BY plan_id)
    SELECT plan_id, arg_max(k, k)::INT AS attempt, arg_max(n, k)::BIGINT AS n, arg_max(approved, k) AS approved, arg_max(score, k) AS score, arg_max(n_clips, k)::BIGINT AS n_clips FROM judged JOIN ended USING (plan_id) WHERE kind > 0 AND k <= last GROUP BY plan_id""",
)
def directed_plans(spark, sf_dir):
    """A plan for each customer, asked for three times at most. By (customer + attempt) % 4 an answer can't be read, has two clips, four good ones, or four of one role; a model's review is against every fifth plan."""
    plans = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("plan_id"), F.lit(1).alias("video_id"), F.lit("a plan").alias("prompt"), F.lit(40.0).alias("target_duration"))
    shots = A.table(spark, sf_dir, "region").select(F.lit(1).alias("video_id"), F.col("r_regionkey").alias("scene_index"), (F.col("r_regionkey") * 60.0).alias("start_time"), (F.col("r_regionkey") * 60.0 + 60).alias("end_time"))
    units = shots.select("scene_index", (F.col("start_time") * 100).alias("start_cs"), (F.col("end_time") * 100).alias("end_cs"), F.array().cast("array<string>").alias("characters"))
    candidates = shots.limit(0).select(F.lit("").alias("query_id"), "scene_index", F.array(F.lit("")).alias("refs"), F.lit("").alias("transcript"), F.lit("").alias("vision"))
    events = plans.limit(0).select("plan_id", F.lit(0).alias("event_id"), F.array(F.lit(0)).alias("scene_indices"))

    def ask(now):
        kind = (F.col("plan_id") + F.col("attempt")) % 4
        role = lambda i: F.when(kind == 3, "rising_action").otherwise(["hook", "setup", "climax", "ending"][i])
        clip = [F.concat(F.lit(f'{{"source_scene_index": {i}, "source_start": {i * 60 + 5}, "source_end": {i * 60 + 15}, "evidence_refs": ["r"], "narrative_role": "'), role(i), F.lit('"}')) for i in range(4)]
        listed = F.array_join(F.slice(F.array(*clip), 1, F.when(kind == 1, 2).otherwise(4)), ", ")
        return now.select("plan_id", F.when(kind == 0, "no plan").otherwise(F.concat(F.lit('```json\n{"clips": ['), listed, F.lit("]}\n```"))).alias("answer"))

    def review(clips):
        return clips.where("plan_id % 5 = 0").select("plan_id", F.lit('```json\n{"approved": false, "score": 0.4, "issues": ["dull"]}\n```').alias("answer")).distinct()

    found, clips = D.directed(plans, candidates, shots, units, events, ask, review)
    counts = clips.groupBy("plan_id").agg(F.count("*").alias("n_clips"))
    return found.join(counts, "plan_id").select("plan_id", "attempt", "n", "approved", "score", "n_clips")


_BEATS = "bt AS (SELECT video_id, scene_index // 4 AS beat_index, min(start_cs) / 100 AS start_time, max(end_cs) / 100 AS end_time, sum(dur_cs)::BIGINT / 100 AS duration, list(scene_index ORDER BY scene_index) AS shots FROM shots GROUP BY ALL)"


@query(
    "story_scenes_from_answers",
    A.sql(
        [
            "shots",
            _BEATS,
            "told AS (SELECT *, beat_index // 2 AS k FROM bt WHERE video_id % 4 = 2 AND beat_index // 2 % 3 < 2)",
            "placed AS (SELECT *, dense_rank() OVER (PARTITION BY video_id ORDER BY k) - 1 AS place FROM told)",
            "every AS (SELECT video_id, CASE WHEN k % 5 = 0 THEN k + 100 ELSE place END AS n, start_time, end_time, duration, beat_index, shots, CASE WHEN k % 2 = 0 THEN 'home' ELSE '' END AS location FROM placed UNION ALL SELECT video_id, beat_index // 3, start_time, end_time, duration, beat_index, shots, '' FROM bt WHERE video_id % 4 <> 2)",
        ],
        """SELECT video_id, n::INT AS story_scene_index, min(start_time) AS start_time, max(end_time) AS end_time, round(sum(duration), 6) AS duration, string_agg(beat_index, ',' ORDER BY beat_index) AS beat_indices,
      array_to_string(list_sort(flatten(list(shots))), ',') AS shot_indices, any_value(location) AS location FROM every GROUP BY video_id, n""",
    ),
)
def story_scenes_from_answers(spark, sf_dir):
    """Beats of four shots; answers of every fourth video group two beats each, leave some out and number some, the others have none, a broken one, or one with an item that is no object."""
    shots = A.shots(spark, sf_dir).withColumn("beat_index", F.floor(F.col("scene_index") / 4).cast("int"))
    beats = shots.groupBy("video_id", "beat_index").agg((F.min("start_cs") / 100).alias("start_time"), (F.max("end_cs") / 100).alias("end_time"), (F.sum("dur_cs") / 100).alias("duration"), F.array_sort(F.collect_list("scene_index")).alias("shot_indices"))
    k, v = F.floor(F.col("beat_index") / 2).cast("int"), F.col("video_id")
    pairs = beats.withColumn("k", k).groupBy("video_id", "k").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("beat_index"), False).cast("array<string>"), ", "), F.lit("]")).alias("of"))
    item = F.concat(F.lit('{"beat_indices": '), "of", F.when(F.col("k") % 5 == 0, F.concat(F.lit(', "story_scene_index": '), F.col("k") + 100)).otherwise(""), F.when(F.col("k") % 2 == 0, ', "location": "home"').otherwise(""), F.lit("}"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") % 3 < 2, F.struct("k", item.alias("item"))))), lambda x: x["item"]), ", ")
    answers = pairs.groupBy("video_id").agg(listed.alias("items")).where(v % 4 > 0).select("video_id", F.when(v % 4 == 1, "no scenes").when(v % 4 == 2, F.concat(F.lit("["), "items", F.lit("]"))).otherwise(F.concat(F.lit("["), "items", F.lit(", 5]"))).alias("answer"))
    made = G.story_scenes(beats, answers)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return made.select("video_id", "story_scene_index", "start_time", "end_time", F.round("duration", 6).alias("duration"), joined("beat_indices"), joined("shot_indices"), "location")


@query(
    "roles_from_answers",
    """WITH sc AS (SELECT c_nationkey AS video_id, c_custkey AS character, CAST(floor(c_acctbal) AS BIGINT) AS screen_cs FROM customer)
    SELECT video_id, character, CASE WHEN video_id % 3 = 0 THEN CASE row_number() OVER (PARTITION BY video_id ORDER BY screen_cs DESC, character) WHEN 1 THEN 'male_lead' WHEN 2 THEN 'female_lead' ELSE 'supporting' END
      ELSE CASE character % 4 WHEN 0 THEN 'villain' WHEN 1 THEN 'minor' ELSE 'supporting' END END AS role FROM sc""",
)
def roles_from_answers(spark, sf_dir):
    """Answers of two videos in three name roles, some of which are none, for some characters."""
    screen = A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("video_id"), F.col("c_custkey").alias("character"), F.floor("c_acctbal").cast("long").alias("screen_cs"))
    i = F.col("character")
    said = F.when(i % 4 == 0, '"villain"').when(i % 4 == 1, '"minor"').when(i % 8 == 2, '"king"').when(i % 8 == 6, "3")
    entry = F.when(said.isNotNull(), F.concat(F.lit('"'), i, F.lit('": '), said))
    rows = screen.groupBy("video_id").agg(F.array_join(F.collect_list(entry), ", ").alias("of"))
    answers = rows.select("video_id", F.when(F.col("video_id") % 3 == 0, "nobody").otherwise(F.concat(F.lit("{"), "of", F.lit("}"))).alias("answer"))
    return G.roles(screen, answers).select("video_id", "character", "role")
