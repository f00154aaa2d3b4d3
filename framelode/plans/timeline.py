"""Queries over timelines: joins in time, folds, groups and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelode.operators import hierarchy as H
from framelode.operators import temporal as T
from framelode.operators import selection
from framelode.plans.registry import query
from framelode.sources import adapters as A


@query("adapter_shot", A.sql("shots", "SELECT * FROM shots"))
def adapter_shot(spark, sf_dir):
    return A.shots(spark, sf_dir)


@query("shot_stats", A.sql("shots", "SELECT video_id, count(*) AS n, min(dur_cs) AS min_cs, max(dur_cs) AS max_cs, round(avg(dur_cs), 4) AS avg_cs FROM shots GROUP BY video_id"))
def shot_stats(spark, sf_dir):
    return selection.shot_stats(A.shots(spark, sf_dir))


_SEGMENTS = "segments AS (SELECT video_id, event_id AS segment_id, start_cs + (event_id * 37) % 900 - 300 AS start_cs, start_cs + (event_id * 37) % 900 - 300 + (event_id % 7) * 50 AS end_cs FROM shots)"


def _segments(spark, sf_dir):
    i = F.col("event_id")
    start = F.col("start_cs") + (i * 37) % 900 - 300
    return A.shots(spark, sf_dir).select("video_id", i.alias("segment_id"), start.alias("start_cs"), (start + (i % 7) * 50).alias("end_cs"))


@query(
    "midpoint_assign",
    A.sql(
        ["shots", _SEGMENTS],
        """SELECT video_id, segment_id, s.scene_index, start_cs < s.start_cs OR end_cs > s.end_cs AS cross_shot FROM (
        SELECT g.video_id, g.segment_id, g.start_cs, g.end_cs, arg_min({'scene_index': s.scene_index, 'start_cs': s.start_cs, 'end_cs': s.end_cs},
          (CASE WHEN 2 * s.start_cs <= g.start_cs + g.end_cs AND g.start_cs + g.end_cs < 2 * s.end_cs THEN -1 ELSE abs(2 * s.start_cs - g.start_cs - g.end_cs) END, s.start_cs, s.scene_index)) AS s
        FROM segments g JOIN shots s ON g.video_id = s.video_id GROUP BY ALL)""",
    ),
)
def midpoint_assign(spark, sf_dir):
    return T.assigned(_segments(spark, sf_dir), A.shots(spark, sf_dir))


@query("point_in_shot", A.sql(["shots", _SEGMENTS], "SELECT g.video_id, g.segment_id, g.start_cs AS at_cs, min(s.scene_index) AS scene_index FROM segments g JOIN shots s ON g.video_id = s.video_id AND s.start_cs <= g.start_cs AND g.start_cs < s.end_cs GROUP BY ALL"))
def point_in_shot(spark, sf_dir):
    points = _segments(spark, sf_dir).select("video_id", "segment_id", F.col("start_cs").alias("at_cs"))
    return T.holding(points, A.shots(spark, sf_dir))


@query("overlap_event_shot", A.sql("shots story_events", "SELECT e.video_id, e.event_id, s.scene_index FROM story_events e JOIN shots s ON e.video_id = s.video_id AND e.start_cs < s.end_cs AND e.end_cs > s.start_cs"))
def overlap_event_shot(spark, sf_dir):
    events = A.story_events(spark, sf_dir).select("video_id", "event_id", F.col("start_cs").alias("l_start"), F.col("end_cs").alias("l_end"))
    shots = A.shots(spark, sf_dir).select("video_id", "scene_index", F.col("start_cs").alias("r_start"), F.col("end_cs").alias("r_end"))
    return T.overlapping(events, shots, "video_id", 20_000).select("video_id", "event_id", "scene_index")


@query("tumbling_segments", A.sql("shots", "SELECT video_id, start_cs // 180000 AS segment, count(*) AS n, sum(dur_cs)::BIGINT AS dur_cs FROM shots GROUP BY ALL"))
def tumbling_segments(spark, sf_dir):
    return A.shots(spark, sf_dir).groupBy("video_id", T.segment(F.col("start_cs"), 180_000).alias("segment")).agg(F.count("*").alias("n"), F.sum("dur_cs").alias("dur_cs"))


@query(
    "audio_windows",
    A.sql("shots", "SELECT video_id, window_index, count(*) AS n_shots FROM (SELECT video_id, unnest(range(start_cs // 30000, greatest(end_cs - 1, start_cs) // 30000 + 1)) AS window_index FROM shots) GROUP BY ALL"),
)
def audio_windows(spark, sf_dir):
    return T.windows(A.shots(spark, sf_dir), "start_cs", "end_cs", 30_000).groupBy("video_id", "window_index").agg(F.count("*").alias("n_shots"))


@query(
    "greedy_chunks",
    A.sql(
        [
            "shots",
            """walk AS (SELECT video_id, scene_index, 0 AS chunk, dur_cs AS held FROM shots WHERE scene_index = 0
  UNION ALL SELECT s.video_id, s.scene_index, CASE WHEN w.held >= 15000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.held >= 15000 THEN s.dur_cs ELSE w.held + s.dur_cs END
  FROM walk w JOIN shots s ON s.video_id = w.video_id AND s.scene_index = w.scene_index + 1)""",
            "last_chunk AS (SELECT video_id, max(chunk) AS last, arg_max(held, scene_index) AS held FROM walk GROUP BY video_id)",
        ],
        """SELECT video_id, chunk AS chunk_index, min(scene_index) AS first_scene, count(*) AS n_shots, min(start_cs) AS start_cs, max(end_cs) AS end_cs,
        CASE WHEN any_value(took) AND chunk = max(final) THEN max(end_cs) - min(start_cs) ELSE sum(dur_cs)::BIGINT END AS duration_cs FROM (
        SELECT s.*, CASE WHEN l.held < 3000 AND l.last > 0 AND w.chunk = l.last THEN w.chunk - 1 ELSE w.chunk END AS chunk, l.held < 3000 AND l.last > 0 AS took, CASE WHEN l.held < 3000 AND l.last > 0 THEN l.last - 1 ELSE l.last END AS final
        FROM walk w JOIN last_chunk l USING (video_id) JOIN shots s USING (video_id, scene_index)) GROUP BY video_id, chunk""",
        recursive=True,
    ),
)
def greedy_chunks(spark, sf_dir):
    return T.chunks(A.shots(spark, sf_dir))


@query(
    "chapter_split",
    A.sql(
        [
            "shots",
            "story_events",
            "durations AS (SELECT video_id, max(end_cs) AS duration_cs FROM shots GROUP BY video_id)",
            "marks AS (SELECT DISTINCT video_id, start_cs FROM story_events WHERE importance >= 6)",
            """hops AS (SELECT a.video_id, a.pos, min(m.start_cs) AS next FROM (SELECT video_id, 0 AS pos FROM durations UNION SELECT video_id, start_cs FROM marks) a JOIN marks m ON a.video_id = m.video_id AND m.start_cs - a.pos >= 30000 GROUP BY ALL)""",
            "walk AS (SELECT video_id, 0::BIGINT AS pos FROM durations UNION ALL SELECT w.video_id, h.next FROM walk w JOIN hops h ON w.video_id = h.video_id AND w.pos = h.pos)",
            """cuts AS (SELECT video_id, pos FROM walk UNION SELECT d.video_id, unnest(range(60000, d.duration_cs - 30000, 60000)) FROM durations d WHERE d.duration_cs > 120000 AND (SELECT count(*) FROM walk w WHERE w.video_id = d.video_id) = 1)""",
        ],
        "SELECT video_id, row_number() OVER w - 1 AS chapter, pos AS start_cs, coalesce(lead(pos) OVER w, duration_cs) AS end_cs FROM cuts JOIN durations USING (video_id) WINDOW w AS (PARTITION BY video_id ORDER BY pos)",
        recursive=True,
    ),
)
def chapter_split(spark, sf_dir):
    durations = A.shots(spark, sf_dir).groupBy("video_id").agg(F.max("end_cs").alias("duration_cs"))
    return T.chapters(A.story_events(spark, sf_dir), durations)


@query(
    "keyframe_grid",
    A.sql(
        "shots",
        """SELECT video_id, scene_index, n AS n_frames, round(CASE WHEN n = 1 THEN start_cs + dur_cs * 0.5::DOUBLE ELSE start_cs + dur_cs * 0.1::DOUBLE END, 4) AS first_at, round(CASE WHEN n = 1 THEN start_cs + dur_cs * 0.5::DOUBLE ELSE start_cs + dur_cs * 0.9::DOUBLE END, 4) AS last_at
        FROM (SELECT *, CAST(CASE WHEN dur_cs < 200 THEN 1 WHEN dur_cs < 500 THEN 2 WHEN dur_cs < 1500 THEN 3 ELSE least(greatest(3, dur_cs // 500), 6) END AS INTEGER) AS n FROM shots)""",
    ),
)
def keyframe_grid(spark, sf_dir):
    rows = A.shots(spark, sf_dir).withColumn("at", T.sample_grid(F.col("start_cs"), F.col("end_cs")))
    return rows.select("video_id", "scene_index", F.size("at").alias("n_frames"), F.round(F.element_at("at", 1), 4).alias("first_at"), F.round(F.element_at("at", -1), 4).alias("last_at"))


@query("dense_renumber", A.sql("shots story_events", "SELECT video_id, event_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_cs, event_id) - 1 AS INTEGER) AS event_index FROM story_events WHERE importance > 3"))
def dense_renumber(spark, sf_dir):
    return T.renumbered(A.story_events(spark, sf_dir).where("importance > 3"), "video_id", ["start_cs", "event_id"], "event_index").select("video_id", "event_id", "event_index")


_BEATS = "beats AS (SELECT video_id, scene_index // 4 AS beat, min(start_cs) AS start_cs, max(end_cs) AS end_cs, sum(dur_cs)::BIGINT AS dur_cs, list_sort(list(scene_index)) AS scene_index_ids FROM shots GROUP BY ALL)"
_SCENES = "story AS (SELECT video_id, beat // 3 AS scene, min(start_cs) AS start_cs, max(end_cs) AS end_cs, sum(dur_cs)::BIGINT AS dur_cs, list_sort(list(beat)) AS beat_ids, list_sort(list_distinct(flatten(list(scene_index_ids)))) AS scene_index_ids FROM beats GROUP BY ALL)"
_CHAPTERS = """parts AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY video_id) = 1 THEN end_cs - start_cs ELSE total END AS dur_cs FROM (
  SELECT video_id, scene // 3 AS chapter, min(start_cs) AS start_cs, max(end_cs) AS end_cs, sum(dur_cs)::BIGINT AS total, list_sort(list(scene)) AS scene_ids, list_sort(list_distinct(flatten(list(scene_index_ids)))) AS scene_index_ids FROM story GROUP BY ALL))"""


def beats(spark, sf_dir):
    return H.rolled_up(H.grouped(A.shots(spark, sf_dir), "video_id", "scene_index", 4, "beat"), "beat", "scene_index")


def story(spark, sf_dir):
    return H.rolled_up(H.grouped(beats(spark, sf_dir), "video_id", "beat", 3, "scene"), "scene", "beat", ("scene_index_ids",))


def _ids(df, *names):
    return df.select(*[F.array_join(c, ",").alias(c) if c in names else c for c in df.columns])


@query("rollup_beats", A.sql(["shots", _BEATS], "SELECT * REPLACE (array_to_string(scene_index_ids, ',') AS scene_index_ids) FROM beats"))
def rollup_beats(spark, sf_dir):
    return _ids(beats(spark, sf_dir), "scene_index_ids")


@query("rollup_scenes", A.sql(["shots", _BEATS, _SCENES], "SELECT * REPLACE (array_to_string(scene_index_ids, ',') AS scene_index_ids, array_to_string(beat_ids, ',') AS beat_ids) FROM story"))
def rollup_scenes(spark, sf_dir):
    return _ids(story(spark, sf_dir), "scene_index_ids", "beat_ids")


@query("rollup_chapters", A.sql(["shots", _BEATS, _SCENES, _CHAPTERS], "SELECT video_id, chapter, start_cs, end_cs, dur_cs, array_to_string(scene_ids, ',') AS scene_ids, len(scene_index_ids) AS n_shots FROM parts"))
def rollup_chapters(spark, sf_dir):
    out = H.rolled_up(H.grouped(story(spark, sf_dir), "video_id", "scene", 3, "chapter"), "chapter", "scene", ("scene_index_ids",), spans=True)
    return out.select("video_id", "chapter", "start_cs", "end_cs", "dur_cs", F.array_join("scene_ids", ",").alias("scene_ids"), F.size("scene_index_ids").alias("n_shots"))


_LISTED = "listed AS (SELECT video_id, scene_index // 4 AS beat, unnest([scene_index // 3 * 3 + scene_index % 2, scene_index // 3 * 3 + 6]) AS scene_index FROM shots)"


def _listed(spark, sf_dir):
    """Lists that overlap, miss some shots and name some that don't exist."""
    s = F.col("scene_index")
    third = (F.floor(s / 3) * 3).cast("int")
    return A.shots(spark, sf_dir).groupBy("video_id", F.floor(s / 4).cast("int").alias("beat")).agg(F.flatten(F.collect_list(F.array(third + s % 2, third + 6))).alias("scene_index_ids"))


@query("reverse_links", A.sql(["shots", _LISTED], "SELECT s.video_id, s.scene_index, max(l.beat) AS beat FROM shots s LEFT JOIN listed l USING (video_id, scene_index) GROUP BY ALL"))
def reverse_links(spark, sf_dir):
    return H.linked_back(A.shots(spark, sf_dir), _listed(spark, sf_dir), "beat", "scene_index").select("video_id", "scene_index", "beat")


@query("child_members", A.sql(["shots", _LISTED], "SELECT DISTINCT video_id, l.beat, scene_index FROM listed l JOIN shots s USING (video_id, scene_index)"))
def child_members(spark, sf_dir):
    return H.members(_listed(spark, sf_dir), A.shots(spark, sf_dir), "beat", "scene_index")


@query("missing_placeholders", "SELECT o_orderkey AS scene_index, coalesce(lang, 'unseen') AS description, d.doc_id IS NULL AS filled FROM orders LEFT JOIN documents d ON d.doc_id * 2 = o_orderkey UNION ALL SELECT doc_id * 2, lang, false FROM documents WHERE doc_id * 2 NOT IN (SELECT o_orderkey FROM orders)")
def missing_placeholders(spark, sf_dir):
    """Views of shots of even numbers, completed for the others."""
    views = A.table(spark, sf_dir, "documents").select((F.col("doc_id") * 2).alias("scene_index"), F.col("lang").alias("description"))
    shots = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("scene_index"))
    return H.completed(views, shots, ["scene_index"], {"description": "unseen"})
