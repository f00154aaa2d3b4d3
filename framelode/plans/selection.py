"""Queries over what is selected for a model, and over lists and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelode.functions import lists as L
from framelode.operators import entity as E
from framelode.operators import selection as S
from framelode.plans.registry import query
from framelode.sources import adapters as A

# Beats of a video are the parts of a size.
_BEATS = "beats AS (SELECT p_size AS video_id, p_partkey AS beat_index, [p_partkey % 130, p_partkey % 77, p_partkey % 130 + 1] AS shot_indices, CASE WHEN p_size % 5 = 0 THEN 0.1 ELSE (p_partkey * 7 % 100) / 100.0 END::DOUBLE AS intensity, CASE WHEN p_size % 5 = 0 THEN 'transition' WHEN p_partkey % 4 = 0 THEN 'confrontation' ELSE 'setup' END AS beat_type FROM part)"


def _beats(spark, sf_dir):
    k, v = F.col("p_partkey"), F.col("p_size")
    quiet = v % 5 == 0
    return A.table(spark, sf_dir, "part").select(
        v.alias("video_id"), k.alias("beat_index"), F.array(k % 130, k % 77, k % 130 + 1).alias("shot_indices"), F.when(quiet, 0.1).otherwise(k * 7 % 100 / 100).alias("intensity"),
        F.when(quiet, "transition").when(k % 4 == 0, "confrontation").otherwise("setup").alias("beat_type"),
    )


@query(
    "important_shots",
    A.sql(
        ["shots", "story_events", _BEATS, "wanted AS (SELECT video_id, shot_indices[1] AS scene_index FROM beats UNION SELECT video_id, shot_indices[-1] FROM beats UNION SELECT video_id, unnest([event_id % 90, event_id % 60]) FROM story_events WHERE importance >= 7)"],
        "SELECT video_id, scene_index FROM shots s WHERE EXISTS (FROM wanted w WHERE w.video_id = s.video_id AND w.scene_index = s.scene_index)",
    ),
)
def important_shots(spark, sf_dir):
    events = A.story_events(spark, sf_dir).select("video_id", "importance", F.array(F.col("event_id") % 90, F.col("event_id") % 60).alias("scene_indices"))
    return S.important_shots(A.shots(spark, sf_dir).select("video_id", "scene_index"), _beats(spark, sf_dir), events)


@query("important_beats", A.sql([_BEATS], "SELECT video_id, beat_index FROM (SELECT *, max(good) OVER (PARTITION BY video_id) AS has_good, row_number() OVER (PARTITION BY video_id ORDER BY beat_index) AS n FROM (SELECT *, intensity >= 0.5 OR beat_type IN ('confrontation', 'resolution') AS good FROM beats)) WHERE good OR (NOT has_good AND n <= 10)"))
def important_beats(spark, sf_dir):
    return S.important_beats(_beats(spark, sf_dir)).select("video_id", "beat_index")


@query(
    "events_for_prompt",
    A.sql(
        "shots story_events",
        """SELECT video_id, event_id AS event_index, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_cs, n) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY event_id) AS n FROM story_events)
        WHERE n <= 20 OR importance >= 7 OR event_id % 6 = 0) WHERE place <= 60""",
    ),
)
def events_for_prompt(spark, sf_dir):
    i = F.col("event_id")
    who = F.when(i % 6 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    rows = A.story_events(spark, sf_dir).select("video_id", i.alias("event_index"), "start_cs", "importance", who.alias("characters"))
    return S.events_for_prompt(rows).select("video_id", "event_index", "place")


@query("every_kth", "SELECT user_id AS video_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, greatest(1, count(*) OVER (PARTITION BY user_id) // 20) AS step FROM events) WHERE n % step = 0")
def every_kth(spark, sf_dir):
    return S.every_kth(A.table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "event_id"), "video_id", "event_id")


@query("frame_routing", "SELECT p_partkey, CASE WHEN p_partkey % 4 >= 2 THEN 'multi' WHEN p_partkey % 4 = 1 OR p_size % 2 = 0 THEN 'single' ELSE 'none' END AS route FROM part")
def frame_routing(spark, sf_dir):
    n = F.col("p_partkey") % 4
    paths = F.when(n > 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, "").otherwise(F.concat(F.lit("frame"), i))))
    return A.table(spark, sf_dir, "part").select("p_partkey", L.frame_route(paths, F.when(F.col("p_size") % 2 == 0, "one")).alias("route"))


@query(
    "face_order",
    A.sql("faces", "SELECT face_id, CAST(row_number() OVER (ORDER BY coalesce(try_cast(t AS DOUBLE), 0), coalesce(try_cast(s AS INTEGER), -1), keyframe::VARCHAR, round(det_score, 2), face_id) AS INTEGER) AS place FROM (SELECT *, CASE face_id % 4 WHEN 0 THEN 'bad' WHEN 1 THEN NULL ELSE (face_id % 7)::VARCHAR END AS t, CASE WHEN face_id % 3 = 0 THEN 'x' ELSE scene_index::VARCHAR END AS s FROM faces)"),
)
def face_order(spark, sf_dir):
    from pyspark.sql import Window

    i = F.col("face_id")
    t = F.when(i % 4 == 0, "bad").when(i % 4 > 1, (i % 7).cast("string"))
    s = F.when(i % 3 == 0, "x").otherwise(F.col("scene_index").cast("string"))
    key = S.face_order(t, s, F.col("keyframe").cast("string"), F.array(F.col("det_score").cast("string")))
    # one video's faces
    return A.faces(spark, sf_dir).select("face_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(key, "face_id")).alias("place"))


_TIERED = "tiered AS (SELECT label, CASE label % 3 WHEN 0 THEN 'passerby' WHEN 1 THEN 'major' ELSE 'minor' END AS tier FROM (SELECT DISTINCT label FROM faces))"


def _tiered(spark, sf_dir):
    k = F.col("label") % 3
    return A.faces(spark, sf_dir).select("label").distinct().withColumn("tier", F.when(k == 0, "passerby").when(k == 1, "major").otherwise("minor"))


@query("gallery_faces", A.sql(["faces", _TIERED], "SELECT label, face_id, CAST(place AS INTEGER) AS place FROM (SELECT label, face_id, tier, row_number() OVER (PARTITION BY label ORDER BY det_score DESC, face_id) AS place FROM faces JOIN tiered USING (label)) WHERE place <= CASE WHEN tier = 'passerby' THEN 1 ELSE 6 END"))
def gallery_faces(spark, sf_dir):
    return S.gallery_faces(A.faces(spark, sf_dir), "label", _tiered(spark, sf_dir)).select("label", "face_id", "place")


@query("tier_counts", A.sql(["faces", _TIERED], "SELECT count(*) FILTER (tier = 'major') AS major, count(*) FILTER (tier = 'minor') AS minor, count(*) FILTER (tier = 'passerby') AS passerby, count(*) AS total FROM tiered"))
def tier_counts(spark, sf_dir):
    return S.tier_counts(_tiered(spark, sf_dir))


@query("without_passersby", A.sql(["faces", _TIERED], "SELECT label, tier FROM tiered WHERE tier <> 'passerby'"))
def without_passersby(spark, sf_dir):
    return S.without_passersby(_tiered(spark, sf_dir)).select("label", "tier")


@query("speakers_applied", A.sql("transcripts", "SELECT scene_index, pos, CASE WHEN speaker = 'user' THEN 'char_1' WHEN pos % 2 = 0 THEN 'char_' || pos END AS character FROM transcripts"))
def speakers_applied(spark, sf_dir):
    mapping = spark.sql("SELECT * FROM VALUES ('user', 'char_1'), ('assistant', NULL), ('nobody', 'char_2') AS m(speaker, mapped)")
    rows = A.transcripts(spark, sf_dir).withColumn("character", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("char_"), "pos")))
    return E.with_speakers(rows, mapping).select("scene_index", "pos", "character")


@query("speaker_ids", "SELECT c_custkey AS character, array_to_string(list_sort(list_distinct(list_concat(['own'], coalesce(bound, [])))), ',') AS speaker_ids FROM customer LEFT JOIN (SELECT o_custkey, list('s' || o_orderkey % 40) AS bound FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1) ON o_custkey = c_custkey")
def speaker_ids(spark, sf_dir):
    i = F.col("o_orderkey")
    mapping = A.table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), i % 40).alias("speaker"), F.when(i % 5 > 0, F.col("o_custkey")).alias("mapped"))
    rows = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("character"), F.array(F.lit("own")).alias("speaker_ids"))
    return E.with_speaker_ids(rows, mapping).select("character", F.array_join("speaker_ids", ",").alias("speaker_ids"))


@query(
    "relation_graph",
    A.sql(
        [
            "appearances", "related AS (SELECT DISTINCT l_suppkey AS a, (l_suppkey * 7 + l_linenumber) % 120 AS b FROM lineitem)",
            "known AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 6 > 0)", "shared AS (SELECT r.a, r.b, list(x.shot ORDER BY x.shot) AS shots FROM related r JOIN appearances x ON x.character = r.a JOIN appearances y ON y.character = r.b AND y.shot = x.shot GROUP BY ALL)",
        ],
        "SELECT a AS character_a, b AS character_b, coalesce(array_to_string(shots, ','), '') AS shots FROM related LEFT JOIN shared USING (a, b) WHERE a IN (FROM known) AND b IN (FROM known)",
    ),
)
def relation_graph(spark, sf_dir):
    name = lambda c: F.concat(F.when(c % 6 > 0, "char_").otherwise("char_tmp_"), c)
    k = F.col("l_suppkey")
    relations = A.table(spark, sf_dir, "lineitem").select(name(k).alias("character_a"), name((k * 7 + F.col("l_linenumber")) % 120).alias("character_b")).distinct()
    cast = A.table(spark, sf_dir, "supplier").select(F.lit(1).alias("video_id"), name(F.col("s_suppkey")).alias("character"))
    out = S.relation_graph(relations, cast, A.appearances(spark, sf_dir).select(name(F.col("character")).alias("character"), "shot"))
    number = lambda c: F.substring_index(c, "_", -1).cast("long").alias(c)
    return out.select(number("character_a"), number("character_b"), F.array_join(F.col("co_appearance_shots").cast("array<string>"), ",").alias("shots"))


@query("companions", A.sql("appearances", "SELECT a.character, count(DISTINCT b.character) AS n, min(b.character) AS first, max(b.character) AS last FROM appearances a JOIN appearances b ON a.shot = b.shot AND a.character <> b.character GROUP BY a.character"))
def companions(spark, sf_dir):
    return S.companions(A.appearances(spark, sf_dir, once=False)).select("character", F.size("others").cast("long").alias("n"), F.element_at("others", 1).alias("first"), F.element_at("others", -1).alias("last"))


@query("roster_whitelist", "SELECT p_partkey, array_to_string(CASE WHEN p_size % 3 = 0 THEN ['char_' || p_size, 'made_up', 'unknown_4'] ELSE list_filter(['char_' || p_size, 'unknown_4'], lambda x: x <> 'char_' || 1 AND (x = 'unknown_4' OR p_size < 25)) END, ',') AS kept FROM part")
def roster_whitelist(spark, sf_dir):
    own = F.concat(F.lit("char_"), "p_size")
    ids = F.array(own, F.lit("made_up"), F.lit(" "), F.lit("unknown_4"), F.lit(None).cast("string"))
    roster = F.when(F.col("p_size") % 3 > 0, F.array(*[F.lit(f"char_{i}") for i in range(2, 25)]))
    return A.table(spark, sf_dir, "part").select("p_partkey", F.array_join(L.whitelisted(ids, roster), ",").alias("kept"))


@query(
    "text_lists",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN event_type || '|7|named' WHEN 1 THEN event_type WHEN 2 THEN '12' WHEN 3 THEN event_type WHEN 4 THEN '' WHEN 5 THEN '' WHEN 6 THEN 'label' ELSE '' END AS texts FROM events""",
)
def text_lists(spark, sf_dir):
    i, kind = F.col("event_id") % 8, F.col("event_type")
    value = (
        F.when(i == 0, F.concat(F.lit('[" '), kind, F.lit(' ", null, 7, "", {"name": "named", "text": ""}]'))).when(i == 1, F.concat(F.lit('"'), kind, F.lit('"'))).when(i == 2, "12").when(i == 3, F.concat(F.lit('{"text": "'), kind, F.lit('"}')))
        .when(i == 4, "null").when(i == 5, "[]").when(i == 6, '[{"label": "label"}]')
    )
    return A.table(spark, sf_dir, "events").select("event_id", F.array_join(L.text_list(value), "|").alias("texts"))


@query("gallery_zip", "SELECT p_partkey, 'p' || i AS path, CASE WHEN i <= p_size % 3 THEN i * 1.5 ELSE 0 END::DOUBLE AS timestamp, CASE WHEN i <= p_size % 2 THEN p_size ELSE -1 END AS scene, i - 1 AS place FROM part, range(1, 4) r(i)")
def gallery_zip(spark, sf_dir):
    size = F.col("p_size")
    none = F.array().cast("array<double>")
    times = F.when(size % 3 == 0, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(size % 3, F.lit(1))), lambda i: i * 1.5))
    scenes = F.when(size % 2 == 1, F.array(size)).otherwise(F.array().cast("array<int>"))
    rows = L.zipped(F.array(F.lit("p1"), F.lit("p2"), F.lit("p3")), times, scenes.cast("array<int>"))
    return A.table(spark, sf_dir, "part").select("p_partkey", F.posexplode(rows).alias("place", "x")).select("p_partkey", "x.path", "x.timestamp", "x.scene", "place")


@query("first_filled", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE 'rest' END AS first FROM orders")
def first_filled(spark, sf_dir):
    i = F.col("o_orderkey")
    return A.table(spark, sf_dir, "orders").select("o_orderkey", L.first_filled(F.array(F.when(i % 3 == 0, F.col("o_orderstatus")).otherwise(""), F.when(i % 5 == 0, F.col("o_orderpriority")), F.lit("rest"))).alias("first"))


@query("valid_entries", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'a' ELSE '' END || CASE WHEN c_nationkey < 20 THEN 'b' ELSE '' END AS kept FROM customer")
def valid_entries(spark, sf_dir):
    known = F.array(F.lit("char_0"), *[F.lit(f"n{i}") for i in range(20)])
    mapping = F.create_map(F.lit("a"), F.concat(F.lit("char_"), F.col("c_custkey") % 4), F.lit("b"), F.concat(F.lit("n"), "c_nationkey"), F.lit("c"), F.lit(None).cast("string"))
    return A.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(F.map_keys(L.valid_entries(mapping, known))), "").alias("kept"))


@query(
    "profile_context",
    """SELECT user_id AS character, array_to_string(list_distinct_ordered, ';') AS last_types FROM (SELECT user_id, list(event_type ORDER BY first DESC)[1:4] AS l, list_reverse(list(event_type ORDER BY first DESC)[1:4]) AS list_distinct_ordered
    FROM (SELECT user_id, event_type, min(event_id) AS first FROM events WHERE event_type <> 'view' GROUP BY ALL) GROUP BY user_id)""",
)
def profile_context(spark, sf_dir):
    """The last four distinct things that say something."""
    said = F.when(F.col("event_type") == "view", " N/A. ").otherwise(F.col("event_type"))
    rows = A.table(spark, sf_dir, "events").select("user_id", "event_id", said.alias("said")).groupBy(F.col("user_id").alias("character")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "said"))), lambda x: x["said"]).alias("said"))
    return rows.select("character", F.array_join(L.last_valid(F.col("said"), 4), ";").alias("last_types")).where("last_types <> ''")


@query(
    "chapters_merged",
    """SELECT plan_id, CAST(row_number() OVER w - 1 AS INTEGER) AS clip_index, scene_index, low AS source_start, high AS source_end, round(sum((high - low) / speed) OVER w, 6) AS timeline_end FROM (
    SELECT *, CASE WHEN least(b, scene_index * 100 + 100) <= greatest(a, scene_index * 100) THEN scene_index * 100 ELSE greatest(a, scene_index * 100) END AS low, CASE WHEN least(b, scene_index * 100 + 100) <= greatest(a, scene_index * 100) THEN scene_index * 100 + 100 ELSE least(b, scene_index * 100 + 100) END AS high
    FROM (SELECT o_custkey AS plan_id, o_orderkey % 4 AS chapter, o_orderkey AS position, o_orderkey % 130 AS scene_index, o_orderkey % 130 * 100 - 20 + o_orderkey % 50 AS a, o_orderkey % 130 * 100 + o_orderkey % 150 AS b, CASE WHEN o_orderkey % 3 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS speed FROM orders) WHERE scene_index IN (SELECT s_suppkey FROM supplier))
    WINDOW w AS (PARTITION BY plan_id ORDER BY chapter, position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def chapters_merged(spark, sf_dir):
    i, scene = F.col("o_orderkey"), F.col("o_orderkey") % 130
    clips = A.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("plan_id"), (i % 4).alias("chapter_index"), i.alias("position"), scene.alias("scene_index"), (scene * 100 - 20 + i % 50).alias("source_start"), (scene * 100 + i % 150).alias("source_end"), F.when(i % 3 == 0, 2.0).otherwise(1.0).alias("speed")
    )
    k = F.col("s_suppkey")
    shots = A.table(spark, sf_dir, "supplier").select(k.alias("scene_index"), (k * 100).alias("start_cs"), (k * 100 + 100).alias("end_cs"))
    return S.chapters_merged(clips, shots).select("plan_id", "clip_index", "scene_index", "source_start", "source_end", F.round("timeline_end", 6).alias("timeline_end"))


@query("shot_boundaries", "SELECT user_id AS video_id, event_id AS frame, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS scene_index FROM (SELECT *, coalesce((abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) > 27)::INT, 0) AS cut FROM events)")
def shot_boundaries(spark, sf_dir):
    return S.shot_boundaries(A.table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame"), F.col("value").alias("metric"))).select("video_id", "frame", "scene_index")
