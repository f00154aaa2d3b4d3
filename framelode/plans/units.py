"""Queries over fused units and their indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelode.operators import fusion as U
from framelode.operators import index as I
from framelode.operators import prompts as M
from framelode.plans.registry import query
from framelode.sources import adapters as A

# A shot is an order; its sides come from other tables by the order's number.
_SIDES = [
    "t AS (SELECT conv_id AS scene_index, list(text ORDER BY turn) AS lines FROM conversations GROUP BY conv_id)",
    """v AS (SELECT scene_index, arg_max({'description': description, 'mood': mood, 'scene_type': scene_type, 'objects': objects, 'action': action}, pos) AS v FROM (SELECT p_partkey % 700 AS scene_index, p_partkey AS pos, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_type END AS description,
      CASE WHEN p_size % 4 = 0 THEN '' ELSE lower(p_brand) END AS mood, CASE WHEN p_size % 5 > 0 THEN p_name END AS scene_type, CASE WHEN p_size % 3 = 0 THEN [p_brand, 'thing'] ELSE [] END AS objects, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS action FROM part) GROUP BY scene_index)""",
    "o AS (SELECT s_suppkey * 3 AS scene_index, CASE WHEN s_suppkey % 4 = 0 THEN [] ELSE [s_name, 'sign'] END AS texts FROM supplier)",
    "c AS (SELECT l_orderkey AS scene_index, list_sort(list_distinct(list('char_' || l_suppkey))) AS characters FROM lineitem GROUP BY 1)",
    "e AS (SELECT event_id % 1000 AS scene_index, list({'event_id': event_id, 'event_type': event_type, 'description': event_type || ' of ' || user_id} ORDER BY event_id) AS events FROM events GROUP BY 1)",
    """a AS (SELECT scene_index, arg_max({'has_music': has_music, 'music_mood': music_mood, 'has_sfx': has_sfx, 'sfx_tags': sfx_tags, 'speech_emotion': speech_emotion, 'silence': silence}, pos) AS a FROM (SELECT c_custkey % 1200 AS scene_index, c_custkey AS pos, c_custkey % 3 <> 1 AS has_music, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE '' END AS music_mood,
      c_custkey % 4 = 0 AS has_sfx, ['bell', 'tag' || c_custkey % 3, 'third', 'fourth'] AS sfx_tags, CASE WHEN c_custkey % 5 = 0 THEN 'calm' ELSE '' END AS speech_emotion, (c_custkey * 13 % 100) / 100.0::DOUBLE AS silence FROM customer) GROUP BY scene_index)""",
    "s AS (SELECT doc_id AS scene_index, max(toxic)::DOUBLE AS hook FROM labels GROUP BY doc_id)",
    "l AS (SELECT p_partkey AS scene_index, CASE WHEN p_size % 2 = 0 THEN 'speech' ELSE 'visual' END AS dominant_modality FROM part)",
    "ch AS (SELECT o_orderkey AS scene_index, max(n_nationkey) AS chapter_index FROM orders, nation WHERE o_orderkey % 25 IN (n_nationkey, n_nationkey + 1) GROUP BY 1)",
    """units AS (SELECT o_orderkey AS scene_index, o_custkey AS video_id, coalesce(lines, []) AS lines, v IS NOT NULL AS has_vision, v.description, v.mood, v.scene_type, v.objects, v.action, o.texts, coalesce(characters, []) AS characters, coalesce(events, []) AS events,
      a IS NOT NULL AS has_audio, a.has_music, a.music_mood, a.has_sfx, a.sfx_tags, a.speech_emotion, a.silence, s.hook, l.dominant_modality, ch.chapter_index
      FROM orders LEFT JOIN t ON t.scene_index = o_orderkey LEFT JOIN v ON v.scene_index = o_orderkey LEFT JOIN o ON o.scene_index = o_orderkey LEFT JOIN c ON c.scene_index = o_orderkey LEFT JOIN e ON e.scene_index = o_orderkey LEFT JOIN a ON a.scene_index = o_orderkey
      LEFT JOIN s ON s.scene_index = o_orderkey LEFT JOIN l ON l.scene_index = o_orderkey LEFT JOIN ch ON ch.scene_index = o_orderkey)""",
]


def units(spark, sf_dir, dealt=lambda rows: rows):
    """``dealt``: what is done to each table that has scenes."""
    read, col, lit = lambda name: A.table(spark, sf_dir, name), F.col, F.lit
    shots = read("orders").select(col("o_orderkey").alias("scene_index"), col("o_custkey").alias("video_id"))
    lines = read("conversations").select(col("conv_id").alias("scene_index"), col("turn").alias("pos"), "text")
    size = col("p_size")
    none = F.array().cast("array<string>")
    vision = read("part").select(
        (col("p_partkey") % 700).alias("scene_index"), col("p_partkey").alias("pos"), F.when(size % 9 == 0, "").otherwise(col("p_type")).alias("description"), F.when(size % 4 == 0, "").otherwise(F.lower("p_brand")).alias("mood"),
        F.when(size % 5 > 0, col("p_name")).alias("scene_type"), F.when(size % 3 == 0, F.array("p_brand", lit("thing"))).otherwise(none).alias("objects"), F.when(size > 25, col("p_brand")).otherwise("").alias("action"),
    )
    k = col("s_suppkey")
    ocr = read("supplier").select((k * 3).alias("scene_index"), lit(0).alias("pos"), F.when(k % 4 == 0, none).otherwise(F.array("s_name", lit("sign"))).alias("texts"))
    who = read("lineitem").select(col("l_orderkey").alias("scene_index"), F.concat(lit("char_"), "l_suppkey").alias("character"))
    events = read("events").select((col("event_id") % 1000).alias("scene_index"), "event_id", "event_type", F.concat("event_type", lit(" of "), "user_id").alias("description"))
    i = col("c_custkey")
    audio = read("customer").select(
        (i % 1200).alias("scene_index"), i.alias("pos"), (i % 3 != 1).alias("has_music"), F.when(i % 3 == 0, F.lower("c_mktsegment")).otherwise("").alias("music_mood"), (i % 4 == 0).alias("has_sfx"),
        F.array(lit("bell"), F.concat(lit("tag"), i % 3), lit("third"), lit("fourth")).alias("sfx_tags"), F.when(i % 5 == 0, "calm").otherwise("").alias("speech_emotion"), (i * 13 % 100 / 100).alias("silence"),
    )
    signals = read("labels").groupBy(col("doc_id").alias("scene_index")).agg(F.create_map(lit("hook_score"), F.max("toxic").cast("double")).alias("scores")).withColumn("pos", lit(0))
    alignments = read("part").select(col("p_partkey").alias("scene_index"), lit(0).alias("pos"), F.when(size % 2 == 0, "speech").otherwise("visual").alias("dominant_modality"))
    number = col("n_nationkey")
    listed = read("orders").select(col("o_orderkey").alias("shot"), F.explode(F.array(col("o_orderkey") % 25, col("o_orderkey") % 25 - 1)).alias("n_nationkey"))
    chapters = listed.join(read("nation"), "n_nationkey", "left_semi").groupBy(number.alias("chapter_index")).agg(F.collect_list("shot").alias("shot_indices"))
    sides = {"vision": vision, "ocr": ocr, "audio": audio, "signals": signals, "alignments": alignments}
    return U.fused(*map(dealt, (shots, lines, who, events, chapters)), **{name: dealt(rows) for name, rows in sides.items()})


def to_three_videos(rows):
    """Scenes dealt to three videos, whose numbers clash."""
    if "shot_indices" in rows.columns:
        each = rows.withColumn("scene_index", F.explode("shot_indices")).drop("shot_indices")
        return to_three_videos(each).groupBy("video_id", "chapter_index").agg(F.collect_list("scene_index").alias("shot_indices"))
    s = F.col("scene_index")
    return rows.withColumn("video_id", s % 3).withColumn("scene_index", F.floor(s / 3))


@query(
    "memory_unit_fusion",
    A.sql(
        _SIDES,
        """SELECT scene_index, video_id, md5(array_to_string(lines, '/')) AS lines, description, mood, scene_type, array_to_string(objects, ',') AS objects, action, array_to_string(texts, ',') AS texts, array_to_string(characters, ',') AS characters,
        array_to_string(list_transform(events, lambda e: e.event_id), ',') AS event_ids, has_music, music_mood, has_sfx, speech_emotion, silence, hook, dominant_modality, chapter_index FROM units""",
    ),
)
def memory_unit_fusion(spark, sf_dir):
    joined = lambda c: F.array_join(c, ",").alias(c)
    ids = F.transform("events", lambda e: e["event_id"].cast("string"))
    return units(spark, sf_dir).select(
        "scene_index", "video_id", F.md5(F.array_join("lines", "/")).alias("lines"), "description", "mood", "scene_type", joined("objects"), "action", joined("texts"), joined("characters"), F.array_join(ids, ",").alias("event_ids"),
        "has_music", "music_mood", "has_sfx", "speech_emotion", "silence", F.col("scores")["hook_score"].alias("hook"), "dominant_modality", "chapter_index",
    )


_TEXT = """(SELECT *, concat_ws(' | ', CASE WHEN len(lines) > 0 THEN '台词: ' || array_to_string(lines, ' ') END, CASE WHEN has_vision THEN '画面: ' || coalesce(description, '') END, CASE WHEN mood <> '' THEN '情绪: ' || mood END, CASE WHEN scene_type <> '' THEN '类型: ' || scene_type END,
  CASE WHEN len(objects) > 0 THEN '物体: ' || array_to_string(objects, ', ') END, CASE WHEN action <> '' THEN '动作: ' || action END, CASE WHEN len(texts) > 0 THEN '文字: ' || array_to_string(texts, ', ') END,
  CASE WHEN len(events) > 0 THEN array_to_string(list_transform(events, lambda e: '事件[' || e.event_type || ']: ' || e.description), ' | ') END, CASE WHEN len(characters) > 0 THEN '人物: ' || array_to_string(characters, ', ') END) AS body,
  list_filter([CASE WHEN has_music THEN '音乐:' || music_mood END, CASE WHEN has_sfx THEN '音效:' || array_to_string(sfx_tags[1:3], ',') END, CASE WHEN speech_emotion <> '' THEN '语音情绪:' || speech_emotion END], lambda x: x IS NOT NULL) AS heard FROM units)"""
_COMBINED = f"combined AS (SELECT scene_index, lines, description, characters, body || CASE WHEN len(heard) > 0 THEN ' | 音频: ' || array_to_string(heard, ', ') ELSE '' END AS combined_text FROM {_TEXT})"


@query("combined_text", A.sql([*_SIDES, _COMBINED], "SELECT scene_index, combined_text FROM combined"))
def combined_text(spark, sf_dir):
    return units(spark, sf_dir).select("scene_index", U.combined_text().alias("combined_text"))


@query("collection_units", A.sql([*_SIDES, _COMBINED, "placed AS (SELECT scene_index, chapter_index FROM units)"], "SELECT CAST(scene_index % 3 AS BIGINT) AS video_id, CAST(scene_index // 3 AS BIGINT) AS scene_index, md5(combined_text) AS text_md5, chapter_index FROM combined JOIN placed USING (scene_index)"))
def collection_units(spark, sf_dir):
    """The units of three videos with clashing scene numbers, in one call."""
    rows = units(spark, sf_dir, to_three_videos)
    return rows.select("video_id", "scene_index", F.md5(U.combined_text()).alias("text_md5"), "chapter_index")


_SPEAKING = "speaking AS (SELECT conv_id AS scene_index, list_distinct(list(who)) AS speaking, list(who ORDER BY turn) AS every FROM (SELECT *, CASE WHEN role = 'user' THEN 'char_' || (conv_id % 60 + 1) WHEN turn % 3 > 0 THEN 'char_' || (turn * 7 % 90) END AS who FROM conversations) WHERE who IS NOT NULL GROUP BY conv_id)"


@query(
    "alignment_rules",
    A.sql(
        [*_SIDES, _SPEAKING, "users AS (SELECT DISTINCT conv_id AS scene_index FROM conversations WHERE role = 'user')"],
        """SELECT scene_index, CASE WHEN mapped IS NOT NULL THEN 'user=char_' || (scene_index % 60 + 1) ELSE '' END AS pairs, array_to_string(list_sort(speaking), ',') AS speaking, array_to_string(characters, ',') AS visible,
        array_to_string(list_filter([CASE WHEN n > 0 THEN 'speech' END, CASE WHEN action <> '' THEN 'visual_action' END, CASE WHEN has_music THEN 'music' END, CASE WHEN has_sfx THEN 'sfx' END, CASE WHEN silence > 0.8 THEN 'silence' END], lambda x: x IS NOT NULL), ',') AS active,
        CASE WHEN silence > 0.8 THEN 'silence' WHEN n >= 2 THEN 'speech' WHEN has_music AND n = 0 THEN 'music' WHEN action <> '' THEN 'visual_action' WHEN n > 0 THEN 'speech' ELSE 'visual' END AS dominant,
        CASE WHEN n > 0 THEN 'speech' WHEN has_music THEN 'music' ELSE 'visual' END AS dominant_in_chunk,
        round(least(1.0::DOUBLE, 0.5::DOUBLE + len(list_intersect(characters, speaking)) * 0.15::DOUBLE + (has_audio::INT + has_vision::INT + (n > 0)::INT) * 0.1::DOUBLE), 2) AS confidence,
        CASE WHEN len(gone) > 0 THEN '说话者不在画面中: ' || array_to_string(list_sort(gone), ',') || '（可能是画外音/旁白）' ELSE '' END AS notes
        FROM (SELECT *, len(lines) AS n, list_filter(speaking, lambda x: NOT list_contains(characters, x)) AS gone FROM (SELECT units.*, coalesce(speaking, []) AS speaking, users.scene_index AS mapped FROM units LEFT JOIN speaking USING (scene_index) LEFT JOIN users USING (scene_index)))""",
    ),
)
def alignment_rules(spark, sf_dir):
    rows = units(spark, sf_dir)
    col = F.col
    # speakers are of one conversation, so that each has a character of its own
    lines = A.transcripts(spark, sf_dir).select(
        "scene_index", "pos", F.concat("speaker", F.lit("@"), "scene_index").alias("speaker"), F.when(col("speaker") != "user", F.when(col("pos") % 3 > 0, F.concat(F.lit("char_"), col("pos") * 7 % 90))).alias("character")
    )
    bound = lines.where("speaker LIKE 'user@%'").select("speaker", F.concat(F.lit("char_"), col("scene_index") % 60 + 1).alias("mapped")).distinct()
    out = U.aligned(rows, lines, bound)
    n, music = F.size("lines"), F.coalesce("has_music", F.lit(False))
    short = rows.select("scene_index", U.dominant_in_chunk(n, music).alias("dominant_in_chunk"))
    gone = F.array_sort(F.array_except("speaking_characters", "visible_characters"))
    in_order = F.when(F.size(gone) > 0, F.concat(F.lit(U.UNSEEN), F.array_join(gone, ","), F.lit(U.VOICE_OVER))).otherwise(F.col("notes"))
    return out.join(short, "scene_index").select(
        "scene_index", F.regexp_replace("speaker_to_character", "@[0-9]+", "").alias("pairs"), F.array_join(F.array_sort("speaking_characters"), ",").alias("speaking"), F.array_join("visible_characters", ",").alias("visible"),
        F.array_join("active_modalities", ",").alias("active"), col("dominant_modality").alias("dominant"), "dominant_in_chunk", col("alignment_confidence").alias("confidence"), in_order.alias("notes"),
    )


# Beats are parts, story scenes suppliers, chapters nations.
_BEATS = "beats AS (SELECT p_partkey AS beat_index, split_part(p_type, ' ', 1) AS beat_type, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS description, CASE WHEN p_size % 2 = 0 THEN lower(p_brand) ELSE '' END AS emotion, CASE WHEN p_size % 3 = 0 THEN [] ELSE ['char_' || p_size, 'char_' || (p_size + 1)] END AS characters, [p_partkey % 130, p_partkey % 77, p_partkey % 130 + 1] AS shots FROM part)"
_STORY = "story AS (SELECT s_suppkey AS scene, s_nationkey, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'story ' || s_name END AS description, CASE WHEN s_suppkey % 3 = 0 THEN n_name ELSE '' END AS location, CASE s_suppkey % 3 WHEN 0 THEN 'setup' WHEN 1 THEN 'climax' ELSE '' END AS plot_function, CASE WHEN s_suppkey % 4 = 0 THEN [] ELSE ['lead', 'char_' || s_suppkey] END AS characters, [s_suppkey, s_suppkey + 7, s_suppkey + 3, -5, s_suppkey + 11, s_suppkey + 2, s_suppkey + 14, s_suppkey + 21] AS beat_list FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey)"


def _beats(spark, sf_dir):
    k, size, lit = F.col("p_partkey"), F.col("p_size"), F.lit
    none = F.array().cast("array<string>")
    return A.table(spark, sf_dir, "part").select(
        k.alias("beat_index"), F.split_part("p_type", lit(" "), lit(1)).alias("beat_type"), F.when(size % 7 == 0, "").otherwise(F.col("p_name")).alias("description"), F.when(size % 2 == 0, F.lower("p_brand")).otherwise("").alias("emotion"),
        F.when(size % 3 == 0, none).otherwise(F.array(F.concat(lit("char_"), size), F.concat(lit("char_"), size + 1))).alias("characters"), F.array(k % 130, k % 77, k % 130 + 1).alias("shot_indices"),
    )


def _story(spark, sf_dir):
    k, lit = F.col("s_suppkey"), F.lit
    rows = A.table(spark, sf_dir, "supplier").join(A.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.select(
        k.alias("story_scene_index"), "s_nationkey", F.when(k % 5 == 0, "").otherwise(F.concat(lit("story "), "s_name")).alias("description"), F.when(k % 3 == 0, F.col("n_name")).otherwise("").alias("location"),
        F.when(k % 3 == 0, "setup").when(k % 3 == 1, "climax").otherwise("").alias("plot_function"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(lit("lead"), F.concat(lit("char_"), k))).alias("characters"),
        F.array(k, k + 7, k + 3, lit(-5), k + 11, k + 2, k + 14, k + 21).alias("beat_indices"),
    )


@query(
    "beat_units",
    A.sql(
        [
            _BEATS, "place AS (SELECT beat_index, unnest(shots) AS scene_index, generate_subscripts(shots, 1) AS place FROM beats)",
            "said AS (SELECT beat_index, array_to_string(list(text ORDER BY place, turn)[1:10], ' ') AS said FROM place JOIN conversations ON conv_id = scene_index GROUP BY 1)",
            "seen AS (SELECT beat_index, array_to_string(list_transform(list(left(text, 50) ORDER BY place)[1:5], lambda x: x), '; ') AS seen FROM place JOIN documents ON doc_id = scene_index GROUP BY 1)",
        ],
        """SELECT beat_index, coalesce(left(said, 500), '') AS transcript_summary, concat_ws(' | ', CASE WHEN description <> '' THEN '节拍: ' || description END, CASE WHEN beat_type <> '' THEN '类型: ' || beat_type END, CASE WHEN said <> '' THEN '台词: ' || left(said, 200) END,
        CASE WHEN seen IS NOT NULL THEN '画面: ' || seen END, CASE WHEN emotion <> '' THEN '情绪: ' || emotion END, CASE WHEN len(characters) > 0 THEN '人物: ' || array_to_string(characters, ', ') END) AS combined_text FROM beats LEFT JOIN said USING (beat_index) LEFT JOIN seen USING (beat_index)""",
    ),
)
def beat_units(spark, sf_dir):
    vision = A.scenes(spark, sf_dir).withColumn("pos", F.lit(0))
    return U.beat_units(_beats(spark, sf_dir), A.transcripts(spark, sf_dir), vision).select("beat_index", "transcript_summary", "combined_text")


@query(
    "scene_units",
    A.sql(
        [
            _BEATS, _STORY, "place AS (SELECT scene, unnest(beat_list) AS beat_index, generate_subscripts(beat_list, 1) AS place FROM story)",
            "kids AS (SELECT scene, list('[' || beat_type || '] ' || description ORDER BY place) FILTER (description <> '') AS descs, list_sort(list_distinct(flatten(list(characters)))) AS who FROM place JOIN beats USING (beat_index) GROUP BY 1)",
        ],
        """SELECT scene AS story_scene_index, array_to_string(CASE WHEN len(characters) > 0 THEN characters ELSE coalesce(who, []) END, ',') AS characters, concat_ws(' | ', CASE WHEN description <> '' THEN '场景: ' || description END, CASE WHEN location <> '' THEN '地点: ' || location END,
        CASE WHEN plot_function <> '' THEN '功能: ' || plot_function END, CASE WHEN len(descs) > 0 THEN '节拍: ' || array_to_string(descs[1:5], '; ') END, CASE WHEN len(characters) > 0 THEN '人物: ' || array_to_string(characters, ', ') END) AS combined_text FROM story LEFT JOIN kids USING (scene)""",
    ),
)
def scene_units(spark, sf_dir):
    return U.scene_units(_story(spark, sf_dir), _beats(spark, sf_dir)).select("story_scene_index", F.array_join("characters", ",").alias("characters"), "combined_text")


_CHAPTERS = "chapters AS (SELECT n_nationkey AS chapter, CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE n_name END AS title, 'about ' || r_name AS description, CASE WHEN n_nationkey % 2 = 0 THEN 'war' ELSE '' END AS theme, 'part ' || n_nationkey % 3 AS chapter_type, CASE WHEN n_nationkey % 4 = 0 THEN [] ELSE list_transform(range(7), lambda i: 'char_' || i) END AS characters, 'dark' AS mood FROM nation JOIN region ON r_regionkey = n_regionkey)"


def _chapters(spark, sf_dir):
    n, lit = F.col("n_nationkey"), F.lit
    scenes = A.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("story_scene_indices"))
    rows = A.table(spark, sf_dir, "nation").join(A.table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).join(scenes, "n_nationkey", "left")
    seven = F.array(*[lit(f"char_{i}") for i in range(7)])
    return rows.select(
        n.alias("chapter_index"), F.coalesce("story_scene_indices", F.array().cast("array<long>")).alias("story_scene_indices"), F.when(n % 6 == 0, "").otherwise(F.col("n_name")).alias("title"), F.concat(lit("about "), "r_name").alias("description"),
        F.when(n % 2 == 0, "war").otherwise("").alias("theme"), F.concat(lit("part "), n % 3).alias("chapter_type"), F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(seven).alias("characters"), lit("dark").alias("mood_progression"),
    )


@query(
    "chapter_units",
    A.sql(
        [_STORY, _CHAPTERS, "kids AS (SELECT s_nationkey AS chapter, list('[' || plot_function || '] ' || description ORDER BY scene) FILTER (description <> '') AS descs, list_sort(list_distinct(flatten(list(characters)))) AS who FROM story GROUP BY 1)"],
        """SELECT chapter AS chapter_index, array_to_string(CASE WHEN len(characters) > 0 THEN characters ELSE coalesce(who, []) END, ',') AS characters, concat_ws(' | ', CASE WHEN title <> '' THEN '章节: ' || title END, '内容: ' || description, CASE WHEN theme <> '' THEN '主题: ' || theme END, '类型: ' || chapter_type,
        CASE WHEN len(descs) > 0 THEN '场景: ' || array_to_string(descs[1:5], '; ') END, CASE WHEN len(characters) > 0 THEN '人物: ' || array_to_string(characters[1:5], ', ') END, '情绪: ' || mood) AS combined_text FROM chapters LEFT JOIN kids USING (chapter)""",
    ),
)
def chapter_units(spark, sf_dir):
    return U.chapter_units(_chapters(spark, sf_dir), _story(spark, sf_dir)).select("chapter_index", F.array_join("characters", ",").alias("characters"), "combined_text")


_LINES = "lines AS (SELECT s.scene_index, string_agg(o_orderpriority || ' L' || o_orderkey, ' ' ORDER BY o_orderkey) AS said FROM orders JOIN bare s ON o_orderkey * 40 >= s.start_cs AND o_orderkey * 40 < s.end_cs GROUP BY 1)"


@query(
    "text_index",
    A.sql(
        [
            "scene AS (SELECT doc_id AS scene_index, doc_id * 700 AS start_cs, doc_id * 700 + 700 AS end_cs FROM documents)", "bare AS (FROM scene WHERE scene_index NOT IN (SELECT conv_id FROM conversations))", _LINES,
            "happens AS (SELECT s.scene_index, string_agg('ev ' || event_type, ' ' ORDER BY event_id) AS evs FROM events JOIN bare s ON event_id * 90 < s.end_cs AND event_id * 90 + 100 > s.start_cs GROUP BY 1)",
            "who AS (SELECT s_suppkey * 3 AS scene_index, list_sort(list_distinct(list(s_name))) AS who FROM supplier GROUP BY 1)",
            "unit AS (SELECT conv_id AS scene_index, string_agg(text, ' ' ORDER BY turn) AS combined_text FROM conversations GROUP BY 1)",
            """entries AS (SELECT scene_index, combined_text, left(combined_text, 30) AS transcript, 'v' AS view, 'nobody' AS who FROM unit JOIN scene USING (scene_index) UNION ALL
              SELECT scene_index, concat_ws(' ', nullif(said, ''), nullif(d.lang, ''), nullif(d.source, ''), evs), coalesce(said, ''), coalesce(d.lang, ''), coalesce(array_to_string(who, ','), '') FROM bare LEFT JOIN lines USING (scene_index) LEFT JOIN happens USING (scene_index) LEFT JOIN who USING (scene_index) LEFT JOIN documents d ON d.doc_id = scene_index)""",
        ],
        """SELECT e.scene_index, md5(combined_text) AS text_md5, transcript, view, who, start_cs, end_cs, coalesce(d.source, '') AS mood, coalesce(d.lang || '!', '') AS scene_type, coalesce(ids, '') AS event_ids FROM entries e JOIN scene USING (scene_index) LEFT JOIN documents d ON d.doc_id = scene_index
        LEFT JOIN (SELECT s.scene_index, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events JOIN scene s ON event_id * 90 < s.end_cs AND event_id * 90 + 100 > s.start_cs GROUP BY 1) USING (scene_index)""",
    ),
)
def text_index(spark, sf_dir):
    read, col, lit = lambda name: A.table(spark, sf_dir, name), F.col, F.lit
    docs = read("documents")
    shots = docs.select(col("doc_id").alias("scene_index"), (col("doc_id") * 700).alias("start_cs"), (col("doc_id") * 700 + 700).alias("end_cs"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    own = read("conversations").groupBy(col("conv_id").alias("scene_index")).agg(whole.alias("combined_text"))
    known = own.select("scene_index", "combined_text", F.substring("combined_text", 1, 30).alias("transcript"), lit("v").alias("vision_description"), F.array(lit("nobody")).alias("characters"))
    lines = read("orders").select((col("o_orderkey") * 40).alias("start_cs"), F.concat("o_orderpriority", lit(" L"), "o_orderkey").alias("text"))
    events = read("events").select("event_id", (col("event_id") * 90).alias("start_cs"), (col("event_id") * 90 + 100).alias("end_cs"), F.concat(lit("ev "), "event_type").alias("description"))
    vision = docs.select(col("doc_id").alias("scene_index"), col("lang").alias("description"), col("source").alias("mood"), F.concat("lang", lit("!")).alias("scene_type"))
    who = read("supplier").select((col("s_suppkey") * 3).alias("scene_index"), col("s_name").alias("display_name"))
    out = I.text_index(shots, known, lines, vision, events, who)
    return out.select("scene_index", F.md5("combined_text").alias("text_md5"), "transcript", col("vision_description").alias("view"), F.array_join("characters", ",").alias("who"), "start_cs", "end_cs", "mood", "scene_type", F.array_join(col("event_ids").cast("array<string>"), ",").alias("event_ids"))


@query("vector_index", "SELECT doc_id AS scene_index, round(list_aggregate(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 'sum'), 6) AS total FROM documents JOIN embeddings ON vec_id = doc_id WHERE trim(text) <> ''")
def vector_index(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scene_index"), F.col("text").alias("combined_text"))
    embedded = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scene_index"), "embedding")
    return I.vector_index(rows, embedded).select("scene_index", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("relation_index", "SELECT (l_suppkey % 30) || '|' || (l_partkey % 30) AS relation_key, arg_max(l_linenumber, l_orderkey * 10 + l_linenumber) AS strength FROM lineitem GROUP BY ALL")
def relation_index(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 30).cast("string").alias("character_a"), (F.col("l_partkey") % 30).cast("string").alias("character_b"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_linenumber").alias("strength"))
    return I.relation_index(rows).select("relation_key", "strength")


@query("chapter_index", A.sql([_CHAPTERS], "SELECT chapter::VARCHAR AS chapter_key, title, description, theme, chapter_type, array_to_string(characters, ',') AS characters FROM chapters"))
def chapter_index(spark, sf_dir):
    rows = _chapters(spark, sf_dir).withColumn("start_cs", F.lit(0))
    return I.chapter_index(rows).select("chapter_key", "title", "description", "theme", "chapter_type", F.array_join("characters", ",").alias("characters"))


@query(
    "idx_character",
    A.sql(_SIDES, "SELECT DISTINCT character, unit_index FROM (SELECT unnest(characters) AS character, scene_index // 4 AS unit_index FROM units UNION ALL SELECT 'char_' || l_suppkey, l_orderkey // 4 FROM lineitem)"),
)
def idx_character(spark, sf_dir):
    seen = A.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("char_"), "l_suppkey").alias("character"), F.col("l_orderkey").alias("shot"))
    rows = units(spark, sf_dir).groupBy(F.floor(F.col("scene_index") / 4).alias("unit_index")).agg(F.flatten(F.collect_list("characters")).alias("cast"), F.collect_list("scene_index").alias("shot_ids"))
    return I.character_units(seen, rows)


@query("idx_event", A.sql("shots story_events", "SELECT video_id, event_type, string_agg(event_id, ',' ORDER BY importance DESC, event_id) AS event_ids FROM story_events GROUP BY ALL"))
def idx_event(spark, sf_dir):
    return I.events_by_type(A.story_events(spark, sf_dir)).select("video_id", "event_type", F.array_join(F.col("event_ids").cast("array<string>"), ",").alias("event_ids"))


@query(
    "idx_emotion",
    "SELECT emotion, source, count(*) AS n, min(ref) AS first_ref, round(sum(intensity), 4) AS intensity FROM (SELECT lower(trim(p_type)) AS emotion, 'vision' AS source, p_partkey AS ref, p_size / 50.0::DOUBLE AS intensity FROM part UNION ALL SELECT event_type, 'event', event_id, 0.5 FROM events WHERE event_type <> 'view' UNION ALL SELECT lower(trim(c_mktsegment)), 'beat', c_custkey, 0.25 FROM customer) GROUP BY ALL",
)
def idx_emotion(spark, sf_dir):
    read = lambda name: A.table(spark, sf_dir, name)
    col = F.col
    out = I.emotions(
        read("part").select(F.concat(F.lit(" "), "p_type").alias("emotion"), F.lit("vision").alias("source"), col("p_partkey").alias("ref"), (col("p_size") / 50).alias("intensity")),
        read("events").select(F.when(col("event_type") == "view", " ").otherwise(col("event_type")).alias("emotion"), F.lit("event").alias("source"), col("event_id").alias("ref"), F.lit(0.5).alias("intensity")),
        read("customer").select(col("c_mktsegment").alias("emotion"), F.lit("beat").alias("source"), col("c_custkey").alias("ref"), F.lit(0.25).alias("intensity")),
    )
    return out.groupBy("emotion", "source").agg(F.count("*").alias("n"), F.min("ref").alias("first_ref"), F.round(F.sum("intensity"), 4).alias("intensity"))


# The six signals of a labelled document, in steps that both engines agree on.
_SIX = "six AS (SELECT *, hook_score AS x1, (unit_index * 7 % 100) / 100.0::DOUBLE AS plot_importance, clarity_score * 0.5 AS emotional_intensity, (unit_index * 13 % 100) / 100.0::DOUBLE AS visual_impact, tension_score AS independence_score, (unit_index * 29 % 50) / 100.0::DOUBLE AS boundary_quality FROM signals)"


@query(
    "idx_signal_topn",
    A.sql(["signals", _SIX], "SELECT signal, CAST(rank AS INTEGER) AS rank, unit_index, score FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY score DESC, unit_index) AS rank FROM (UNPIVOT (SELECT unit_index, hook_score, plot_importance, emotional_intensity, visual_impact, independence_score, boundary_quality FROM six) ON hook_score, plot_importance, emotional_intensity, visual_impact, independence_score, boundary_quality INTO NAME signal VALUE score)) WHERE rank <= 20 AND score > 0.3"),
)
def idx_signal_topn(spark, sf_dir):
    i = F.col("unit_index")
    more = {"plot_importance": i * 7 % 100 / 100, "emotional_intensity": F.col("clarity_score") * 0.5, "visual_impact": i * 13 % 100 / 100, "independence_score": F.col("tension_score"), "boundary_quality": i * 29 % 50 / 100}
    return I.top_signals(A.signals(spark, sf_dir).withColumns(more), list(I.SIGNALS)).select("signal", "rank", "unit_index", "score")


_TAGS = "list_concat(CASE WHEN has_music THEN ['music:' || coalesce(nullif(music_mood, ''), 'unknown')] ELSE [] END, CASE WHEN has_sfx THEN list_transform(sfx_tags, lambda s: 'sfx:' || s) ELSE [] END, CASE WHEN silence > 0.7 THEN ['silence'] ELSE [] END, CASE WHEN speech_emotion <> '' THEN ['speech_emotion:' || speech_emotion] ELSE [] END)"


@query("idx_audio_tags", A.sql(_SIDES, f"SELECT tag, count(*) AS n, min(scene_index) AS first_scene FROM (SELECT unnest({_TAGS}) AS tag, scene_index FROM units) GROUP BY tag"))
def idx_audio_tags(spark, sf_dir):
    c = F.col
    tags = I.audio_tags(c("has_music"), c("music_mood"), c("has_sfx"), c("sfx_tags"), c("silence"), c("speech_emotion"))
    return I.by_tag(units(spark, sf_dir), tags, "scene_index").groupBy("tag").agg(F.count("*").alias("n"), F.min("scene_index").alias("first_scene"))


@query("idx_usage", "SELECT tag, count(*) AS n, count(DISTINCT doc_id) AS n_units FROM (SELECT unnest(list_distinct([lang, source, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END])) AS tag, doc_id FROM documents) GROUP BY tag")
def idx_usage(spark, sf_dir):
    tags = F.array_distinct(F.array("lang", "source", F.when(F.col("n_chars") > 1000, "long").otherwise("short")))
    return I.by_tag(A.table(spark, sf_dir, "documents"), tags, "doc_id").groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_units"))


@query(
    "prompt_beats",
    A.sql(
        [_BEATS],
        """SELECT beat_index % 20 AS segment, md5(string_agg(line, chr(10) ORDER BY beat_index)) AS lines_md5, count(*) AS n FROM (SELECT beat_index, concat_ws(' | ', 'Beat ' || beat_index || ' [' || beat_index || '.0s-' || beat_index || '.5s]', '类型: ' || beat_type, CASE WHEN description <> '' THEN '内容: ' || description END,
        CASE WHEN emotion <> '' THEN '情绪: ' || emotion END, CASE WHEN len(characters) > 0 THEN '人物: ' || array_to_string(characters, ', ') END) AS line FROM beats) GROUP BY 1""",
    ),
)
def prompt_beats(spark, sf_dir):
    rows = _beats(spark, sf_dir).withColumns({"segment": F.col("beat_index") % 20, "start_time": F.col("beat_index").cast("double"), "end_time": F.col("beat_index") + 0.5})
    counts = rows.groupBy("segment").agg(F.count("*").alias("n"))
    return M.prompt_of(rows, "segment", "beat_index", M.beat_line()).join(counts, "segment").select("segment", F.md5("lines").alias("lines_md5"), "n")


@query(
    "prompt_scenes",
    A.sql(
        [_STORY],
        """SELECT s_nationkey AS chapter, string_agg(line, chr(10) ORDER BY scene) AS lines FROM (SELECT s_nationkey, scene, concat_ws(' | ', 'StoryScene ' || scene || ' [' || scene || '.0s-' || scene || '.5s]', CASE WHEN location <> '' THEN '地点: ' || location END, CASE WHEN plot_function <> '' THEN '功能: ' || plot_function END,
        CASE WHEN description <> '' THEN '内容: ' || left(description, 80) END, CASE WHEN len(characters) > 0 THEN '人物: ' || array_to_string(characters[1:5], ', ') END) AS line, row_number() OVER (PARTITION BY s_nationkey ORDER BY scene) AS n FROM story) WHERE n <= 3 GROUP BY 1""",
    ),
)
def prompt_scenes(spark, sf_dir):
    rows = _story(spark, sf_dir).withColumns({"start_time": F.col("story_scene_index").cast("double"), "end_time": F.col("story_scene_index") + 0.5})
    return M.prompt_of(rows, "s_nationkey", "story_scene_index", M.scene_line(), most=3).withColumnRenamed("s_nationkey", "chapter")
