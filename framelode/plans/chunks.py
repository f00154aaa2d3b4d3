"""Queries over model answers about chunks of shots. The answers are made of the events: JSON with local and global shot numbers, repeated, broken and missing parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelode.functions import variants as V
from framelode.operators import chunk_answers as C
from framelode.operators import chunk_outputs
from framelode.operators import entity, profiles, shared
from framelode.plans.registry import query
from framelode.sources import adapters as A

#: Shots of a chunk.
SIZE = 6


def chunked(spark, sf_dir):
    """The shots, six to a chunk, and the chunks. Both are written, as several tables are made of them."""
    shots = A.shots(spark, sf_dir).select("video_id", "scene_index", (F.col("start_cs") / 100).alias("start_time"), (F.col("end_cs") / 100).alias("end_time"), "event_id", "event_type").withColumn("chunk_index", F.floor(F.col("scene_index") / SIZE).cast("int"))
    shots = shared.written(shots, "shots")
    chunks = shots.groupBy("video_id", "chunk_index").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.array_sort(F.collect_list("scene_index")).alias("shot_indices"))
    return shots, shared.written(chunks.withColumn("duration", F.col("end_time") - F.col("start_time")), "chunks")


def answers(spark, sf_dir, made=None):
    """video_id, chunk_index, answer. made: what ``chunked`` gives, where it is there already."""
    shots, chunks = made or chunked(spark, sf_dir)
    rows = shots.join(chunks.select("video_id", "chunk_index", F.col("start_time").alias("from")), ["video_id", "chunk_index"])
    i, s = F.col("event_id"), F.col("scene_index")
    lo, text = s % SIZE, lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    one_of = lambda by, values: F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    fields = lambda **of: F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v if not isinstance(v, str) else F.lit(v)) for k, v in of.items()]), F.lit("}"))
    local = one_of(i, [lo.cast("string"), F.lit(None), text(lo), F.lit(None), lo.cast("string"), F.lit("99")])
    scene = one_of(i, [s.cast("string"), s.cast("string"), F.lit(None), lo.cast("string"), text(lo + 1), F.lit("100000")])
    vision = F.when(i % 7 == 0, '"text"').otherwise(
        fields(
            description=F.when(i % 5 != 0, text(F.concat(F.lit("  "), "event_type", F.lit(" "), i % 50, F.lit(" ")))), action_description=text(F.col("event_type")), mood='" calm "',
            objects=one_of(i, [F.concat(F.lit('["'), "event_type", F.lit('", {"name": "n'), i % 4, F.lit('"}, null, "  "]')), F.lit('"single"'), F.lit(None)]), ocr_texts=F.when(i % 2 == 0, '["A", "B"]'),
        )
    )
    audio = F.when(i % 9 == 0, "[1]").otherwise(
        fields(has_music=one_of(i, ['"是"', "true", "0", '"1"', '"maybe"', "2", "null", '"NO"']), has_sfx=F.when(s % 2 == 0, "true").otherwise("false"), silence_ratio=one_of(i, ['"45%"', "0.3", "55", '"x"']), speech_emotion=F.when(i % 3 == 0, '"tense"').otherwise('""'), sfx_tags='"bang"')
    )
    present = one_of(i, [F.lit('["char_a", {"character_id": "unknown_1"}, "unknown", null, {"id": "char_b"}]'), F.lit('"entity_7"'), F.lit('{"id": "char_b"}'), F.lit(None), F.lit("5")])
    view = fields(local_shot_index=local, scene_index=scene, vision=vision, audio=audio, characters_present=present)
    again = F.when(i % 4 == 0, fields(local_shot_index=local, scene_index=scene, vision=fields(description=text(F.concat(F.lit("again "), F.expr("repeat('x', cast(event_id % 30 as int))"))))))
    start = F.when(F.col("video_id") % 2 == 0, F.col("start_time") - F.col("from")).otherwise(F.col("start_time")) + 0.25
    end = start + (i % 5 - 1) * 1.5
    line = fields(start_time=F.when(i % 3 == 0, text(start)).otherwise(start.cast("string")), end_time=end.cast("string"), text=F.when(i % 6 == 0, '""').otherwise(text(F.concat("event_type", F.lit(" line")))), speaker=one_of(i, ['"char_a"', '"unknown_2"', '"unknown"', F.lit(None)]), type=F.when(i % 3 == 1, '"narration"'))
    update = F.when(i % 3 == 0, fields(character_id=one_of(i / 3, ['"char_a"', '"entity_7"', '"unknown_2"', '"char_c"', '"nobody"', '"unknown_9"']), new_names=one_of(i, [F.concat(F.lit('["Name'), i % 8, F.lit('", "未知"]')), F.lit(None)]), appearance_change=one_of(i, [F.concat(F.lit('" coat '), i % 10, F.lit('"')), F.lit('"无变化"'), F.lit(None), F.lit('""')]), key_action=one_of(i / 3, [F.lit('"暂无"'), F.concat(F.lit('"runs '), i % 6, F.lit('"')), F.lit('""')])))
    merge = F.when(i % 5 == 0, fields(primary=one_of(i / 5, ['"char_a"', '"char_c"', '"entity_7"', '"char_a"']), duplicate=one_of(i / 10, ['"char_c"', '"char_a"', '"char_zz"', '"entity_7"', '""']), confidence=one_of(i, ['"95%"', "0.7", "0.86", '"x"']), reason='"alike"'))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scene_index", F.col(c).alias("of")))), lambda x: x["of"]), ", ").alias(c)
    # made in a step before they are collected, which is compiled
    told = rows.select("video_id", "chunk_index", "scene_index", view.alias("views"), again.alias("again"), line.alias("lines"), update.alias("updates"), merge.alias("merges"))
    some = told.groupBy("video_id", "chunk_index").agg(*map(listed, ("views", "again", "lines", "updates", "merges")))
    n = F.col("video_id") + F.col("chunk_index")
    views = F.when(n % 17 == 0, '"none"').otherwise(F.concat(F.lit("["), F.concat_ws(", ", "views", F.nullif("again", F.lit("")), F.lit("7, null")), F.lit("]")))
    whole = F.concat(F.lit('{"transcripts": ['), "lines", F.lit(', "x"], "per_shot": '), views, F.lit(', "character_updates": ['), "updates", F.lit('], "character_merge_suggestions": ['), "merges", F.lit("]}"))
    answer = F.when(n % 11 == 0, "sorry, none").otherwise(F.when(F.col("chunk_index") % 2 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), whole)))
    return some.where(n % 13 != 0).select("video_id", "chunk_index", answer.alias("answer"))


_STATE = "(video_id + chunk_index) % 13 = 0 OR (video_id + chunk_index) % 11 = 0"
_TMP = "'char_tmp_chunk_' || lpad(CAST(chunk_index AS VARCHAR), 4, '0') || '_unknown_'"
#: Shots with their chunk, and of each chunk its shots, times and whether it has an answer (``told``).
_BASE = [
    "shots",
    "cs AS (SELECT video_id, scene_index, start_cs / 100 AS start_time, end_cs / 100 AS end_time, event_id AS i, event_type, CAST(scene_index // 6 AS INTEGER) AS chunk_index, scene_index % 6 AS lo FROM shots)",
    f"ck AS (SELECT video_id, chunk_index, min(start_time) AS from_time, max(end_time) AS to_time, min(scene_index) AS first_scene, count(*) AS n_shots, NOT ({_STATE}) AS told FROM cs GROUP BY video_id, chunk_index)",
    "st AS (SELECT cs.*, from_time, to_time, first_scene, n_shots FROM cs JOIN ck USING (video_id, chunk_index) WHERE told)",
]
_LINES = [
    """ln0 AS (SELECT *, CASE WHEN video_id % 2 = 0 THEN start_time - from_time ELSE start_time END + 0.25 AS a FROM st)""",
    """ln1 AS (SELECT *, a + (i % 5 - 1) * 1.5::DOUBLE AS b FROM ln0)""",
    """md AS (SELECT video_id, chunk_index, any_value(from_time) > 0.5 AND sum((t BETWEEN from_time - 1 AND to_time + 1)::INT) > sum((t <= to_time - from_time + 1)::INT) AND min(t) >= any_value(from_time) - 1 AS absolute
      FROM (SELECT video_id, chunk_index, from_time, to_time, unnest([a, b]) AS t FROM ln1) WHERE t >= 0 GROUP BY video_id, chunk_index)""",
    """ln2 AS (SELECT video_id, chunk_index, lo AS pos, i, event_type || ' line' AS text, CAST(format('{:.1f}', CASE WHEN absolute THEN a ELSE a + from_time END) AS DOUBLE) AS s, CAST(format('{:.1f}', CASE WHEN absolute THEN b ELSE b + from_time END) AS DOUBLE) AS e
      FROM ln1 JOIN md USING (video_id, chunk_index) WHERE i % 6 > 0)""",
    f"""ln3 AS (SELECT video_id, chunk_index, pos, s AS start_time, greatest(s, e) AS end_time, text, i, CASE i % 4 WHEN 0 THEN 'char_a' WHEN 1 THEN {_TMP} || '2' ELSE 'unknown' END AS speaker, CASE i % 4 WHEN 0 THEN 'char_a' WHEN 1 THEN {_TMP} || '2' END AS character_id FROM ln2)""",
    """ln AS (SELECT l.*, q.scene_index, l.start_time < q.start_time OR l.end_time > q.end_time AS cross_shot FROM ln3 l, LATERAL (SELECT * FROM cs WHERE cs.video_id = l.video_id AND cs.chunk_index = l.chunk_index
      ORDER BY CASE WHEN cs.start_time <= (l.start_time + l.end_time) / 2 AND (l.start_time + l.end_time) / 2 < cs.end_time THEN 0 ELSE 1 END, abs(cs.start_time - (l.start_time + l.end_time) / 2), cs.scene_index LIMIT 1) q)""",
]
_VIEWS = [
    "iv0 AS (SELECT *, CASE WHEN i % 6 IN (0, 2, 4) THEN lo WHEN i % 6 = 5 THEN 99 END AS lv, CASE i % 6 WHEN 0 THEN scene_index WHEN 1 THEN scene_index WHEN 3 THEN lo WHEN 4 THEN lo + 1 WHEN 5 THEN 100000 END AS sv FROM st WHERE (video_id + chunk_index) % 17 > 0)",
    "iv1 AS (SELECT *, FALSE AS again, scene_index AS place FROM iv0 UNION ALL SELECT *, TRUE, scene_index + 1000000 FROM iv0 WHERE i % 4 = 0)",
    "im AS (SELECT video_id, chunk_index, count_if(sv < n_shots) > count_if(sv BETWEEN first_scene AND first_scene + n_shots - 1) AS by_local FROM iv1 GROUP BY video_id, chunk_index)",
    """iv2 AS (SELECT *, CASE WHEN lv < n_shots THEN first_scene + lv END AS ls, CASE WHEN sv BETWEEN first_scene AND first_scene + n_shots - 1 THEN sv END AS gs, CASE WHEN sv < n_shots THEN first_scene + sv END AS sl FROM iv1 JOIN im USING (video_id, chunk_index))""",
    """iv3 AS (SELECT * REPLACE (CASE WHEN ls IS NOT NULL AND gs IS NOT NULL THEN CASE WHEN by_local THEN ls ELSE gs END WHEN gs IS NOT NULL THEN CASE WHEN by_local AND sl IS NOT NULL THEN sl ELSE gs END WHEN ls IS NOT NULL THEN ls ELSE sl END AS scene_index) FROM iv2)""",
    """iv4 AS (SELECT *, NOT again AND i % 7 > 0 AS vis, NOT again AND i % 9 > 0 AS aud,
      CASE WHEN again THEN trim('again ' || repeat('x', CAST(i % 30 AS INTEGER))) WHEN i % 7 > 0 AND i % 5 > 0 THEN event_type || ' ' || (i % 50) ELSE '' END AS descr,
      CASE WHEN again OR i % 7 = 0 OR i % 3 = 2 THEN [] WHEN i % 3 = 0 THEN [event_type, 'n' || (i % 4)] ELSE ['single'] END AS objects, CASE WHEN NOT again AND i % 7 > 0 AND i % 2 = 0 THEN ['A', 'B'] ELSE [] END AS texts FROM iv3 WHERE scene_index IS NOT NULL)""",
    """iv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, scene_index ORDER BY len(descr) + CASE WHEN vis THEN len(event_type) ELSE 0 END + 8 * (len(objects) + len(texts)) + CASE WHEN aud AND i % 3 = 0 THEN 5 ELSE 0 END DESC, place) AS rank FROM iv4) WHERE rank = 1)""",
    "sp AS (SELECT video_id, scene_index, count(*) AS n_lines, array_to_string(list_sort(list_distinct(list(character_id) FILTER (WHERE character_id IS NOT NULL))), ',') AS speaking FROM ln GROUP BY ALL)",
]


@query(
    "chunk_transcripts",
    A.sql([*_BASE, *_LINES], "SELECT video_id, chunk_index, CAST(pos AS INTEGER) AS pos, start_time, end_time, text, speaker, character_id, CAST(scene_index AS INTEGER) AS scene_index, CASE WHEN i % 3 = 1 THEN 'narration' ELSE 'dialogue' END AS transcript_type, cross_shot FROM ln"),
)
def chunk_transcripts(spark, sf_dir):
    shots, chunks = chunked(spark, sf_dir)
    return C.backfilled(chunks, shots, answers(spark, sf_dir, (shots, chunks))).transcripts


@query(
    "chunk_backfill",
    A.sql(
        [*_BASE, *_LINES, *_VIEWS],
        f"""SELECT cs.video_id, CAST(cs.scene_index AS INTEGER) AS scene_index, cs.start_time AS "timestamp", cs.start_time, cs.end_time, CASE WHEN iv.i IS NULL THEN '模型未返回该镜头画面分析' WHEN descr = '' THEN '无法判断' ELSE descr END AS description,
      coalesce(array_to_string(objects, ','), '') AS objects, CASE WHEN vis THEN 'calm' ELSE '' END AS mood, CASE WHEN vis THEN iv.event_type ELSE '' END AS action_description, coalesce(array_to_string(texts, ','), '') AS texts,
      coalesce(aud AND iv.i % 8 IN (0, 1, 3, 5), FALSE) AS has_music, coalesce(aud AND iv.lo % 2 = 0, FALSE) AS has_sfx, CASE WHEN aud THEN 'bang' ELSE '' END AS sfx_tags, CASE WHEN aud THEN [0.45::DOUBLE, 0.3::DOUBLE, 0.55::DOUBLE, 0.0::DOUBLE][iv.i % 4 + 1] ELSE 0.0::DOUBLE END AS silence_ratio,
      CASE WHEN iv.i IS NULL AND n_lines > 0 THEN 'unknown' ELSE '' END AS speech_rate, CASE WHEN aud AND iv.i % 3 = 0 THEN 'tense' ELSE '' END AS speech_emotion,
      CASE WHEN iv.again OR iv.i IS NULL THEN '' ELSE ['char_a,char_tmp_chunk_' || lpad(CAST(cs.chunk_index AS VARCHAR), 4, '0') || '_unknown_1,char_b', 'entity_7', 'char_b', '', ''][iv.i % 5 + 1] END AS visible_characters, coalesce(speaking, '') AS speaking_characters,
      concat_ws(',', CASE WHEN n_lines > 0 THEN 'speech' END, CASE WHEN aud AND iv.i % 8 IN (0, 1, 3, 5) THEN 'music' END, CASE WHEN aud AND iv.lo % 2 = 0 THEN 'sfx' END) AS active_modalities,
      CASE WHEN n_lines > 0 THEN 'speech' WHEN aud AND iv.i % 8 IN (0, 1, 3, 5) THEN 'music' ELSE 'visual' END AS dominant_modality, CASE WHEN iv.i IS NULL THEN 0.0::DOUBLE ELSE 0.8::DOUBLE END AS alignment_confidence,
      CASE WHEN iv.i IS NULL THEN '模型未返回该镜头 per_shot，写入占位对齐' ELSE '' END AS notes
      FROM cs LEFT JOIN iv ON iv.video_id = cs.video_id AND iv.scene_index = cs.scene_index LEFT JOIN sp ON sp.video_id = cs.video_id AND sp.scene_index = cs.scene_index""",
    ),
)
def chunk_backfill(spark, sf_dir):
    shots, chunks = chunked(spark, sf_dir)
    made = C.backfilled(chunks, shots, answers(spark, sf_dir, (shots, chunks)))
    key = ["video_id", "scene_index"]
    rows = made.vision.join(made.ocr.drop("timestamp"), key).join(made.audio, key).join(made.alignments, key)
    shown = [F.array_join(c, ",").alias(c) for c in ("objects", "texts", "sfx_tags", "visible_characters", "speaking_characters", "active_modalities")]
    return rows.select(*key, "timestamp", "start_time", "end_time", "description", "mood", "action_description", "has_music", "has_sfx", "silence_ratio", "speech_rate", "speech_emotion", "dominant_modality", "alignment_confidence", "notes", *shown)


#: Two characters of each video from its pictures and a passer-by, who counts for nobody.
_GALLERIES = """gl AS (SELECT DISTINCT video_id, 'char_a' AS cid, 'major' AS tier FROM cs UNION ALL SELECT DISTINCT video_id, 'char_c', 'minor' FROM cs WHERE video_id % 2 = 0)"""


def galleries(spark, sf_dir):
    videos = A.shots(spark, sf_dir).select("video_id").distinct()
    of = lambda name, tier: videos.select("video_id", F.lit(name).alias("character_id"), F.lit(tier).alias("tier"), F.array(F.col("video_id").cast("int") % 5, F.lit(1)).alias("appearance_scenes"))
    return of("char_a", "major").union(of("char_c", "minor").where("video_id % 2 = 0")).union(of("char_zz", "passerby"))


_PROFILES = [
    *_BASE,
    _GALLERIES,
    f"""up AS (SELECT video_id, chunk_index, 1 AS phase, scene_index AS place, i, CASE (i // 3) % 6 WHEN 0 THEN 'char_a' WHEN 1 THEN 'entity_7' WHEN 2 THEN {_TMP} || '2' WHEN 3 THEN 'char_c' ELSE {_TMP} || '9' END AS cid,
      CASE (i // 3) % 6 WHEN 2 THEN 'unknown_2' WHEN 5 THEN 'unknown_9' END AS raw, CASE WHEN i % 2 = 0 THEN 'Name' || (i % 8) END AS name, CASE i % 4 WHEN 0 THEN 'coat ' || (i % 10) WHEN 1 THEN '无变化' END AS change, CASE WHEN (i // 3) % 3 = 1 THEN 'runs ' || (i % 6) END AS action
      FROM st WHERE i % 3 = 0 AND (i // 3) % 6 <> 4)""",
    f"""me AS (SELECT video_id, chunk_index, phase, place, cid, raw, name, change, action FROM up
      UNION ALL SELECT DISTINCT video_id, chunk_index, 0, -1, {_TMP} || '2', 'unknown_2', NULL, NULL, NULL FROM st WHERE i % 6 > 0 AND i % 4 = 1
      UNION ALL SELECT DISTINCT video_id, chunk_index, 0, -1, {_TMP} || '1', 'unknown_1', NULL, NULL, NULL FROM st WHERE (video_id + chunk_index) % 17 > 0 AND i % 5 = 0)""",
    "kn AS (SELECT video_id, cid, min(chunk_index) AS first FROM (SELECT video_id, cid, chunk_index FROM me UNION ALL SELECT video_id, cid, -1 FROM gl) GROUP BY ALL)",
    "mn AS (SELECT m.*, gl.tier AS gtier, row_number() OVER (PARTITION BY m.video_id, m.cid ORDER BY chunk_index, phase, place) AS n FROM me m LEFT JOIN gl ON gl.video_id = m.video_id AND gl.cid = m.cid)",
    "fi AS (SELECT video_id, cid, gtier IS NULL AND raw IS NOT NULL AS tmp, gtier IS NULL AND raw IS NULL AS made, raw FROM mn WHERE n = 1)",
    "na AS (SELECT video_id, cid, string_agg(name, ',' ORDER BY nth) AS names FROM (SELECT video_id, cid, name, min(n) AS nth FROM (SELECT video_id, cid, name, n FROM mn WHERE name IS NOT NULL UNION ALL SELECT video_id, cid, raw, 0 FROM fi WHERE tmp) GROUP BY ALL) GROUP BY ALL)",
    """de AS (SELECT video_id, cid, arg_max(change, n) FILTER (change <> '无变化') AS description, string_agg(chunk_index || ':' || change, ',' ORDER BY n) FILTER (change IS NOT NULL) AS changes, string_agg(chunk_index || ':' || action, ',' ORDER BY n) FILTER (action IS NOT NULL AND NOT (made AND n = 1)) AS actions
      FROM mn JOIN fi USING (video_id, cid) GROUP BY ALL)""",
    """su AS (SELECT * FROM (SELECT video_id, chunk_index, scene_index AS place, ['char_a', 'char_c', 'entity_7', 'char_a'][(i // 5) % 4 + 1] AS prim, ['char_c', 'char_a', 'char_zz', 'entity_7', ''][(i // 10) % 5 + 1] AS dup, [0.95::DOUBLE, 0.7::DOUBLE, 0.86::DOUBLE, 0.0::DOUBLE][i % 4 + 1] AS confidence FROM st WHERE i % 5 = 0) WHERE prim <> dup AND dup <> '')""",
    "ac AS (SELECT s.* FROM su s JOIN kn p ON p.video_id = s.video_id AND p.cid = s.prim AND p.first <= s.chunk_index JOIN kn d ON d.video_id = s.video_id AND d.cid = s.dup AND d.first <= s.chunk_index)",
    "sg AS (SELECT video_id, prim AS cid, string_agg(chunk_index || ':' || dup || ':' || CAST(confidence AS VARCHAR), ',' ORDER BY chunk_index, place) AS merges FROM ac GROUP BY ALL)",
    """pr AS (SELECT k.video_id, k.cid, coalesce(names, '') AS names, coalesce(de.description, CASE WHEN tmp THEN '临时标注人物（无脸谱匹配）' ELSE '' END) AS description, coalesce(changes, '') AS changes, coalesce(actions, '') AS actions, coalesce(gl.tier, 'minor') AS tier,
      NOT coalesce(made AND k.cid LIKE 'entity%', FALSE) AS is_human, coalesce(merges, '') AS merges FROM kn k LEFT JOIN gl ON gl.video_id = k.video_id AND gl.cid = k.cid LEFT JOIN fi ON fi.video_id = k.video_id AND fi.cid = k.cid
      LEFT JOIN na ON na.video_id = k.video_id AND na.cid = k.cid LEFT JOIN de ON de.video_id = k.video_id AND de.cid = k.cid LEFT JOIN sg ON sg.video_id = k.video_id AND sg.cid = k.cid)""",
]


def _profiles(spark, sf_dir):
    read = shared.written(answers(spark, sf_dir).withColumn("answer", V.read_object(F.col("answer"))), "read")
    return profiles.folded(galleries(spark, sf_dir), C.mentions(read), C.suggestions(read))


@query("chunk_profiles", A.sql(_PROFILES, "SELECT video_id, cid AS character_id, names, description, changes, actions, tier, is_human, merges FROM pr"))
def chunk_profiles(spark, sf_dir):
    shown = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ",")
    rows = _profiles(spark, sf_dir)
    return rows.select(
        "video_id", "character_id", F.array_join("names", ",").alias("names"), "description", shown("appearance_changes", "chunk_idx", "description").alias("changes"), shown("key_actions", "chunk_idx", "action").alias("actions"), "tier", "is_human",
        shown("merge_suggestions", "chunk_index", "duplicate_id", "confidence").alias("merges"),
    )


_LINKS = [
    """pv AS (SELECT video_id, least(prim, dup) AS x, greatest(prim, dup) AS y, max(confidence) AS best, count(DISTINCT chunk_index) AS chunks, count_if(prim = least(prim, dup)) AS for_x, count_if(prim = greatest(prim, dup)) AS for_y FROM ac GROUP BY ALL)""",
    "rk AS (SELECT video_id, cid, CASE tier WHEN 'major' THEN 1 ELSE 2 END AS rank FROM pr)",
    """links AS (SELECT video_id, CASE WHEN f THEN x ELSE y END AS kept, CASE WHEN f THEN y ELSE x END AS merged, best, chunks FROM (
      SELECT pv.*, (-for_x, rx.rank, x) <= (-for_y, ry.rank, y) AS f FROM pv JOIN rk rx ON rx.video_id = pv.video_id AND rx.cid = x JOIN rk ry ON ry.video_id = pv.video_id AND ry.cid = y WHERE best >= 0.85 AND chunks >= 2))""",
]


@query("chunk_identity_links", A.sql([*_PROFILES, *_LINKS], "SELECT video_id, kept, merged, best, chunks FROM links"))
def chunk_identity_links(spark, sf_dir):
    rows = shared.written(_profiles(spark, sf_dir), "profiles")
    return entity.confirmed_merges(profiles.votes(rows), rows.select("video_id", F.col("character_id").alias("character"), "tier"), ["video_id"])


_NAMES = [
    "li AS (SELECT video_id, merged, min(kept) AS kept FROM links GROUP BY ALL)",
    "walk AS (SELECT video_id, merged AS id, kept AS cur, 1 AS n FROM li UNION ALL SELECT w.video_id, w.id, l.kept, n + 1 FROM walk w JOIN li l ON l.video_id = w.video_id AND l.merged = w.cur WHERE n < 20)",
    "nm AS (SELECT * FROM (SELECT video_id, id, CASE WHEN max(n) = 20 THEN id ELSE arg_max(cur, n) END AS canonical FROM walk GROUP BY video_id, id) WHERE id <> canonical)",
]


@query(
    "chunk_characters",
    A.sql(
        [
            *_PROFILES,
            *_LINES,
            *_VIEWS,
            *_LINKS,
            *_NAMES,
            f"vi AS (SELECT video_id, scene_index, unnest(CASE i % 5 WHEN 0 THEN ['char_a', {_TMP} || '1', 'char_b'] WHEN 1 THEN ['entity_7'] WHEN 2 THEN ['char_b'] ELSE [] END) AS cid FROM iv WHERE NOT again)",
            "se AS (SELECT DISTINCT x.video_id, coalesce(canonical, x.cid) AS cid, x.scene_index FROM (FROM vi UNION ALL SELECT video_id, unnest([video_id % 5, 1]), cid FROM gl) x LEFT JOIN nm ON nm.video_id = x.video_id AND nm.id = x.cid)",
            """ap AS (SELECT se.video_id, se.cid, string_agg(CAST(se.scene_index AS VARCHAR), ',' ORDER BY se.scene_index) AS scenes, sum(end_time - start_time ORDER BY se.scene_index) AS total, min(start_time) AS f, max(end_time) AS l FROM se LEFT JOIN cs ON cs.video_id = se.video_id AND cs.scene_index = se.scene_index GROUP BY ALL)""",
        ],
        """SELECT pr.video_id, pr.cid AS character_id, coalesce(nullif(split_part(names, ',', 1), ''), pr.cid) AS display_name, coalesce(scenes, '') AS appearance_scenes, CAST(format('{:.1f}', coalesce(total, 0.0::DOUBLE)) AS DOUBLE) AS total_screen_time,
      CAST(format('{:.1f}', coalesce(f, 0.0::DOUBLE)) AS DOUBLE) AS first_appearance, CAST(format('{:.1f}', coalesce(l, 0.0::DOUBLE)) AS DOUBLE) AS last_appearance
      FROM pr LEFT JOIN ap ON ap.video_id = pr.video_id AND ap.cid = pr.cid WHERE (pr.video_id, pr.cid) NOT IN (SELECT (video_id, id) FROM nm)""",
        recursive=True,
    ),
)
def chunk_characters(spark, sf_dir):
    shots, chunks = chunked(spark, sf_dir)
    made = chunk_outputs.understood(chunks, shots, answers(spark, sf_dir, (shots, chunks)), galleries(spark, sf_dir))
    return made["character"].select("video_id", "character_id", "display_name", F.array_join("appearance_scenes", ",").alias("appearance_scenes"), "total_screen_time", "first_appearance", "last_appearance")


@query(
    "chunk_prompts",
    A.sql(
        _BASE[:3],
        """SELECT video_id, chunk_index, count(*)::INT AS n_shots, string_agg('local_shot_index ' || lo || ' | scene_index ' || scene_index || ' | abs ' || format('{:.1f}', start_time) || 's-' || format('{:.1f}', end_time) || 's | rel ' || format('{:.1f}', start_time - from_time) || 's-' || format('{:.1f}', end_time - from_time) || 's | duration ' || format('{:.1f}', end_time - start_time) || 's', chr(10) ORDER BY lo) AS lines
      FROM cs JOIN ck USING (video_id, chunk_index) GROUP BY video_id, chunk_index""",
    ),
)
def chunk_prompts(spark, sf_dir):
    shots, chunks = chunked(spark, sf_dir)
    return C.boundaries(C.read(chunks, shots, answers(spark, sf_dir, (shots, chunks))))


@query(
    "chunk_profile_context",
    A.sql(
        [
            *_PROFILES,
            "ch AS (SELECT video_id, cid, change, n, chunk_index, phase, place FROM mn WHERE change IS NOT NULL AND change <> '无变化')",
            # of repeated texts the first place counts
            "cf AS (SELECT video_id, cid, change AS t, min(n) AS n FROM ch GROUP BY ALL)",
            "cx AS (SELECT video_id, cid, list(t ORDER BY n) AS ts FROM cf GROUP BY ALL)",
            "af AS (SELECT m.video_id, m.cid, action AS t, min(n) AS n FROM mn m JOIN fi USING (video_id, cid) WHERE action IS NOT NULL AND NOT (made AND n = 1) GROUP BY ALL)",
            "ax AS (SELECT video_id, cid, list(t ORDER BY n) AS ts FROM af GROUP BY ALL)",
        ],
        """SELECT pr.video_id, pr.cid AS character_id, description, concat_ws(chr(10), CASE WHEN names <> '' THEN '  档案称呼/别名: ' || array_to_string(string_split(names, ',')[1:5], ', ') END,
      CASE WHEN cx.ts IS NOT NULL THEN '  有效外观线索: ' || array_to_string(cx.ts[-4:], '; ') END, CASE WHEN ax.ts IS NOT NULL THEN '  关键行为线索: ' || array_to_string(ax.ts[-6:], '; ') END) AS lines
      FROM pr LEFT JOIN cx ON cx.video_id = pr.video_id AND cx.cid = pr.cid LEFT JOIN ax ON ax.video_id = pr.video_id AND ax.cid = pr.cid""",
    ),
)
def chunk_profile_context(spark, sf_dir):
    return profiles.context(_profiles(spark, sf_dir))
