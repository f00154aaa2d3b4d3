"""Queries over loosely typed values, identifiers and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelode.functions import chunks as K
from framelode.functions import coerce as V
from framelode.functions import text as T
from framelode.operators import entity, joins
from framelode.plans.registry import query
from framelode.sources import adapters as A
from framelode.sources import probe

# Answers of a model, clean and not, made of the events.
_RAW = """raw AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN (event_id % 130) || '%' WHEN 1 THEN ' ' || (event_id % 150) || ' ' WHEN 2 THEN CAST((event_id % 40) / 20.0 AS VARCHAR) WHEN 3 THEN 'abc' WHEN 4 THEN '' WHEN 5 THEN '-3' WHEN 6 THEN 'Yes' WHEN 7 THEN '否' ELSE NULL END AS value FROM events)"""


def raw(spark, sf_dir):
    i = F.col("event_id")
    kinds = [F.concat(i % 130, F.lit("%")), F.concat(F.lit(" "), i % 150, F.lit(" ")), ((i % 40) / 20).cast("string"), F.lit("abc"), F.lit(""), F.lit("-3"), F.lit("Yes"), F.lit("否")]
    value = F.lit(None).cast("string")
    for n, kind in enumerate(kinds):
        value = F.when(i % 9 == n, kind).otherwise(value)
    return A.table(spark, sf_dir, "events").select("event_id", value.alias("value"))


@query(
    "safe_values",
    A.sql(
        [_RAW],
        """SELECT event_id, round(coalesce(try_cast(trim(value) AS DOUBLE), 0.0::DOUBLE), 6) AS number, try_cast(trunc(try_cast(trim(value) AS DOUBLE)) AS INTEGER) AS whole,
        round(CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN ends_with(trim(value), '%') OR (n > 1 AND n <= 100) THEN n / 100 ELSE n END)) END, 6) AS share,
        CASE WHEN lower(trim(value)) IN ('true', 'yes', 'y', '1', '是', '有') THEN true WHEN lower(trim(value)) IN ('false', 'no', 'n', '0', '否', '无', 'none', 'null', '') THEN false ELSE coalesce(try_cast(trim(value) AS DOUBLE) <> 0, false) END AS flag
        FROM (SELECT *, try_cast(trim(rtrim(trim(value), '%')) AS DOUBLE) AS n FROM raw)""",
    ),
)
def safe_values(spark, sf_dir):
    v = F.col("value")
    return raw(spark, sf_dir).select("event_id", F.round(V.safe_float(v), 6).alias("number"), V.safe_int(v).alias("whole"), F.round(V.unit_score(v), 6).alias("share"), V.safe_bool(v).alias("flag"))


_PLACEHOLDERS = ", ".join(f"'{p}'" for p in T.PLACEHOLDERS)


@query("placeholder_filter", "SELECT doc_id, text AS first, trim(coalesce(nullif(trim(text), ''), '')) = '' OR lower(trim(trim(text), ' \t\r\n。.!！,，;；:：')) IN (" + _PLACEHOLDERS + ") AS placeholder FROM documents")
def placeholder_filter(spark, sf_dir):
    """Every document by its whole text."""
    return A.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("first")).withColumn("placeholder", T.is_placeholder(F.col("first")))


@query(
    "video_slugs",
    "SELECT page_id, coalesce(nullif(left(lower(trim(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9\\x{4e00}-\\x{9fff}]', '_', 'g'), '_+', '_', 'g'), '_')), 30), ''), 'video') AS slug, left(md5(url || ':' || page_id), 8) AS hash FROM pages",
)
def video_slugs(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), T.short_hash(F.concat("url", F.lit(":"), "page_id")).alias("hash"))


@query(
    "json_extract",
    """SELECT event_id, CAST(json_extract(block, '$.k') AS INTEGER) AS k FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN props WHEN 3 THEN props ELSE NULL END AS block FROM events)""",
)
def json_extract(spark, sf_dir):
    """The answer's object from a fenced block named json, any fenced block, prose around it, or the bare text; null if it is cut off."""
    i, p = F.col("event_id"), F.col("props")
    answer = F.when(i % 5 == 0, F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```\nDone {"))).when(i % 5 == 1, F.concat(F.lit("```\n"), p, F.lit("```"))).when(i % 5 == 2, F.concat(F.lit("The answer is "), p, F.lit(" ."))).when(i % 5 == 3, p).otherwise(F.expr("left(props, length(props) - 1)"))
    block = T.json_block(answer)
    return A.table(spark, sf_dir, "events").select("event_id", F.get_json_object(block, "$.k").try_cast("int").alias("k"))


@query(
    "probe_parse",
    "SELECT s_suppkey, round(coalesce(CASE WHEN d <> 0 THEN n / d END, 30.0::DOUBLE), 6) AS fps, CASE s_suppkey % 4 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN CASE WHEN s_suppkey % 8 = 2 THEN 'application/octet-stream' ELSE 'video/x-matroska' END ELSE 'audio/mp4' END AS media, s_suppkey % 700 > 480 OR s_suppkey % 50 > 10 AS compress FROM (SELECT *, (s_suppkey % 60 * 1000)::DOUBLE AS n, (s_suppkey % 3 * 1001)::DOUBLE AS d FROM supplier)",
)
def probe_parse(spark, sf_dir):
    i = F.col("s_suppkey")
    name = F.element_at(F.array(*map(F.lit, ("a.MP4", "b.c.jpg", "none", "x.m4a", "a.MP4", "b.c.jpg", "film.mkv", "x.m4a"))), (i % 8 + 1).cast("int"))
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", F.round(V.frame_rate(F.concat(i % 60 * 1000, F.lit("/"), i % 3 * 1001)), 6).alias("fps"), V.media_type(name).alias("media"), ((i % 700 > 480) | (i % 50 > 10)).alias("compress"))


@query(
    "probe_info",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0.0::DOUBLE ELSE s_suppkey * 7.25::DOUBLE END AS duration, CAST(s_suppkey % 900 AS INTEGER) AS width, CAST(s_suppkey % 700 AS INTEGER) AS height, CAST(format('{:.2f}', coalesce(CASE WHEN s_suppkey % 3 > 0 THEN (s_suppkey % 60 * 1000)::DOUBLE / (s_suppkey % 3 * 1001)::DOUBLE END, 30.0::DOUBLE)) AS DOUBLE) AS fps,
    CASE WHEN s_suppkey % 2 = 0 THEN 'h264' ELSE 'unknown' END AS codec, s_suppkey * 100000 AS file_size, s_suppkey % 700 > 480 OR coalesce(CASE WHEN s_suppkey % 3 > 0 THEN (s_suppkey % 60 * 1000)::DOUBLE / (s_suppkey % 3 * 1001)::DOUBLE END, 30.0::DOUBLE) > 10.004::DOUBLE AS compress,
    s_suppkey % 5 > 0 AND s_suppkey > 0 AND (s_suppkey % 4 < 3 AND abs(s_suppkey % 4 * 3) <= greatest(5.0::DOUBLE, s_suppkey * 0.0725::DOUBLE) OR s_suppkey % 4 = 3 AND 9 <= greatest(5.0::DOUBLE, s_suppkey * 0.0725::DOUBLE)) AS same FROM supplier WHERE s_suppkey % 7 > 0""",
)
def probe_info(spark, sf_dir):
    """Probes of files with sound before the picture; every seventh has no picture."""
    i = F.col("s_suppkey")
    video = F.when(i % 7 > 0, F.concat(F.lit(', {"codec_type": "video", "width": '), i % 900, F.lit(', "height": "'), i % 700, F.lit('", "r_frame_rate": "'), i % 60 * 1000, F.lit("/"), i % 3 * 1001, F.lit('"'), F.when(i % 2 == 0, ', "codec_name": "h264"').otherwise(""), F.lit("}"))).otherwise("")
    length = F.when(i % 5 > 0, F.concat(F.lit(', "duration": "'), i * 7.25, F.lit('"'))).otherwise("")
    text = F.concat(F.lit('{"streams": [{"codec_type": "audio", "codec_name": "aac"}'), video, F.lit('], "format": {"size": "'), i * 100000, F.lit('"'), length, F.lit("}}"))
    rows = probe.info(A.table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("probe"))).drop("probe")
    return rows.withColumn("compress", probe.needs_compression(F.col("height"), F.col("fps"))).withColumn("same", probe.duration_matches(F.col("duration"), i * 7.25 + i % 4 * 3))


@query(
    "normalize_ids",
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'char_' || user_id WHEN event_id % 5 = 1 THEN 'entity_' || user_id WHEN event_id % 5 = 2 THEN CASE WHEN event_id % 10 = 2 THEN 'char_tmp_unknown_1' ELSE 'char_tmp_chunk_' || lpad((event_id % 40)::VARCHAR, 4, '0') || '_unknown_1' END END AS character FROM events",
)
def normalize_ids(spark, sf_dir):
    i = F.col("event_id")
    name = F.when(i % 5 == 0, F.concat(F.lit(" char_"), "user_id")).when(i % 5 == 1, F.concat(F.lit("entity_"), "user_id")).when(i % 5 == 2, "unknown_1 ").when(i % 5 == 3, "unknown")
    return A.table(spark, sf_dir, "events").select("event_id", V.character_id(name, F.when(i % 10 == 2, -1).otherwise(i % 40).cast("int")).alias("character"))


_ITEMS = "items AS (SELECT video_id AS chunk, scene_index, start_cs / 100.0::DOUBLE + CASE WHEN video_id % 2 = 0 THEN 0 ELSE (video_id % 9) * 1000 END AS start, end_cs / 100.0::DOUBLE + CASE WHEN video_id % 2 = 0 THEN 0 ELSE (video_id % 9) * 1000 END AS stop FROM shots)"
_SPANS = "spans AS (SELECT chunk, (chunk % 9) * 1000.0::DOUBLE AS start_time, (chunk % 9) * 1000.0::DOUBLE + max(end_cs) / 100.0::DOUBLE AS end_time, max(end_cs) / 100.0::DOUBLE AS duration FROM (SELECT video_id AS chunk, end_cs FROM shots) GROUP BY chunk)"


@query(
    "time_mode_infer",
    A.sql(
        ["shots", _ITEMS, _SPANS],
        """SELECT chunk, CASE WHEN start_time > 0.5 AND whole > own AND least_t >= start_time - 1 THEN 'absolute' ELSE 'relative' END AS mode FROM spans LEFT JOIN (
        SELECT chunk, count(*) FILTER (t <= greatest(duration, end_time - start_time) + 1) AS own, count(*) FILTER (t >= start_time - 1 AND t <= end_time + 1) AS whole, min(t) AS least_t FROM (SELECT chunk, unnest([start, stop]) AS t FROM items) JOIN spans USING (chunk) WHERE t >= 0 GROUP BY chunk) USING (chunk)""",
    ),
)
def time_mode_infer(spark, sf_dir):
    v = F.col("video_id")
    move = F.when(v % 2 == 0, 0).otherwise(v % 9 * 1000)
    shots = A.shots(spark, sf_dir)
    items = shots.select(v.alias("chunk"), (F.col("start_cs") / 100 + move).alias("start"), (F.col("end_cs") / 100 + move).alias("end"))
    spans = shots.groupBy(v.alias("chunk")).agg((F.max("end_cs") / 100).alias("duration")).withColumn("start_time", (F.col("chunk") % 9 * 1000).cast("double")).withColumn("end_time", F.col("start_time") + F.col("duration"))
    return K.time_modes(items, spans)


@query(
    "dual_index_resolve",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN by_local IS NOT NULL AND scene IS NOT NULL THEN CASE WHEN mode = 'local' THEN by_local ELSE scene END
      WHEN scene IS NOT NULL THEN CASE WHEN mode = 'local' AND as_local IS NOT NULL THEN as_local ELSE scene END WHEN by_local IS NOT NULL THEN by_local ELSE as_local END AS resolved
    FROM (SELECT *, CASE WHEN l_linenumber < 4 THEN l_linenumber + 10 END AS by_local, CASE WHEN l_partkey % 20 BETWEEN 10 AND 15 THEN l_partkey % 20 END AS scene, CASE WHEN l_partkey % 20 < 6 THEN l_partkey % 20 + 10 END AS as_local, CASE WHEN l_orderkey % 3 = 0 THEN 'local' ELSE 'global' END AS mode FROM lineitem)""",
)
def dual_index_resolve(spark, sf_dir):
    local, scene = F.col("l_linenumber"), F.col("l_partkey") % 20
    mode = K.scene_index_mode(F.when(F.col("l_orderkey") % 3 == 0, 2).otherwise(1), F.lit(1))
    return A.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", K.resolved_scene(F.when(local < 4, local + 10), F.when(scene.between(10, 15), scene), F.when(scene < 6, scene + 10), mode).cast("long").alias("resolved")
    )


@query("best_of_answers", "SELECT o_custkey, arg_max(o_orderkey, (length(o_orderpriority) + 8 * (o_orderkey % 5) + 5 * (o_orderkey % 2), -o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def best_of_answers(spark, sf_dir):
    i = F.col("o_orderkey")
    rows = A.table(spark, sf_dir, "orders").withColumn("quality", K.answer_quality(F.length("o_orderpriority"), i % 5, i % 2))
    return joins.keep(rows, ["o_custkey"], [-F.col("quality"), i], last=False).select("o_custkey", "o_orderkey")


@query(
    "list_rules",
    "SELECT scene_index, array_to_string(list[1:3], ',') AS first3, array_to_string(list[-3:], ',') AS last3, len(list_distinct(list)) AS n_distinct, array_to_string(list_transform(list_sort(list_distinct(list)), lambda x: upper(x)), ',') AS names, list_contains(list, 'user') AS has_user FROM (SELECT conv_id AS scene_index, list(role ORDER BY turn) AS list FROM conversations GROUP BY conv_id)",
)
def list_rules(spark, sf_dir):
    own = A.transcripts(spark, sf_dir).groupBy("scene_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "speaker"))), lambda x: x["speaker"]).alias("list"))
    x, n = F.col("list"), F.size("list")
    return own.select("scene_index", F.array_join(F.slice(x, 1, 3), ",").alias("first3"), F.array_join(F.slice(x, F.greatest(n - 2, F.lit(1)), F.lit(3)), ",").alias("last3"), F.size(F.array_distinct(x)).alias("n_distinct"), F.array_join(F.transform(F.array_sort(F.array_distinct(x)), F.upper), ",").alias("names"), F.array_contains(x, "user").alias("has_user"))


@query(
    "set_rules",
    A.sql("appearances", "SELECT x.c AS a, y.c AS b, coalesce(n, 0) AS \"both\", x.s + y.s - coalesce(n, 0) AS either, round(coalesce(n, 0) / (x.s + y.s - coalesce(n, 0)), 6) AS jaccard, x.s - coalesce(n, 0) AS only_a FROM (SELECT character AS c, count(*) AS s FROM appearances GROUP BY 1) x JOIN (SELECT character AS c, count(*) AS s FROM appearances GROUP BY 1) y ON x.c < y.c JOIN (SELECT p.character AS a, q.character AS b, count(*) AS n FROM appearances p JOIN appearances q USING (shot) WHERE p.character < q.character GROUP BY ALL) ON a = x.c AND b = y.c"),
)
def set_rules(spark, sf_dir):
    """Every pair of characters that share a shot."""
    return entity.overlaps(A.appearances(spark, sf_dir, once=False))
