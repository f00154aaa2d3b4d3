"""Timeline views over the fixture tables, and the same views as SQL.

Times are whole centiseconds, so that sums are exact in any order. Each view is a function of (spark, sf_dir); the
SQL of the same name in ``CTES`` gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contiguous timeline for each user: one shot an event, of the length its value says."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    length = F.round(F.col("value") * 100).cast("long")
    before = F.coalesce(F.sum("dur_cs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = table(spark, sf_dir, "events").withColumn("dur_cs", length)
    return rows.select(
        F.col("user_id").alias("video_id"), (F.row_number().over(order) - 1).alias("scene_index"), "event_id", "event_type", before.alias("start_cs"), (before + F.col("dur_cs")).alias("end_cs"), "dur_cs"
    )


def importance(props: str = "props"):
    return F.floor(F.get_json_object(props, "$.k").cast("int") / 10).cast("int") + 1


def story_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on the timeline that reach five seconds into what follows."""
    own = table(spark, sf_dir, "events").select("event_id", importance().alias("importance"))
    return shots(spark, sf_dir).join(own, "event_id").select("video_id", "event_id", "event_type", "start_cs", (F.col("end_cs") + 500).alias("end_cs"), "importance")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("scene_index"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), "text")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as described scenes: text, mood, type and what is in them."""
    objects = F.array(F.concat(F.lit("obj_"), F.coalesce("n_chars", F.lit(0)) % 7))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scene_index"), F.col("text").alias("description"), F.col("lang").alias("mood"), F.col("source").alias("scene_type"), objects.alias("objects"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three words of each benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("query"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of 0 to 1 for each labelled document, in steps that both engines agree on."""
    own = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    size = (F.col("n_chars") % 1000) / 1000
    return own.select(
        F.col("doc_id").alias("unit_index"), F.col("source").alias("unit_type"), size.alias("hook_score"), F.col("quality").cast("double").alias("clarity_score"),
        F.col("toxic").cast("double").alias("tension_score"), ((F.col("doc_id") * 7 % 100) / 100).alias("emotion_score"),
    )


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as faces: four to a key frame, two to a scene."""
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        i.alias("face_id"), F.floor(i / 4).cast("long").alias("keyframe"), F.floor(i / 2).cast("long").alias("scene_index"), (i * 37 % 100 / 100).alias("det_score"), F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


#: How far the eight faces of a person are turned from the first.
TURNS = (0.0, 0.1, 0.2, 0.6, 0.05, 0.15, 0.3, 3.0)


def crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight faces of each embedding's person, turned away step by step, in seven videos. ``cluster``: three of a person, the first two of which are alike, and share a key frame
    for every fifth person; ``crew``: the faces of two people, or of one in every third crew."""
    i = F.col("vec_id")
    e = F.col("embedding").cast("array<double>")

    def turned(by: float):
        return F.zip_with(e, F.reverse(e), lambda x, y: x + F.lit(by) * y)

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.array(*map(turned, TURNS))).alias("k", "embedding"))
    k = F.col("k")
    frame = i * 8 + F.when((k == 3) & (i % 5 == 0), 0).otherwise(k)
    pair = F.floor(i / 14)
    return rows.select(
        (i * 8 + k).alias("face_id"), (i % 7).alias("video_id"), frame.alias("keyframe"), "embedding", (i * 3 + F.when(k == 7, 2).when(k.isin(2, 3, 6), 1).otherwise(0)).alias("cluster"),
        F.when(pair % 3 == 0, 1_000_000 + i).otherwise(pair * 7 + i % 7).alias("crew"),
    )


def appearances(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """Which character is in which shot; not ``once``: with repeated rows, for what makes them distinct itself where it has dealt them out."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("character"), F.col("l_orderkey").alias("shot"))
    return rows.distinct() if once else rows


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan a customer, one clip an order; durations in centiseconds, speeds of 1, 1.25 or 2."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders")
    speed = F.element_at(F.array(F.lit(100), F.lit(125), F.lit(200)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return rows.select(
        F.col("o_custkey").alias("plan_id"), (F.row_number().over(order) - 1).alias("clip_index"), F.col("o_orderkey").alias("clip_id"), F.floor(F.col("o_totalprice") / 10).cast("long").alias("dur_cs"),
        F.col("o_orderpriority").alias("role"), F.col("o_orderstatus").alias("status"), speed.alias("speed_pct"),
    )


CTES = {
    "shots": """shots AS (
  SELECT user_id AS video_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS scene_index, event_id, event_type,
    CAST(coalesce(sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_cs,
    CAST(coalesce(sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d AS BIGINT) AS end_cs, d AS dur_cs
  FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS d FROM events))""",
    "story_events": """story_events AS (
  SELECT s.video_id, s.event_id, s.event_type, s.start_cs, s.end_cs + 500 AS end_cs, CAST(CAST(json_extract(e.props, '$.k') AS INTEGER) // 10 AS INTEGER) + 1 AS importance
  FROM shots s JOIN events e USING (event_id))""",
    "transcripts": "transcripts AS (SELECT conv_id AS scene_index, turn AS pos, role AS speaker, text FROM conversations)",
    "scenes": "scenes AS (SELECT doc_id AS scene_index, text AS description, lang AS mood, source AS scene_type, ['obj_' || (coalesce(n_chars, 0) % 7)] AS objects FROM documents)",
    "search_queries": "search_queries AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS query FROM benchmark)",
    "signals": """signals AS (
  SELECT doc_id AS unit_index, source AS unit_type, (n_chars % 1000) / 1000.0::DOUBLE AS hook_score, quality::DOUBLE AS clarity_score, toxic::DOUBLE AS tension_score, (doc_id * 7 % 100) / 100.0::DOUBLE AS emotion_score
  FROM labels JOIN documents USING (doc_id))""",
    "faces": "faces AS (SELECT vec_id AS face_id, vec_id // 4 AS keyframe, vec_id // 2 AS scene_index, (vec_id * 37 % 100) / 100.0::DOUBLE AS det_score, embedding::DOUBLE[] AS embedding, label FROM embeddings)",
    "crowd": """crowd AS (SELECT vec_id * 8 + k AS face_id, vec_id % 7 AS video_id, vec_id * 8 + CASE WHEN k = 3 AND vec_id % 5 = 0 THEN 0 ELSE k END AS keyframe,
    list_transform(range(1, 65), lambda j: e[j] + [0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.6::DOUBLE, 0.05::DOUBLE, 0.15::DOUBLE, 0.3::DOUBLE, 3.0::DOUBLE][k + 1] * e[65 - j]) AS embedding,
    vec_id * 3 + CASE WHEN k = 7 THEN 2 WHEN k IN (2, 3, 6) THEN 1 ELSE 0 END AS cluster, CASE WHEN vec_id // 14 % 3 = 0 THEN 1000000 + vec_id ELSE vec_id // 14 * 7 + vec_id % 7 END AS crew
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(8)) AS k FROM embeddings))""",
    "appearances": "appearances AS (SELECT DISTINCT l_suppkey AS character, l_orderkey AS shot FROM lineitem)",
    "clips": """clips AS (
  SELECT o_custkey AS plan_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS clip_index, o_orderkey AS clip_id, CAST(floor(o_totalprice / 10) AS BIGINT) AS dur_cs,
    o_orderpriority AS role, o_orderstatus AS status, [100, 125, 200][o_orderkey % 3 + 1] AS speed_pct
  FROM orders)""",
}


def sql(views: str | list[str], body: str, recursive: bool = False) -> str:
    """``body`` behind the views it reads: names of ``CTES``, in one string, or in a list with further expressions."""
    parts = [CTES.get(v, v) for v in (views.split() if isinstance(views, str) else views)]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}" if parts else body
