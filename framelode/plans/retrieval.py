"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelode.functions import text as T
from framelode.operators import chapter_plan as P
from framelode.operators import search as S
from framelode.operators import shared
from framelode.plans.registry import query
from framelode.sources import adapters as A

_TERMS = r"list_filter(regexp_split_to_array(lower({0}), '[\s\x{{3000}}]+'), lambda w: w <> '')"
_HITS = "len(list_filter(terms, lambda t: contains({0}, t)))"
_ASKED = "asked AS (SELECT *, " + _TERMS.format("query") + " AS terms FROM search_queries)"
_TRANSCRIPT = f"th AS (SELECT query_id, scene_index, {_HITS.format('lower(text)')} / len(terms) AS score, pos, text FROM transcripts, asked WHERE {_HITS.format('lower(text)')} > 0)"
_SCENE = "lower(concat_ws(' ', description, mood, scene_type, array_to_string(objects, ' ')))"
_VISION = f"vh AS (SELECT query_id, scene_index, {_HITS.format(_SCENE)} / len(terms) * 0.8::DOUBLE AS score, description FROM scenes, asked WHERE {_HITS.format(_SCENE)} > 0)"


@query("kw_transcript_score", A.sql(["transcripts", "search_queries", _ASKED, _TRANSCRIPT], "SELECT query_id, scene_index, pos, round(score, 6) AS score, left(text, 100) AS snippet FROM th"))
def kw_transcript_score(spark, sf_dir):
    return S.transcript_hits(A.transcripts(spark, sf_dir), A.search_queries(spark, sf_dir)).select("query_id", "scene_index", "pos", F.round("score", 6).alias("score"), "snippet")


@query("kw_vision_score", A.sql(["scenes", "search_queries", _ASKED, _VISION], "SELECT query_id, scene_index, round(score, 6) AS score, left(description, 100) AS snippet FROM vh"))
def kw_vision_score(spark, sf_dir):
    return S.vision_hits(A.scenes(spark, sf_dir), A.search_queries(spark, sf_dir)).select("query_id", "scene_index", F.round("score", 6).alias("score"), "snippet")


def _event_rows(spark, sf_dir):
    own = A.story_events(spark, sf_dir)
    return own.select(F.col("event_id").alias("pos"), F.col("video_id").alias("scene_index"), F.concat_ws(" ", F.lit("user"), "event_type", "importance").alias("description"), "event_type", F.when(F.col("importance") >= 7, "tense").otherwise("calm").alias("emotion"), "importance")


def _event_queries(spark):
    return spark.sql("SELECT * FROM VALUES (1, 'click tense'), (2, 'user ERROR  calm'), (3, 'purchase purchase view'), (4, '  '), (5, '10 calm') AS q(query_id, query)")


@query(
    "kw_event_score",
    A.sql(
        "shots story_events",
        f"""SELECT query_id, event_id AS pos, round(least({_HITS.format('txt')} / len(terms) * 0.9::DOUBLE * (1 + importance * 0.05::DOUBLE), 2.0::DOUBLE), 6) AS score
        FROM (SELECT *, lower(concat_ws(' ', 'user', event_type, importance, event_type, CASE WHEN importance >= 7 THEN 'tense' ELSE 'calm' END)) AS txt FROM story_events),
        (SELECT query_id, {_TERMS.format('query')} AS terms FROM (VALUES (1, 'click tense'), (2, 'user ERROR  calm'), (3, 'purchase purchase view'), (4, '  '), (5, '10 calm')) q(query_id, query))
        WHERE {_HITS.format('txt')} > 0""",
    ),
)
def kw_event_score(spark, sf_dir):
    return S.event_hits(_event_rows(spark, sf_dir), _event_queries(spark)).select("query_id", "pos", F.round("score", 6).alias("score"))


_MARKS = T.KEYWORD_MARKS.replace("'", "''")
_PARTS = r"list_filter(regexp_split_to_array({0}, '[\s\x{{3000}}]+'), lambda w: w <> '')"
_GRAMS = "flatten(list_transform(list_filter({0}, lambda p: strlen(p) <> length(p) AND length(p) >= 2), lambda p: list_transform(range(1, length(p)), lambda i: substring(p, i, 2))))"
_KEYWORDS = f"list_sort(list_distinct(list_concat(list_filter(list_transform({_PARTS}, lambda w: lower(trim(w, '{_MARKS}'))), lambda w: length(w) >= 2), {_GRAMS.format(_PARTS)})))[1:100]"


@query("text_index_keywords", A.sql("transcripts", f"SELECT scene_index, pos, len(k) AS n_keywords, array_to_string(k, ' ') AS keywords FROM (SELECT *, {_KEYWORDS.format('text')} AS k FROM transcripts)"))
def text_index_keywords(spark, sf_dir):
    k = T.keywords(F.col("text"))
    return A.transcripts(spark, sf_dir).select("scene_index", "pos", F.size(k).alias("n_keywords"), F.array_join(k, " ").alias("keywords"))


_INDEX_TERMS = f"list_distinct(list_concat({_TERMS.format('query')}, {_GRAMS.format(_PARTS.format('lower(query)'))}))"


@query(
    "text_index_score",
    A.sql(
        "transcripts search_queries",
        f"""SELECT query_id, scene_index, pos, m AS matches, CAST(format('{{:.3f}}', least(m / (len(terms) * 2), 1.5::DOUBLE) * 0.85::DOUBLE) AS DOUBLE) AS score, left(text, 100) AS snippet,
          array_to_string(CASE WHEN {_HITS.format('lower(text)')} > 0 THEN ['transcript'] ELSE ['index'] END, ',') AS modalities FROM (
        SELECT query_id, scene_index, pos, text, terms, len(list_intersect(terms, k)) + {_HITS.format('lower(text)')} AS m
        FROM (SELECT *, {_KEYWORDS.format('text')} AS k FROM transcripts),
        (SELECT query_id, {_INDEX_TERMS} AS terms FROM search_queries)) WHERE m > 0""",
    ),
)
def text_index_score(spark, sf_dir):
    rows = A.transcripts(spark, sf_dir).select(F.struct("scene_index", "pos").alias("scene_index"), F.col("text").alias("combined_text"), T.keywords(F.col("text")).alias("keywords"), F.col("text").alias("transcript"), F.lit("").alias("vision_description"))
    return S.index_hits(rows, A.search_queries(spark, sf_dir)).select("query_id", "scene_index.scene_index", "scene_index.pos", "matches", "score", "snippet", F.array_join("modalities", ",").alias("modalities"))


def _merged(spark, sf_dir):
    asked = A.search_queries(spark, sf_dir)
    return S.merged([S.transcript_hits(A.transcripts(spark, sf_dir), asked), S.vision_hits(A.scenes(spark, sf_dir), asked)])


_DEDUPE = """records AS (SELECT *, coalesce(score > max(score) OVER (PARTITION BY query_id, scene_index ORDER BY layer, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS record FROM hits),
 kinds AS (SELECT query_id, scene_index, string_agg(m, ',' ORDER BY place) AS modalities FROM (SELECT query_id, scene_index, m, min((layer, pos, k)) AS place FROM (
   SELECT query_id, scene_index, layer, pos, unnest(modalities) AS m, generate_subscripts(modalities, 1) AS k FROM hits) GROUP BY ALL) GROUP BY ALL),
 best AS (SELECT query_id, scene_index, max(score) AS score, arg_max(match_type, (layer, pos)) FILTER (record) AS match_type, coalesce(arg_max(snippet, (layer, pos)) FILTER (record AND snippet <> ''), '') AS snippet,
   count(DISTINCT ref) AS n_refs, coalesce(arg_min(transcript, (layer, pos)) FILTER (transcript <> ''), '') AS transcript, coalesce(arg_min(vision, (layer, pos)) FILTER (vision <> ''), '') AS vision FROM records GROUP BY ALL),
 merged AS (SELECT * FROM best JOIN kinds USING (query_id, scene_index))"""
_MERGE = [
    *("transcripts", "scenes", "search_queries", _ASKED, _TRANSCRIPT, _VISION),
    """hits AS (SELECT query_id, scene_index, score, 'keyword_transcript' AS match_type, left(text, 100) AS snippet, text AS transcript, '' AS vision, ['transcript'] AS modalities, 'transcripts#t' || pos AS ref, 0 AS layer, pos FROM th
  UNION ALL SELECT query_id, scene_index, score, 'keyword_vision', left(description, 100), '', description, ['vision'], 'vision#scene_' || scene_index, 1, scene_index FROM vh)""",
    _DEDUPE,
]


@query("merge_dedupe_modalities", A.sql(_MERGE, "SELECT query_id, scene_index, round(score, 6) AS score, match_type, snippet, modalities, n_refs, md5(transcript) AS transcript_md5, md5(vision) AS vision_md5 FROM merged"))
def merge_dedupe_modalities(spark, sf_dir):
    # hits are dealt by scene alone, once: what follows is of a query and scene or of a scene
    out = S.deduplicated(_merged(spark, sf_dir).repartition("scene_index"))
    # digests, not texts, meet the hits
    line = F.struct(F.col("pos").cast("long").alias("at"), F.md5("text").alias("md5"))
    lines = A.transcripts(spark, sf_dir).groupBy("scene_index").agg(F.collect_list(line).alias("lines"))
    views = A.scenes(spark, sf_dir).groupBy("scene_index").agg(F.min(F.md5("description")).alias("view"))
    out = out.join(lines, "scene_index", "left").join(views, "scene_index", "left").withColumns({
        "transcript_md5": F.get(F.filter("lines", lambda x: x["at"] == F.col("transcript_at")), F.lit(0))["md5"], "vision_md5": F.when(F.col("vision_at").isNotNull(), F.col("view")),
    })
    filled = lambda c: F.coalesce(c, F.md5(F.lit(""))).alias(c)
    return out.select("query_id", "scene_index", F.round("score", 6).alias("score"), "match_type", "snippet", F.array_join("modalities", ",").alias("modalities"), F.size("refs").cast("long").alias("n_refs"), filled("transcript_md5"), filled("vision_md5"))


@query(
    "kw_search_topk",
    A.sql(_MERGE, "SELECT query_id, CAST(rank AS INTEGER) AS rank, scene_index, round(score, 6) AS score, match_type, modalities, snippet FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, scene_index) AS rank FROM merged) WHERE rank <= 10"),
)
def kw_search_topk(spark, sf_dir):
    asked = A.search_queries(spark, sf_dir)
    layers = lambda rows, best: [S.transcript_hits(rows["transcripts"], asked, best), S.vision_hits(rows["vision"], asked, best)]
    ranked = S.best_scenes(layers, {"transcripts": A.transcripts(spark, sf_dir), "vision": A.scenes(spark, sf_dir)}, 10)
    return ranked.select("query_id", "rank", "scene_index", F.round("score", 6).alias("score"), "match_type", F.array_join("modalities", ",").alias("modalities"), "snippet")


# One memory for the whole funnel: a scene is a document's number, its lines are a conversation's.
_MEMORY = [
    *("shots", "story_events", "transcripts", "scenes"),
    "mq AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:3], ' ') || ' ' || ['click', 'obj_3', 'TENSE purchase', ''][item_id % 4 + 1] AS query, embedding::DOUBLE[] AS embedding FROM benchmark JOIN embeddings ON vec_id = item_id * 3)",
    "asked AS (SELECT *, " + _TERMS.format("query") + " AS terms FROM mq)",
    _TRANSCRIPT,
    _VISION,
    "sh AS (SELECT doc_id + doc_id // 16 AS scene_index, doc_id * 100 AS start_cs, doc_id * 100 + 100 AS end_cs FROM documents GROUP BY doc_id)",
    f"""eh AS (SELECT query_id, scene_index, event_id AS pos, description, least({_HITS.format('txt')} / len(terms) * 0.9::DOUBLE * (1 + importance * 0.05::DOUBLE), 2.0::DOUBLE) AS score FROM (
      SELECT *, lower(concat_ws(' ', description, event_type, emotion)) AS txt FROM (SELECT video_id AS scene_index, event_id, event_type, importance, 'user ' || event_type || ' ' || importance AS description, CASE WHEN importance >= 7 THEN 'tense' ELSE 'calm' END AS emotion FROM story_events)), asked
      WHERE {_HITS.format('txt')} > 0)""",
    f"""un AS (SELECT scene_index, string_agg(text, ' ' ORDER BY pos) AS combined_text, arg_min(text, pos) AS transcript, arg_max(text, pos) AS vision FROM transcripts GROUP BY scene_index),
    ix AS (SELECT query_id, scene_index, terms, len(list_intersect(terms, k)) + {_HITS.format('lower(combined_text)')} AS m, transcript, vision FROM (SELECT *, {_KEYWORDS.format('combined_text')} AS k FROM un), (SELECT query_id, {_INDEX_TERMS} AS terms FROM mq)),
    ih AS (SELECT *, CAST(format('{{:.3f}}', least(m / (len(terms) * 2), 1.5::DOUBLE) * 0.85::DOUBLE) AS DOUBLE) AS score, list_concat(CASE WHEN {_HITS.format('lower(transcript)')} > 0 THEN ['transcript'] ELSE [] END, CASE WHEN {_HITS.format('lower(vision)')} > 0 THEN ['vision'] ELSE [] END) AS ms FROM ix WHERE m > 0)""",
    """eb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, scene_index) AS rank FROM (SELECT q.query_id, u.vec_id AS scene_index, round(list_cosine_similarity(u.embedding::DOUBLE[], q.embedding), 9) AS score FROM embeddings u, mq q)) WHERE rank <= 50)""",
    """every_hit AS (SELECT query_id, scene_index, score, 'embedding' AS match_type, '' AS snippet, '' AS transcript, '' AS vision, ['embedding'] AS modalities, 'vectors#' || scene_index AS ref, 0 AS layer, rank AS pos FROM eb
  UNION ALL SELECT query_id, scene_index, score, 'keyword_transcript', left(text, 100), text, '', ['transcript'], 'transcripts#t' || pos, 1, pos FROM th
  UNION ALL SELECT query_id, scene_index, score, 'keyword_vision', left(description, 100), '', description, ['vision'], 'vision#scene_' || scene_index, 2, scene_index FROM vh
  UNION ALL SELECT query_id, scene_index, score, 'keyword_event', left(description, 100), '', '', ['event'], 'events#event_' || pos, 3, pos FROM eh
  UNION ALL SELECT query_id, scene_index, score, 'index', left(coalesce(nullif(vision, ''), transcript, ''), 100), '', '', CASE WHEN len(ms) = 0 THEN ['index'] ELSE ms END, 'search_index#scene_' || scene_index, 4, 0 FROM ih)""",
]
_FUNNEL = [
    _DEDUPE,
    """top20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, scene_index) - 1 AS "index", count(*) OVER (PARTITION BY query_id) AS n FROM merged) WHERE "index" < 20),
 answered AS (SELECT *, ((query_id * 7 + "index" * 3) % 11) / 11.0::DOUBLE AS relevance FROM top20),
 blended AS (SELECT * REPLACE (CASE WHEN stays THEN score WHEN semantic THEN CAST(format('{:.3f}', score * 0.3::DOUBLE + relevance * 0.7::DOUBLE) AS DOUBLE) ELSE score * 0.3::DOUBLE END AS score) FROM (
   SELECT *, n < 4 OR query_id % 5 = 0 AS stays, NOT (n < 4 OR query_id % 5 = 0) AND "index" % 2 = 0 AND relevance > 0.2::DOUBLE AS semantic FROM answered)),
 top_k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "index") AS rank FROM blended) WHERE rank <= 10),
 lines AS (SELECT scene_index, string_agg(text, ' ' ORDER BY pos) AS every_line FROM transcripts GROUP BY scene_index)""",
]
_SHOWN = """SELECT query_id, CAST(rank AS INTEGER) AS rank, t.scene_index, round(score, 6) AS score, match_type, snippet, CASE WHEN semantic THEN modalities || ',semantic' ELSE modalities END AS modalities, n_refs,
  md5(coalesce(nullif(t.transcript, ''), nullif(un.transcript, ''), every_line, '')) AS transcript_md5, md5(coalesce(nullif(t.vision, ''), nullif(un.vision, ''), d.text, '')) AS vision_md5, sh.start_cs, sh.end_cs, md5(un.combined_text) AS unit_md5,
  CASE WHEN sh.scene_index IS NOT NULL AND s0.scene_index IS NOT NULL THEN left(u0.combined_text, 100) END AS context_before, CASE WHEN sh.scene_index IS NOT NULL AND s2.scene_index IS NOT NULL THEN left(u2.combined_text, 100) END AS context_after
  FROM top_k t LEFT JOIN un ON un.scene_index = t.scene_index LEFT JOIN lines ON lines.scene_index = t.scene_index LEFT JOIN documents d ON d.doc_id = t.scene_index LEFT JOIN sh ON sh.scene_index = t.scene_index
  LEFT JOIN sh s0 ON s0.scene_index = t.scene_index - 1 LEFT JOIN un u0 ON u0.scene_index = t.scene_index - 1 LEFT JOIN sh s2 ON s2.scene_index = t.scene_index + 1 LEFT JOIN un u2 ON u2.scene_index = t.scene_index + 1"""


def _funnel_sql(condition: str) -> str:
    return A.sql([*_MEMORY, "appearances", f"hits AS (SELECT * FROM every_hit WHERE {condition})", *_FUNNEL], _SHOWN)


def _memory(spark, sf_dir):
    col = F.col
    lines = A.transcripts(spark, sf_dir)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    units = lines.groupBy("scene_index").agg(F.array_join(ordered, " ").alias("combined_text"), F.min_by("text", "pos").alias("transcript"), F.max_by("text", "pos").alias("vision"))
    vectors = A.table(spark, sf_dir, "embeddings").select(col("vec_id").alias("scene_index"), "embedding")
    # every seventeenth number is no shot's
    docs = A.table(spark, sf_dir, "documents").select("doc_id").distinct()
    return {
        "units": units.join(vectors, "scene_index", "full"), "transcripts": lines, "vision": A.scenes(spark, sf_dir), "events": _event_rows(spark, sf_dir), "appearances": A.appearances(spark, sf_dir),
        "index": units.select("scene_index", "combined_text", T.keywords(col("combined_text")).alias("keywords"), "transcript", col("vision").alias("vision_description")),
        "shots": docs.select((col("doc_id") + F.floor(col("doc_id") / 16)).alias("scene_index"), (col("doc_id") * 100).alias("start_cs"), (col("doc_id") * 100 + 100).alias("end_cs")),
    }


def _asked(spark, sf_dir):
    more = F.element_at(F.array(*map(F.lit, ("click", "obj_3", "TENSE purchase", ""))), (F.col("item_id") % 4 + 1).cast("int"))
    words = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    vectors = A.table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 3).alias("item_id"), "embedding")
    return A.table(spark, sf_dir, "benchmark").join(vectors, "item_id").select(F.col("item_id").alias("query_id"), F.concat(words, F.lit(" "), more).alias("query"), "embedding")


def _answers(candidates):
    """A model's answers: every second candidate, and none for every fifth query."""
    rows = candidates.where("index % 2 = 0 AND query_id % 5 > 0")
    return rows.select("query_id", "index", (((F.col("query_id") * 7 + F.col("index") * 3) % 11) / 11).alias("relevance"), F.col("index").alias("pos"))


def _shown(found):
    return found.select(
        "query_id", "rank", *S.scene_key(found), F.round("score", 6).alias("score"), "match_type", "snippet", F.array_join("modalities", ",").alias("modalities"), F.size("refs").cast("long").alias("n_refs"),
        F.md5("transcript").alias("transcript_md5"), F.md5("vision").alias("vision_md5"), "start_cs", "end_cs", F.md5("combined_text").alias("unit_md5"), "context_before", "context_after",
    )


@query("search_memory", _funnel_sql("true"))
def search_memory(spark, sf_dir):
    return _shown(S.search_memory(_memory(spark, sf_dir), _asked(spark, sf_dir), answers=_answers))


@query("search_memory_character", _funnel_sql("scene_index IN (SELECT shot FROM appearances WHERE character = 5)"))
def search_memory_character(spark, sf_dir):
    return _shown(S.search_memory(_memory(spark, sf_dir), _asked(spark, sf_dir), answers=_answers, character=5))


@query("search_memory_time", _funnel_sql("scene_index IN (SELECT scene_index FROM sh WHERE start_cs >= 500 AND end_cs <= 15000)"))
def search_memory_time(spark, sf_dir):
    return _shown(S.search_memory(_memory(spark, sf_dir), _asked(spark, sf_dir), answers=_answers, time_range=(500, 15000)))


@query("search_memory_scene_type", _funnel_sql("scene_index IN (SELECT scene_index FROM scenes WHERE contains(lower(scene_type), 'src1'))"))
def search_memory_scene_type(spark, sf_dir):
    return _shown(S.search_memory(_memory(spark, sf_dir), _asked(spark, sf_dir), answers=_answers, scene_type="SRC1"))


@query("filter_character", A.sql("appearances", "SELECT 5 AS asked, o_orderkey AS scene_index FROM orders WHERE o_orderkey IN (SELECT shot FROM appearances WHERE character = 5) UNION ALL SELECT -1, o_orderkey FROM orders"))
def filter_character(spark, sf_dir):
    hits, who = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_index")), A.appearances(spark, sf_dir)
    return S.of_character(hits, who, 5).select(F.lit(5).alias("asked"), "scene_index").union(S.of_character(hits, who, -1).select(F.lit(-1).alias("asked"), "scene_index"))


@query("filter_time", A.sql("shots", "SELECT video_id, scene_index FROM shots WHERE start_cs >= 2000 AND end_cs <= 30000"))
def filter_time(spark, sf_dir):
    rows = A.shots(spark, sf_dir).withColumn("scene_index", F.struct("video_id", "scene_index"))
    return S.within_time(rows.select("scene_index"), rows, 2000, 30000).select("scene_index.*")


@query("filter_scene_type", A.sql("scenes", "SELECT scene_index FROM scenes WHERE contains(lower(scene_type), 'src1')"))
def filter_scene_type(spark, sf_dir):
    rows = A.scenes(spark, sf_dir)
    return S.of_scene_type(rows.select("scene_index"), rows, "SRC1").select("scene_index")


@query(
    "neighbor_context",
    A.sql("transcripts", "SELECT scene_index AS video_id, pos AS scene_index, left(lag(text) OVER w, 100) AS context_before, left(lead(text) OVER w, 100) AS context_after FROM transcripts WINDOW w AS (PARTITION BY scene_index ORDER BY pos)"),
)
def neighbor_context(spark, sf_dir):
    units = A.transcripts(spark, sf_dir).select(F.col("scene_index").alias("video_id"), F.col("pos").alias("scene_index"), F.col("text").alias("combined_text"))
    return S.with_context(units.select("video_id", "scene_index"), units).select("video_id", "scene_index", "context_before", "context_after")


@query(
    "vector_topn",
    """SELECT query_id, CAST(rank AS INTEGER) AS rank, scene_index, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, scene_index) AS rank FROM (
    SELECT q.vec_id AS query_id, u.vec_id AS scene_index, list_cosine_similarity(u.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings u, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 50""",
)
def vector_topn(spark, sf_dir):
    rows = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scene_index"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = rows.where("scene_index % 100 = 0").select(F.col("scene_index").alias("query_id"), "embedding")
    return S.vector_hits(rows, asked, 50).select("query_id", "rank", "scene_index", F.round("score", 6).alias("score"))


@query(
    "rerank_blend",
    A.sql(
        "clips",
        """SELECT plan_id AS query_id, clip_index AS "index", semantic, round(CASE WHEN stays THEN score WHEN semantic THEN CAST(format('{:.3f}', score * 0.3::DOUBLE + relevance * 0.7::DOUBLE) AS DOUBLE) ELSE score * 0.3::DOUBLE END, 6) AS score FROM (
        SELECT c.plan_id, c.clip_index, c.score, a.relevance, (c.n < 4 OR x.plan_id IS NULL) AS stays, NOT (c.n < 4 OR x.plan_id IS NULL) AND a.relevance IS NOT NULL AS semantic
        FROM (SELECT plan_id, clip_index, (clip_id % 97) / 97.0::DOUBLE AS score, count(*) OVER (PARTITION BY plan_id) AS n FROM clips) c
        LEFT JOIN (SELECT plan_id, clip_index, (clip_id % 11) / 11.0::DOUBLE AS relevance FROM clips WHERE clip_index % 2 = 0 AND (clip_id % 11) / 11.0::DOUBLE > 0.2::DOUBLE AND plan_id % 5 > 0) a USING (plan_id, clip_index)
        LEFT JOIN (SELECT DISTINCT plan_id FROM clips WHERE plan_id % 5 > 0) x ON x.plan_id = c.plan_id)""",
    ),
)
def rerank_blend(spark, sf_dir):
    rows = A.clips(spark, sf_dir)
    candidates = rows.select(F.col("plan_id").alias("query_id"), F.col("clip_index").alias("index"), ((F.col("clip_id") % 97) / 97).alias("score"))
    answers = rows.where("clip_index % 2 = 0 AND plan_id % 5 > 0").select(F.col("plan_id").alias("query_id"), F.col("clip_index").alias("index"), ((F.col("clip_id") % 11) / 11).alias("relevance"))
    # a second answer for the same candidate must change nothing
    answers = answers.withColumn("pos", F.lit(0)).union(answers.where("relevance > 0.2").select("query_id", "index", F.lit(0.99).alias("relevance"), F.lit(1).alias("pos")))
    return S.reranked(candidates, answers).select("query_id", "index", "semantic", F.round("score", 6).alias("score"))


# A collection: the memory's scenes dealt to three videos, whose scene numbers clash. A shot is ten seconds long.
_V = "scene_index % 3"
_COLLECTION = [
    *[m for m in _MEMORY if not m.startswith(("sh AS", "eb AS"))],
    "sh AS (SELECT doc_id + doc_id // 16 AS scene_index, ((doc_id + doc_id // 16) // 3) * 1000 AS start_cs, ((doc_id + doc_id // 16) // 3) * 1000 + 1000 AS end_cs FROM documents GROUP BY doc_id)",
]
_COLLECTION.insert(
    len(_COLLECTION) - 2,
    """eb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, scene_index) AS rank FROM (SELECT q.query_id, u.vec_id AS scene_index, round(list_cosine_similarity(u.embedding::DOUBLE[], q.embedding), 9) AS score FROM embeddings u, mq q WHERE u.vec_id % 3 = q.query_id % 3)) WHERE rank <= 50)""",
)


def _collection(spark, sf_dir):
    one = _memory(spark, sf_dir)
    dealt = {name: rows.withColumn("video_id", F.col(c := "shot" if name == "appearances" else "scene_index") % 3).withColumn(c, F.floor(F.col(c) / 3)) for name, rows in one.items()}
    return dealt | {"shots": dealt["shots"].select("video_id", "scene_index", (F.col("scene_index") * 1000).alias("start_cs"), (F.col("scene_index") * 1000 + 1000).alias("end_cs"))}


@query(
    "search_collection",
    A.sql(
        [
            *_COLLECTION,
            "appearances",
            """hits AS (SELECT h.* FROM every_hit h LEFT JOIN sh ON sh.scene_index = h.scene_index WHERE h.scene_index % 3 = query_id % 3 AND CASE query_id % 4
             WHEN 1 THEN sh.start_cs >= 3000 AND sh.end_cs <= 40000
             WHEN 2 THEN h.scene_index IN (SELECT shot FROM appearances WHERE character = query_id % 12) OR NOT EXISTS (SELECT 1 FROM appearances WHERE character = query_id % 12 AND shot % 3 = query_id % 3)
             WHEN 3 THEN sh.start_cs >= 2000 AND h.scene_index IN (SELECT scene_index FROM scenes WHERE contains(lower(scene_type), 'src1')) ELSE TRUE END)""",
            *_FUNNEL,
        ],
        _SHOWN.replace("t.scene_index, round", "CAST(t.scene_index % 3 AS BIGINT) AS video_id, CAST(t.scene_index // 3 AS BIGINT) AS scene_index, round").replace("t.scene_index - 1", "t.scene_index - 3").replace("t.scene_index + 1", "t.scene_index + 3"),
    ),
)
def search_collection(spark, sf_dir):
    """Queries of several videos with filters of their own, in one call."""
    i = F.col("query_id")
    asked = _asked(spark, sf_dir).withColumns({
        "video_id": i % 3, "character": F.when(i % 4 == 2, i % 12), "start_cs": F.when(i % 4 == 1, 3000).when(i % 4 == 3, 2000), "end_cs": F.when(i % 4 == 1, 40000), "scene_type": F.when(i % 4 == 3, "SRC1"),
    })
    return _shown(S.search_memory(_collection(spark, sf_dir), asked, answers=_answers))


_EVENTS = "pe AS (SELECT event_id % 3 AS video_id, (event_id % 997) * 3.5::DOUBLE AS start_time, CASE WHEN event_id % 3 = 2 THEN least(importance, 5) ELSE importance END AS importance FROM story_events)"
_CHAPTERS = [
    *_COLLECTION,
    _EVENTS,
    "vd AS (SELECT scene_index % 3 AS video_id, max(end_cs) / 100 AS duration FROM sh GROUP BY 1)",
    """cut AS (SELECT video_id, 0.0::DOUBLE AS t FROM vd UNION ALL SELECT * FROM (SELECT c.video_id, (SELECT min(e.start_time) FROM pe e WHERE e.video_id = c.video_id AND e.importance >= 6 AND e.start_time - c.t >= 300) AS t FROM cut c) WHERE t IS NOT NULL)""",
    """ends AS (SELECT video_id, duration, CASE WHEN len(told) = 1 AND duration > 1200 THEN list_concat([0.0::DOUBLE], list_transform(range(1, CAST(ceil((duration - 300) / 600) AS BIGINT)), lambda i: i * 600.0::DOUBLE)) ELSE told END AS begins
      FROM (SELECT c.video_id, any_value(duration) AS duration, list(t ORDER BY t) AS told FROM cut c JOIN vd USING (video_id) GROUP BY c.video_id))""",
    """chapters AS (SELECT video_id, i - 1 AS chapter_index, begins[i] AS start_time, coalesce(begins[i + 1], duration) AS end_time, len(begins) AS n FROM (SELECT *, unnest(range(1, len(begins) + 1)) AS i FROM ends))""",
]


def _chapters(spark, sf_dir):
    own = A.story_events(spark, sf_dir)
    i = F.col("event_id")
    events = own.select((i % 3).alias("video_id"), ((i % 997) * 3.5).alias("start_time"), F.when(i % 3 == 2, F.least("importance", F.lit(5))).otherwise(F.col("importance")).alias("importance"))
    memory = _collection(spark, sf_dir)
    return memory, P.split(memory["shots"].groupBy("video_id").agg((F.max("end_cs") / 100).alias("duration")), events)


@query("chapters_split", A.sql(["shots", "story_events", *_CHAPTERS[2:]], "SELECT video_id, CAST(chapter_index AS INTEGER) AS chapter_index, start_time, end_time FROM chapters", recursive=True))
def chapters_split(spark, sf_dir):
    return _chapters(spark, sf_dir)[1]


_CANDIDATES = [
    *_CHAPTERS,
    """hits AS (SELECT h.query_id || '#' || chapter_index AS query_id, h.* EXCLUDE (query_id) FROM every_hit h JOIN sh USING (scene_index) JOIN chapters c ON c.video_id = h.scene_index % 3 AND sh.start_cs >= round(c.start_time * 100) AND sh.end_cs <= round(c.end_time * 100) WHERE h.scene_index % 3 = h.query_id % 3)""",
    _DEDUPE,
    "cd AS (SELECT *, CAST(split_part(query_id, '#', 1) AS BIGINT) AS plan_id, CAST(split_part(query_id, '#', 2) AS INTEGER) AS chapter_index FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, scene_index) AS rank FROM merged) WHERE rank <= 15)",
]


def _plans(spark, sf_dir):
    """A plan for each benchmark item, over the video of its number."""
    return _asked(spark, sf_dir).select(F.col("query_id").alias("plan_id"), (F.col("query_id") % 3).alias("video_id"), "query", "embedding", F.lit(90.0).alias("target_duration"))


def _planned(spark, sf_dir):
    memory, chapters = _chapters(spark, sf_dir)
    asked = P.queries(_plans(spark, sf_dir), chapters)
    return memory, asked, S.search_memory(memory, asked, P.CANDIDATES, digits=9)


@query(
    "chapter_candidates",
    A.sql(
        _CANDIDATES,
        """SELECT plan_id, cd.chapter_index, CAST(rank AS INTEGER) AS rank, CAST(scene_index % 3 AS BIGINT) AS video_id, CAST(scene_index // 3 AS BIGINT) AS scene_index, round(score, 6) AS score, match_type, n_refs, round(90.0::DOUBLE / n, 6) AS budget
      FROM cd JOIN chapters c ON c.video_id = scene_index % 3 AND c.chapter_index = cd.chapter_index""",
        recursive=True,
    ),
)
def chapter_candidates(spark, sf_dir):
    _, asked, found = _planned(spark, sf_dir)
    rows = found.join(asked.select("query_id", "plan_id", "chapter_index", "budget"), "query_id")
    return rows.select("plan_id", "chapter_index", "rank", "video_id", "scene_index", F.round("score", 6).alias("score"), "match_type", F.size("refs").cast("long").alias("n_refs"), F.round("budget", 6).alias("budget"))


@query(
    "chapter_planning",
    A.sql(
        [
            *_CANDIDATES,
            "sides AS (SELECT scene_index, string_agg(text, ' ' ORDER BY pos) AS every_line FROM transcripts GROUP BY scene_index)",
            """said AS (SELECT cd.*, coalesce(nullif(cd.transcript, ''), nullif(un.transcript, ''), every_line, '') AS says, coalesce(nullif(cd.vision, ''), nullif(un.vision, ''), d.text, '') AS shows, sh.start_cs / 100 AS s0, sh.end_cs / 100 AS s1
             FROM cd JOIN sh USING (scene_index) LEFT JOIN un USING (scene_index) LEFT JOIN sides USING (scene_index) LEFT JOIN documents d ON d.doc_id = cd.scene_index WHERE rank % 3 = 1)""",
            """cl AS (SELECT *, CASE WHEN rank % 2 = 0 THEN s0 WHEN s0 - 1 > s0 THEN s0 - 1 ELSE s0 END AS f0, CASE WHEN rank % 2 = 0 THEN s1 ELSE least(s0 + 2.5 + rank / 7.0::DOUBLE, s1) END AS f1, CASE WHEN rank % 4 = 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS speed FROM said)""",
            "pl AS (SELECT *, row_number() OVER w - 1 AS clip_index, coalesce(sum((f1 - f0) / speed) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t0, sum((f1 - f0) / speed) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t1 FROM cl WINDOW w AS (PARTITION BY plan_id ORDER BY chapter_index, rank))",
        ],
        """SELECT plan_id, CAST(clip_index AS INTEGER) AS clip_index, chapter_index, CAST(scene_index % 3 AS BIGINT) AS video_id, CAST(scene_index // 3 AS BIGINT) AS source_scene_index, CAST(format('{:.3f}', f0) AS DOUBLE) AS source_start, CAST(format('{:.3f}', f1) AS DOUBLE) AS source_end,
      CAST(format('{:.3f}', t0) AS DOUBLE) AS timeline_start, CAST(format('{:.3f}', t1) AS DOUBLE) AS timeline_end, speed, CASE WHEN rank % 2 = 0 THEN 'rising_action' ELSE 'hook' END AS narrative_role, CASE WHEN rank = 4 THEN 1 ELSE least(n_refs, 3) END AS n_refs,
      md5(left(says, 200)) AS transcript_md5, md5(CASE WHEN rank = 7 THEN 'own' ELSE left(shows, 200) END) AS vision_md5 FROM pl""",
        recursive=True,
    ),
)
def chapter_planning(spark, sf_dir):
    """Answers are made of the candidates: every third one a clip, some of them inverted, out of range or of shots that don't exist."""
    memory, asked, found = _planned(spark, sf_dir)
    found = shared.written(found, "candidates")
    c = F.col
    rank, start = c("rank"), c("start_cs") / 100
    whole = F.concat_ws(", ", F.concat(F.lit('"source_start": '), F.when(rank % 2 == 0, start + 5).otherwise(start - 1)), F.concat(F.lit('"source_end": '), F.when(rank % 2 == 0, start + 4).otherwise(start + 2.5 + rank / 7)), F.when(rank % 4 == 1, '"speed": 1.5'), F.when(rank % 2 == 1, '"narrative_role": "hook"'), F.when(rank == 4, '"evidence_refs": ["mine"]'), F.when(rank == 7, '"matched_vision": "own"'))
    clip = F.concat(F.lit('{"source_scene_index": "'), c("scene_index").cast("string"), F.lit('", '), whole, F.lit("}"))
    rows = found.where("rank % 3 = 1").join(asked.select("query_id", "plan_id", "chapter_index"), "query_id")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", clip.alias("clip")))), lambda x: x["clip"]), ", ")
    answers = rows.groupBy("plan_id", "chapter_index", "video_id").agg(F.concat(F.lit('```json\n{"title": "t", "clips": [{"source_scene_index": 99999999}, 3, '), listed, F.lit("]}\n```")).alias("answer"))
    shots = memory["shots"].select("video_id", "scene_index", (c("start_cs") / 100).alias("start_time"), (c("end_cs") / 100).alias("end_time"))
    made = P.clips(answers, found, shots)
    digest = lambda x: F.md5(F.coalesce(x, F.lit("")))
    return made.select(
        "plan_id", "clip_index", "chapter_index", "video_id", "source_scene_index", "source_start", "source_end", "timeline_start", "timeline_end", "speed", "narrative_role", F.size("evidence_refs").cast("long").alias("n_refs"),
        digest(c("matched_transcript")).alias("transcript_md5"), digest(c("matched_vision")).alias("vision_md5"),
    )
