"""Queries over characters, speakers and their relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelode.operators import entity as E
from framelode.operators import selection
from framelode.plans.registry import query
from framelode.sources import adapters as A


@query("cooccurrence_pairs", A.sql("appearances", "SELECT x.character AS a, y.character AS b, count(*) AS n_shared, min(x.shot) AS first_shared FROM appearances x JOIN appearances y ON x.shot = y.shot AND x.character < y.character GROUP BY ALL"))
def cooccurrence_pairs(spark, sf_dir):
    return E.cooccurring(A.appearances(spark, sf_dir, once=False))


@query(
    "cooccurrence_top40",
    A.sql("appearances", """SELECT a, b, n_shared, array_to_string(shots[1:12], ', ') || CASE WHEN n_shared > 12 THEN '...' ELSE '' END AS sample FROM (SELECT x.character AS a, y.character AS b, count(*) AS n_shared, list(x.shot ORDER BY x.shot) AS shots
      FROM appearances x JOIN appearances y ON x.shot = y.shot AND x.character < y.character GROUP BY ALL ORDER BY n_shared DESC, a, b LIMIT 40)"""),
)
def cooccurrence_top40(spark, sf_dir):
    return E.cooccurrence_lines(A.appearances(spark, sf_dir, once=False)).select("a", "b", "n_shared", "sample")


@query(
    "key_events",
    "SELECT user_id % 3 AS video_id, character, count(*) AS n_events, string_agg(event_id, ',' ORDER BY event_id) AS event_ids FROM (SELECT *, unnest(list_distinct([user_id % 7, event_id % 5])) AS character FROM events) GROUP BY ALL",
)
def key_events(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    rows = A.table(spark, sf_dir, "events").select((u % 3).alias("video_id"), "event_id", F.array(u % 7, i % 5).alias("characters"))
    return E.key_events(rows).select("video_id", "character", "n_events", F.array_join(F.col("event_ids").cast("array<string>"), ",").alias("event_ids"))


_SPEECH = "speech AS (SELECT o_orderpriority AS speaker, o_orderkey AS scene_index FROM orders)"


def _speech(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("speaker"), F.col("o_orderkey").alias("scene_index"))


@query(
    "speaker_cooccurrence",
    A.sql(["appearances", _SPEECH], "SELECT speaker, character, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY n DESC, character) AS rank FROM (SELECT speaker, character, count(*) AS n FROM speech s JOIN appearances a ON s.scene_index = a.shot GROUP BY ALL)) WHERE rank <= 5"),
)
def speaker_cooccurrence(spark, sf_dir):
    return E.speaker_counts(_speech(spark, sf_dir), A.appearances(spark, sf_dir)).select("speaker", "character", "n", "rank")


_ORDERS = "timeline AS (SELECT o_orderkey AS shot, CAST(floor(o_totalprice) AS BIGINT) AS dur_cs, o_orderkey * 10 AS start_cs FROM orders)"


def _timeline(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("shot"), F.floor("o_totalprice").cast("long").alias("dur_cs"), (F.col("o_orderkey") * 10).alias("start_cs"))


_SCREEN = "screen AS (SELECT character, sum(dur_cs)::BIGINT AS screen_cs, min(start_cs) AS first_cs, max(start_cs) AS last_cs, count(*) AS n_shots FROM appearances JOIN timeline USING (shot) GROUP BY character)"


@query("screen_time", A.sql(["appearances", _ORDERS, _SCREEN], "SELECT * FROM screen"))
def screen_time(spark, sf_dir):
    return E.screen_time(A.appearances(spark, sf_dir), _timeline(spark, sf_dir))


@query(
    "importance_score",
    A.sql(
        ["appearances", _ORDERS, _SCREEN],
        """SELECT character, round(0.4::DOUBLE * screen_cs / greatest(total, 1) + 0.3::DOUBLE * lines / greatest(all_lines, 1) + 0.3::DOUBLE * n_events / greatest(all_events, 1), 6) AS importance_score
        FROM screen JOIN (SELECT l_suppkey AS character, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS n_events FROM lineitem GROUP BY 1) USING (character),
        (SELECT sum(dur_cs) AS total FROM timeline), (SELECT count(*) AS all_lines, count(*) FILTER (l_returnflag = 'R') AS all_events FROM lineitem)""",
    ),
)
def importance_score(spark, sf_dir):
    lines = A.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("character"), (F.col("l_returnflag") == "R").alias("event"))
    own = lines.groupBy("character").agg(F.count("*").alias("lines"), F.count_if("event").alias("n_events"))
    every = lines.agg(F.count("*").alias("all_lines"), F.count_if("event").alias("all_events"))
    total = _timeline(spark, sf_dir).agg(F.sum("dur_cs").alias("total"))
    rows = E.screen_time(A.appearances(spark, sf_dir), _timeline(spark, sf_dir)).join(own, "character").crossJoin(F.broadcast(every)).crossJoin(F.broadcast(total))
    c = F.col
    return rows.select("character", F.round(E.importance(c("screen_cs"), c("lines"), c("n_events"), c("total"), c("all_lines"), c("all_events")), 6).alias("importance_score"))


_VOTES = "votes AS (SELECT l_suppkey % 40 AS prim, l_partkey % 40 AS dup, l_linenumber AS chunk, l_discount * 10 AS confidence FROM lineitem)"
_TIERS = "tiers AS (SELECT s_suppkey AS character, CASE s_suppkey % 4 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' WHEN 2 THEN 'passerby' ELSE 'odd' END AS tier FROM supplier)"
_MERGES = """pairs AS (SELECT least(prim, dup) AS x, greatest(prim, dup) AS y, max(confidence) AS best, count(DISTINCT chunk) AS chunks, count(*) FILTER (prim = least(prim, dup)) AS for_x, count(*) FILTER (prim = greatest(prim, dup)) AS for_y FROM votes WHERE prim <> dup GROUP BY ALL),
 ranked AS (SELECT character, CASE tier WHEN 'major' THEN 1 WHEN 'minor' THEN 2 WHEN 'passerby' THEN 3 ELSE 4 END AS rank FROM tiers),
 merges AS (SELECT CASE WHEN first THEN x ELSE y END AS kept, CASE WHEN first THEN y ELSE x END AS merged, best, chunks FROM (
   SELECT p.*, (-for_x, rx.rank, x) <= (-for_y, ry.rank, y) AS first FROM pairs p JOIN ranked rx ON rx.character = x JOIN ranked ry ON ry.character = y WHERE best >= 0.85 AND chunks >= 2))"""


def _merges(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem")
    votes = rows.select((F.col("l_suppkey") % 40).alias("primary"), (F.col("l_partkey") % 40).alias("duplicate"), F.col("l_linenumber").alias("chunk"), (F.col("l_discount") * 10).alias("confidence"))
    i = F.col("s_suppkey")
    tier = F.element_at(F.array(*map(F.lit, ("major", "minor", "passerby", "odd"))), (i % 4 + 1).cast("int"))
    return E.confirmed_merges(votes, A.table(spark, sf_dir, "supplier").select(i.alias("character"), tier.alias("tier")))


@query("merge_votes", A.sql([_VOTES, _TIERS, _MERGES], "SELECT kept, merged, round(best, 6) AS best, chunks FROM merges"))
def merge_votes(spark, sf_dir):
    return _merges(spark, sf_dir).select("kept", "merged", F.round("best", 6).alias("best"), "chunks")


#: Chains of links: each id to a third of itself, down to 0; a few cycles.
_LINKS = "links AS (SELECT p_partkey AS merged, CASE WHEN p_partkey % 50 = 7 THEN p_partkey + 1 WHEN p_partkey % 50 = 8 THEN p_partkey - 1 ELSE p_partkey // 3 END AS kept FROM part)"


@query(
    "canonicalize",
    A.sql(
        [
            _LINKS,
            "walk AS (SELECT merged AS id, kept AS cur, 1 AS n FROM links WHERE merged <> kept UNION ALL SELECT w.id, l.kept, n + 1 FROM walk w JOIN links l ON l.merged = w.cur AND l.merged <> l.kept WHERE n < 60)",
        ],
        "SELECT id, CASE WHEN max(n) = 60 THEN id ELSE arg_max(cur, n) END AS canonical FROM walk GROUP BY id",
        recursive=True,
    ),
)
def canonicalize(spark, sf_dir):
    i = F.col("p_partkey")
    to = F.when(i % 50 == 7, i + 1).when(i % 50 == 8, i - 1).otherwise(F.floor(i / 3))
    return E.canonical(A.table(spark, sf_dir, "part").select(i.alias("merged"), to.alias("kept")))


@query(
    "apply_mapping",
    A.sql(
        [_VOTES, _TIERS, _MERGES, "names AS (SELECT merged AS id, min(kept) AS canonical FROM merges GROUP BY merged)"],
        """SELECT l_orderkey, string_agg(c, ',' ORDER BY first) AS characters FROM (SELECT l_orderkey, coalesce(canonical, v) AS c, min((pos, v)) AS first
        FROM (SELECT l_orderkey, l_suppkey % 40 AS v, l_linenumber AS pos FROM lineitem) LEFT JOIN names ON id = v GROUP BY ALL) GROUP BY l_orderkey""",
    ),
)
def apply_mapping(spark, sf_dir):
    names = _merges(spark, sf_dir).groupBy(F.col("merged").alias("id")).agg(F.min("kept").alias("canonical"))
    rows = A.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 40).alias("v"), "l_linenumber").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "v"))), lambda x: x["v"]).alias("characters"))
    return E.renamed(rows, "characters", names, ["l_orderkey"], is_list=True).select("l_orderkey", F.array_join("characters", ",").alias("characters"))


_UPDATES = """updates AS (SELECT user_id AS character, event_id AS chunk, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS name,
  CASE event_id % 4 WHEN 0 THEN 'None.' WHEN 1 THEN ' ' WHEN 2 THEN '未知' ELSE 'seen at ' || event_id END AS description, CASE WHEN event_id % 5 = 0 THEN 'a' || event_id ELSE '' END AS action FROM events)"""


@query(
    "profile_fold",
    A.sql(
        [_UPDATES],
        """SELECT character, coalesce((SELECT string_agg(name, ',' ORDER BY first) FROM (SELECT name, min(chunk) AS first FROM updates n WHERE n.character = u.character AND name <> '' GROUP BY name)), '') AS names,
        coalesce(arg_max(description, chunk) FILTER (description LIKE 'seen%'), '') AS description, coalesce(string_agg(action, ',' ORDER BY chunk) FILTER (action <> ''), '') AS actions, count(*) AS n_updates FROM updates u GROUP BY character""",
    ),
)
def profile_fold(spark, sf_dir):
    i = F.col("event_id")
    description = F.when(i % 4 == 0, "None.").when(i % 4 == 1, " ").when(i % 4 == 2, "未知").otherwise(F.concat(F.lit("seen at "), i))
    rows = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("character"), i.alias("chunk"), F.when(i % 3 == 0, F.col("event_type")).otherwise("").alias("name"), description.alias("description"), F.when(i % 5 == 0, F.concat(F.lit("a"), i)).otherwise("").alias("action"))
    return E.profiles(rows).select("character", F.array_join("names", ",").alias("names"), "description", F.array_join("actions", ",").alias("actions"), "n_updates")


@query("role_fallback", "SELECT c_nationkey AS video_id, c_custkey AS character, CASE row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) WHEN 1 THEN 'male_lead' WHEN 2 THEN 'female_lead' ELSE 'supporting' END AS role FROM customer")
def role_fallback(spark, sf_dir):
    rows = A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("video_id"), F.col("c_custkey").alias("character"), F.col("c_acctbal").alias("screen_cs"))
    return E.roles(rows).select("video_id", "character", "role")


@query("speaker_map", "SELECT o_custkey AS video_id, o_orderpriority AS speaker, arg_max(o_orderstatus, o_orderkey) AS character FROM orders WHERE o_orderkey % 3 > 0 GROUP BY ALL")
def speaker_map(spark, sf_dir):
    character = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus"))
    return E.speakers_map(A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderpriority").alias("speaker"), character.alias("character"), F.col("o_orderkey").alias("pos")))


@query(
    "speaker_samples",
    A.sql("transcripts", "SELECT scene_index, speaker, string_agg(left(text, 50), ' / ' ORDER BY pos) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY scene_index, speaker ORDER BY pos) AS n FROM transcripts) WHERE n <= 3 GROUP BY ALL"),
)
def speaker_samples(spark, sf_dir):
    return E.speaker_samples(A.transcripts(spark, sf_dir)).withColumn("samples", F.array_join("samples", " / "))


@query(
    "dialogue_and_event_counts",
    A.sql("shots story_events", "SELECT video_id, count(*) AS n_events, count(*) FILTER (importance >= 7) AS n_important, count(DISTINCT event_type) AS n_types FROM story_events GROUP BY video_id"),
)
def dialogue_and_event_counts(spark, sf_dir):
    return selection.event_counts(A.story_events(spark, sf_dir))


@query("stable_characters", "SELECT c_nationkey AS video_id, id AS character FROM (SELECT *, max(NOT starts_with(id, 'char_tmp_')) OVER (PARTITION BY c_nationkey) AS lasting FROM (SELECT c_nationkey, CASE WHEN c_custkey % 9 > c_nationkey % 9 OR c_nationkey % 9 = 8 THEN 'char_tmp_' ELSE 'char_' END || c_custkey AS id FROM customer)) WHERE NOT lasting OR NOT starts_with(id, 'char_tmp_')")
def stable_characters(spark, sf_dir):
    i, v = F.col("c_custkey"), F.col("c_nationkey")
    rows = A.table(spark, sf_dir, "customer").select(v.alias("video_id"), F.concat(F.when((i % 9 > v % 9) | (v % 9 == 8), "char_tmp_").otherwise("char_"), i).alias("character"))
    return E.stable_only(rows)


@query("event_edges_valid", "SELECT l_orderkey AS source, l_partkey AS target, l_linenumber AS n FROM lineitem WHERE l_orderkey <> l_partkey AND l_orderkey IN (SELECT p_partkey FROM part) AND l_partkey IN (SELECT o_orderkey FROM orders) AND l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey IN (SELECT p_partkey FROM part)")
def event_edges_valid(spark, sf_dir):
    edges = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("n"))
    nodes = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).intersect(A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))
    return E.valid_edges(edges, nodes).select("source", "target", "n")


@query(
    "speaker_bind_greedy",
    A.sql(
        [
            "counts AS (SELECT o_custkey % 50 AS video_id, o_orderpriority AS speaker, o_orderkey % 6 AS character, count(*) AS n FROM orders GROUP BY ALL)",
            "ranked AS (SELECT video_id, speaker, row_number() OVER (PARTITION BY video_id ORDER BY speaker) AS k, list(character ORDER BY n DESC, character) AS wanted FROM counts GROUP BY video_id, speaker)",
            """walk AS (SELECT DISTINCT video_id, 0::BIGINT AS k, []::BIGINT[] AS used, ''::VARCHAR AS speaker, NULL::BIGINT AS character FROM counts UNION ALL
              SELECT video_id, k, CASE WHEN free IS NULL THEN used ELSE list_append(used, free) END, speaker, free FROM (SELECT r.video_id, r.k, w.used, r.speaker, list_filter(r.wanted, lambda c: NOT list_contains(w.used, c))[1] AS free FROM walk w JOIN ranked r ON r.video_id = w.video_id AND r.k = w.k + 1))""",
        ],
        "SELECT video_id, speaker, character FROM walk WHERE character IS NOT NULL",
        recursive=True,
    ),
)
def speaker_bind_greedy(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("video_id"), F.col("o_orderpriority").alias("speaker"), (F.col("o_orderkey") % 6).alias("character")).agg(F.count("*").alias("n"))
    return E.bound_greedily(rows)
