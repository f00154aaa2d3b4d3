"""What keeps a query's cost in step with its tables: rows that are dealt out, parsed once and made small before they are joined."""

import re

import numpy as np
from pyspark.sql import functions as F

from framelode.functions import terms
from framelode.operators import director, entity, fusion, index, search, selection, shared
from framelode.plans import registry


def test_open_plans_are_dealt_to_all_tasks_and_their_answers_parsed_once(spark, monkeypatch):
    seen, parsed = [], []
    read = director.V.read_object
    monkeypatch.setattr(director.V, "read_object", lambda answer: parsed.append(1) or read(answer))
    plans = spark.range(40).coalesce(1).select(F.col("id").alias("plan_id"), F.lit(1).alias("video_id"), F.lit("p").alias("prompt"), F.lit(40.0).alias("target_duration"))
    shots = spark.createDataFrame([(1, i, i * 60.0, i * 60.0 + 60) for i in range(4)], "video_id int, scene_index int, start_time double, end_time double")
    units = shots.select("scene_index", (F.col("start_time") * 100).alias("start_cs"), (F.col("end_time") * 100).alias("end_cs"), F.array().cast("array<string>").alias("characters"))
    candidates = shots.limit(0).select(F.lit("").alias("query_id"), "scene_index", F.array(F.lit("")).alias("refs"), F.lit("").alias("transcript"), F.lit("").alias("vision"))
    events = plans.limit(0).select("plan_id", F.lit(0).alias("event_id"), F.array(F.lit(0)).alias("scene_indices"))

    def ask(now):
        seen.append(now.rdd.getNumPartitions())
        return now.select("plan_id", F.lit('```json\n{"clips": [{"source_scene_index": 2}, {"source_scene_index": 9}]}\n```').alias("answer"))

    found, clips = director.directed(plans, candidates, shots, units, events, ask, rounds=1)
    assert seen == [spark.sparkContext.defaultParallelism] and len(parsed) == 1
    assert {(r.attempt, r.approved) for r in found.collect()} == {(0, False)} and found.count() == 40
    assert sorted(tuple(r) for r in clips.select("plan_id", "source_scene_index").collect()) == [(i, 2) for i in range(40)]
    shared.cleaned(spark)


def test_beats_of_equal_shots_are_laid_out_once_from_cut_lines(spark):
    beats = spark.range(200).select(
        F.col("id").alias("beat_index"), F.when(F.col("id") % 4 == 3, F.lit(None)).otherwise(F.array(F.lit(1), F.lit(2), F.lit(9))).alias("shot_indices"), *[F.lit("").alias(c) for c in ("beat_type", "description", "emotion")], F.array().cast("array<string>").alias("characters"),
    )
    said = {1: ["a" * 3, None, "b" * 300], 2: ["c" * 900, *("d" * 50_000 for _ in range(12))]}
    lines = spark.createDataFrame([(s, i, t) for s, texts in said.items() for i, t in enumerate(texts)], "scene_index int, pos int, text string")
    views = spark.createDataFrame([(2, 0, "first"), (2, 1, "v" * 60), (1, 0, None)], "scene_index int, pos int, description string")
    out = fusion.beat_units(beats, lines, views)
    every = " ".join(t for t in [*said[1], *said[2]][:10] if t is not None)
    rows = out.select("beat_index", "transcript_summary", "combined_text").collect()
    assert len(rows) == 200
    for r in rows:
        told = r.beat_index % 4 < 3
        assert r.transcript_summary == (every[:500] if told else "")
        assert r.combined_text == (f"{fusion.LINES}: {every[:200]} | {fusion.VIEW}: {'v' * 50}" if told else "")
    sizes = [len(x.text or "") for x in fusion.heads(lines, 10, 500).select(F.explode("lines").alias("x")).select("x.*").collect()]
    assert len(sizes) == 13 and sum(sizes) == 303 + 500


def test_canonical_ids_need_no_broadcast_and_stop_when_none_moves(spark, monkeypatch):
    written, plans = shared.written, []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(shared, "written", seen)
    chain = [(i, i - 1) for i in range(1, 9)] + [(i, i // 3) for i in range(100, 2000) if i // 3 != 0]
    cycles = [(5001, 5002), (5002, 5003), (5003, 5001), (5010, 5001), (6001, 6002), (6002, 6001), (7, 7), (8, 90)]
    rows = spark.createDataFrame(chain + cycles, "merged long, kept long")
    to = {}
    for merged, kept in chain + cycles:
        if merged != kept:
            to[merged] = min(kept, to.get(merged, kept))

    def end(x):
        at, n = x, 0
        while at in to and n < 100:
            at, n = to[at], n + 1
        return x if n == 100 else at

    assert {(r.id, r.canonical) for r in entity.canonical(rows).collect()} == {(x, end(x)) for x in to}
    assert not any("Broadcast" in plan for plan in plans)
    del plans[:]
    assert entity.canonical(spark.range(1, 5000).select(F.col("id").alias("merged"), F.floor(F.col("id") / 3).alias("kept"))).select("canonical").distinct().count() == 1
    assert len(plans) <= 6  # thirteen rounds of doubling would be for a chain of all
    shared.cleaned(spark)


def test_pairs_of_a_shot_are_dealt_to_tasks_of_bounded_rows(spark, monkeypatch):
    rows = [(c, s) for s in range(60) for c in range(s % 7 + 1)] * 2 + [(0, 0), (None, 3), (5, None)]
    who = spark.createDataFrame(rows, "character long, shot long").coalesce(1)
    monkeypatch.setattr(entity, "TASK_ROWS", 10)
    got = entity.cooccurring(who)
    shots, pairs = set(rows), {}
    for c, s in shots:
        for d, t in shots:
            if None not in (c, d, s, t) and s == t and c < d:
                pairs.setdefault((c, d), set()).add(s)
    assert {(r.a, r.b): (r.n_shared, r.first_shared) for r in got.collect()} == {k: (len(v), min(v)) for k, v in pairs.items()}
    n = sum(len(v) for v in pairs.values())
    for made in (got, entity.overlaps(who), selection.companions(who)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        dealt = [int(x) for x in re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", plan)]
        assert -(-sum(None not in r for r in rows) // 10) in dealt and -(-n // 10) in dealt
    assert {r.character: r.others for r in selection.companions(who).collect()} == {c: sorted({x for p in pairs if c in p for x in p} - {c}) for c in {x for p in pairs for x in p}}


def test_character_units_are_dealt_before_they_are_made_distinct(spark, monkeypatch):
    monkeypatch.setattr(entity, "TASK_ROWS", 10)
    rows = [(f"c{i % 9}", i % 40) for i in range(200)] * 2 + [(None, 1), ("c1", None)]
    who = spark.createDataFrame(rows, "character string, shot long").coalesce(1)
    units = spark.range(10).select(F.col("id").alias("unit_index"), F.array(F.lit("c3"), F.lit("nobody")).alias("cast"), F.transform(F.array(*map(F.lit, range(4))), lambda i: F.col("id") * 4 + i).alias("shot_ids"))
    made = index.character_units(who, units)
    assert sorted(map(tuple, made.collect())) == sorted({("c3", u) for u in range(10)} | {(c, s // 4) for c, s in rows if c is not None and s is not None})
    dealt = [int(x) for x in re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", made._jdf.queryExecution().optimizedPlan().toString())]
    assert len(dealt) >= 3 and min(dealt) >= 40


def test_a_task_of_vector_search_holds_so_many_cosines(spark, monkeypatch):
    rows = spark.range(90).select(F.col("id").alias("scene_index"), F.array(F.cos(F.col("id") / 90), F.sin(F.col("id") / 90)).alias("embedding")).coalesce(1)
    asked = rows.where("scene_index % 9 = 0").withColumnRenamed("scene_index", "query_id")
    whole = search.vector_hits(rows, asked, 4).collect()
    monkeypatch.setattr(search, "CELLS", 70)
    assert search.vector_hits(rows, asked, 4).collect() == whole


def test_merged_hits_are_dealt_once_by_their_scene(spark):
    made = registry.queries()["merge_dedupe_modalities"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and not re.search(r"hashpartitioning\(scene_index#\d+L?, (transcript|vision)_at", plan)


def _plain_best(texts, asked, n):
    """Brute force: (query, scene, share) of the n best scenes of each query."""
    out = []
    for q, query in asked:
        terms = query.lower().split()
        of = {}
        for scene, text, weight in texts:
            if k := sum(t in (text or "") for t in terms):
                of[scene] = max(of.get(scene, 0), k / len(terms) * weight)
        out += [(q, s, round(by, 9)) for s, by in sorted(of.items(), key=lambda x: (-x[1], x[0]))[:n]]
    return sorted(out)


def test_equal_rows_are_read_once_and_their_smallest_scenes_count(spark, tmp_path):
    read = str(tmp_path / "read")
    texts = [(s, f"click {s % 7} of user", s % 2 + 1.0) for s in range(2999, -1, -1)] * 2 + [(3, None, 1.0)]
    asked = [(q, f"click {q} q{q} user") for q in range(9)]
    rows = spark.createDataFrame(texts, "scene_index long, _low string, weight double").coalesce(1)
    queries = spark.createDataFrame(asked, "query_id int, query string")

    def step(table, batch):
        for low in batch.column("_low").to_pylist():
            with open(read, "a") as f:
                f.write(f"{low}\n")
            yield table.places(low)

    score = lambda batch, hit, held, size: held / size * batch.column("weight").to_numpy()[hit]
    found = search._scanned(rows, queries, F.split(F.lower("query"), " "), ["_low"], "", step, search.Best(5), score).collect()
    assert sorted((r.query_id, r.scene_index, round(r.by, 9)) for r in found) == _plain_best(texts, asked, 5)
    assert len(open(read).read().splitlines()) <= 3 * 16  # 14 kinds of rows and the empty one, of at most three batches


def test_best_scenes_with_filters_are_those_of_brute_force(spark):
    texts = [(s, f"{'tense' if s % 3 else 'calm'} word{s % 11} user{s // 2 % 5}", 1.0) for s in range(400)] * 3
    rows = spark.createDataFrame([(s, t, 100 * s, 100 * s + 100, [s % 4], ["kind" if s % 2 else "else"]) for s, t, _ in texts], "scene_index long, text string, _start long, _end long, _cast array<int>, _kinds array<string>").coalesce(1)
    asked = [(i, f"tense word{i % 11} u", None if i % 2 else 1000 * i, None if i % 3 else 2, "Kind" if i % 5 == 0 else None) for i in range(30)]
    queries = spark.createDataFrame(asked, "query_id int, query string, start_cs long, character int, scene_type string").withColumn("end_cs", F.lit(None).cast("long"))
    found = search.matched(rows, queries, "text", search.Best(6)).collect()
    expected = []
    for i, query, start, who, kind in asked:
        own = [x for x in texts if (start is None or 100 * x[0] >= start) and (who is None or x[0] % 4 == who) and (kind is None or x[0] % 2)]
        expected += _plain_best(own, [(i, query)], 6)
    assert sorted((r.query_id, r.scene_index, round(r.by, 9)) for r in found) == sorted(expected)


def test_a_hit_no_better_than_the_last_of_the_best_is_not_held():
    rng = np.random.default_rng(5)
    pool, every = search._Pool(7, 4), []
    for _ in range(60):
        query, scene, score = rng.integers(0, 7, 500), rng.integers(0, 900, 500), rng.integers(0, 6, 500) / 5
        every += zip(query.tolist(), scene.tolist(), score.tolist())
        pool.add(query, scene, score)
        assert pool.held <= max(pool.size, 2 * 28)
    best = {}
    for q, s, by in every:
        best[q, s] = max(by, best.get((q, s), 0))
    expected = [x for q in range(7) for x in sorted(((q, s, by) for (p, s), by in best.items() if p == q), key=lambda x: (-x[2], x[1]))[:4]]
    assert list(zip(*(c.tolist() for c in pool.best()))) == expected
    before = pool.held
    pool.add(np.arange(7), np.full(7, 899), np.zeros(7))
    assert pool.held == before


def test_common_terms_are_looked_for_alone():
    asked = [("a", ["e", "word", "e", "ñga"]), ("b", ["word1", "e"]), ("c", ["nothing"])]
    table = terms.TermTable(asked)
    texts = [f"eee ee ee e e eeeeeeeeeeeeee word{i}" for i in range(terms.PROBED)] + ["word1 ñga", "", None, "nothing e"]
    held = [table.places(t) for t in texts]
    assert [w for _, w in table._common] == ["e"]
    assert [{table.terms[i] for i in h} for h in held] == [{t for t in table.of if t in (x or "")} for x in texts]
    assert table.counted(held).tolist() == [table.counts(table.held(x)).tolist() for x in texts]
    assert table.counted([[table.at["word1"]] * 2, []]).tolist() == [[0, 2, 0], [0, 0, 0]] and table.counted([]).shape == (0, 3)


def test_attributes_hold_the_characters_that_are_asked_for(spark):
    memory = {
        "shots": spark.range(6).select(F.col("id").alias("scene_index"), F.col("id").alias("start_cs"), F.col("id").alias("end_cs")),
        "appearances": spark.range(60).select((F.col("id") % 10).alias("character"), (F.col("id") % 6).alias("shot")),
        "vision": spark.range(4).select(F.col("id").alias("scene_index"), F.lit("Src").alias("scene_type")),
    }
    asked = spark.createDataFrame([(1, 4), (2, None), (3, 4)], "query_id int, character long")
    got = {r.scene_index: r._cast for r in search.attributes(memory, asked).collect()}
    assert got == {s: [4] if s % 2 == 0 else None for s in range(6)}
    assert {r._cast for r in search.attributes(memory, asked.select("query_id", F.lit("src").alias("scene_type"))).collect()} == {None}


def test_faces_of_one_vector_are_compared_once_and_chains_end_in_their_smallest_core(spark, monkeypatch):
    from framelode.operators import cluster

    turn = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    # a chain in both directions whose faces touch the next alone, sixty equal faces, a border face, one far off, and zero vectors
    chain = [(n, turn(d)) for n, d in zip([9, 3, 12, 0, 7, 5, 11, 2], range(0, 320, 40), strict=True)]
    rows = [(v, 1000 * v + n, e) for v in (1, 2) for n, e in chain] + [(3, 3000 + n, turn(10)) for n in range(60)] + [(3, 3100, turn(60)), (3, 3101, turn(200)), (3, 3102, [0.0, 0.0]), (3, 3103, [0.0, 0.0]), (3, 3104, [0.0, 0.0])]
    faces = spark.createDataFrame(rows, "video long, face_id long, embedding array<double>")
    seen, pairs = [], cluster._block_pairs
    monkeypatch.setattr(cluster, "_block_pairs", lambda own, *a: seen.append(own.count()) or pairs(own, *a))
    found = dict(map(tuple, cluster.density_labels(faces, 0.42, 3, "video").collect()))
    assert found == {1000 * v + n: 1000 * v for v in (1, 2) for n, _ in chain} | {3000 + n: 3000 for n in range(60)} | {3100: 3000, 3101: -1, 3102: -1, 3103: -1, 3104: -1}
    assert seen == [16 + 1 + 1 + 1 + 1]


def test_faces_go_only_where_their_cluster_meets_another(spark, monkeypatch):
    from framelode.operators import cluster

    for name, value in {"BLOCK": 6, "FEW": 6, "PAIRS": 20, "AT_ONCE": 40}.items():
        monkeypatch.setattr(cluster, name, value, raising=False)
    rng = np.random.default_rng(4)
    sizes = [1, 2, 3, 30, 12, 1, 2, 3, 2, 2, 4, 1, 1, 1, 2, 3]
    rows = [(n % 2, c, e) for n, c in enumerate(np.repeat(np.arange(16), sizes).tolist()) for e in [rng.normal(size=5)]]
    rows = [(c // 8, n, c, e.tolist()) for n, (_, c, e) in enumerate(rows)]
    faces = spark.createDataFrame(rows, "video long, face_id long, c long, embedding array<double>")
    pairs = [(0, 3), (1, 3), (2, 3), (3, 4), (0, 1), (5, 6), (8, 9), (10, 15)]
    unit = lambda c: np.stack([np.array(e) / np.linalg.norm(e) for _, _, k, e in rows if k == c])
    top = {(x, y): np.sort((unit(x) @ unit(y).T).ravel())[::-1][:5] for x, y in pairs}
    dealt, repartition = [], type(faces).repartition
    monkeypatch.setattr(type(faces), "repartition", lambda self, *a: (dealt.append(self.count()) if "i" in a else None) or repartition(self, *a))
    found = cluster.top_pair_mean(faces, "c", 5, "video", spark.createDataFrame(pairs, "x long, y long"))
    assert {(r.x, r.y): (round(r.link, 9), round(r.strong, 9)) for r in found.collect()} == {p: (round(s.mean(), 9), round(s[0], 9)) for p, s in top.items()}
    far = spark.createDataFrame([(1, n, n, np.eye(60)[n // 3].tolist()) for n in range(180)], "video long, face_id long, c long, embedding array<double>")
    own = spark.createDataFrame([(3 * n, 3 * n + 1, 1.0) for n in range(50)], "x long, y long, centroid double")
    assert {(r.x, r.y, r.link) for r in cluster.top_pair_mean(far, "c", 5, "video", own).collect()} == {(3 * n, 3 * n + 1, 1.0) for n in range(50)}
    assert dealt[-1] == 100


def test_winning_scenes_are_read_for_their_own_queries_and_queries_go_out_once(spark, monkeypatch):
    texts = [(s % 2, s, f"user click {s % 5} of {'purchase ' * (s % 3)}") for s in range(40)]
    rows = spark.createDataFrame(texts, "video_id long, scene_index long, text string").withColumn("pos", F.lit(0).cast("long"))
    asked = spark.createDataFrame([(f"{v}#{n}", v, "click user" if n % 2 else f"purchase click {n}") for v in (0, 1) for n in range(8)], "query_id string, video_id long, query string")
    sent, out = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(1) or out(self, value))
    hits, merged = [], search.merged
    monkeypatch.setattr(search, "merged", lambda layers: hits.extend(rows.count() for rows in layers) or merged(layers))
    layers = lambda tables, best: [search.transcript_hits(tables["transcripts"], asked, best)] * 2
    found = search.best_scenes(layers, {"transcripts": rows}, 2, plain={"transcripts": rows})
    low = {(v, s): t.lower() for v, s, t in texts}
    share = lambda q, t: sum(w in t for w in q.split()) / len(q.split())
    expected = set()
    for q in asked.collect():
        of = sorted(((-round(share(q["query"], t), 9), s) for (v, s), t in low.items() if v == q.video_id and share(q["query"], t)))[:2]
        expected |= {(q.query_id, s, n + 1, -by) for n, (by, s) in enumerate(of)}
    assert {(r.query_id, r.scene_index, r["rank"], round(r.score, 9)) for r in found.collect()} == expected
    assert len(sent) == 1 and hits == [len(expected)] * 2


def test_blocks_of_descriptions_are_dealt_in_rounds(spark, monkeypatch):
    import random

    from framelode.operators import cluster

    for name, value in {"WORDS": 400, "ROUND": 1, "TIMES": 2}.items():
        monkeypatch.setattr(cluster, name, value, raising=False)
    rng = random.Random(8)
    sets = {i: frozenset(rng.sample([f"{kind}{n}" for kind in "ab"[: 1 + i % 2] for n in range(9)], rng.randint(4, 9))) for i in range(120)}
    rows = spark.createDataFrame([("s", i, len(w), sorted(w)) for i, w in sets.items()], "k string, id long, n int, words array<string>")
    dealt, grouped = [], type(rows).groupBy
    monkeypatch.setattr(type(rows), "groupBy", lambda self, *a: (dealt.append(self.count()) if a[-2:] == ("i", "j") else None) or grouped(self, *a))
    found = {(r.a, r.b) for r in cluster.like_pairs(rows, "k", 0.5).collect()}
    same = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.5}
    assert {p for p in found if p in same} == same == found
    assert len(dealt) > 2 and max(dealt) < sum(dealt) / 2
