import numpy as np
from pyspark.sql import functions as F

from framelode.operators import assemble, search
from framelode.sources import providers


def test_answers_are_retried_and_missing_ones_null(spark):
    rows = spark.createDataFrame([(i, f"p{i % 3}") for i in range(50)], "id long, prompt string")
    out = providers.asked(rows, "prompt", providers.Recorded({"p0": "zero", "p1": ""}), pause=0.0).collect()
    assert {(r.prompt, r.answer) for r in out} == {("p0", "zero"), ("p1", None), ("p2", None)} and len(out) == 50


def test_embeddings_are_units_that_follow_from_the_text(spark):
    rows = spark.createDataFrame([(1, "Rain falls"), (2, "rain FALLS"), (3, None), (4, "  ")], "id long, text string")
    found = {r.id: np.array(r.embedding) for r in providers.embedded(rows, "text", providers.HashEmbedding(16)).collect()}
    assert np.allclose(found[1], found[2]) and np.allclose(found[3], found[4]) and all(np.isclose(np.linalg.norm(v), 1) for v in found.values())


def test_a_reranker_end_to_end(spark):
    rows = spark.createDataFrame([(1, "rain run\nRUN in the rain\nrain only\nnothing\nrun"), (2, "x")], "query_id long, prompt string")
    answers = providers.rerank_answers(providers.asked(rows, "prompt", providers.EvenRelevance(), pause=0.0))
    candidates = spark.createDataFrame([(1, i, 0.5) for i in range(4)] + [(2, 0, 0.5)], "query_id long, index int, score double")
    out = {(r.query_id, r["index"]): round(r.score, 6) for r in search.reranked(candidates, answers).collect()}
    assert out == {(1, 0): 0.85, (1, 1): 0.5, (1, 2): 0.15, (1, 3): 0.5, (2, 0): 0.5}


def test_beats_from_answers_and_without(spark):
    shots = spark.createDataFrame([(v, 10 + i, i * 100, i * 100 + 100, 100) for v in (1, 2) for i in range(34)], "video_id int, scene_index int, start_cs long, end_cs long, dur_cs long")
    own = assemble.segmented(shots)
    asked = own.groupBy("video_id", "segment").agg(F.concat(F.lit("v"), "video_id", F.lit("s"), "segment").alias("prompt"))
    good = """Sure: ```json
[{"shot_indices": [0, 1, 12], "beat_type": "setup", "description": "d", "intensity": "0.7", "characters": ["char_1", "char_9", "unknown_2"]}, {"shot_indices": [], "beat_type": "x"}, {"shot_indices": [99]}, {"shot_indices": [3], "intensity": null}]
```"""
    # a number that can't be read voids its segment's answer
    spoilt = '[{"shot_indices": [0]}, {"shot_indices": [1], "intensity": "much"}]'
    answers = providers.asked(asked, "prompt", providers.Recorded({"v1s0": good, "v1s1": "no list", "v2s0": "[]", "v2s1": spoilt}), pause=0.0)
    rosters = spark.createDataFrame([(1, ["char_1"])], "video_id int, roster array<string>")
    out = {(r.video_id, r.beat_index): r for r in assemble.beats_from_answers(shots, answers, rosters).collect()}
    first = out[1, 0]
    # local numbers 0, 1 and 12 are shots 10, 11 and 22
    assert (first.shot_indices, first.beat_type, first.intensity, first.characters, first.dur_cs, first.end_cs) == ([10, 11, 22], "setup", 0.7, ["char_1", "unknown_2"], 300, 1300)
    assert (out[1, 1].shot_indices, out[1, 1].intensity, out[1, 1].beat_type) == ([13], 0.0, "")
    assert (out[1, 2].shot_indices, out[1, 2].beat_type) == ([40, 41, 42, 43], "unknown")
    assert [out[2, n].shot_indices for n in (0, 7, 8)] == [[10, 11, 12, 13], [38, 39], [40, 41, 42, 43]] and len(out) == 3 + 9


def test_events_and_edges_from_answers(spark):
    text = '[{"event_index": 1, "start_time": "2.5", "event_type": "fight", "characters": ["a", " ", null]}, {"event_index": "2", "importance": "8", "evidence": ["shot_3"]}]'
    answers = spark.createDataFrame([(1, text), (2, "sorry"), (3, None), (4, text.replace('"8"', '"high"'))], "video_id int, answer string")
    events = assemble.events_from_answers(answers)
    assert [tuple(r)[:11] for r in events.orderBy("position").collect()] == [(1, 1, 2.5, 0.0, "fight", "", ["a"], "", 5, [], 0.8), (1, 2, 0.0, 0.0, "", "", [], "", 8, ["shot_3"], 0.8)]
    edges = spark.createDataFrame([(1, '[{"source_event": 1, "target_event": 2, "strength": 0.9}, {"source_event": 1, "target_event": 1}, {"source_event": 1, "target_event": 7}, {"target_event": 2}]'), (2, '[{"source_event": 1, "target_event": 2}]')], "video_id int, answer string")
    assert [(r.video_id, r.source, r.target, r.strength, r.confidence) for r in assemble.edges_from_answers(edges, events).collect()] == [(1, 1, 2, 0.9, 0.5)]
