"""Over a collection an operator gives, for each video, what it gives over that video alone: scene numbers, characters and speakers of two videos clash."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.operators import entity, fusion, index, search, selection

TABLES = {
    "shots": "scene_index int, start_cs long, end_cs long",
    "lines": "scene_index int, pos int, text string, speaker string, character string, start_cs long, end_cs long",
    "who": "scene_index int, character string, shot int, display_name string",
    "events": "scene_index int, pos long, event_id long, event_type string, description string, emotion string, importance int, start_cs long, end_cs long",
    "vision": "scene_index int, pos int, description string, mood string, scene_type string, objects array<string>, action string",
    "units": "scene_index int, combined_text string, transcript string, vision string, vision_description string, characters array<string>, keywords array<string>, embedding array<double>",
    "mapping": "speaker string, mapped string",
    "relations": "character_a string, character_b string, strength double",
    "chapters": "chapter_index int, shot_indices array<int>",
    "queries": "query_id long, query string, embedding array<double>, character string, start_cs long, end_cs long, scene_type string",
}


def video(seed):
    """The rows of one video, by table."""
    import random

    rng = random.Random(seed)
    names, words = [f"char_{i}" for i in range(4)], ["run", "home", "door", "red", "走了", "sea"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
    vector = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    n = 12
    return {
        "shots": [(i, i * 700, i * 700 + 700) for i in range(n)],
        "lines": [(i % n, i, text(), f"s{rng.randrange(3)}", rng.choice([None, *names]), rng.randrange(n * 700), 0) for i in range(20)],
        "who": [(s, c, s, c.upper()) for s in range(n) for c in names if rng.random() < 0.4],
        "events": [(i % n, i, i, rng.choice(words), text(), rng.choice(["calm", ""]), rng.randrange(10), i * 500, i * 500 + 900) for i in range(10)],
        "vision": [(i, i, text(), rng.choice(["", "sad"]), rng.choice(["Street", "room"]), ["cup"], "") for i in range(n) if rng.random() < 0.8],
        "units": [(i, text(), text(), text(), text(), names[:2], words[:2], vector()) for i in range(n) if rng.random() < 0.7],
        "mapping": [(f"s{i}", rng.choice([None, *names])) for i in range(3)],
        "relations": [(a, b, rng.random()) for a in names for b in names if a < b],
        "chapters": [(c, [c * 4 + i for i in range(5)]) for c in range(3)],
        "queries": [(seed * 100 + q, text(), vector(), rng.choice([None, *names, "char_x"]), rng.choice([None, 700]), rng.choice([None, 6000]), rng.choice([None, None, "street"])) for q in range(6)],
    }


OPERATORS = {
    "fused": lambda t: fusion.fused(t["shots"], t["lines"], t["who"], t["events"], t["chapters"], vision=t["vision"]),
    "aligned": lambda t: fusion.aligned(fusion.fused(t["shots"], t["lines"], t["who"], t["events"], vision=t["vision"]), t["lines"], t["mapping"]),
    "text_index": lambda t: index.text_index(t["shots"], t["units"].drop("vision"), t["lines"], t["vision"], t["events"], t["who"]),
    "with_speakers": lambda t: entity.with_speakers(t["lines"], t["mapping"]),
    "cooccurring": lambda t: entity.cooccurring(t["who"]),
    "screen_time": lambda t: entity.screen_time(t["who"], t["shots"].withColumnRenamed("scene_index", "shot").withColumn("dur_cs", F.col("end_cs") - F.col("start_cs"))),
    "companions": lambda t: selection.companions(t["who"]),
    "relation_graph": lambda t: selection.relation_graph(t["relations"], t["who"] if "video_id" in t["who"].columns else t["who"].withColumn("video_id", F.lit("a")), t["who"]),
    "search_memory": lambda t: search.search_memory({"units": t["units"], "transcripts": t["lines"].drop("start_cs", "end_cs"), "vision": t["vision"].drop("pos"), "events": t["events"].drop("start_cs", "end_cs"), "index": t["units"], "shots": t["shots"], "appearances": t["who"].drop("scene_index")}, t["queries"], 5),
}


@pytest.fixture(scope="module")
def videos(spark):
    rows = {v: video(n) for n, v in enumerate("ab", 1)}
    alone = {v: {name: spark.createDataFrame(r[name], kind).cache() for name, kind in TABLES.items()} for v, r in rows.items()}
    together = {name: reduce(DataFrame.union, [t[name].withColumn("video_id", F.lit(v)) for v, t in alone.items()]).cache() for name in TABLES}
    return alone, together


@pytest.mark.parametrize("name", OPERATORS)
def test_each_video_of_a_collection(videos, name):
    alone, together = videos
    found = OPERATORS[name](together)
    columns = sorted(c for c in found.columns if c != "video_id")
    assert "video_id" in found.columns
    by_video: dict[str, list] = {v: [] for v in alone}
    for r in found.collect():
        by_video[r["video_id"]].append(repr([r[c] for c in columns]))
    for v, tables in alone.items():
        expected = [repr([r[c] for c in columns]) for r in OPERATORS[name](tables).collect()]
        assert expected and sorted(by_video[v]) == sorted(expected), v


def test_a_text_is_searched_once_for_all_queries_of_its_terms(spark):
    """Queries that differ in their time ranges alone: no hit outside a query's range leaves a task, and texts that no query may find aren't read."""
    from framelode.operators import search

    rows = spark.createDataFrame([(s, s, f"word{s % 3} and", 100 * s, 100 * s + 100, [s % 2], ["a"]) for s in range(60)], "scene_index long, pos long, text string, _start long, _end long, _cast array<int>, _kinds array<string>").coalesce(1)
    asked = [(f"{q}#{c}", "and " + q, 1000 * c, 1000 * c + 1000, 1 if c == 2 else None) for q in ("word1", "word2") for c in range(5)]
    queries = spark.createDataFrame(asked, "query_id string, query string, start_cs long, end_cs long, character int")
    expected = {(i, s) for i, q, a, b, who in asked for s in range(60) if a <= 100 * s and 100 * s + 100 <= b and (who is None or s % 2 == who)}
    found = search.matched(rows.select("scene_index", "text", "_start", "_end", "_cast", "_kinds"), queries, "text", 100).collect()
    assert {(r.query_id, r.scene_index) for r in found} == expected
    every = search.matched(rows.select("scene_index", "text", "_start", "_end", "_cast", "_kinds"), queries, "text").collect()
    assert {(r.query_id, r.scene_index) for r in every} == expected and {round(r.share, 3) for r in every} == {0.5, 1.0}
