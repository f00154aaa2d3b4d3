import json

from framelode.operators import groupings as G


def beats(spark, videos):
    rows = [(v, i, i * 10.0, i * 10.0 + 8, 8.0, [2 * i, 2 * i + 1], ["x"] if i % 2 else [f"c{i}"]) for v, n in videos.items() for i in range(n)]
    return spark.createDataFrame(rows, "video_id string, beat_index int, start_time double, end_time double, duration double, shot_indices array<int>, characters array<string>")


def test_story_scenes(spark):
    answers = {
        "told": json.dumps([{"beat_indices": [1, 0, 99], "description": "d", "characters": ["x"]}, {"beat_indices": []}, {"beat_indices": [98]}, {"beat_indices": [3, 3], "story_scene_index": 7, "location": "home"}, {"beat_indices": [4]}]),
        "spoilt": json.dumps([{"beat_indices": [0]}, 5]),
        "typed": json.dumps([{"beat_indices": [0], "location": 3}]),
        "empty": "[]",
        "broken": "no list",
        "nobody": json.dumps([{"beat_indices": [77]}]),
    }
    rows = beats(spark, dict.fromkeys([*answers, "silent"], 5)).drop("characters")
    out = {}
    for r in G.story_scenes(rows, spark.createDataFrame(list(answers.items()), "video_id string, answer string")).collect():
        out.setdefault(r.video_id, []).append((r.story_scene_index, r.start_time, r.end_time, r.duration, r.beat_indices, r.shot_indices, r.location, r.description, r.characters))
    fallback = [(0, 0.0, 28.0, 24.0, [0, 1, 2], [0, 1, 2, 3, 4, 5], "", "", []), (1, 30.0, 48.0, 16.0, [3, 4], [6, 7, 8, 9], "", "", [])]
    assert {v: sorted(x) for v, x in out.items() if v != "told"} == dict.fromkeys(["spoilt", "typed", "empty", "broken", "silent"], fallback)
    # a list that names none of the beats gives no scenes
    assert sorted(out["told"]) == [(0, 0.0, 18.0, 16.0, [0, 1, 99], [0, 1, 2, 3], "", "d", ["x"]), (2, 40.0, 48.0, 8.0, [4], [8, 9], "", "", []), (7, 30.0, 38.0, 8.0, [3, 3], [6, 7], "home", "", [])]


def test_chapters(spark):
    scenes = beats(spark, {"short": 5, "few": 3, "told": 5, "nobody": 4, "silent": 4}).withColumnRenamed("beat_index", "story_scene_index").withColumnRenamed("shot_indices", "beat_indices").selectExpr("*", "beat_indices AS shot_indices")
    videos = spark.createDataFrame([("short", 599.0), ("few", 900.0), ("told", 900.0), ("nobody", 900.0), ("silent", 900.0)], "video_id string, duration double")
    told = json.dumps([{"story_scene_indices": [0, 1], "title": "one", "characters": ["z"]}, {"story_scene_indices": [4, 9]}])
    answers = spark.createDataFrame([("short", told), ("few", told), ("told", told), ("nobody", '[{"story_scene_indices": [55]}]')], "video_id string, answer string")
    out = {}
    for r in G.chapters(scenes, answers, videos).collect():
        out.setdefault(r.video_id, []).append((r.chapter_index, r.title, r.start_time, r.end_time, r.duration, r.story_scene_indices, r.beat_indices, r.characters, r.chapter_type))
    assert out["short"] == [(0, "全篇", 0.0, 48.0, 48.0, [0, 1, 2, 3, 4], list(range(10)), ["c0", "c2", "c4", "x"], "act_1")] and out["few"][0][5] == [0, 1, 2]
    assert sorted(out["told"]) == [(0, "one", 0.0, 18.0, 16.0, [0, 1], [0, 1, 2, 3], ["z"], ""), (1, "", 40.0, 48.0, 8.0, [4, 9], [8, 9], [], "")]
    for v in ("nobody", "silent"):
        assert sorted(x[:6] for x in out[v]) == [(0, "章节 1", 0.0, 28.0, 24.0, [0, 1, 2]), (1, "章节 2", 30.0, 38.0, 8.0, [3])] and sorted(out[v])[0][7] == ["c0", "c2", "x"]


def test_arcs_relations_and_roles(spark):
    who = [("v", "char_a"), ("v", "char_b"), ("v", "char_tmp_1"), ("w", "char_tmp_2"), ("w", "char_c")]
    characters = spark.createDataFrame(who, "video_id string, character string")
    appearances = spark.createDataFrame([(v, c, s) for v, c in who for s in ([1, 2, 3] if c != "char_b" else [2, 3, 9])], "video_id string, character string, shot int")
    told = {
        "arcs": [{"character_id": "char_a", "arc_type": "growth", "key_moments": [1, 4]}, {"character_id": "char_b"}, {"character_id": "nobody"}, 5],
        "relations": [
            {"character_a": "char_a", "character_b": "char_b", "relation_type": "ally", "strength": "0.9"}, {"character_a": "char_a", "character_b": "char_tmp_1"}, {"character_a": "char_b", "character_b": "char_c"},
            {"character_a": "char_b", "character_b": "char_a"}, {"character_a": "char_a", "character_b": "char_b", "strength": "much"},
        ],
    }
    answers = spark.createDataFrame([("v", json.dumps(told)), ("w", "none")], "video_id string, answer string")
    assert sorted((r.video_id, r.character_id, r.arc_type, r.key_moments) for r in G.arcs(answers, characters).collect()) == [("v", "char_a", "growth", [1, 4]), ("v", "char_b", "flat", [])]
    assert sorted((r.character_a, r.character_b, r.relation_type, r.strength, r.co_appearance_shots) for r in G.relations(answers, characters, appearances).collect()) == [("char_a", "char_b", "ally", 0.9, [2, 3]), ("char_b", "char_a", "stranger", 0.5, [2, 3])]
    screen = spark.createDataFrame([(v, c, 100 - i) for i, (v, c) in enumerate(who)], "video_id string, character string, screen_cs long")
    roles = spark.createDataFrame([("v", json.dumps({"char_a": "villain", "char_b": "king", "char_tmp_1": 4})), ("w", "?")], "video_id string, answer string")
    assert {(r.video_id, r.character): r.role for r in G.roles(screen, roles).collect()} == {("v", "char_a"): "villain", ("v", "char_b"): "supporting", ("v", "char_tmp_1"): "supporting", ("w", "char_tmp_2"): "male_lead", ("w", "char_c"): "female_lead"}
