import pytest

from framelode import __main__ as cli
from framelode import api
from framelode.config import Config
from framelode.sources.snapshots import Snapshots
from framelode.sources.store import Store


def frames(spark, video):
    make = lambda rows, kind: spark.createDataFrame([(video, *r) for r in rows], f"video_id string, {kind}")
    return {
        "video_meta": make([("f.mp4", "/m/f.mp4")], "filename string, storage_path string"),
        "shot": make([(i, i * 5.0, i * 5.0 + 5) for i in range(4)], "scene_index int, start_time double, end_time double"),
        "transcript": make([(0, "the red door opens", 1), (1, "a quiet sea", 2)], "pos int, text string, scene_index int"),
        "vision": make([(1, "a door", "tense", "room"), (3, "red light", "", "street")], "scene_index int, description string, mood string, scene_type string"),
        "event": make([(0, "talk", "they open the door", [1], 8)], "event_index int, event_type string, description string, scene_indices array<int>, importance int"),
        "character": make([("char_a", [1, 2])], "character_id string, appearance_scenes array<int>"),
        "text_index": make([(1, "the red door opens a door", ["red", "door"], "the red door opens", "a door")], "scene_index int, combined_text string, keywords array<string>, transcript string, vision_description string"),
        "memory_unit": make([(1, "the red door opens a door", [1.0, 0.0])], "scene_index int, combined_text string, embedding array<double>"),
        "edit_clip": make([("p1", 1, 10.0, 14.5, 1.0, 0.8), ("p1", 0, 5.0, 10.0, 2.0, 1.0)], "plan_id string, clip_index int, source_start double, source_end double, speed double, audio_volume double"),
    }


def test_search_over_a_store_and_its_snapshots(spark, tmp_path, capsys):
    store = Store(spark, f"file://{tmp_path}/store")
    for name, rows in frames(spark, "old").items():
        store.write(name, rows)
    Snapshots(spark, f"{store.root}/_snapshots", store).commit(frames(spark, "new"))
    queries = spark.createDataFrame([(1, "old", "Red door", None, None), (2, "new", "red", "char_a", None), (3, "new", "door", None, 500), (4, "nobody", "door", None, None)], "query_id long, video_id string, query string, character string, start_cs long")
    found = {(r.query_id, r["rank"]): r for r in api.searched(store, queries, 3).collect()}
    assert {k[0] for k in found} == {1, 2, 3} and {r.video_id for k, r in found.items() if k[0] != 1} == {"new"}
    first = found[1, 1]
    assert (first.video_id, first.scene_index, first.start_cs, first.end_cs) == ("old", 1, 500, 1000) and {"transcript", "vision", "event"} <= set(first.modalities)
    assert [r.scene_index for k, r in sorted(found.items()) if k[0] == 2] == [1]  # scene 3 is nobody's
    clips = api.cut_list(store, "p1").where("source = '/m/f.mp4'").collect()
    assert {(r.clip_index, r.from_s, r.to_s, r.speed) for r in clips} == {(0, 5.0, 10.0, 2.0), (1, 10.0, 14.5, 1.0)}
    with pytest.raises(LookupError):
        api.cut_list(store, "p9")
    cli.main(["--store", store.root, "search", "--video-id", "new", "--query", "sea"], spark)
    cli.main(["--store", store.root, "videos"], spark)
    cli.main(["query"], spark)
    out = capsys.readouterr().out
    assert "a quiet sea" in out and "f.mp4" in out and "chunk_backfill" in out


def test_settings(spark):
    assert Config.of(spark) == Config()
    spark.conf.set("spark.framelode.search_top", "7")
    assert Config.of(spark).search_top == 7
    spark.conf.set("spark.framelode.search_top", "many")
    with pytest.raises(ValueError):
        Config.of(spark)
    spark.conf.unset("spark.framelode.search_top")
