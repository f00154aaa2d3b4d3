import json

import pytest

from framelode.sources import video_json
from framelode.sources.snapshots import Snapshots
from framelode.sources.store import Store


def shots(spark, video, starts):
    return spark.createDataFrame([(video, i, float(s), s + 1.0) for i, s in enumerate(starts)], "video_id string, scene_index int, start_time double, end_time double")


def lines(spark, video, texts):
    return spark.createDataFrame([(video, i, t) for i, t in enumerate(texts)], "video_id string, pos int, text string")


def starts(rows, video):
    return sorted(r.start_time for r in rows.where(f"video_id = '{video}'").collect())


def test_tables_change_together_and_only_with_the_commit(spark, tmp_path, monkeypatch):
    snaps = Snapshots(spark, f"file://{tmp_path}/s")
    assert snaps.at().read("shot").count() == 0
    first = snaps.commit({"shot": shots(spark, "a", [1, 2]).union(shots(spark, "b", [9])), "transcript": lines(spark, "a", ["x"])})
    before = snaps.at()

    def killed(rows):
        raise RuntimeError("killed")

    # a writer that dies between its tables
    real = Snapshots._rows
    monkeypatch.setattr(Snapshots, "_rows", lambda self, batch, name: killed(None))
    with pytest.raises(RuntimeError):
        snaps.commit({"shot": shots(spark, "a", [5]), "transcript": lines(spark, "a", ["new"])})
    monkeypatch.setattr(Snapshots, "_rows", real)
    assert snaps.versions() == [first] and starts(snaps.at().read("shot"), "a") == [1, 2]

    snaps.commit({"shot": shots(spark, "a", [5]), "transcript": lines(spark, "a", ["new", "newer"])})
    assert starts(before.read("shot"), "a") == [1, 2] and [r.text for r in before.read("transcript", "a").collect()] == ["x"]
    now = snaps.at()
    assert starts(now.read("shot"), "a") == [5] and starts(now.read("shot"), "b") == [9] and now.read("transcript").count() == 2
    assert starts(snaps.at(first).read("shot"), "a") == [1, 2]
    snaps.commit({"shot": shots(spark, "a", [7])})  # all that a video had is replaced, tables that the commit doesn't name too
    assert snaps.at().read("transcript", "a").count() == 0 and starts(snaps.at().read("shot", "a"), "a") == [7]
    whole = sorted(map(tuple, snaps.at().read("shot").collect()))
    snaps.compacted()
    assert len(snaps.at().entries) == 1 and sorted(map(tuple, snaps.at().read("shot").collect())) == whole
    with pytest.raises(ValueError):
        snaps.commit({"shot": shots(spark, "a", [1]).withColumnRenamed("start_time", "colour")})


def test_two_writers_get_two_versions(spark, tmp_path, monkeypatch):
    snaps = Snapshots(spark, f"file://{tmp_path}/s")
    snaps.commit({"shot": shots(spark, "a", [1])})
    real, calls = Snapshots.versions, []

    def stale(self):
        calls.append(1)
        return [] if len(calls) == 1 else real(self)

    monkeypatch.setattr(Snapshots, "versions", stale)
    assert snaps.commit({"shot": shots(spark, "b", [2])}) == 1
    monkeypatch.setattr(Snapshots, "versions", real)
    assert snaps.at().read("shot").count() == 2


def test_videos_without_a_commit_come_from_the_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.write("shot", shots(spark, "old", [3]).union(shots(spark, "a", [4])))
    store.write("character", spark.createDataFrame([("old", "char_1", 0.5), ("old", "char_2", None)], "video_id string, character_id string, importance_score double"))
    snaps = Snapshots(spark, f"file://{tmp_path}/s", store)
    assert starts(snaps.at().read("shot", "old"), "old") == [3]
    snaps.commit({"shot": shots(spark, "a", [1])})
    now = snaps.at()
    assert starts(now.read("shot"), "a") == [1] and starts(now.read("shot"), "old") == [3]
    assert [r.character_id for r in now.memory("old")["character"].collect()] == ["char_1"]
    with pytest.raises(LookupError):
        now.memory("nobody")
    now.register()
    assert spark.sql("SELECT count(*) FROM shot").first()[0] == 2


def test_json_directories(spark, tmp_path):
    def put(video, name, content):
        path = tmp_path / "videos" / video / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")

    event = {"event_index": "3", "start_time": 1, "end_time": "2.5", "event_type": "talk", "description": "d"}
    put("v1", "events.json", [event, event | {"event_index": 4.0, "importance": 9, "characters": ["char_a"], "more": 1}])
    put("v2", "events.json", [event, {"event_index": 1}])  # a field is missing: the file counts as empty
    put("v3", "events.json", "[{")
    put("v1", "speaker_map.json", {"s1": "char_a", "s2": "char_b"})
    put("v1", "event_graph.json", {"nodes": [], "edges": [{"source_event": 3, "target_event": 4, "relation_type": "cause"}]})
    put("v1", "transcripts.json", [{"start_time": 0, "end_time": 1, "text": "a"}, {"start_time": 1, "end_time": 2, "text": "b", "speaker": None, "scene_index": 2}])
    put("v1", "meta.json", {"filename": "f", "storage_path": "p", "duration": 9, "width": 1, "height": 2, "fps": 25, "codec": "c", "file_size": 7})
    put("v4", "events.json", [event | {"event_type": 5}])
    read = lambda table: video_json.read(spark, f"{tmp_path}/videos", table)
    events = read("event")
    assert [(r.video_id, r.event_index, r.start_time, r.end_time, r.importance, r.confidence, r.characters, r.emotion) for r in events.orderBy("event_index").collect()] == [("v1", 3, 1.0, 2.5, 5, 0.8, [], ""), ("v1", 4, 1.0, 2.5, 9, 0.8, ["char_a"], "")]
    assert {(r.speaker, r.character_id) for r in read("speaker_map").collect()} == {("s1", "char_a"), ("s2", "char_b")}
    assert [(r.source, r.target, r.strength) for r in read("event_edge").collect()] == [(3, 4, 0.5)]
    assert [(r.pos, r.text, r.speaker, r.confidence, r.scene_index) for r in read("transcript").orderBy("pos").collect()] == [(0, "a", None, 1.0, -1), (1, "b", None, 1.0, 2)]
    assert read("video_meta").first().status == "uploaded" and read("shot").count() == 0
    assert events.where("video_id in ('v1', 'v9')").count() == 2 and events.where("video_id = 'v3'").count() == 0
    few = video_json.read(spark, f"{tmp_path}/videos", "event", ["v1", "v9"])
    assert few.count() == 2 and few.rdd.getNumPartitions() == 1 < events.rdd.getNumPartitions() and events.count() == 2


def test_only_the_files_of_the_videos_asked_for_are_opened(spark, tmp_path, monkeypatch):
    for video in ("a", "b", "c"):
        (tmp_path / "videos" / video).mkdir(parents=True)
        (tmp_path / "videos" / video / "ocr.json").write_text('[{"scene_index": 1, "timestamp": 0}]')
    (tmp_path / "videos" / "stray.txt").write_text("")
    reader = lambda only: video_json._Reader(f"{tmp_path}/videos", "ocr", video_json.table_schema("ocr"), only)
    assert [p.video_id for p in reader(None).partitions()] == ["a", "b", "c"]
    assert [p.video_id for p in reader(["c", "a", "nobody", "stray.txt"]).partitions()] == ["a", "c"]
    assert list(reader(["a"]).read(reader(["a"]).partitions()[0])) == [("a", 1, 0.0, [])]
    assert sorted(tuple(r) for r in video_json.read(spark, f"{tmp_path}/videos", "ocr", ["a", "c"]).collect()) == [("a", 1, 0.0, []), ("c", 1, 0.0, [])]
