import json

import pytest
from pyspark.sql import functions as F

from framelode.operators import search
from framelode.sources import schemas
from framelode.sources.store import Store, ingest_id, read_json_list


def test_tables_are_replaced_video_by_video(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = lambda v, n: spark.createDataFrame([(v, i, float(i), i + 1.0) for i in range(n)], "video_id string, scene_index int, start_time double, end_time double")
    assert store.read("shot").count() == 0 and store.read("shot").schema == schemas.schema("shot")
    store.write("shot", rows("a", 3))
    store.write("shot", rows("b", 2))
    store.write("shot", rows("a", 5))
    assert {r["video_id"]: r["count"] for r in store.read("shot").groupBy("video_id").count().collect()} == {"a": 5, "b": 2}
    assert store.read("shot", "b").count() == 2
    with pytest.raises(ValueError):
        store.write("shot", rows("a", 1).withColumn("colour", F.lit("x")))
    with pytest.raises(KeyError):
        store.read("nothing")
    store.write("video_meta", spark.createDataFrame([("b", "b.mp4"), ("a", "a.mp4")], "video_id string, filename string"))
    store.write("memory_unit", spark.createDataFrame([("b", 0)], "video_id string, scene_index int"))
    assert [(r.video_id, r.memory_ready) for r in store.list_videos().collect()] == [("a", False), ("b", True)]
    store.register()
    assert spark.sql("SELECT count(*) FROM shot JOIN video_meta USING (video_id)").first()[0] == 7


def test_a_step_that_is_done_is_not_made_again(spark, tmp_path):
    store, made = Store(spark, f"file://{tmp_path}/store"), []

    def make():
        made.append(1)
        return spark.createDataFrame([("a", 1)], "video_id string, beat_index int")

    for _ in range(3):
        assert store.step("a", "beats", "beat", make).count() == 1
    assert made == [1] and [r.step for r in store.done("a").collect()] == ["beats"]


def test_the_scored_characters_stand_before_the_found_ones(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.write("character", spark.createDataFrame([("a", "char_1", None), ("a", "char_2", None)], "video_id string, character_id string, importance_score double"))
    assert store.characters("a").count() == 2
    store.write("character", spark.createDataFrame([("a", "char_1", 0.5), ("a", "char_2", None)], "video_id string, character_id string, importance_score double"))
    assert [r.character_id for r in store.characters("a").collect()] == ["char_1"]


def test_one_bad_item_voids_its_file(spark, tmp_path):
    good = [{"pos": 1, "text": "a"}, {"pos": 2}, {}]
    for name, content in {"good": json.dumps(good), "item": '[{"pos": 1}, 5]', "cut": '[{"pos": 1}', "object": '{"pos": 1}', "empty": "[]"}.items():
        (tmp_path / f"{name}.json").write_text(content)
        assert read_json_list(spark, f"file://{tmp_path}/{name}.json", "pos int, text string").count() == (3 if name == "good" else 0), name
    assert read_json_list(spark, f"file://{tmp_path}/none.json", "pos int").count() == 0


def test_ids_of_new_videos(spark):
    rows = spark.createDataFrame([("My  Film (2).mp4", "/x/a", 5), ("???.mov", "/y", 1)], "name string, path string, size long")
    found = [r[0] for r in rows.select(ingest_id(F.col("name"), F.col("path"), F.col("size"))).collect()]
    assert found[0].startswith("my_film_2_") and len(found[0]) == len("my_film_2_") + 8 and found[1].startswith("video_")


def test_a_video_that_is_not_there_is_an_error(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(LookupError):
        store.video("v1")
    store.write("video_meta", spark.createDataFrame([("v1", "a.mp4")], "video_id string, filename string"))
    assert store.video("v1").first()["filename"] == "a.mp4"
    with pytest.raises(LookupError):
        store.video("v2")


def test_indexes_are_written_read_and_gone_without(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.index("text_index", "v1") is None
    texts = spark.createDataFrame([(1, "a b", ["a"])], "scene_index int, combined_text string, keywords array<string>")
    vectors = spark.createDataFrame([(1, [0.6, 0.8])], "scene_index int, embedding array<double>")
    store.write_indexes("v1", {"text_index": texts, "vector_index": vectors})
    assert [(r.scene_index, r.keywords) for r in store.index("text_index", "v1").collect()] == [(1, ["a"])]
    found = search.vector_hits(store.index("vector_index", "v1"), spark.createDataFrame([(9, [3.0, 4.0])], "query_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.scene_index, round(r.score, 6)) for r in found] == [(9, 1, 1.0)]
    assert store.index("vector_index", "v2") is None
    for part in (tmp_path / "s" / "text_index").rglob("*.parquet"):
        for side in part.parent.glob(f".{part.name}.crc"):
            side.unlink()
        part.write_bytes(b"no parquet")
    assert store.index("text_index", "v1") is None
    with pytest.raises(ValueError, match="no index"):
        store.write_indexes("v1", {"shot": texts})
