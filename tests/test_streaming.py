import json

from pyspark.sql import functions as F

from framelode.operators import temporal
from framelode.sources import adapters
from framelode.streaming import profiles

SMALL = "/root/testdata/sf0.001"


def drained(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streamed_chunks_are_the_batch_ones(spark, tmp_path):
    shots = adapters.shots(spark, SMALL)
    for n in range(3):  # three files, each later in every video than the one before
        shots.where(f"scene_index div 8 = {n}" if n < 2 else "scene_index >= 16").coalesce(1).write.mode("append").parquet(f"{tmp_path}/shots")
    stream = spark.readStream.schema(shots.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/shots")
    out = drained(profiles.closed_chunks(stream), "closed_chunks", "append")
    batch = temporal.chunks(shots, least=0).where("duration_cs >= 15000")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))
    assert out.count() > 0


def test_an_end_of_a_video_closes_its_rest(spark, tmp_path):
    shots = adapters.shots(spark, SMALL).select("video_id", "scene_index", "start_cs", "end_cs", "dur_cs")
    ends = shots.select("video_id", F.lit(None).cast("int").alias("scene_index"), F.lit(0).cast("long").alias("start_cs"), F.lit(0).cast("long").alias("end_cs"), F.lit(0).cast("long").alias("dur_cs")).distinct()
    for n in range(3):
        shots.where(f"scene_index div 8 = {n}" if n < 2 else "scene_index >= 16").coalesce(1).write.mode("append").parquet(f"{tmp_path}/shots")
    ends.coalesce(1).write.mode("append").parquet(f"{tmp_path}/shots")
    for least in (0, 3_000, 14_000):
        stream = spark.readStream.schema(shots.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/shots")
        out = drained(profiles.closed_chunks(stream, least=least), f"ended_{least}", "append")
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, temporal.chunks(shots, least=least).collect()))


def test_streamed_profiles_end_as_the_batch_ones(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, i, f"n{i % 7}" if i % 3 else "") for i in range(60)], "character long, chunk long, name string")
    for n in range(3):
        rows.where(f"chunk div 20 = {n}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/updates")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/updates")
    out = drained(profiles.running_profiles(stream), "profiles", "update")
    last = {r.character: (sorted(r.names), r.n_updates) for r in out.orderBy("n_updates").collect()}
    batch = rows.groupBy("character").agg(F.array_sort(F.collect_set(F.nullif("name", F.lit("")))).alias("names"), F.count("*").alias("n"))
    assert last == {r.character: (r.names, r.n) for r in batch.collect()}


def test_windows_of_a_stream(spark, tmp_path):
    events = adapters.table(spark, SMALL, "events")
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    out = drained(profiles.windowed_counts(stream, "1 day"), "windowed", "complete")
    assert out.agg(F.sum("n")).first()[0] == events.count()


def _answer(**parts):
    return json.dumps({"transcripts": [], "per_shot": []} | parts)


def _update(character, names=(), change="", action=""):
    return {"character_id": character, "new_names": list(names), "appearance_change": change, "key_action": action}


def test_profiles_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    from framelode.functions import variants as V
    from framelode.operators import chunk_answers, profiles
    from framelode.streaming import chunk_profiles

    merge = lambda a, b, c: {"primary": a, "duplicate": b, "confidence": c, "reason": "alike"}
    told = {
        ("v", 0): _answer(transcripts=[{"text": "a", "speaker": "unknown_1"}, {"text": "", "speaker": "unknown_7"}], character_updates=[_update("char_a", ["Ann", "未知"], "red coat", "runs"), _update("char_new", ["Bob"], "无变化", "hides"), 5], character_merge_suggestions=[merge("char_a", "char_new", "90%"), merge("char_a", "char_late", 1), merge("char_a", "char_a", 1)]),
        ("v", 1): "no answer",
        ("v", 2): _answer(per_shot=[{"scene_index": 1, "characters_present": ["unknown_2", {"id": "unknown_1"}]}], character_updates=[_update("char_new", ["Rob", "Bob"], "hat", "sits"), _update("entity_dog", [], "brown", "barks"), _update("unknown_2", ["Cid"], "", "waves"), _update("nobody", ["X"])]),
        ("v", 3): _answer(character_updates=[_update("char_late", [], "late"), _update("entity_dog", [], "", "sleeps"), _update("char_a", ["Ann"], "无", "无")], character_merge_suggestions=[merge("char_a", "char_late", 0.8), merge("entity_dog", "char_p", 1)]),
        ("w", 0): _answer(character_updates=[_update("char_a", ["Other"])]),
    }
    galleries = spark.createDataFrame([("v", "char_a", "major"), ("v", "char_p", "passerby"), ("u", "char_u", "minor")], "video_id string, character_id string, tier string")
    answers = spark.createDataFrame([(*k, a) for k, a in told.items()], "video_id string, chunk_index int, answer string")
    read = answers.withColumn("answer", V.read_object(F.col("answer")))
    batch = {(r.video_id, r.character_id): r.asDict(True) for r in profiles.folded(galleries, chunk_answers.mentions(read), chunk_answers.suggestions(read)).collect()}
    assert batch["v", "char_a"]["names"] == ["Ann"] and batch["v", "char_a"]["description"] == "red coat"
    assert [m["duplicate_id"] for m in batch["v", "char_a"]["merge_suggestions"]] == ["char_new", "char_late"]
    assert [a["action"] for a in batch["v", "char_new"]["key_actions"]] == ["sits"] and batch["v", "char_new"]["description"] == "hat"
    assert batch["v", "entity_dog"]["entity_type"] == "other" and not batch["v", "entity_dog"]["merge_suggestions"] and [a["action"] for a in batch["v", "entity_dog"]["key_actions"]] == ["sleeps"]
    assert batch["v", "char_tmp_chunk_0002_unknown_2"]["names"] == ["unknown_2", "Cid"] and ("v", "char_tmp_chunk_0000_unknown_7") not in batch and ("u", "char_u") in batch

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timers keep the query going for ever
    source = spark.readStream.schema(answers.schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")

    def run(name, *keys, patience=600):
        """Put these answers in and take the stream up where it ended."""
        for n, part in enumerate(keys):
            path = tmp_path / "in" / f"{name}{n}.json"
            path.write_text("".join(json.dumps({"video_id": v, "chunk_index": c, "answer": told.get((v, c), "none")}) + "\n" for v, c in part))
        out = chunk_profiles.folded(source, galleries, patience).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda df, _: seen.update({(r.video_id, r.character_id): r.asDict(True) for r in df.collect()}))
        query = out.trigger(availableNow=True).start()
        assert query.awaitTermination(60), query.stop()

    seen = {}
    run("a", [("v", 0), ("w", 0)], [("v", 2)])  # chunk 2 waits for chunk 1
    assert ("v", "entity_dog") not in seen and seen["v", "char_new"]["names"] == ["Bob"]
    run("b", [("v", 1)], [("v", 3), ("v", 0)])
    assert {k: {f: x for f, x in p.items() if f != "chunk_index"} for k, p in seen.items()} == {k: p for k, p in batch.items() if k[0] != "u"}

    told["v", 5] = _answer(character_updates=[_update("char_five", ["Fifth"])])  # chunk 4 never comes
    run("c", [("v", 5)], patience=0)
    run("d", [("w", 1)], patience=0)
    assert seen["v", "char_five"]["names"] == ["Fifth"]
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
