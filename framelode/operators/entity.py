"""Characters and speakers: co-occurrence, importance, merging of identities, profiles, binding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelode.functions import text as T
from framelode.operators import joins, shared

#: Fixed values of the rules.
LEAST_CONFIDENCE, LEAST_CHUNKS = 0.85, 2
WEIGHTS = (0.4, 0.3, 0.3)
TIERS = ("major", "minor", "passerby")
#: The fallback roles by screen time.
ROLES, OTHER_ROLE = ("male_lead", "female_lead"), "supporting"
TEMPORARY = "char_tmp_"
#: Rows of two or three ids that a task sorts or groups.
TASK_ROWS = 1_000_000


def tasks_for(spark: SparkSession, rows: int | None) -> int:
    """Into how many tasks so many rows are dealt; bytes say little, as shuffled ids shrink to few of them."""
    return max(spark.sparkContext.defaultParallelism, -(-(rows or 0) // TASK_ROWS))


def by_shot(appearances: DataFrame) -> tuple[DataFrame, int]:
    """Each character of a shot once, dealt by shots, and into how many tasks the pairs of a shot go."""
    place = joins.place(appearances)
    spark = appearances.sparkSession
    rows = appearances.select(*place, "character", "shot").where("character is not null and shot is not null")
    own = rows.repartition(tasks_for(spark, rows.count()), *place, "shot").distinct()
    n = F.count("*")
    pairs = own.groupBy(*place, "shot").agg((n * (n - 1) / 2).cast("long").alias("n")).agg(F.sum("n")).head()[0]
    return own, tasks_for(spark, pairs)


def pairs_of_shots(own: DataFrame, tasks: int) -> DataFrame:
    """a < b of each shot of ``by_shot``, with the number of their shots and the first."""
    place = joins.place(own)
    pairs = own.select(*place, "shot", F.col("character").alias("a")).join(own.select(*place, "shot", F.col("character").alias("b")), [*place, "shot"]).where("a < b")
    return pairs.repartition(tasks, *place, "a", "b").groupBy(*place, "a", "b").agg(F.count("*").alias("n_shared"), F.min("shot").alias("first_shared"))


def cooccurring(appearances: DataFrame, least: int = 1) -> DataFrame:
    """a < b and the number of shots that both are in, for (character, shot); an equi-join on the shot. Of a collection (video_id) within each video. Shots and pairs are counted first, so that no task holds
    more than about ``TASK_ROWS`` of them."""
    return pairs_of_shots(*by_shot(appearances)).where(F.col("n_shared") >= least)


def overlaps(appearances: DataFrame) -> DataFrame:
    """Of every pair a < b of characters that share a shot: shots of both, of either, their Jaccard value, and shots of a alone. Of any other pair these are 0, the sum of
    ``shot_counts``, 0 and a's own count: they are not listed, as their number grows with the square of the characters'."""
    place = joins.place(appearances)
    own, tasks = by_shot(appearances)
    size = shot_counts(appearances)
    pairs = pairs_of_shots(own, tasks).select(*place, "a", "b", F.col("n_shared").alias("both"))
    for end in ("a", "b"):
        pairs = pairs.repartition(tasks, *place, end).join(size.select(*place, F.col("character").alias(end), F.col("n").alias(f"n_{end}")), [*place, end])
    pairs = pairs.withColumn("either", F.col("n_a") + F.col("n_b") - F.col("both"))
    return pairs.select(*place, "a", "b", "both", "either", F.round(F.col("both") / F.greatest("either", F.lit(1)), 6).alias("jaccard"), (F.col("n_a") - F.col("both")).alias("only_a"))


def shot_counts(appearances: DataFrame) -> DataFrame:
    """The number of shots of each character."""
    place = joins.place(appearances)
    rows = appearances.select(*place, "character", "shot")
    return rows.repartition(tasks_for(rows.sparkSession, rows.count()), *place, "shot").distinct().groupBy(*place, "character").agg(F.count("*").alias("n"))


def cooccurrence_lines(appearances: DataFrame, most: int = 40, samples: int = 12) -> DataFrame:
    """(place, a, b, n_shared, sample): the ``most`` pairs that share most shots, ties by their ids, with their first shots, and dots where there are more. Of a collection those of each video."""
    place = joins.place(appearances)
    order = Window.partitionBy(*(place or [F.lit(0)])).orderBy(F.desc("n_shared"), "a", "b")
    # a plain bound on the row number is one that tasks keep to before the shuffle
    top = cooccurring(appearances).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select(*place, (F.col("_r") - 1).alias("place"), "a", "b", "n_shared")
    own = appearances.select(*place, "character", "shot").distinct()
    both = top.select(*place, "a", "b").join(own.withColumnRenamed("character", "a"), [*place, "a"]).join(own.withColumnRenamed("character", "b"), [*place, "b", "shot"])
    first = both.withColumn("_r", F.row_number().over(Window.partitionBy(*place, "a", "b").orderBy("shot"))).where(F.col("_r") <= samples)
    listed = first.groupBy(*place, "a", "b").agg(F.array_join(F.array_sort(F.collect_list("shot")).cast("array<string>"), ", ").alias("_listed"))
    rows = top.join(listed, [*place, "a", "b"])
    return rows.select(*place, "place", "a", "b", "n_shared", F.concat("_listed", F.when(F.col("n_shared") > samples, "...").otherwise("")).alias("sample"))


def key_events(events: DataFrame) -> DataFrame:
    """(character, n_events, event_ids): the events (event_id, characters) in which each character is, in order. Of a collection within each video."""
    place = joins.place(events)
    each = events.select(*place, "event_id", F.explode(F.array_distinct("characters")).alias("character"))
    return each.groupBy(*place, "character").agg(F.count("*").alias("n_events"), F.array_sort(F.collect_list("event_id")).alias("event_ids"))


def speaker_counts(speech: DataFrame, appearances: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` characters that are in most scenes in which each speaker speaks, ties by character."""
    pairs = speech.select("speaker", "scene_index").distinct().join(appearances.select("character", F.col("shot").alias("scene_index")).distinct(), "scene_index")
    order = Window.partitionBy("speaker").orderBy(F.desc("n"), "character")
    return pairs.groupBy("speaker", "character").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def speaker_samples(transcripts: DataFrame, most: int = 3, size: int = 50) -> DataFrame:
    """(scene_index, speaker, samples): the beginnings of a speaker's first lines (pos, text) in a scene, as a list in order."""
    key = [*joins.place(transcripts), "scene_index", "speaker"]
    rows = transcripts.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("pos"))).where(F.col("_n") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", T.prefix(F.col("text"), size).alias("line")))), lambda x: x["line"])
    return rows.groupBy(*key).agg(lines.alias("samples"))


def screen_time(appearances: DataFrame, shots: DataFrame) -> DataFrame:
    """Per character: total time, first and last shot start, number of shots. Of a collection (video_id) within each video."""
    place = joins.place(appearances, shots)
    own = appearances.select(*place, "character", "shot").distinct().join(shots, [*place, "shot"])
    return own.groupBy(*place, "character").agg(F.sum("dur_cs").alias("screen_cs"), F.min("start_cs").alias("first_cs"), F.max("start_cs").alias("last_cs"), F.count("*").alias("n_shots"))


def importance(screen: Column, dialogue: Column, events: Column, duration: Column, lines: Column, total_events: Column) -> Column:
    one = F.lit(1)
    a, b, c = WEIGHTS
    return a * screen / F.greatest(duration, one) + b * dialogue / F.greatest(lines, one) + c * events / F.greatest(total_events, one)


def confirmed_merges(votes: DataFrame, tiers: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """votes (primary, duplicate, chunk, confidence) to confirmed (kept, merged): a pair, in either order, whose best confidence is 0.85 or more and
    which two chunks or more name, both of it known to ``tiers`` (character, tier). Kept is who has most votes as primary, then the better tier, then the smaller id.
    scope: columns of both, as video_id, within which ids are ids."""
    scope = scope or []
    pair = votes.where("primary <> duplicate").withColumn("x", F.least("primary", "duplicate")).withColumn("y", F.greatest("primary", "duplicate"))
    good = pair.groupBy(*scope, "x", "y").agg(F.max("confidence").alias("best"), F.countDistinct("chunk").alias("chunks"), F.count_if(F.col("primary") == F.col("x")).alias("for_x"), F.count_if(F.col("primary") == F.col("y")).alias("for_y"))
    good = good.where((F.col("best") >= LEAST_CONFIDENCE) & (F.col("chunks") >= LEAST_CHUNKS))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")), F.lit(0)), F.lit(len(TIERS) + 1))
    ranks = tiers.groupBy(*scope, "character").agg(F.min(rank).alias("rank"))
    both = good.join(ranks.withColumnsRenamed({"character": "x", "rank": "rank_x"}), [*scope, "x"]).join(ranks.withColumnsRenamed({"character": "y", "rank": "rank_y"}), [*scope, "y"])
    key = lambda own, side: F.struct(-F.col(f"for_{side}"), F.col(f"rank_{side}"), F.col(own))
    first = key("x", "x") <= key("y", "y")
    return both.select(*scope, F.when(first, F.col("x")).otherwise(F.col("y")).alias("kept"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("merged"), "best", "chunks")


def canonical(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(merged, kept) to (id, canonical): links followed to their end by doubling the step each round. Of several links of one id the
    smallest target counts; ids on a cycle stay themselves. An id that has reached its end takes no further step, and the rounds end when none moves; the joins shuffle, as files of few
    bytes hold very many ids."""
    spark = links.sparkSession
    first = links.where("merged <> kept").groupBy("merged").agg(F.min("kept").alias("to")).withColumnRenamed("merged", "id")
    first = shared.written(first, "canonical")
    ids = first.select(F.col("id").alias("to"), F.lit(False).alias("_end")).hint("shuffle_merge")
    now = shared.written(first.join(ids, "to", "left").select("id", "to", F.coalesce("_end", F.lit(True)).alias("end")), "canonical")
    steps = max(1, first.count().bit_length())
    shared.dropped(spark, first)
    for _ in range(min(rounds, steps)):
        onward = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("end").alias("ends")).hint("shuffle_merge")
        moved = now.where("not end").drop("end").join(onward, "to").select("id", F.col("next").alias("to"), F.col("ends").alias("end"), (F.col("next") != F.col("to")).alias("moved"))
        step = shared.written(moved.union(now.where("end").withColumn("moved", F.lit(False))), "canonical")
        shared.dropped(spark, now)
        now = step.drop("moved")
        now._written_to = step._written_to
        if step.where("moved").isEmpty():
            break
    return now.select("id", F.when(F.col("end"), F.col("to")).otherwise(F.col("id")).alias("canonical"))


def renamed(rows: DataFrame, column: str, names: DataFrame, key: list[str], is_list: bool = False) -> DataFrame:
    """``column`` with canonical ids put for merged ones (names: id, canonical), by an equi-join; in lists, which ``key`` tells apart, repeated ids keep
    their first place, and a null list stays null."""
    own = names.select(F.col("id").alias("_id"), F.col("canonical").alias("_canonical")).dropDuplicates(["_id"])
    if not is_list:
        return rows.join(own, F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("_canonical", column)).drop("_id", "_canonical")
    each = rows.select(*key, F.posexplode(column).alias("_place", "_one")).join(own, F.col("_one") == F.col("_id"), "left")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_place", F.coalesce("_canonical", "_one").alias("id")))), lambda x: x["id"])
    lists = each.groupBy(*key).agg(F.array_distinct(ids).alias("_list"))
    return rows.join(lists, key, "left").withColumn(column, F.coalesce("_list", column)).drop("_list")


def profiles(updates: DataFrame) -> DataFrame:
    """Per character from (character, chunk, name, description, action): distinct names and all actions in order of chunks, the last description that says
    something, the number of updates."""

    def listed(column: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("chunk", column))), lambda x: x[column])

    says = F.when(~T.is_placeholder(F.col("description")), F.col("chunk"))
    return updates.groupBy("character").agg(
        F.array_distinct(F.filter(listed("name"), lambda n: n != "")).alias("names"), F.coalesce(F.max_by("description", says), F.lit("")).alias("description"),
        F.filter(listed("action"), lambda a: a != "").alias("actions"), F.count("*").alias("n_updates"),
    )


def roles(screen: DataFrame) -> DataFrame:
    """The fallback roles of each video's characters by screen time."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("screen_cs"), "character"))
    return screen.withColumn("role", F.coalesce(F.try_element_at(F.array(*map(F.lit, ROLES)), n), F.lit(OTHER_ROLE)))


def speakers_map(transcripts: DataFrame) -> DataFrame:
    """The last character that each speaker of a video was bound to."""
    return transcripts.where(F.col("speaker").isNotNull() & F.col("character").isNotNull()).groupBy("video_id", "speaker").agg(F.max_by("character", "pos").alias("character"))


def with_speakers(transcripts: DataFrame, mapping: DataFrame) -> DataFrame:
    """transcripts (speaker, character) with the character that ``mapping`` (speaker, mapped) has for their speaker, their own otherwise. Of a collection (video_id) within each video."""
    place = joins.place(transcripts, mapping)
    own = mapping.where("mapped is not null").select(*place, "speaker", "mapped").dropDuplicates([*place, "speaker"])
    return transcripts.join(own, [*place, "speaker"], "left").withColumn("character", F.coalesce("mapped", "character")).select(*transcripts.columns)


def with_speaker_ids(characters: DataFrame, mapping: DataFrame) -> DataFrame:
    """characters (character, speaker_ids) with the speakers that ``mapping`` binds to them among their own, in order, each once."""
    bound = mapping.where("mapped is not null").groupBy(F.col("mapped").alias("character")).agg(F.collect_set("speaker").alias("_bound"))
    none = F.array().cast("array<string>")
    rows = characters.join(bound, "character", "left")
    every = F.array_sort(F.array_distinct(F.concat(F.coalesce("speaker_ids", none), F.coalesce("_bound", none))))
    return rows.withColumn("speaker_ids", F.when(F.col("_bound").isNotNull(), every).otherwise(F.col("speaker_ids"))).drop("_bound")


def bound_greedily(counts: DataFrame) -> DataFrame:
    """(video_id, speaker, character, n) to one character for each speaker: speakers by name, each the best free character by count, then by name."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        out = []
        for speaker, own in rows.sort_values(["speaker", "n", "character"], ascending=[True, False, True]).groupby("speaker", sort=True):
            free = next((c for c in own["character"] if c not in used), None)
            if free is not None:
                used.add(free)
                out.append((rows["video_id"].iloc[0], speaker, free))
        return pd.DataFrame(out, columns=["video_id", "speaker", "character"])

    return counts.groupBy("video_id").applyInPandas(step, "video_id long, speaker string, character long")


def stable_only(characters: DataFrame) -> DataFrame:
    """Characters whose ids are not temporary; all of them if there are no others."""
    lasting = ~F.col("character").startswith(TEMPORARY)
    any_of_video = F.max(lasting).over(Window.partitionBy("video_id"))
    return characters.withColumn("_some", any_of_video).where(lasting | ~F.col("_some")).drop("_some")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (source, target) between two different known nodes (id)."""
    known = nodes.select("id").distinct()
    out = edges.where("source <> target").join(known.withColumnRenamed("id", "source"), "source", "left_semi")
    return out.join(known.withColumnRenamed("id", "target"), "target", "left_semi")
