"""All that the answers about the chunks of a collection give, as the tables of the store: lines, views, sound, alignments, profiles, who speaks as whom and the characters, under one name each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.operators import chunk_answers, entity, profiles, shared


def canonical_names(links: DataFrame) -> DataFrame:
    """video_id, id and canonical from confirmed merges (video_id, merged, kept): ids are followed to their end within their video."""
    own = lambda c: F.struct("video_id", F.col(c).alias("id")).alias(c)
    ends = entity.canonical(links.select(own("merged"), own("kept")))
    return ends.select("id.video_id", F.col("id.id").alias("id"), F.col("canonical.id").alias("canonical")).where("id <> canonical")


def _of_video(names: DataFrame, column: str) -> DataFrame:
    return names.select("video_id", F.col("id").alias(column), F.col("canonical").alias(f"_{column}")).dropDuplicates(["video_id", column])


def _renamed(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    return rows.join(_of_video(names, column), ["video_id", column], "left").withColumn(column, F.coalesce(f"_{column}", column)).drop(f"_{column}").select(*rows.columns)


def _renamed_lists(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """Lists of ids under their canonical names, each once, in the order of their first: a video's few merges come with its rows as one map."""
    of = names.groupBy("video_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "canonical"))).alias("_names"))
    named = lambda c: F.array_distinct(F.transform(c, lambda x: F.coalesce(F.try_element_at("_names", x), x)))
    # where nobody is merged a list keeps what it repeats
    with_map = lambda c: F.when(F.col("_names").isNotNull(), named(F.col(c))).otherwise(F.col(c))
    return rows.join(of, "video_id", "left").withColumns({c: with_map(c) for c in columns}).drop("_names").select(*rows.columns)


def understood(chunks: DataFrame, shots: DataFrame, answers: DataFrame, galleries: DataFrame) -> dict[str, DataFrame]:
    """Tables by name: transcript, ocr, vision, audio_prosody, alignment, character_profile, character (all with video_id, as ``sources/schemas.py`` has them, some with further columns), speaker_map (video_id,
    speaker, character_id) and identity_link (video_id, merged, kept, best, chunks). galleries: video_id, character_id, tier, appearance_scenes."""
    rows = shared.written(chunk_answers.read(chunks, shots, answers), "read")
    made = chunk_answers.backfilled_from(rows, shots)
    folded = shared.written(profiles.folded(galleries, chunk_answers.mentions(rows), chunk_answers.suggestions(rows)), "profiles")
    links = shared.written(entity.confirmed_merges(profiles.votes(folded), folded.select("video_id", F.col("character_id").alias("character"), "tier"), ["video_id"]), "links")
    names = shared.written(canonical_names(links), "names")
    transcripts = _renamed(_renamed(made.transcripts, names, "character_id"), names, "speaker")
    alignments = shared.written(_renamed_lists(made.alignments, names, "visible_characters", "speaking_characters"), "alignments")
    into = _of_video(names, "character_id")
    marked = folded.join(into, ["video_id", "character_id"], "left").withColumn("merged_into", F.coalesce("_character_id", F.lit(""))).drop("_character_id")
    return {
        "transcript": transcripts, "ocr": made.ocr, "vision": made.vision, "audio_prosody": made.audio, "alignment": alignments, "character_profile": marked, "speaker_map": chunk_answers.speaker_map(transcripts),
        "character": profiles.characters(folded, names, alignments, galleries, shots), "identity_link": links,
    }

