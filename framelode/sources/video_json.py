"""Directories of JSON files, one a video, as a data source: ``spark.read.format("video_json").option("path", root).option("table", "event").load()``, or ``read``.

A partition is one video; the option ``videos``, a JSON list of ids, opens the files of those alone. (Filters are not pushed into the source: Spark 4.1 keeps what one query has pushed for the next query over the same
DataFrame, which then loses rows.) The files are read on the executors, through pyarrow's file systems: local and mounted folders, and the object stores that pyarrow knows by their URI. Files are lists of objects,
one object, or maps whose entries become rows.

Defined cases, as the data model has them: a field that is missing has its default (an empty text or list, zero, false, or that of ``DEFAULTS``; null where it may be null); an object without a field that it must
have, or with a value that doesn't fit, voids its whole file, as does anything that is no such JSON; a video without the file has no rows. Whole numbers may be written as texts or as 3.0.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as S
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framelode.sources import schemas

#: Where each table's rows stand. A dot leads to a field of an object; "{}" is one object, "*" a map of keys to values.
FILES = {
    "video_meta": ("meta.json", "{}"), "shot": ("scenes/scenes.json", ""), "beat": ("beats.json", ""), "story_scene": ("story_scenes.json", ""), "chapter": ("chapters.json", ""), "minute_chunk": ("minute_chunks.json", ""),
    "transcript": ("transcripts.json", ""), "ocr": ("ocr.json", ""), "vision": ("vision.json", ""), "audio_prosody": ("audio_prosody.json", ""), "alignment": ("multimodal_alignments.json", ""),
    "character": ("characters.json", ""), "character_profile": ("character_profiles.json", ""), "character_relation": ("character_relations.json", ""), "event": ("events.json", ""),
    "event_edge": ("event_graph.json", "edges"), "speaker_map": ("speaker_map.json", "*"),
}
#: Fields that an object must have, fields that may be null, and defaults that aren't those of their type.
REQUIRED = {
    "video_meta": "filename storage_path duration width height fps codec file_size", "shot": "scene_index start_time end_time duration", "beat": "beat_index start_time end_time", "story_scene": "story_scene_index start_time end_time",
    "chapter": "chapter_index start_time end_time", "minute_chunk": "chunk_index start_time end_time duration", "transcript": "start_time end_time text", "ocr": "scene_index timestamp", "vision": "scene_index timestamp description",
    "audio_prosody": "scene_index", "alignment": "scene_index start_time end_time", "character": "character_id display_name", "character_profile": "character_id", "character_relation": "character_a character_b relation_type",
    "event": "event_index start_time end_time event_type description", "event_edge": "source target relation_type", "speaker_map": "speaker character_id",
}
NULLABLE = {"transcript": "speaker character_id", "character": "role importance_score", "shot": "beat_index story_scene_index"}
DEFAULTS = {
    "video_meta": {"status": "uploaded"}, "transcript": {"confidence": 1.0, "scene_index": -1, "transcript_type": "dialogue"}, "character_profile": {"tier": "major", "is_human": True, "entity_type": "human"},
    "character_relation": {"strength": 0.5}, "event": {"importance": 5, "confidence": 0.8}, "event_edge": {"strength": 0.5, "confidence": 0.5},
}
#: Fields that stand under another name in the files.
NAMES = {"event_edge": {"source": "source_event", "target": "target_event"}}
_EXTRA = {"speaker_map": "speaker string, character_id string"}


def table_schema(table: str) -> S.StructType:
    return S.StructType.fromDDL(f"video_id string, {_EXTRA[table]}") if table in _EXTRA else schemas.schema(table)


def fitted(value, kind: S.DataType):
    """The value as the type has it; an error if it doesn't fit."""
    if isinstance(kind, S.StringType):
        if isinstance(value, str):
            return value
    elif isinstance(kind, S.BooleanType):
        if isinstance(value, bool) or value in (0, 1):
            return bool(value)
    elif isinstance(kind, (S.IntegerType, S.LongType)):
        if isinstance(value, bool) or float(value) == int(float(value)):
            return int(float(value))
    elif isinstance(kind, S.DoubleType):
        return float(value)
    elif isinstance(kind, S.ArrayType) and isinstance(value, list):
        return [fitted(v, kind.elementType) for v in value]
    elif isinstance(kind, S.MapType) and isinstance(value, dict):
        return {fitted(k, kind.keyType): fitted(v, kind.valueType) for k, v in value.items()}
    elif isinstance(kind, S.StructType) and isinstance(value, dict):
        return tuple(None if value.get(f.name) is None else fitted(value[f.name], f.dataType) for f in kind.fields)
    raise ValueError(f"{value!r} is no {kind.simpleString()}")


def _default(kind: S.DataType):
    return [] if isinstance(kind, S.ArrayType) else {} if isinstance(kind, S.MapType) else "" if isinstance(kind, S.StringType) else False if isinstance(kind, S.BooleanType) else 0.0 if isinstance(kind, S.DoubleType) else 0


def typed(item: dict, table: str, place: int, kind: S.StructType) -> tuple:
    """An object's fields behind video_id; kind: the table's schema."""
    required, nullable, out = REQUIRED[table].split(), NULLABLE.get(table, "").split(), []
    for f in kind.fields[1:]:
        name = NAMES.get(table, {}).get(f.name, f.name)
        if f.name == "pos" and name not in item:
            out.append(place)
        elif name in item and not (item[name] is None and f.name in nullable):
            out.append(fitted(item[name], f.dataType))
        elif f.name in required:
            raise ValueError(f"no {name}")
        else:
            out.append(None if f.name in nullable else DEFAULTS.get(table, {}).get(f.name, _default(f.dataType)))
    return tuple(out)


def parsed(text: str, table: str, kind: S.StructType) -> list[tuple]:
    """The rows of one file; none if any of it doesn't fit."""
    try:
        found, way = json.loads(text), FILES[table][1]
        if way == "*":
            found = [{"speaker": k, "character_id": v} for k, v in found.items()]
        elif way == "{}":
            found = [found]
        elif way:
            found = found.get(way, [])
        return [typed(item, table, n, kind) for n, item in enumerate(found)] if isinstance(found, list) else []
    except (ValueError, TypeError, AttributeError, OverflowError):
        return []


class Video(InputPartition):
    def __init__(self, video_id: str):
        super().__init__(video_id)
        self.video_id = video_id


class _Reader(DataSourceReader):
    def __init__(self, root: str, table: str, kind: S.StructType, only: list[str] | None):
        self.root, self.table, self.kind, self.only = root, table, kind, only

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[Video]:
        from pyarrow import fs

        files, root = self._files()
        if self.only is not None:  # no listing of all videos for a few of them
            found = [v for v in sorted(set(self.only)) if files.get_file_info(f"{root}/{v}").type == fs.FileType.Directory]
        else:
            found = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.Directory)
        return [Video(v) for v in found]

    def read(self, partition: Video) -> Iterator[tuple]:
        from pyarrow import fs

        if not isinstance(partition, Video):
            return
        files, root = self._files()
        path = f"{root}/{partition.video_id}/{FILES[self.table][0]}"
        if files.get_file_info(path).type != fs.FileType.File:
            return
        with files.open_input_stream(path) as stream:
            text = stream.read()
        for row in parsed(text.decode(errors="replace"), self.table, self.kind):
            yield (partition.video_id, *row)


def register(spark: SparkSession) -> None:
    """Make the source known to the session."""
    # types are read from their text here, as workers have no session to do it
    kinds = {table: table_schema(table) for table in FILES}

    class VideoJson(DataSource):
        @classmethod
        def name(cls) -> str:
            return "video_json"

        def schema(self) -> S.StructType:
            return kinds[self.options["table"]]

        def reader(self, schema: S.StructType) -> _Reader:
            only = self.options.get("videos")
            return _Reader(self.options["path"].rstrip("/"), self.options["table"], kinds[self.options["table"]], None if only is None else json.loads(only))

    spark.dataSource.register(VideoJson)


def read(spark: SparkSession, root: str, table: str, videos: list[str] | None = None) -> DataFrame:
    """A table of all videos below ``root``, or of these."""
    register(spark)
    rows = spark.read.format("video_json").option("path", root).option("table", table)
    return (rows if videos is None else rows.option("videos", json.dumps(videos))).load()
