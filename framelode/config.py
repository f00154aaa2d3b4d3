"""Settings of the engine: defaults in one place, changed by ``spark.framelode.<name>`` in the session's configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    """Lengths in seconds, sizes in pixels, similarities as cosines."""

    store: str = ""
    chunk_target: float = 150.0
    chunk_rest: float = 30.0
    keyframes: int = 6
    cut_threshold: float = 27.0
    shortest_shot: float = 1.0
    audio_window: float = 300.0
    most_height: int = 480
    most_fps: float = 10.0
    face_eps: float = 0.42
    face_split_eps: float = 0.30
    face_points: int = 3
    merge_faces: int = 32
    search_top: int = 10
    director_rounds: int = 3

    @classmethod
    def of(cls, spark: SparkSession) -> Config:
        """The session's settings; one that can't be read as its type is an error."""
        given = {}
        for f in fields(cls):
            value = spark.conf.get(f"spark.framelode.{f.name}", None)
            if value is not None:
                given[f.name] = {"str": str, "int": int, "float": float}[f.type](value)
        return cls(**given)
