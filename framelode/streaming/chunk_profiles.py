"""Profiles of characters over a stream of answers about chunks: what ``operators/profiles.py`` folds, chunk by chunk.

State of a video: its profiles by character (a map), the next chunk, and chunks that came before their predecessors (a map), which wait. A timer ends the waiting for a chunk that never comes: the
next ones are then taken in their order. Answers for a chunk whose turn is over are left out.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framelode.functions import text as T
from framelode.functions import variants as V
from framelode.operators import chunk_answers, profiles

_CHUNK = "named array<string>, updates array<struct<place: int, id: string, names: array<string>, change: string, action: string>>, suggested array<struct<place: int, primary: string, duplicate: string, confidence: double, reason: string>>"
_FIELDS = [c.strip().split(" ")[0] for c in ("names, description, appearance_changes, key_actions, tier, is_human, entity_type, gallery_ref, merge_suggestions").split(",")]
OUT = f"video_id string, character_id string, chunk_index int, {profiles.PROFILE}"
#: Seconds for which a chunk waits for those before it.
PATIENCE = 600


def _says(value: str) -> bool:
    """Whether a text is no placeholder."""
    return value.strip(T.PLACEHOLDER_MARKS).lower() not in (*T.PLACEHOLDERS, "")


def scoped(raw: str, chunk: int) -> str | None:
    raw = (raw or "").strip()
    return raw if raw.startswith(("char_", "entity_")) else f"char_tmp_chunk_{chunk:04d}_{raw}" if raw.startswith("unknown_") else None


def empty(**own) -> dict:
    return {"names": [], "description": "", "appearance_changes": [], "key_actions": [], "tier": "minor", "is_human": True, "entity_type": "human", "gallery_ref": "", "merge_suggestions": []} | own


def _plain(structs: list) -> list[tuple]:
    """Structs, which come as rows or as dicts, as the plain tuples that state takes."""
    return [tuple(s.values() if isinstance(s, dict) else s) for s in structs]


class Fold(StatefulProcessor):
    def __init__(self, patience: float = PATIENCE):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "character_id string", profiles.PROFILE)
        self.waiting = handle.getMapState("waiting", "chunk_index int", _CHUNK)
        self.next = handle.getValueState("next", "chunk_index int")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:  # noqa: N802, N803 - names of the interface
        for character, tier in _plain(initialState.galleries):
            self._keep(character, empty(tier=tier, gallery_ref=character))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        due = self._next()
        for row in rows:
            if row.chunk_index >= due:
                self.waiting.updateValue((row.chunk_index,), (row.named, _plain(row.updates), _plain(row.suggested)))
        touched: dict[str, int] = {}
        while self.waiting.containsKey((due,)):
            self._take(due, touched)
            due += 1
        self.next.update((due,))
        if any(True for _ in self.waiting.keys()):
            self.handle.registerTimer(int(time.time() * 1000 + self.patience * 1000))
        yield from self._shown(key, touched)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        touched: dict[str, int] = {}
        left = sorted(k[0] for k in self.waiting.keys())
        for chunk in left:
            self._take(chunk, touched)
        if left:
            self.next.update((left[-1] + 1,))
        yield from self._shown(key, touched)

    def _next(self) -> int:
        return self.next.get()[0] if self.next.exists() else 0

    def _get(self, character: str) -> dict | None:
        return dict(zip(_FIELDS, self.known.getValue((character,)), strict=True)) if self.known.containsKey((character,)) else None

    def _keep(self, character: str, profile: dict) -> None:
        self.known.updateValue((character,), tuple([tuple(x) if isinstance(x, tuple) else x for x in v] if isinstance(v := profile[f], list) else v for f in _FIELDS))

    def _shown(self, key, touched: dict[str, int]) -> Iterator[Row]:
        for character, chunk in touched.items():
            profile = self._get(character)
            yield Row(video_id=key[0], character_id=character, chunk_index=chunk, **profile)

    def _take(self, chunk: int, touched: dict[str, int]) -> None:
        named, updates, suggested = self.waiting.getValue((chunk,))
        self.waiting.removeKey((chunk,))
        for raw in named:
            self._enter(raw, chunk, touched)
        for _, raw, names, change, action in updates:
            if (character := scoped(raw, chunk)) is None:
                continue
            if raw.startswith("unknown_"):
                self._enter(raw, chunk, touched)
            profile = self._get(character)
            if made := profile is None:
                other = character.startswith("entity_")
                profile = empty(is_human=not other, entity_type="other" if other else "human")
            profile["names"] = list(dict.fromkeys([*profile["names"], *(n for n in names if _says(n))]))
            if change:
                profile["appearance_changes"] = [*profile["appearance_changes"], (chunk, change)]
                if _says(change):
                    profile["description"] = change
            if not made and _says(action):
                profile["key_actions"] = [*profile["key_actions"], (chunk, action)]
            self._keep(character, profile)
            touched[character] = chunk
        for _, primary, duplicate, confidence, reason in suggested:
            if (profile := self._get(primary)) is not None and self.known.containsKey((duplicate,)):
                profile["merge_suggestions"] = [*profile["merge_suggestions"], (duplicate, reason, confidence, chunk)]
                self._keep(primary, profile)
                touched[primary] = chunk

    def _enter(self, raw: str, chunk: int, touched: dict[str, int]) -> None:
        character = scoped(raw, chunk)
        if not self.known.containsKey((character,)):
            self._keep(character, empty(names=[raw], description=profiles.TEMPORARY))
            touched[character] = chunk

    def close(self) -> None:
        pass


def folded(answers: DataFrame, galleries: DataFrame, patience: float = PATIENCE) -> DataFrame:
    """A row for each profile that a batch changes, with the chunk of its last change, for a stream of ``answers`` (video_id, chunk_index, answer text). galleries: video_id, character_id, tier, not a stream.
    Needs the state store of RocksDB (spark.sql.streaming.stateStore.providerClass). With timers a query has always another batch to run: one that should end once its
    input is read (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled off; its timers then fire with the next input."""
    read = answers.withColumn("answer", V.read_object(F.col("answer")))
    rows = read.select(F.col("video_id").cast("string").alias("video_id"), F.col("chunk_index").cast("int").alias("chunk_index"), *[of(F.col("answer")).alias(c) for c, of in (("named", chunk_answers.unknown_names), ("updates", chunk_answers.updates), ("suggested", chunk_answers.suggested))])
    first = galleries.where("tier <> 'passerby'").groupBy(F.col("video_id").cast("string").alias("video_id")).agg(F.collect_set(F.struct("character_id", "tier")).alias("galleries"))
    return rows.groupBy("video_id").transformWithState(Fold(patience), OUT, "Update", "processingTime", first.groupBy("video_id"))
