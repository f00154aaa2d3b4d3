"""Streams of shots and of character updates, with the state that the batch operators fold.

Both give, after all input, what the batch forms give over the same rows, as long as each video's rows arrive in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHUNK = "video_id long, chunk_index long, first_scene long, n_shots long, start_cs long, end_cs long, duration_cs long"


def closed_chunks(shots: DataFrame, target: int = 15_000, least: int = 0) -> DataFrame:
    """The greedy chunks (see the batch form) of a stream of shots. A row without scene_index is a video's end: what is left then is its last
    chunk, or joins the one before if it is shorter than ``least``. Without a ``least`` a chunk leaves as soon as it holds ``target``, with one as soon as the next does,
    as it may still take in a rest. A video without an end keeps its rest in the state. Rows behind the end are dropped."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # the open chunk: index, first, n, start, end, held; and one that is full but may still grow
        now, full = (list(state.get[:6]), list(state.get[6:])) if state.exists else ([0, -1, 0, 0, 0, 0], [0, -1, 0, 0, 0, 0])
        out: list[tuple] = []

        def leave(chunk: list) -> None:
            if chunk[2]:
                out.append((key[0], *chunk))

        rows = pd.concat(list(parts)).sort_values("scene_index")
        for row in rows.itertuples(index=False):
            if now[0] < 0:
                break
            if pd.isna(row.scene_index):
                if now[2] and full[2] and now[5] < least:
                    full = [*full[:2], full[2] + now[2], full[3], now[4], now[4] - full[3]]
                    now[2] = 0
                leave(full)
                leave(now)
                now, full = [-1, -1, 0, 0, 0, 0], [0, -1, 0, 0, 0, 0]
                break
            if not now[2]:
                now[1], now[3], now[5] = row.scene_index, row.start_cs, 0
            now[2], now[4], now[5] = now[2] + 1, row.end_cs, now[5] + row.dur_cs
            if now[5] >= target:
                leave(full)
                full = list(now)
                now = [now[0] + 1, -1, 0, 0, 0, 0]
                if not least:
                    leave(full)
                    full[2] = 0
        state.update(tuple(int(x) for x in [*now, *full]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK.split(", ")])

    rows = shots.select("video_id", "scene_index", "start_cs", "end_cs", "dur_cs")
    held = ", ".join(f"{kind}{c} long" for kind in ("now_", "full_") for c in ("index", "first", "n", "start", "end", "held"))
    return rows.groupBy("video_id").applyInPandasWithState(step, CHUNK, held, "append", GroupStateTimeout.NoTimeout)


def running_profiles(updates: DataFrame) -> DataFrame:
    """character, names and n_updates so far, for a stream of (character, chunk, name): a row for each character that a batch touches."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, count = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for part in parts:
            for name in part.sort_values("chunk")["name"]:
                count += 1
                if name and name not in names:
                    names.append(name)
        state.update((names, int(count)))
        yield pd.DataFrame({"character": [key[0]], "names": [names], "n_updates": [count]})

    return updates.select("character", "chunk", "name").groupBy("character").applyInPandasWithState(step, "character long, names array<string>, n_updates long", "names array<string>, n long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of each event type in tumbling windows of event time; rows later than ``late`` are dropped. Times without a zone are taken as UTC."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
