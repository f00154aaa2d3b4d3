"""The retrieval funnel: scored hits of five layers, merged, filtered, ranked, blended and put in context.

A hit is a row of query_id, scene_index, score, match_type, snippet, modalities, refs, where its texts stand
(``transcript_at``: the place of its transcript, ``vision_at``: the scene of its description, null where the layer has none
or it is empty) and pos, the place it has among those of its layer and scene. Whole texts are looked up at the end, for what is shown.

Queries are a stated set. They go to the rows in blocks of ``QUERY_BLOCK``, each of which is one pass over the rows: a block's
terms are one automaton that finds all of them in a text at once, a block's vectors are one matrix.

Tables that have a ``video_id`` are a collection: a scene is a scene of its video, a query (which then has a video_id too) searches its own video, and rows of videos that nobody
asks for are left out before anything else, which on a store partitioned by video reads only those asked for. Filters are columns of the queries (character, start_cs and end_cs,
scene_type, each null for none), so that one pass serves queries that look at different stretches. Where only the best scenes are wanted, a task applies the filters and
keeps each query's best, so that no more than tasks x queries x n hits are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from framelode.functions import numbers as N
from framelode.functions import text as T
from framelode.functions.terms import TermTable
from framelode.operators import joins, shared

SNIPPET = 100
#: Fixed values of the layers' scores.
VISION_WEIGHT, EVENT_WEIGHT, EVENT_STEP, EVENT_CAP, INDEX_WEIGHT, INDEX_CAP = 0.8, 0.9, 0.05, 2.0, 0.85, 1.5
RERANK_OLD, RERANK_NEW, RERANK_LEAST, RERANK_REST = 0.3, 0.7, 0.2, 0.3
VECTOR_TOP, CANDIDATES = 50, 20
#: Queries that go out at once, and rows that are compared with them at once.
QUERY_BLOCK, ROW_BLOCK = 4096, 2048
#: Cosines that a task holds at once; with their places, an order of both and copies they take some 50 bytes each.
CELLS = 1 << 20
#: Hits that leave a task at once, or that it holds before it keeps the best, at most.
HITS = 1 << 18
#: Queries of a block, with all those that differ in their filters alone; each block reads all rows, and a query takes some 200 bytes in a task.
MEMBERS = 1 << 20
#: The columns of queries that restrict what they find.
FILTERS = ("character", "start_cs", "end_cs", "scene_type")


def scene_key(rows: DataFrame) -> list[str]:
    return ["video_id", "scene_index"] if "video_id" in rows.columns else ["scene_index"]


def asked_for(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """The ``rows`` of the videos that queries search; all rows where there is one memory only."""
    if "video_id" not in rows.columns or "video_id" not in queries.columns:
        return rows
    return rows.join(joins.small(queries.select("video_id").distinct()), "video_id", "left_semi")


def _blocks(queries: DataFrame, size: Column | None = None) -> Iterator[list]:
    """The rows of the queries, block by block: ``QUERY_BLOCK`` at most, and ``MEMBERS`` by the sum of ``size``. A table of several blocks is evaluated once."""
    first = queries.limit(QUERY_BLOCK + 1).collect() if size is None else []
    if size is None and len(first) <= QUERY_BLOCK:
        yield from [first] if first else []
        return
    queries = shared.written(queries, "queries")
    count, members = queries.agg(F.count("*"), F.sum(F.lit(0) if size is None else size)).first()
    n = max(-(-count // QUERY_BLOCK), -(-(members or 0) // MEMBERS))
    for block in range(n):
        if found := queries.where(F.pmod(F.xxhash64(queries.columns[0]), F.lit(n)) == block).collect():
            yield found


class _Asked:
    """The queries of one video in a block. Those of equal terms are one entry of ``table``, and those of equal filters one pattern: a scene is held against each pattern once, and a text against each entry."""

    def __init__(self, rows: list):
        self.table = TermTable([(n, r.terms) for n, r in enumerate(rows)])
        every = [(n, m) for n, r in enumerate(rows) for m in r.members]
        self.ids = [m.query_id for _, m in every]
        #: By query: its entry and its place.
        self.entry, self.place = np.array([n for n, _ in every], np.int64), {i: p for p, i in enumerate(self.ids)}
        of: dict[tuple, list[tuple[int, int]]] = {}
        for place, (n, m) in enumerate(every):
            of.setdefault(tuple(m[f] if f in m else None for f in FILTERS), []).append((n, place))
        self.character, start, end, kind = (list(c) for c in zip(*of, strict=True))
        self.start = np.array([-np.inf if x is None else x for x in start], float)
        self.end = np.array([np.inf if x is None else x for x in end], float)
        self.kind = [None if k is None else k.lower() for k in kind]
        self.timed = np.array([x is not None or y is not None for x, y in zip(start, end, strict=True)], bool)
        self.told = np.array([c is not None or k is not None for c, k in zip(self.character, self.kind, strict=True)], bool)
        #: By pattern: the entries of its queries, and the queries' places.
        self.members = [(np.array([n for n, _ in own], np.int64), np.array([p for _, p in own], np.int64)) for own in of.values()]

    def allowing(self, start, end, cast, kinds) -> list[int]:
        """The patterns that allow a scene of these times, characters and types (lower-cased, null where it has no view)."""
        good = ~self.timed
        if start is not None and end is not None:
            good = good | ((start >= self.start) & (end <= self.end))
        out = []
        for n in np.flatnonzero(good).tolist():
            who, kind = self.character[n], self.kind[n]
            if not self.told[n] or ((who is None or who in (cast or ())) and (kind is None or any(kind in k for k in kinds or ()))):
                out.append(n)
        return out

    def expanded(self, found: tuple[np.ndarray, ...], patterns: list[int]) -> tuple[np.ndarray, ...]:
        """What was found of a row, entries and more, for the queries of those patterns."""
        at = np.full(len(self.table.ids), -1)
        at[found[0]] = np.arange(len(found[0]))
        places, rows = [], []
        for n in patterns:
            entries, own = self.members[n]
            hit = at[entries]
            places.append(own[hit >= 0])
            rows.append(hit[hit >= 0])
        row = np.concatenate(rows)
        return np.concatenate(places), *(c[row] for c in found[1:])


    def picked(self, found: tuple[np.ndarray, ...], wanted: list) -> tuple[np.ndarray, ...]:
        """What was found of a row, entries and more, for those of the queries ``wanted`` that are of this block."""
        at = np.full(len(self.table.ids), -1)
        at[found[0]] = np.arange(len(found[0]))
        places = np.array([self.place[q] for q in wanted if q in self.place], np.int64)
        row = at[self.entry[places]]
        return places[row >= 0], *(c[row[row >= 0]] for c in found[1:])


#: Columns that rows have where queries have filters, and the column of the queries that a row is read for, where those are known.
_ATTRIBUTES, _WANTED = ("_start", "_end", "_cast", "_kinds"), "_wanted"


class Best(NamedTuple):
    """How many scenes of each query are wanted, and to how many digits scores are compared: as they are without."""

    n: int
    digits: int | None = 9


def _best(query: np.ndarray, scene: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, scene, score) the n best scenes of each query by their best score, ties to the smaller scene."""
    order = np.lexsort((-score, scene, query))
    query, scene, score = query[order], scene[order], score[order]
    first = np.ones(len(query), bool)
    first[1:] = (query[1:] != query[:-1]) | (scene[1:] != scene[:-1])
    query, scene, score = query[first], scene[first], score[first]
    order = np.lexsort((scene, -score, query))
    query, scene, score = query[order], scene[order], score[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    return query[place < n], scene[place < n], score[place < n]


class _Pool:
    """The best scenes of each query of a video that a task has seen. A hit that is no better than the last of a query's n best is not taken in."""

    def __init__(self, queries: int, n: int):
        self.n, self.size = n, min(HITS, 4 * n * queries)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.limit = 0, self.size
        self.worst, self.last = np.full(queries, -np.inf), np.zeros(queries, np.int64)

    def add(self, query: np.ndarray, scene: np.ndarray, score: np.ndarray) -> None:
        worst = self.worst[query]
        good = ~((score < worst) | ((score == worst) & (scene >= self.last[query])))
        self.parts.append((query[good], scene[good], score[good]))
        self.held += int(good.sum())
        if self.held > self.limit:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        found = query, scene, score = _best(*(np.concatenate(c) for c in zip(none, *self.parts, strict=True)), self.n)
        self.parts, self.held, self.limit = [found], len(query), max(self.size, 2 * len(query))
        ends = np.flatnonzero(np.r_[query[1:] != query[:-1], True]) if len(query) else np.zeros(0, int)
        ends = ends[np.diff(np.r_[-1, ends]) == self.n]
        self.worst[query[ends]], self.last[query[ends]] = score[ends], scene[ends]
        return found


def _alike(batch: pa.RecordBatch, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its class, rows that are equal in ``columns`` being one, and a row of each class. With lists each row is its own."""
    every = np.arange(batch.num_rows)
    if any(pa.types.is_nested(batch.column(c).type) for c in columns):
        return every, every
    of = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        code = np.asarray(batch.column(c).dictionary_encode("encode").indices).astype(np.int64)
        of = np.unique(of * (code.max(initial=0) + 1) + code, return_inverse=True)[1]
    return of, np.unique(of, return_index=True)[1]


def _smallest(of: np.ndarray, scene: np.ndarray, n: int) -> np.ndarray:
    """The rows of the n smallest scenes of each class, one row a scene, class by class."""
    order = np.lexsort((scene, of))
    first = np.ones(len(order), bool)
    first[1:] = (of[order][1:] != of[order][:-1]) | (scene[order][1:] != scene[order][:-1])
    order = order[first]
    of = of[order]
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
    return order[np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)])) < n]


def _allowed(asked: _Asked, batch: pa.RecordBatch) -> tuple[np.ndarray, list[list[int]]]:
    """For each row, with ``_ATTRIBUTES``, which of the lists of patterns that follow allow its scene, -1 for none. A scene is looked at once."""
    scene, first = _alike(batch, [c for c in ("video_id", "scene_index") if c in batch.schema.names])
    scenes = batch.select(list(_ATTRIBUTES)).take(pa.array(first))
    number: dict[tuple, int] = {}
    of = [number.setdefault(p, len(number)) if (p := tuple(asked.allowing(*s))) else -1 for s in zip(*(scenes.column(c).to_pylist() for c in _ATTRIBUTES), strict=True)]
    return np.array(of, np.int64)[scene], [list(p) for p in number]


def _scanned(rows: DataFrame, queries: DataFrame, terms: Column | Callable[[Column], Column], texts: list[str], extra: str, step: Callable, best: Best | int | None = None, score: Callable | None = None) -> DataFrame:
    """``rows`` without ``texts`` and with query_id and the long columns of ``extra``, a row for each hit. ``step(table, batch)`` gives for each
    row of the batch the queries that it hits, as an array of their places, and an array of each of ``extra``. Rows with ``_WANTED`` give hits of those queries alone, whose filters have let them pass.

    With ``best``, instead: query_id, the scene's key and ``by``, the score to its digits, of the ``best`` scenes that each task finds for each query among those that its
    filters allow. ``step(table, batch)`` then gives for each row the places of the terms that it holds, one for each time that they count, and ``score(batch, rows of hits, counts, sizes)`` the hits'
    scores. Rows of a batch that are equal but for their scene, and that the same filters allow, have equal scores: they are read once, and of them the ``best`` smallest scenes count."""
    best = Best(best) if isinstance(best, int) else best
    video = "video_id" if "video_id" in rows.columns and "video_id" in queries.columns else None
    key, extra = scene_key(rows) if video else ["scene_index"], extra.split()
    kept = [c for c in rows.columns if c not in texts and c not in _ATTRIBUTES and c != _WANTED]
    picked = _WANTED in rows.columns
    of = [video] if video else []
    asked = queries.select("query_id", *of, *[c for c in FILTERS if c in queries.columns], (terms(F.col("query")) if callable(terms) else terms).alias("terms")).where(F.size("terms") > 0)
    # a text is searched once for all queries of the same terms
    member = F.struct("query_id", *[c for c in FILTERS if c in queries.columns]).alias("member")
    asked = asked.groupBy("terms", *of).agg(F.collect_list(member).alias("members"))
    filtered = _ATTRIBUTES[0] in rows.columns
    if best:
        schema = StructType([*(rows.schema[c] for c in key), queries.schema["query_id"], StructField("by", DoubleType())])
    else:
        schema = StructType([*(rows.schema[c] for c in kept), queries.schema["query_id"], *(StructField(c, LongType()) for c in extra)])
    id_type, names = to_arrow_type(queries.schema["query_id"].dataType), schema.names
    # what scores depend on
    told = [c for c in rows.columns if c not in key and c not in _ATTRIBUTES]

    # the rows of one video, of a batch
    def parts_of(batch: pa.RecordBatch, own: dict) -> Iterator[tuple[object, pa.RecordBatch]]:
        if video is None:
            yield None, batch
            return
        column = batch.column(video)
        for value in column.unique().to_pylist():
            if value in own:
                yield value, batch.filter(pc.equal(column, pa.scalar(value, column.type)))

    def scan(shared_block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[object, _Asked] = shared_block.value
            pools: dict[object, _Pool] = {}
            for whole in batches:
                for value, part in parts_of(whole, own):
                    asked_by, table = own[value], own[value].table
                    every = list(range(len(asked_by.members)))
                    if filtered:  # scenes that no query may find aren't read
                        allowed, patterns = _allowed(asked_by, part)
                        part, allowed = part.filter(pa.array(allowed >= 0)), allowed[allowed >= 0]
                    else:
                        allowed, patterns = np.zeros(part.num_rows, np.int64), [every]
                    if best:
                        if value not in pools:
                            pools[value] = _Pool(len(asked_by.ids), best.n)
                        scenes = np.asarray(part.column("scene_index"))
                        alike, first = _alike(part, told)
                        few = _smallest(alike * len(patterns) + allowed, scenes, best.n)
                        rows_at_once = max(1, HITS // max(1, table.pairs))
                        for at in range(0, len(few), rows_at_once):
                            some = few[at : at + rows_at_once]
                            kinds, kind = np.unique(alike[some], return_inverse=True)
                            counts = table.counted(step(table, part.take(pa.array(first[kinds]))))
                            for n in np.unique(allowed[some]).tolist():
                                mine = np.flatnonzero(allowed[some] == n)
                                for entries, members in (asked_by.members[p] for p in patterns[n]):
                                    cells = counts[kind[mine]][:, entries]
                                    hit, entry = np.nonzero(cells)
                                    row = some[mine[hit]]
                                    by = score(part, row, cells[hit, entry], table.sizes[entries[entry]])
                                    pools[value].add(members[entry], scenes[row], by if best.digits is None else np.round(by, best.digits))
                        continue
                    rows_at_once = max(1, HITS // max(1, len(table.ids)))
                    for at in range(0, part.num_rows, rows_at_once):
                        batch = part.slice(at, rows_at_once)
                        found = step(table, batch)
                        if picked:
                            found = [asked_by.picked(f, w) for f, w in zip(found, batch.column(_WANTED).to_pylist(), strict=True)]
                        else:
                            found = [asked_by.expanded(f, patterns[allowed[at + n]]) for n, f in enumerate(found)]
                        hit = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                        places, *more = (np.concatenate(c) for c in zip(*found, strict=True))
                        shown = batch.select(kept).take(pa.array(hit))
                        yield pa.RecordBatch.from_arrays([*shown.columns, pa.array(asked_by.ids, id_type).take(pa.array(places)), *(pa.array(c.astype(np.int64)) for c in more)], names)
            for value, pool in pools.items():
                places, scenes, by = pool.best()
                columns = [pa.array(scenes, to_arrow_type(schema["scene_index"].dataType)), pa.array(own[value].ids, id_type).take(pa.array(places)), pa.array(by)]
                if video:
                    columns.insert(0, pa.array([value] * len(scenes), to_arrow_type(schema[video].dataType)))
                yield pa.RecordBatch.from_arrays(columns, names)

        return rows.mapInArrow(run, schema)

    # layers that read the same terms of the queries, and both passes over them, share what is sent out
    sent = queries.__dict__.setdefault("_sent", {}).setdefault((terms, video), []) if callable(terms) else []
    if not sent:
        for block in _blocks(asked, F.size("members")):
            by_video: dict[object, list] = {}
            for r in block:
                by_video.setdefault(r[video] if video else None, []).append(r)
            sent.append(rows.sparkSession.sparkContext.broadcast({v: _Asked(own) for v, own in by_video.items()}))
    parts = [scan(block) for block in sent]
    return reduce(DataFrame.union, parts) if parts else rows.sparkSession.createDataFrame([], schema)


def matched(rows: DataFrame, queries: DataFrame, text: str, best: Best | int | None = None, score: Callable = lambda batch, hit, share: share) -> DataFrame:
    """Every row, without its column ``text``, with each query (query_id, query) of which that holds a term: ``share`` of its terms, repeated
    ones each time. With ``best`` the scenes that are best by ``score(batch, rows of hits, shares)``."""

    def step(table: TermTable, batch: pa.RecordBatch) -> Iterator[tuple]:
        for low in batch.column("_low").to_pylist():
            counts = table.counts(table.held(low))
            hit = np.flatnonzero(counts)
            yield hit, counts[hit], table.sizes[hit]

    rows, terms = rows.withColumn("_low", F.lower(text)).drop(text), T.tokens
    if best:
        held = lambda table, batch: map(table.places, batch.column("_low").to_pylist())
        return _scanned(rows, queries, terms, ["_low"], "", held, best, lambda batch, hit, held, size: score(batch, hit, held / size))
    found = _scanned(rows, queries, terms, ["_low"], "_held _size", step)
    return found.withColumn("share", F.col("_held") / F.col("_size")).drop("_held", "_size")


def _hits(rows: DataFrame, kind: str, score: Column, ref: Column, transcript: Column | None = None, vision: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("long")
    return rows.select(
        "query_id", *scene_key(rows), score.alias("score"), F.lit(f"keyword_{kind}").alias("match_type"), F.coalesce("snippet", F.lit("")).alias("snippet"), F.array(F.lit(kind)).alias("modalities"), F.array(ref).alias("refs"),
        (none if transcript is None else transcript).cast("long").alias("transcript_at"), (none if vision is None else vision).cast("long").alias("vision_at"), F.col("pos").cast("long").alias("pos"),
    )


def _kept(rows: DataFrame) -> list[str]:
    """The columns that a layer passes on: the scene's key and what filters ask of it."""
    return [*scene_key(rows), *(c for c in (*_ATTRIBUTES, _WANTED) if c in rows.columns)]


def _snippet(text: Column) -> Column:
    return T.prefix(text, SNIPPET).alias("snippet")


def transcript_hits(transcripts: DataFrame, queries: DataFrame, best: Best | None = None) -> DataFrame:
    """transcripts: scene_index, pos (its place in time), text. ``best``, here and below: only so many scenes of each query and task, with ``by`` in place of all that a hit shows."""
    if best:
        return matched(transcripts.select(*_kept(transcripts), "text"), queries, "text", best)
    found = matched(transcripts.select(*_kept(transcripts), "pos", "text", _snippet(F.col("text"))), queries, "text")
    return _hits(found, "transcript", F.col("share"), F.concat(F.lit("transcripts#t"), F.col("pos")), transcript=F.col("pos"))


def vision_hits(vision: DataFrame, queries: DataFrame, best: Best | None = None) -> DataFrame:
    """vision: scene_index, description, mood, scene_type and, where there are any, objects; all of them are searched."""
    objects = [F.array_join("objects", " ")] if "objects" in vision.columns else []
    every = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (F.col("description"), F.col("mood"), F.col("scene_type"), *objects)))
    if best:
        return matched(vision.select(*_kept(vision), every.alias("every")), queries, "every", best, lambda batch, hit, share: share * VISION_WEIGHT)
    said = F.coalesce(F.col("description") != "", F.lit(False))
    rows = vision.select(*_kept(vision), F.col("scene_index").alias("pos"), F.when(said, F.col("scene_index")).alias("vision_at"), _snippet(F.col("description")), every.alias("every"))
    found = matched(rows, queries, "every")
    return _hits(found, "vision", F.col("share") * VISION_WEIGHT, F.concat(F.lit("vision#scene_"), F.col("scene_index")), vision=F.col("vision_at"))


def event_hits(events: DataFrame, queries: DataFrame, best: Best | None = None) -> DataFrame:
    """events: scene_index (the first of the event's), pos (its number), description, event_type, emotion, importance, which raises the score by
    0.05 a step, to 2.0 at most."""
    every = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("description", "event_type", "emotion")))
    if best:
        of = lambda batch, hit, share: np.minimum(share * EVENT_WEIGHT * (1 + np.asarray(batch.column("importance"))[hit] * EVENT_STEP), EVENT_CAP)
        return matched(events.select(*_kept(events), F.coalesce(F.col("importance").cast("double"), F.lit(0.0)).alias("importance"), every.alias("every")), queries, "every", best, of)
    rows = events.select(*_kept(events), "pos", F.coalesce("importance", F.lit(0)).alias("importance"), _snippet(F.col("description")), every.alias("every"))
    score = F.least(F.col("share") * EVENT_WEIGHT * (1 + F.col("importance") * EVENT_STEP), F.lit(EVENT_CAP))
    return _hits(matched(rows, queries, "every"), "event", score, F.concat(F.lit("events#event_"), F.col("pos")))


def _index_score(matches: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The score of the text index of each pair; there are few different ones."""
    pairs, place = np.unique(np.stack([matches, size], axis=1), axis=0, return_inverse=True)
    each = np.array([round(min(m / (n * 2), INDEX_CAP) * INDEX_WEIGHT, 3) for m, n in pairs.tolist()], float)
    return each[place.ravel()]


def index_hits(index: DataFrame, queries: DataFrame, best: Best | None = None) -> DataFrame:
    """Hits on the text index (scene_index, combined_text, keywords, transcript, vision_description), with ``matches``: keywords shared with the
    query's distinct terms, and those terms that the text holds, each counted. The modalities are those of the two texts that hold a term."""
    texts = {"_low": "combined_text", "_said": "transcript", "_seen": "vision_description"}
    shown = F.coalesce(F.nullif(F.col("vision_description"), F.lit("")), F.col("transcript"), F.lit(""))
    rows = index.select(*_kept(index), _snippet(shown), F.col("keywords").alias("_keywords"), *(F.lower(c).alias(a) for a, c in texts.items()))

    def counted(table: TermTable, low: str | None, keywords: list | None) -> np.ndarray:
        return table.counts(table.held(low)) + table.counts(set(keywords or ()))

    def step(table: TermTable, batch: pa.RecordBatch) -> Iterator[tuple]:
        columns = (batch.column(c).to_pylist() for c in ("_low", "_said", "_seen", "_keywords"))
        for low, said, seen, keywords in zip(*columns, strict=True):
            counts = counted(table, low, keywords)
            hit = np.flatnonzero(counts)
            in_said, in_seen = (table.counts(table.held(text))[hit] > 0 for text in ((said, seen) if len(hit) else (None, None)))
            yield hit, counts[hit], table.sizes[hit], in_said, in_seen

    def brief(table: TermTable, batch: pa.RecordBatch) -> Iterator[list[int]]:
        for low, keywords in zip(batch.column("_low").to_pylist(), batch.column("_keywords").to_pylist(), strict=True):
            yield [*table.places(low), *(table.at[k] for k in set(keywords or ()) if k in table.at)]

    if best:
        few = rows.drop("snippet", "_said", "_seen")
        return _scanned(few, queries, T.query_terms, ["_low", "_keywords"], "", brief, best, lambda batch, hit, matches, size: _index_score(matches, size))
    found = _scanned(rows, queries, T.query_terms, [*texts, "_keywords"], "matches size said seen", step)
    either = F.array_compact(F.array(F.when(F.col("said") > 0, "transcript"), F.when(F.col("seen") > 0, "vision")))
    found = found.withColumn("modalities", F.when(F.size(either) > 0, either).otherwise(F.array(F.lit("index"))))
    score = N.half_even(F.least(F.col("matches") / (F.col("size") * 2), F.lit(INDEX_CAP)) * INDEX_WEIGHT, 3)
    none = F.lit(None).cast("long")
    return found.select(
        "query_id", *scene_key(found), score.alias("score"), F.lit("index").alias("match_type"), "snippet", "modalities", F.array(F.concat(F.lit("search_index#scene_"), F.col("scene_index").cast("string"))).alias("refs"),
        none.alias("transcript_at"), none.alias("vision_at"), F.lit(0).cast("long").alias("pos"), "matches",
    )


def vector_hits(units: DataFrame, queries: DataFrame, n: int = VECTOR_TOP) -> DataFrame:
    """query_id, scene_index, score and rank: the n units (scene_index, embedding) of the largest cosine, to nine digits, for each query vector
    (query_id, embedding), ties to the smaller scene_index. Null vectors and those of another length take no part; zero vectors have cosine 0.
    A task keeps the n best of what it has seen. Of a collection those of the query's video."""
    video = ["video_id"] if "video_id" in units.columns and "video_id" in queries.columns else []
    rows = asked_for(units, queries).select(*video, F.col("scene_index").cast("long").alias("scene_index"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null and scene_index is not null")
    asked = queries.select("query_id", *video, F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    schema = StructType([*(units.schema[c] for c in video), queries.schema["query_id"], StructField("scene_index", LongType()), StructField("score", DoubleType())])
    id_type, names = to_arrow_type(queries.schema["query_id"].dataType), schema.names

    def units_of(vectors: list) -> np.ndarray:
        out = np.array(vectors, float)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)

    def scan(own: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # by video and length of vector: ids of queries, their vectors, the best scenes and scores so far
            held = {k: [ids, wanted, np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))] for k, (ids, wanted) in own.value.items()}
            step = max(min(ROW_BLOCK, CELLS // max([len(ids) for ids, _ in own.value.values()], default=1)), 1)
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    sizes = np.asarray(batch.column("embedding").value_lengths())
                    videos = batch.column("video_id") if video else None
                    for value in videos.unique().to_pylist() if video else [None]:
                        of_video = np.ones(len(batch), bool) if videos is None else np.asarray(pc.equal(videos, pa.scalar(value, videos.type)))
                        for size in np.unique(sizes[of_video]).tolist():
                            if (value, size) not in held:
                                continue
                            part = batch.filter(pa.array(of_video & (sizes == size)))
                            ids, wanted, scenes, scores = held[value, size]
                            vectors = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                            scores = np.concatenate([scores, np.round(wanted @ units_of(vectors).T, 9)], axis=1)
                            scenes = np.concatenate([scenes, np.broadcast_to(np.asarray(part.column("scene_index")), (len(ids), len(part)))], axis=1)
                            order = np.lexsort((scenes, -scores), axis=1)[:, :n]
                            held[value, size][2:] = np.take_along_axis(scenes, order, axis=1), np.take_along_axis(scores, order, axis=1)
            for (value, _), (ids, _, scenes, scores) in held.items():
                if scenes.size:
                    columns = [pa.array([i for i in ids for _ in range(scenes.shape[1])], id_type), pa.array(scenes.ravel()), pa.array(scores.ravel())]
                    yield pa.RecordBatch.from_arrays([*([pa.array([value] * scenes.size, to_arrow_type(schema["video_id"].dataType))] if video else []), *columns], names)

        return rows.mapInArrow(run, schema)

    parts = []
    for block in _blocks(asked):
        of: dict[tuple, list] = {}
        for r in block:
            of.setdefault((r.video_id if video else None, len(r.embedding)), []).append(r)
        parts.append(scan(rows.sparkSession.sparkContext.broadcast({k: ([r.query_id for r in own], units_of([r.embedding for r in own])) for k, own in of.items()})))
    found = reduce(DataFrame.union, parts) if parts else rows.sparkSession.createDataFrame([], schema)
    return top(found, n)


def as_hits(found: DataFrame) -> DataFrame:
    """Ranked units of ``vector_hits`` as hits."""
    none = F.lit(None).cast("long")
    return found.select(
        "query_id", *scene_key(found), "score", F.lit("embedding").alias("match_type"), F.lit("").alias("snippet"), F.array(F.lit("embedding")).alias("modalities"), F.array(F.concat(F.lit("vectors#"), F.col("scene_index"))).alias("refs"),
        none.alias("transcript_at"), none.alias("vision_at"), F.col("rank").cast("long").alias("pos"),
    )


def top(rows: DataFrame, n: int, by: str = "score") -> DataFrame:
    """The n best of each query, ties to the smaller scene_index, with their ``rank`` from 1. Tasks keep n before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "scene_index")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def merged(layers: list[DataFrame]) -> DataFrame:
    """The layers' hits in the order in which they report, one after another: ``ord`` is (layer, scene, place)."""
    return reduce(DataFrame.unionByName, [rows.withColumn("ord", F.struct(F.lit(n).alias("layer"), F.col("scene_index").alias("scene"), F.col("pos").cast("long").alias("pos"))).drop("pos") for n, rows in enumerate(layers)])


def deduplicated(hits: DataFrame) -> DataFrame:
    """One row for each query and scene. The best score stands, an equal later one doesn't replace it; a better hit without a snippet
    keeps the one before; modalities and refs are united in order of appearance; the first texts that are not empty stay."""
    key = ["query_id", *scene_key(hits)]
    before = Window.partitionBy(*key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = hits.withColumn("record", F.coalesce(F.col("score") > F.max("score").over(before), F.lit(True)))

    def united(column: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", column))), lambda x: x[column])))

    def first_place(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("ord")))

    shown = F.when(F.col("record") & (F.col("snippet") != ""), F.col("ord"))
    return rows.groupBy(*key).agg(
        F.max("score").alias("score"), F.max_by("match_type", F.when(F.col("record"), F.col("ord"))).alias("match_type"), F.coalesce(F.max_by("snippet", shown), F.lit("")).alias("snippet"),
        united("modalities").alias("modalities"), united("refs").alias("refs"), first_place("transcript_at").alias("transcript_at"), first_place("vision_at").alias("vision_at"),
    )


def of_character(hits: DataFrame, appearances: DataFrame, character) -> DataFrame:
    """Hits in scenes where the character is; all hits if nobody knows that character."""
    own = appearances.where(F.col("character") == F.lit(character)).select(F.col("shot").alias("scene_index")).distinct()
    return hits if own.isEmpty() else hits.join(own, "scene_index", "left_semi")


def within_time(hits: DataFrame, shots: DataFrame, start, end) -> DataFrame:
    """Hits whose scene lies within the range, both ends included."""
    own = shots.where((F.col("start_cs") >= start) & (F.col("end_cs") <= end)).select("scene_index").distinct()
    return hits.join(own, "scene_index", "left_semi")


def of_scene_type(hits: DataFrame, scenes: DataFrame, kind: str) -> DataFrame:
    own = scenes.where(F.contains(F.lower("scene_type"), F.lit(kind.lower()))).select("scene_index").distinct()
    return hits.join(own, "scene_index", "left_semi")


def with_context(hits: DataFrame, units: DataFrame, size: int = SNIPPET) -> DataFrame:
    """``context_before`` and ``context_after``: what stands in the neighbours in order of (video_id, scene_index), which for sparse
    numbers are the nearest ones rather than those one apart."""
    order = Window.partitionBy("video_id").orderBy("scene_index")
    around = units.select("video_id", "scene_index", T.prefix(F.lag("combined_text").over(order), size).alias("context_before"), T.prefix(F.lead("combined_text").over(order), size).alias("context_after"))
    return hits.join(around, ["video_id", "scene_index"], "left")


def reranked(candidates: DataFrame, answers: DataFrame, least: int = 4) -> DataFrame:
    """Candidates (query_id, index from 0, score) blended with a model's answers (query_id, index, relevance, pos): 0.3 of the old and 0.7
    of the new score, to three digits, if that is over 0.2, else 0.3 of the old. Of repeated answers the first counts. Queries with fewer than
    ``least`` candidates, or none answered, stay as they are."""
    first = joins.keep(answers.where(F.col("relevance") > RERANK_LEAST), ["query_id", "index"], ["pos"], last=False).select("query_id", "index", "relevance")
    of_query = Window.partitionBy("query_id")
    answered = answers.select("query_id").distinct().withColumn("_answered", F.lit(True))
    rows = candidates.join(first, ["query_id", "index"], "left").join(answered, "query_id", "left").withColumn("_n", F.count("*").over(of_query))
    blend = F.when(F.col("relevance").isNotNull(), N.half_even(F.col("score") * RERANK_OLD + F.col("relevance") * RERANK_NEW, 3)).otherwise(F.col("score") * RERANK_REST)
    stays = F.col("_answered").isNull() | (F.col("_n") < least)
    return rows.withColumn("semantic", ~stays & F.col("relevance").isNotNull()).withColumn("score", F.when(stays, F.col("score")).otherwise(blend)).drop("_n", "_answered", "relevance")


def looked_up(hits: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """``hits``, a written table of few rows, with the columns of ``table`` for their keys, null where it has none: the table is reduced to the keys
    of the hits before they are joined."""
    return hits.join(table.join(joins.small(hits.select(*key).distinct()), key, "left_semi"), key, "left")


Layer = Callable[[dict[str, DataFrame], "Best | None"], list[DataFrame]]


def _compared(digits: int | None) -> Column:
    return F.col("score") if digits is None else F.round("score", digits)


def best_scenes(layers: Layer, tables: dict[str, DataFrame], n: int, more: DataFrame | None = None, digits: int | None = 9, plain: dict[str, DataFrame] | None = None) -> DataFrame:
    """The n best scenes of each query among the hits of ``layers(tables, best)`` and of ``more``, deduplicated, with their rank. Scores alone, to ``digits`` digits or as they are, decide which these
    are, and a task passes on its n best; only the rows of those scenes are then searched again, each for the queries that it is among the best of, for all that a hit shows. plain: the tables as they are without what filters need."""
    found = layers(tables, Best(n, digits))
    if more is not None:
        found = [*found, more.select(*scene_key(more), "query_id", _compared(digits).alias("by"))]
    key = scene_key(found[0])
    scores = reduce(DataFrame.unionByName, found).groupBy("query_id", *key).agg(F.max("by").alias("by"))
    best = shared.written(top(scores, n, "by").select("query_id", *key, "rank"), "scenes")
    scenes = joins.small(shared.written(best.groupBy(*key).agg(F.collect_list("query_id").alias(_WANTED)), "wanted"))
    narrow = {name: rows.join(scenes, key) for name, rows in (plain or tables).items()}
    every = layers(narrow, None)
    hits = merged(every if more is None else [more, *every]).join(joins.small(best.select("query_id", *key)), ["query_id", *key], "left_semi")
    return deduplicated(hits).join(joins.small(best), ["query_id", *key])


def attributes(memory: dict[str, DataFrame], queries: DataFrame) -> DataFrame | None:
    """What the filters of the queries ask of scenes: each scene's times, characters (of those that are asked for) and lower-cased types, null where it has no shot, none of them or no view. None without
    filters."""
    asked = [f for f in FILTERS if f in queries.columns]
    if not asked:
        return None
    key = scene_key(memory["shots"])
    times = asked_for(memory["shots"], queries).groupBy(*key).agg(F.min("start_cs").alias("_start"), F.max("end_cs").alias("_end"))
    place = [c for c in key if c != "scene_index"]
    own = [*joins.place(memory["appearances"], queries), "character"]
    # before they are dealt to their scenes, appearances are those of the characters asked for
    wanted = queries.select(*own).distinct() if "character" in asked else memory["appearances"].select(*own).limit(0)
    who = memory["appearances"].join(joins.small(wanted), own, "left_semi").select(*place, F.col("shot").alias("scene_index"), "character").groupBy(*key).agg(F.collect_set("character").alias("_cast"))
    kinds = asked_for(memory["vision"], queries).groupBy(*key).agg(F.collect_set(F.lower("scene_type")).alias("_kinds"))
    return times.join(who, key, "full").join(kinds, key, "full")


def known_filters(queries: DataFrame, appearances: DataFrame) -> DataFrame:
    """``queries`` without the characters whom nobody knows: those restrict nothing."""
    if "character" not in queries.columns:
        return queries
    scope = ["video_id"] if "video_id" in queries.columns and "video_id" in appearances.columns else []
    known = appearances.join(joins.small(queries.select(*scope, "character").distinct()), [*scope, "character"], "left_semi").select(*scope, "character").distinct().withColumn("_known", F.lit(True))
    return queries.join(known, [*scope, "character"], "left").withColumn("character", F.when(F.col("_known"), F.col("character"))).drop("_known")


def permitted(hits: DataFrame, queries: DataFrame, scenes: DataFrame | None, on: str = "query_id") -> DataFrame:
    """``hits``, few of them, that the filters of their queries allow, with the query_id of each query of the same ``on``; scenes: ``attributes``."""
    columns = [c for c in hits.columns if c != on]
    if scenes is None:
        return hits.join(joins.small(queries.select(*dict.fromkeys((on, "query_id")))), on).select("query_id", *[c for c in columns if c != "query_id"])
    asked = [f for f in FILTERS if f in queries.columns]
    rows = hits.join(scenes, scene_key(hits), "left").join(joins.small(queries.select(*dict.fromkeys((on, "query_id")), *[F.col(f).alias(f"_q_{f}") for f in asked])), on)
    c = F.col
    good = {
        "start_cs": c("_q_start_cs").isNull() | (c("_start") >= c("_q_start_cs")), "end_cs": c("_q_end_cs").isNull() | (c("_end") <= c("_q_end_cs")),
        "character": c("_q_character").isNull() | F.array_contains("_cast", c("_q_character")), "scene_type": c("_q_scene_type").isNull() | F.exists("_kinds", lambda k: F.contains(k, F.lower("_q_scene_type"))),
    }
    return rows.where(reduce(lambda a, b: a & b, [F.coalesce(good[f], F.lit(False)) for f in asked])).select("query_id", *columns)


def search_memory(
    memory: dict[str, DataFrame], queries: DataFrame, top_k: int = 10, character=None, time_range: tuple | None = None, scene_type: str | None = None, answers: DataFrame | Callable[[DataFrame], DataFrame] | None = None, digits: int | None = None
) -> DataFrame:
    """The whole funnel for queries (query_id, query, embedding) over one memory, or over a collection if its tables and the queries have ``video_id``.

    ``memory``: units (scene_index, combined_text, transcript, vision, embedding), transcripts, vision, events and index as their layers
    read them, shots (scene_index, start_cs, end_cs) and appearances (character, shot). The five layers are merged and filtered by the queries' own columns ``FILTERS`` (or by character,
    time_range and scene_type, which stand for all queries), hits of one scene become one, the 20 best are reranked by ``answers`` (query_id, index, relevance, pos; or a function from
    candidates to them) where there are more than three, and the ``top_k`` best are put in context. Ties go to the smaller scene, after the reranking to the better rank before;
    scores are compared as they are, or to ``digits`` digits.

    Returns query_id, rank, scene_index, score, match_type, snippet, modalities (with "semantic" for reranked ones), refs, transcript, vision,
    start_cs, end_cs, combined_text, context_before and context_after."""
    for name, given in (("character", character), ("start_cs", time_range and time_range[0]), ("end_cs", time_range and time_range[1]), ("scene_type", scene_type)):
        if given is not None:
            queries = queries.withColumn(name, F.lit(given))
    queries = shared.written(known_filters(queries, memory["appearances"]), "queries")
    scenes = attributes(memory, queries)
    scenes = None if scenes is None else shared.written(scenes, "attributes")
    # a vector is searched once for all queries that have it
    first = queries.where("embedding is not null").groupBy("embedding", *joins.place(memory["units"], queries)).agg(F.min("query_id").alias("_first"))
    first = shared.written(first, "vectors")
    found = as_hits(vector_hits(memory["units"], first.withColumnRenamed("_first", "query_id"))).withColumnRenamed("query_id", "_first")
    members = queries.join(first, [c for c in first.columns if c != "_first"]).select("_first", "query_id", *[f for f in FILTERS if f in queries.columns])
    near = shared.written(permitted(found, members, scenes, "_first"), "near")

    def layers(rows: dict[str, DataFrame], best: Best | None) -> list[DataFrame]:
        found = [of(rows[name], queries, best) for name, of in (("transcripts", transcript_hits), ("vision", vision_hits), ("events", event_hits), ("index", index_hits))]
        return found if best else [*found[:3], found[3].drop("matches")]

    texts = plain = {name: asked_for(memory[name], queries) for name in ("transcripts", "vision", "events", "index")}
    if scenes is not None:
        own = joins.small(scenes)
        texts = {name: rows.join(own, scene_key(rows), "left") for name, rows in texts.items()}
    found = best_scenes(layers, texts, CANDIDATES, near, digits, plain)
    key = scene_key(found)
    found = shared.written(found.withColumn("index", F.col("rank") - 1).drop("rank"), "candidates")
    if answers is not None:
        given = answers(looked_up(found, memory["units"].select(*key, "combined_text"), key)) if callable(answers) else answers
        found = reranked(found, given)
        semantic = F.when(F.col("semantic"), F.array(F.lit("semantic"))).otherwise(F.array().cast("array<string>"))
        found = found.withColumn("modalities", F.array_distinct(F.concat("modalities", semantic))).drop("semantic")
    order = Window.partitionBy("query_id").orderBy(_compared(digits).desc(), "index")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).drop("index")
    return enriched(shared.written(found, "found"), memory)


def enriched(found: DataFrame, memory: dict[str, DataFrame]) -> DataFrame:
    """``found``, a written table of hits, with their texts, their shot and what stands in the shots numbered one before and one after. A hit without
    a transcript gets its unit's, else its scene's lines; one without a description its unit's, else the scene's own."""
    key = scene_key(found)
    # the scenes that are shown, counted once: every table is reduced to them before it is joined
    wanted = joins.small(shared.written(found.select(*key).distinct(), "wanted"))
    of = lambda table: table.join(wanted, key, "left_semi")
    lines = of(memory["transcripts"])
    views = of(memory["vision"]).groupBy(*key).agg(F.first("description").alias("_view"))
    own = lines.select(*key, F.col("pos").cast("long").alias("transcript_at"), F.col("text").alias("_line"))
    rows = found.join(own.dropDuplicates([*key, "transcript_at"]), [*key, "transcript_at"], "left")
    in_shot = lines.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("_lines"))
    units = of(memory["units"]).select(*key, "combined_text", F.col("transcript").alias("_unit_line"), F.col("vision").alias("_unit_view"))
    for table in (in_shot, units, views, of(memory["shots"]).select(*key, "start_cs", "end_cs")):
        rows = rows.join(table, key, "left")
    # the neighbours of the scenes that are shown, at once
    around = wanted.select(*key).union(wanted.withColumn("scene_index", F.col("scene_index") - 1).select(*key)).union(wanted.withColumn("scene_index", F.col("scene_index") + 1).select(*key)).distinct()
    near = memory["units"].join(joins.small(around, 3 * joins.BROADCAST_ROWS), key, "left_semi").select(*key, T.prefix(F.col("combined_text"), SNIPPET).alias("text")).join(memory["shots"].select(*key).distinct(), key, "left_semi")
    near = shared.written(near, "around")
    for name, step in (("context_before", 1), ("context_after", -1)):
        rows = rows.join(near.select(*[c for c in key if c != "scene_index"], (F.col("scene_index") + step).alias("scene_index"), F.nullif(F.col("text"), F.lit("")).alias(name)), key, "left")
    filled = lambda *columns: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))
    has_shot = F.col("start_cs").isNotNull()
    return rows.select(
        "query_id", "rank", *key, "score", "match_type", "snippet", "modalities", "refs", filled("_line", "_unit_line", "_lines").alias("transcript"),
        F.when(F.col("vision_at").isNotNull(), F.col("_view")).otherwise(filled("_unit_view", "_view")).alias("vision"), "start_cs", "end_cs", "combined_text",
        F.when(has_shot, F.col("context_before")).alias("context_before"), F.when(has_shot, F.col("context_after")).alias("context_after"),
    )
