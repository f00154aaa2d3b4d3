"""Clustering of embedded faces: density clusters, splits, constrained merges, tiers and representatives.

The greedy steps depend on order. They run over one video's clusters or one cluster's faces at a time, which is what they are
defined on; the joins that find candidates for them are distributed.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions import vector as V
from framelode.operators import entity, joins, shared

#: Fixed values of the rules.
EPS, LEAST_POINTS, SPLIT_EPS, MOST_RADIUS = 0.42, 3, 0.30, 0.34
CENTROID_ALONE, LINK, CENTROID_WITH_LINK, STRONG, CENTROID_WITH_STRONG = 0.86, 0.78, 0.62, 0.82, 0.50
PASSERBY = 3
LEAST_DET, SIDE_YAW, SIDE_OFFSET = 0.65, 35.0, 0.35
SLACK = 1e-9
#: Faces of a block of the all-pairs comparison: ``BLOCK`` until a video has ``FEW`` blocks, then more, ``MOST`` at most, as each face is sent to as many tasks as there are blocks.
BLOCK, FEW, MOST = 1024, 8, 65_536
#: Similarities that a task holds at once, those of single precision that it looks through at once, few enough to stay in a cache, and how far these may be off.
AT_ONCE, TILE, ROUGH = 1 << 23, 1 << 20, 1e-5
#: Pairs of faces that a task gathers at once where it compares few faces of very many clusters.
PAIRS = 1 << 16


def _blocks(faces: Column) -> Column:
    """The number of blocks for so many faces of a video."""
    least = lambda size: F.ceil(faces / size).cast("int")
    return F.greatest(F.least(least(BLOCK), F.lit(FEW)), least(MOST))


def _block_pairs(faces: DataFrame, columns: list[str], step: Callable, schema: str, scope: str | None = None) -> DataFrame:
    """What ``step(rows of block i, rows of block j, their unit vectors, those of j, whether i = j)`` yields for every pair of blocks i <= j of the faces of one ``scope``, that is of one video (all
    faces are of one without it), each in a task of its own: all pairs of a video's faces meet, and no task holds more than two blocks and ``AT_ONCE`` similarities."""
    rows = faces.select("face_id", "embedding", (F.lit(0) if scope is None else F.col(scope)).alias("_scope"), *columns)
    sizes = rows.groupBy("_scope").agg(_blocks(F.count("*")).alias("_n"))
    own = F.pmod(F.xxhash64("face_id"), F.col("_n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda b: F.struct(F.least(own, b).alias("i"), F.greatest(own, b).alias("j")))
    dealt = rows.join(sizes, "_scope").withColumn("own", own).withColumn("_at", F.explode(pairs)).select("*", "_at.i", "_at.j").drop("_at", "_n")

    return _compared(dealt, step, schema)


def _compared(dealt: DataFrame, step: Callable, schema: str) -> DataFrame:
    """What ``step`` yields for each two blocks (_scope, i, j) of ``dealt``, whose rows tell which of both they are of (``own``)."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        rows = rows.take(np.argsort(np.asarray(rows["face_id"]), kind="stable"))
        flat = np.asarray(rows["embedding"].combine_chunks().flatten(), float)
        block, unit = rows.drop_columns(["embedding"]).to_pandas(), flat.reshape(len(rows), -1)
        size = np.linalg.norm(unit, axis=1, keepdims=True)
        unit = np.divide(unit, size, out=np.zeros_like(unit), where=size > 0)
        i, j = key[1].as_py(), key[2].as_py()
        left, right = (block["own"] == i).to_numpy(), (block["own"] == j).to_numpy()
        for found in step(block[left], block[right], unit[left], unit[right], i == j):
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    # a number of partitions that is asked for isn't lowered for small data: the work is in the comparison
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "_scope", "i", "j").groupBy("_scope", "i", "j").applyInArrow(run, schema)


def _near(left: np.ndarray, right: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``left`` and ``right`` of the unit vectors whose cosine distance is eps or less, and their similarity: those that single precision can't tell apart from others are few, and counted in double."""
    least, rough = 1 - eps - SLACK, ROUGH * max(1.0, left.shape[1] / 64)
    single = left.astype(np.float32), right.astype(np.float32)
    at_once = max(1, TILE // max(1, len(right)))
    held = np.empty((at_once, len(right)), np.float32)
    found, n = [], 0
    for at in range(0, len(left), at_once):
        some = single[0][at : at + at_once]
        found.append(np.flatnonzero(np.matmul(some, single[1].T, out=held[: len(some)]) >= least - rough) + at * len(right))
        n += len(found[-1])
        if n < 1 << 16 and at + at_once < len(left):
            continue
        places, found, n = np.concatenate(found), [], 0
        for begin in range(0, len(places), 1 << 16):
            i, j = np.divmod(places[begin : begin + (1 << 16)], max(1, len(right)))
            similar = np.einsum("ij,ij->i", left[i], right[j])
            good = similar >= least
            yield i[good], j[good], similar[good]


def _similar_pairs(faces: DataFrame, eps: float, scope: str | None) -> DataFrame:
    """(a, b, similar), both ways and each face with itself, of faces (face_id, embedding) of one video, ``scope``, whose cosine distance is eps or less."""

    def step(left: pd.DataFrame, right: pd.DataFrame, own: np.ndarray, other: np.ndarray, same: bool) -> Iterator[pd.DataFrame]:
        names = left["face_id"].to_numpy(), right["face_id"].to_numpy()
        for x, y, similar in _near(own, other, eps):
            a, b = names[0][x], names[1][y]
            yield pd.DataFrame({"a": a, "b": b, "similar": similar})
            if not same:
                yield pd.DataFrame({"a": b, "b": a, "similar": similar})

    return _block_pairs(faces, [], step, "a long, b long, similar double", scope)


def near_pairs(faces: DataFrame, eps: float, scope: str | None = None) -> DataFrame:
    """(a, b), both ways and each face with itself, of faces (face_id, embedding) of one video, ``scope``, whose cosine distance is eps or less."""
    return _similar_pairs(faces, eps, scope).select("a", "b")


def core_points(faces: DataFrame, eps: float = EPS, least: int = LEAST_POINTS, scope: str | None = None) -> DataFrame:
    """Faces with ``least`` faces or more, themselves included, within eps. A task counts: no pair leaves it."""

    def step(left: pd.DataFrame, right: pd.DataFrame, own: np.ndarray, other: np.ndarray, same: bool) -> Iterator[pd.DataFrame]:
        counts = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        for x, y, _ in _near(own, other, eps):
            counts[0][:] += np.bincount(x, minlength=len(left))
            counts[1][:] += np.bincount(y, minlength=len(right))
        yield pd.DataFrame({"face_id": left["face_id"], "n": counts[0]})
        if not same:
            yield pd.DataFrame({"face_id": right["face_id"], "n": counts[1]})

    return _block_pairs(faces, [], step, "face_id long, n long", scope).groupBy("face_id").agg(F.sum("n").alias("n_near")).where(F.col("n_near") >= least)


def _kept(df: DataFrame) -> DataFrame:
    """A step of a loop, in the shared folder."""
    return shared.written(df, "cluster")


def _distinct(faces: DataFrame, scope: str | None) -> tuple[DataFrame, DataFrame | None]:
    """The faces without those whose vector a smaller one of their ``scope`` has, with ``n``, how many have it, and (face_id, first) for those left out, None if there are none."""
    c = F.col
    key = ["_scope", "_hash", "embedding"]
    rows = faces.select("face_id", "embedding", (F.lit(0) if scope is None else c(scope)).alias("_scope"), F.xxhash64("embedding").alias("_hash"))
    several = _kept(rows.groupBy("_scope", "_hash").count().where("count > 1").drop("count"))
    if several.isEmpty():
        return faces.withColumn("n", F.lit(1)), None
    rows = rows.join(joins.small(several), ["_scope", "_hash"])
    several = _kept(rows.groupBy(*key).agg(F.min("face_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    others = _kept(rows.join(joins.small(several.select(*key, "first")), key).where("face_id <> first").select("face_id", "first"))
    kept = faces.join(joins.small(others.select("face_id")), "face_id", "left_anti").join(joins.small(several.select(c("first").alias("face_id"), c("n").cast("int").alias("n"))), "face_id", "left")
    return kept.withColumn("n", F.coalesce("n", F.lit(1))), others


def _smallest_reached(edges: DataFrame) -> DataFrame:
    """(id, canonical): for the faces of ``edges`` (a, b; a < b) the smallest one they reach. In a round faces follow their smallest smaller neighbour to its end, then the edges between those ends are left: half as many ends at most."""
    names = None
    while not edges.isEmpty():
        ends = _kept(entity.canonical(edges.select(F.col("b").alias("merged"), F.col("a").alias("kept"))))
        onward = ends.withColumnsRenamed({"id": "_id", "canonical": "_end"})
        told = ends if names is None else names.join(onward, F.col("canonical") == F.col("_id"), "left").select("id", F.coalesce("_end", "canonical").alias("canonical")).union(ends.join(names, "id", "left_anti"))
        moved = edges
        for side in ("a", "b"):
            moved = moved.join(onward, F.col(side) == F.col("_id"), "left").withColumn(side, F.coalesce("_end", side)).drop("_id", "_end")
        left = _kept(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        last, names = names, _kept(told)
        shared.dropped(edges.sparkSession, edges, ends, *([] if last is None else [last]))
        edges = left
    return edges.select(F.col("a").alias("id"), F.col("b").alias("canonical")) if names is None else names


def density_labels(faces: DataFrame, eps: float = EPS, least: int = LEAST_POINTS, scope: str | None = None) -> DataFrame:
    """face_id and label: the smallest core face that its core reaches; a border face joins the smallest label of its cores; -1 for noise. Faces of one vector are compared once, and a pair is written once."""
    c = F.col
    own, others = _distinct(faces, scope)

    def step(left: pd.DataFrame, right: pd.DataFrame, own: np.ndarray, other: np.ndarray, same: bool) -> Iterator[pd.DataFrame]:
        names, n = (left["face_id"].to_numpy(), right["face_id"].to_numpy()), (left["n"].to_numpy(), right["n"].to_numpy())
        for x, y, _ in _near(own, other, eps):
            a, b = names[0][x], names[1][y]
            once = a <= b if same else slice(None)
            found = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "n_a": np.where(a <= b, n[0][x], n[1][y]), "n_b": np.where(a <= b, n[1][y], n[0][x])})
            yield found[once]

    near = _kept(_block_pairs(own, ["n"], step, "a long, b long, n_a int, n_b int", scope))
    around = near.select(c("a").alias("core"), "n_b").union(near.where("a <> b").select("b", "n_a"))
    cores = _kept(around.groupBy("core").agg(F.sum("n_b").alias("n")).where(c("n") >= least).select("core"))
    is_core = joins.small(cores.withColumn("_is", F.lit(True)))
    links = near.where("a <> b").select("a", "b")
    for side in ("a", "b"):
        links = links.join(is_core.withColumnsRenamed({"core": side, "_is": f"core_{side}"}), side, "left")
    links = _kept(links.select("a", "b", F.coalesce("core_a", F.lit(False)).alias("core_a"), F.coalesce("core_b", F.lit(False)).alias("core_b")).where("core_a OR core_b"))
    shared.dropped(faces.sparkSession, near)
    names = _smallest_reached(_kept(links.where("core_a AND core_b").select("a", "b")))
    now = _kept(cores.join(names, c("core") == c("id"), "left").select("core", F.coalesce("canonical", "core").alias("label")))
    border = links.where("core_a AND NOT core_b").select(c("b").alias("face_id"), c("a").alias("core")).union(links.where("core_b AND NOT core_a").select("a", "b"))
    labels = now.select(c("core").alias("face_id"), "label").union(border.join(now, "core").groupBy("face_id").agg(F.min("label").alias("label")))
    if others is not None:
        labels = _kept(labels)
        labels = labels.union(others.join(labels.withColumnRenamed("face_id", "first"), "first").select("face_id", "label"))
    return faces.select("face_id").join(labels, "face_id", "left").select("face_id", F.coalesce("label", F.lit(-1)).alias("label"))


def dbscan(vectors: np.ndarray, eps: float, least: int) -> np.ndarray:
    """The same for the faces of one cluster, in one task; labels from 0 in order of their first core."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
    near = unit @ unit.T >= 1 - eps - SLACK
    np.fill_diagonal(near, True)
    core = near.sum(axis=1) >= least
    out, label = np.full(len(vectors), -1), 0
    for n in np.flatnonzero(core):
        if out[n] >= 0:
            continue
        todo = [n]
        while todo:
            i = todo.pop()
            if out[i] < 0:
                out[i] = label
                if core[i]:
                    todo += np.flatnonzero(near[i] & (out < 0)).tolist()
        label += 1
    return out


def centroids(faces: DataFrame, key: str) -> DataFrame:
    """The unit vector of the mean of each cluster's unit vectors."""
    each = faces.select(key, F.posexplode(V.unit(F.col("embedding"))).alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("c")).select(key, V.unit(F.col("c")).alias("centroid"))


def radii(faces: DataFrame, key: str, share: float = 0.9) -> DataFrame:
    """The 90th percentile, interpolated, of the cosine distances of a cluster's faces to its centroid."""
    rows = faces.join(centroids(faces, key), key).withColumn("distance", 1 - V.dot(V.unit(F.col("embedding")), F.col("centroid")))
    return rows.groupBy(key).agg(F.percentile("distance", share).alias("radius"), F.count("*").alias("n_faces"))


def conflicts(faces: DataFrame, key: str) -> DataFrame:
    """Clusters with two faces on one key frame, which can't be one person."""
    return faces.groupBy(key, "keyframe").count().where("count > 1").select(key).distinct()


def should_merge(centroid: Column, link: Column, strong: Column) -> Column:
    return (centroid >= CENTROID_ALONE) | ((link >= LINK) & (centroid >= CENTROID_WITH_LINK)) | ((strong >= STRONG) & (centroid >= CENTROID_WITH_STRONG))


def alike_clusters(faces: DataFrame, key: str, scope: str | None = None) -> DataFrame:
    """(x, y, centroid), x < y, of the clusters of one scope whose centroids are as similar as any rule of ``should_merge`` asks for at least; no others can merge."""
    place = [] if scope is None else [scope]
    names = faces.select(*place, key).distinct()
    middles = centroids(faces, key).join(names, key).select(F.col(key).alias("face_id"), F.col("centroid").alias("embedding"), *place)
    return _similar_pairs(middles, 1 - CENTROID_WITH_STRONG, scope).where("a < b").select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("similar").alias("centroid"))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, where the places of each begin and end, and the places in order of keys."""
    rows = np.argsort(keys, kind="stable")
    names, starts = np.unique(keys[rows], return_index=True)
    return names, starts, np.r_[starts[1:], len(keys)], rows


def _met(faces: DataFrame, key: str, pairs: DataFrame, scope: str | None) -> DataFrame:
    """Rows for ``_compared``: faces of the clusters of ``pairs`` (x, y, and centroid where that is known), dealt to those two blocks alone that hold clusters of a pair, with ``_others``, the clusters in the second block that are
    compared with a face's of the first. Clusters that are near the same smallest one are one block's, unless they have more than ``BLOCK`` faces; the faces of a larger cluster are dealt to several."""
    c = F.col
    rows = faces.select("face_id", "embedding", (F.lit(0) if scope is None else c(scope)).alias("_scope"), c(key).alias("_key"))
    counts = rows.groupBy("_scope", "_key").count()
    both = pairs.select(c("x").alias("_key"), c("y").alias("_other"), *pairs.columns[2:]).union(pairs.select("y", "x", *pairs.columns[2:]))
    near = both.where(c("centroid") >= CENTROID_ALONE) if "centroid" in pairs.columns else both
    counts = counts.join(both.select("_key").distinct(), "_key", "left_semi").join(near.groupBy("_key").agg(F.min("_other").alias("_near")), "_key", "left").withColumn("_lead", F.least("_near", "_key"))
    counts = counts.join(counts.groupBy("_scope", "_lead").agg(F.sum("count").alias("_group")), ["_scope", "_lead"]).join(counts.groupBy("_scope").agg(_blocks(F.sum("count")).alias("_n")), "_scope")
    alone = c("_group") > BLOCK
    counts = _kept(counts.select("_scope", "_key", "_n", F.when(alone, c("_key")).otherwise(c("_lead")).alias("_at"), F.when(alone, F.ceil(c("count") / BLOCK)).otherwise(1).cast("int").alias("_parts")))
    own = lambda part: F.pmod(F.xxhash64("_at", part), c("_n")).cast("int")
    homes = counts.withColumn("_part", F.explode(F.sequence(F.lit(0), c("_parts") - 1))).select("_scope", "_key", own(c("_part")).alias("own")).distinct()
    met = homes.join(both.select("_key", "_other"), "_key").join(homes.select("_scope", c("_key").alias("_other"), c("own").alias("_to")), ["_scope", "_other"])
    sends = met.groupBy("_scope", "_key", "own", "_to").agg(F.collect_set("_other").alias("_others"))
    dealt = rows.join(counts, ["_scope", "_key"]).withColumn("own", own(F.pmod(F.xxhash64("face_id"), c("_parts")).cast("int"))).drop("_n", "_at", "_parts").join(sends, ["_scope", "_key", "own"])
    return dealt.select("face_id", "embedding", "_scope", c("_key").alias(key), "own", F.when(c("own") <= c("_to"), c("_others")).alias("_others"), F.least("own", "_to").alias("i"), F.greatest("own", "_to").alias("j"))


def _products(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ranges (from, to) of both sides, one of each a pair: which pair, and all places of the left range with all of the right one."""
    wide = right[1] - right[0]
    n = (left[1] - left[0]) * wide
    pair = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x, y = np.divmod(at, wide[pair])
    return pair, left[0][pair] + x, right[0][pair] + y


def top_pair_mean(faces: DataFrame, key: str, k: int = 5, scope: str | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(x, y, link, strong): for two clusters the mean of their k most similar pairs of faces, and the best one. Each pair of blocks reports
    the k best of each two clusters. pairs: (x, y), x < y, the only ones that are looked at, maybe with their centroids' similarity."""
    few = pairs is not None

    def step(left: pd.DataFrame, right: pd.DataFrame, own: np.ndarray, other: np.ndarray, same: bool) -> Iterator[pd.DataFrame]:
        # the clusters of either block, where the faces of each begin and end, and those faces
        (xs, x_from, x_to, x_rows), (ys, y_from, y_to, y_rows) = (_runs(block[key].to_numpy()) for block in (left, right))
        own, other = own[x_rows], other[y_rows]

        def best(px: np.ndarray, py: np.ndarray, pair: np.ndarray, s: np.ndarray) -> pd.DataFrame:
            order = np.lexsort((-s, pair))
            pair, s = pair[order], s[order]
            begins = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            first = np.arange(len(pair)) - np.repeat(begins, np.diff(np.r_[begins, len(pair)])) < k
            a, b = xs[px[pair[first]]], ys[py[pair[first]]]
            return pd.DataFrame({"x": np.minimum(a, b), "y": np.maximum(a, b), "s": s[first]})

        def compared(px: np.ndarray, py: np.ndarray) -> Iterator[pd.DataFrame]:
            size = (x_to - x_from)[px] * (y_to - y_from)[py]
            large = size > PAIRS
            small = np.flatnonzero(~large)
            till = np.cumsum(size[small])
            at = 0
            while at < len(small):
                end = max(at + 1, int(np.searchsorted(till, (till[at - 1] if at else 0) + PAIRS, "right")))
                some = small[at:end]
                pair, x, y = _products((x_from[px[some]], x_to[px[some]]), (y_from[py[some]], y_to[py[some]]))
                yield best(px, py, some[pair], np.einsum("ij,ij->i", own[x], other[y]))
                at = end
            for n in np.flatnonzero(large):
                of = other[y_from[py[n]] : y_to[py[n]]]
                at_once, end = max(1, AT_ONCE // len(of)), x_to[px[n]]
                for at in range(x_from[px[n]], end, at_once):
                    s = (own[at : min(end, at + at_once)] @ of.T).ravel()
                    s = np.partition(s, len(s) - k)[len(s) - k :] if len(s) > k else s
                    yield best(px, py, np.full(len(s), n), s)

        if few:
            lists = [left["_others"].iloc[x_rows[n]] for n in x_from]
            px, wanted = np.repeat(np.arange(len(xs)), np.fromiter(map(len, lists), int, len(lists))), np.concatenate([np.zeros(0, xs.dtype), *lists]).astype(xs.dtype)
            py = np.minimum(np.searchsorted(ys, wanted), max(0, len(ys) - 1))
            good = (ys[py] == wanted) & ((wanted > xs[px]) if same else (wanted != xs[px])) if len(ys) else np.zeros(len(px), bool)
            yield from compared(px[good], py[good])
            return
        rows = max(1, PAIRS // max(1, len(ys)))
        for at in range(0, len(xs), rows):
            px, py = np.divmod(np.arange(at * len(ys), min(at + rows, len(xs)) * len(ys)), max(1, len(ys)))
            good = ys[py] > xs[px] if same else ys[py] != xs[px]
            yield from compared(px[good], py[good])

    schema = "x long, y long, s double"
    found = _compared(_met(faces, key, pairs, scope), step, schema) if few else _block_pairs(faces, [key], step, schema, scope)
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("x", "y").orderBy(F.desc("s")))).where(F.col("n") <= k)
    return ranked.groupBy("x", "y").agg(F.avg("s").alias("link"), F.max("s").alias("strong"))


def merge_rules(faces: DataFrame, key: str, scope: str | None = None) -> DataFrame:
    """(x, y, link, strong, centroid, merges) of the clusters that ``alike_clusters`` finds."""
    pairs = _kept(alike_clusters(faces, key, scope))
    rows = top_pair_mean(faces, key, scope=scope, pairs=pairs).join(pairs, ["x", "y"])
    return rows.withColumn("merges", should_merge(F.col("centroid"), F.col("link"), F.col("strong")))


def split_impure(faces: DataFrame, key: str = "cluster", eps: float = SPLIT_EPS, least: int = LEAST_POINTS) -> DataFrame:
    """faces (cluster, face_id, keyframe, embedding) with ``part``: clusters that hold a conflict or reach beyond 0.34, of 2 * least faces or more, are clustered
    again with a smaller eps, noise as clusters of its own; all others are part 0. Which clusters those are follows from sums; their faces are compared block by block."""
    bad = conflicts(faces, key).union(radii(faces, key).where(F.col("radius") > MOST_RADIUS).select(key)).distinct()
    large = faces.groupBy(key).count().where(F.col("count") >= 2 * least).select(key)
    impure = _kept(bad.join(large, key, "left_semi"))
    again = faces.join(impure, key, "left_semi")
    labels = density_labels(again, eps, least, key).join(again.select(key, "face_id"), "face_id")
    # clusters in order of their first core, then noise in order of faces
    noise = F.col("label") < 0
    place = F.dense_rank().over(Window.partitionBy(key).orderBy(noise, F.when(noise, F.col("face_id")).otherwise(F.col("label"))))
    parts = labels.select(key, "face_id", (place - 1).cast("long").alias("part"))
    return parts.union(faces.join(impure, key, "left_anti").select(key, "face_id", F.lit(0).cast("long").alias("part")))


def merged(pairs: DataFrame, keyframes: DataFrame) -> DataFrame:
    """(video_id, cluster, merged): clusters joined along ``pairs`` (video_id, x, y) in order of (x, y), unless the two sets of clusters share a key frame
    of ``keyframes`` (video_id, cluster, keyframes); named by the smallest cluster. One video's clusters are one group."""

    def step(key, links: pd.DataFrame, frames: pd.DataFrame) -> pd.DataFrame:
        parent = {int(c): int(c) for c in frames["cluster"]}
        held = {int(c): set(k) for c, k in zip(frames["cluster"], frames["keyframes"], strict=True)}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        for x, y in links[["x", "y"]].sort_values(["x", "y"]).itertuples(index=False):
            a, b = sorted((root(int(x)), root(int(y))))
            if a != b and not held[a] & held[b]:
                parent[b] = a
                held[a] |= held.pop(b)
        return pd.DataFrame({"video_id": key[0], "cluster": list(parent), "merged": [root(c) for c in parent]}, columns=["video_id", "cluster", "merged"])

    return pairs.groupBy("video_id").cogroup(keyframes.groupBy("video_id")).applyInPandas(step, "video_id long, cluster long, merged long")


def tier_bounds(n_shots: int, seconds: float) -> tuple[int, int]:
    """Scenes from which a cluster is major and minor, by a video's shots and length: 10 or a twentieth of the shots; 2 below 10 minutes,
    ``PASSERBY`` below 30, then 5 or that."""
    return max(10, int(n_shots * 0.05)), 2 if seconds < 600 else PASSERBY if seconds < 1800 else max(5, PASSERBY)


def tiers(faces: DataFrame, key: str, n_shots: int, seconds: float) -> DataFrame:
    """n_faces, n_scenes and tier of each cluster, by the number of its scenes."""
    major, minor = tier_bounds(n_shots, seconds)
    counts = faces.groupBy(key).agg(F.count("*").alias("n_faces"), F.countDistinct("scene_index").alias("n_scenes"))
    return counts.withColumn("tier", F.when(F.col("n_scenes") >= major, "major").when(F.col("n_scenes") >= minor, "minor").otherwise("passerby"))


def galleries(faces: DataFrame, tiers_of: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """A gallery for each cluster that is no passer-by: character_id, ``place`` (most faces first, ties to the smaller cluster), total_detections, appearance_scenes, tier, embedding_centroid and its faces (path,
    timestamp, scene_index) in order. faces: key, face_id, scene_index, embedding, path, timestamp; tiers_of: as ``tiers`` gives them; shown: key, face_id, place, the faces that stand for a cluster. Of a collection (faces with video_id;
    a cluster is of one video) with the video, and in order within it."""
    video = joins.place(faces)
    known = tiers_of.where("tier <> 'passerby'").select(key, "n_faces", "tier")
    own = faces.join(known.select(key), key, "left_semi")
    scenes = own.groupBy(*video, key).agg(F.array_sort(F.collect_set("scene_index")).alias("appearance_scenes"))
    picked = own.join(shown.select(key, "face_id", F.col("place").alias("_place")), [key, "face_id"])
    listed = picked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "path", "timestamp", "scene_index"))), lambda f: F.struct(f["path"], f["timestamp"], f["scene_index"])).alias("faces"))
    rows = known.join(scenes, key).join(listed, key, "left").join(centroids(own, key).withColumnRenamed("centroid", "embedding_centroid"), key)
    order = Window.partitionBy(*(video or [F.lit(0)])).orderBy(F.desc("n_faces"), key)  # the clusters of one video
    return rows.select(
        *video, F.format_string("char_%03d", F.col(key)).alias("character_id"), (F.row_number().over(order) - 1).alias("place"), F.col("n_faces").alias("total_detections"), "appearance_scenes", "tier", "embedding_centroid", "faces"
    )


def best_of_scene(faces: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key, "scene_index").orderBy(F.desc("det_score"), "face_id")
    return faces.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def time_sampled(faces: DataFrame, key: str, buckets: int = 5) -> DataFrame:
    """The best face of each of a cluster's equal stretches of scenes; the last scene belongs to the last stretch."""
    of = Window.partitionBy(key)
    low, high = F.min("scene_index").over(of), F.max("scene_index").over(of)
    bucket = F.when(high == low, 0).otherwise(F.least(F.lit(buckets - 1), F.floor((F.col("scene_index") - low) * buckets / (high - low))))
    order = Window.partitionBy(key, "bucket").orderBy(F.desc("det_score"), "face_id")
    return faces.withColumn("bucket", bucket.cast("int")).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def sampled_in_time(faces: DataFrame, key: str, count: int) -> DataFrame:
    """(key, face_id, place): ``count`` faces (face_id, timestamp, det_score, size) of each cluster spread over its time, in order of time: of each of ``count`` equal stretches, whose ends belong to both,
    the best that is not taken yet, and where a stretch has none the one nearest to the next time of an even grid. A cluster of ``count`` faces or fewer gives all, one of a single moment its surest.

    Only faces that can be taken reach the walk: two of each stretch, and of clusters with a stretch of fewer than two the ``count`` nearest to each time of the grid; so no task holds more than
    count * (count + 2) rows of a cluster."""
    c = F.col
    sizes = faces.groupBy(key).agg(F.min("timestamp").alias("_low"), F.max("timestamp").alias("_high"), F.count("*").alias("_n"))
    rows = faces.select(key, "face_id", "timestamp", "det_score", "size").join(sizes, key)
    surest = Window.partitionBy(key).orderBy(F.desc("det_score"), "face_id")
    plain = (c("_n") <= count) | (c("_high") <= c("_low"))
    few = rows.where(plain).withColumn("_r", F.row_number().over(surest)).where((c("_n") <= count) | (c("_r") <= count))
    # as they stand in time where all are taken, the surest first where there is no time
    order = Window.partitionBy(key).orderBy(F.when(c("_n") <= count, c("timestamp")), F.when(c("_n") > count, c("_r")), "face_id")
    few = few.select(key, "face_id", (F.row_number().over(order) - 1).cast("long").alias("place"))
    many = rows.where(~plain).withColumn("_width", (c("_high") - c("_low")) / count)
    about = F.floor((c("timestamp") - c("_low")) / c("_width"))
    starts = lambda i: c("_low") + c("_width") * i
    inside = lambda i: (i >= 0) & (i < count) & (starts(i) <= c("timestamp")) & (c("timestamp") <= F.when(i == count - 1, c("_high")).otherwise(starts(i) + c("_width")))
    dealt = many.withColumn("_i", F.explode(F.filter(F.array(about - 1, about, about + 1), inside)))
    best = Window.partitionBy(key, "_i").orderBy(F.desc("det_score"), F.desc("size"), "timestamp", "face_id")
    firsts = dealt.withColumn("_r", F.row_number().over(best)).where("_r <= 2")
    full = firsts.groupBy(key, "_i").agg(F.count("*").alias("_m")).where("_m = 2").groupBy(key).agg(F.count("*").alias("_full")).where(c("_full") == count).select(key)
    grid = many.join(full, key, "left_anti").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("_off", F.abs(c("timestamp") - (c("_low") + (c("_high") - c("_low")) * c("_i") / max(count - 1, 1))))
    near = Window.partitionBy(key, "_i").orderBy("_off", F.desc("det_score"), "timestamp", "face_id")
    nearest = grid.withColumn("_r", F.row_number().over(near)).where(c("_r") <= count)
    columns = [key, "face_id", "timestamp", "det_score", "size", "_low", "_high"]
    reduced = firsts.select(*columns).union(nearest.select(*columns)).dropDuplicates([key, "face_id"])

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        held = rows.sort_values(["timestamp", "face_id"]).to_dict("records")
        low, high = held[0]["_low"], held[0]["_high"]
        width, taken = (high - low) / count, {}
        for i in range(count):
            start = low + width * i
            end = high if i == count - 1 else start + width
            inside = [f for f in held if f["face_id"] not in taken and start <= f["timestamp"] <= end]
            if inside:
                best = max(inside, key=lambda f: (f["det_score"], f["size"]))
                taken[best["face_id"]] = best
        for i in range(count):
            left = [f for f in held if f["face_id"] not in taken]
            if len(taken) >= count or not left:
                break
            at = low + (high - low) * i / max(count - 1, 1)
            best = min(left, key=lambda f: (abs(f["timestamp"] - at), -f["det_score"]))
            taken[best["face_id"]] = best
        out = sorted(taken.values(), key=lambda f: (f["timestamp"], f["face_id"]))
        return pd.DataFrame({key: rows[key].iloc[0], "face_id": [f["face_id"] for f in out], "place": range(len(out))})

    return few.union(reduced.groupBy(key).applyInPandas(step, few.schema))


def merge_faces(faces: DataFrame, key: str, most: int) -> DataFrame:
    """(key, face_id, place): up to ``most`` faces that stand for a cluster when clusters are compared: the surest half, then some spread over its time, then the surest of the rest. Of a cluster of ``most`` faces
    or fewer all, in order."""
    c, quota = F.col, max(1, most // 2)
    surest = faces.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("det_score"), "face_id"))).where(c("_r") <= most).select(key, "face_id", "_r")
    spread = sampled_in_time(faces, key, most - quota).select(key, "face_id", c("place").alias("_r"))
    told = surest.withColumn("_part", F.when(c("_r") <= quota, 0).otherwise(2)).unionByName(spread.withColumn("_part", F.lit(1)))
    once = told.groupBy(key, "face_id").agg(F.min(F.struct("_part", "_r")).alias("_at"))
    small = faces.groupBy(key).agg((F.count("*") <= most).alias("_all"))
    order = Window.partitionBy(key).orderBy(F.when(c("_all"), c("face_id")), "_at")
    return once.join(small, key).withColumn("place", F.row_number().over(order) - 1).where(c("place") < most).select(key, "face_id", c("place").cast("long").alias("place"))


def spread_fill(faces: DataFrame, key: str, wanted: int = 5) -> DataFrame:
    """(key, face_id, place): the best face first, then one after another that which is farthest in time from all taken ones, new scenes before known ones."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rest = rows.sort_values(["det_score", "face_id"], ascending=[False, True]).to_dict("records")
        taken = [rest.pop(0)]
        while rest and len(taken) < wanted:
            times, seen = [t["scene_index"] for t in taken], {t["scene_index"] for t in taken}
            best = max(rest, key=lambda r: (r["scene_index"] not in seen, min(abs(r["scene_index"] - t) for t in times), r["det_score"], -r["face_id"]))
            rest.remove(best)
            taken.append(best)
        return pd.DataFrame({key: rows[key].iloc[0], "face_id": [t["face_id"] for t in taken], "place": range(len(taken))})

    return faces.select(key, "face_id", "scene_index", "det_score").groupBy(key).applyInPandas(step, f"{key} long, face_id long, place long")


#: Words of a block of descriptions (each counts for ``ROW`` more), pairs of places that a task looks at once, and links up to which the walk over a key's undecided descriptions is one task's.
WORDS, ROW, PLACES, LINKS = 1 << 21, 64, 1 << 22, 2_000_000
#: Blocks are compared in rounds of as many words as all sets have, so many times, but of ``ROUND`` at least: a round's shuffle is all of them that is on disk at once.
TIMES, ROUND = 2, 1 << 27


def _alike(rows: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The ids, smaller first, of the pairs of ``rows`` (id, words, right) that share more than ``least`` of their words: within the rows, or between those that are ``right`` and the rest, none of which is larger,
    if there are both. Of words ordered from rare to common, two sets can only share so many if they share one of the first: the larger's first 1 - least, the smaller's first (1 - least) / (1 + least)."""
    rows = rows.combine_chunks()
    ids, right = np.asarray(rows["id"]), np.asarray(rows["right"])
    lists = rows["words"].chunk(0)
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    encoded = lists.flatten().dictionary_encode()
    codes = np.asarray(encoded.indices)
    rank = np.empty(len(encoded.dictionary), np.int64)
    rank[np.argsort(np.bincount(codes, minlength=len(rank)), kind="stable")] = np.arange(len(rank))
    row, starts = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    words = rank[codes]
    words = words[np.lexsort((words, row))]
    place = np.arange(len(words)) - starts[row]
    first = lambda share: size - np.floor(share * size - SLACK).astype(np.int64)
    two = right.any() and not right.all()
    large = np.flatnonzero((place < first(least)[row]) & (right[row] if two else True))
    small = np.flatnonzero((place < first(2 * least / (1 + least))[row]) & (~right[row] if two else True))
    large = large[np.argsort(words[large], kind="stable")]
    low, high = (np.searchsorted(words[large], words[small], side) for side in ("left", "right"))
    till = np.cumsum(high - low)
    held = np.zeros(len(rank), np.int64)
    out = [np.zeros((2, 0), np.int64)]
    at = 0
    while at < len(small):
        end = max(at + 1, int(np.searchsorted(till, (till[at - 1] if at else 0) + PLACES, "right")))
        n = (high - low)[at:end]
        y = np.repeat(row[small[at:end]], n)
        x = row[large[np.repeat(low[at:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
        fits = (size[y] > least * size[x] - SLACK) & (two | (size[y] < size[x]) | ((size[y] == size[x]) & (y < x)))
        found = np.unique(x[fits] * len(size) + y[fits])
        xs, ys = np.divmod(found, len(size))
        ends = np.flatnonzero(np.r_[xs[1:] != xs[:-1], True]) + 1 if len(xs) else []
        begin = 0
        for stop in ends:
            i, js = xs[begin], ys[begin:stop]
            own = words[starts[i] : starts[i] + size[i]]
            held[own] = 1
            upto = np.cumsum(size[js]) - size[js]
            both = np.add.reduceat(held[words[np.repeat(starts[js] - upto, size[js]) + np.arange(size[js].sum())]], upto)
            held[own] = 0
            js = js[both / (size[i] + size[js] - both) > least]
            out.append(np.stack([np.minimum(ids[i], ids[js]), np.maximum(ids[i], ids[js])]))
            begin = stop
        at = end
    return tuple(np.unique(np.concatenate(out, axis=1), axis=1))


def like_pairs(sets: DataFrame, key: str, least: float) -> DataFrame:
    """(key, a, b), a < b: the different sets (key, id, n, words; n words, none is empty) of one key that share more than ``least`` of their words. Sets of one key are put in order of size and dealt to blocks of
    ``WORDS`` words; only blocks whose sizes are near enough meet, two in a task, in rounds: what a round has dealt is freed before the next one."""
    spark, c = sets.sparkSession, F.col
    order = Window.partitionBy(key).orderBy("n", "id")
    blocks = shared.written(sets.select(key, "id", "n", F.floor((F.sum(c("n") + ROW).over(order) - 1) / WORDS).cast("int").alias("block")), "blocks")
    ends = blocks.groupBy(key, "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.sum(c("n") + ROW).alias("words"))
    left, right = (ends.select(key, c("block").alias(b), c("low").alias(f"low_{b}"), c("high").alias(f"high_{b}"), c("words").alias(f"words_{b}")) for b in "ij")
    pairs = left.join(right, key).where((c("i") <= c("j")) & (c("high_i") > least * c("low_j") - SLACK))
    pairs = shared.written(pairs.select(key, "i", "j", F.when(c("i") < c("j"), c("words_i") + c("words_j")).otherwise(c("words_i")).alias("words")), "sides")
    every, dealt = ends.agg(F.sum("words")).first()[0] or 0, pairs.agg(F.sum("words")).first()[0] or 0
    rounds = max(1, -(-dealt // max(ROUND, TIMES * every)))
    rows = sets.select(key, "id", "words").join(blocks.select(key, "id", "block"), [key, "id"])
    rows = shared.written(rows, "rows") if rounds > 1 else rows

    def step(own: pa.Table) -> pa.Table:
        a, b = _alike(own, least)
        return pa.table({key: pa.array([own[key][0].as_py()] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = []
    for n in range(rounds):
        own = pairs.where(F.pmod(F.xxhash64(key, "i", "j"), F.lit(rounds)) == n)
        sides = own.select(key, "i", "j", c("i").alias("block"), F.lit(False).alias("right")).union(own.where("i < j").select(key, "i", "j", c("j").alias("block"), F.lit(True)))
        met = rows.join(joins.small(sides), [key, "block"]).select(key, "i", "j", "right", "id", "words")
        found.append(shared.written(met.groupBy(key, "i", "j").applyInArrow(step, f"{key} string, a long, b long"), "links"))
        if rounds > 1:
            del met, sides, own
            gc.collect()
            spark.sparkContext._jvm.System.gc()  # Spark deletes the files of shuffles that nothing refers to any more
    shared.dropped(spark, *([rows] if rounds > 1 else []))
    return reduce(DataFrame.union, found)


def _followers(links: DataFrame, key: str) -> DataFrame:
    """(key, id): those of ``links`` (key, a, b; a < b) that a smaller one leads which follows none itself. While there are more than ``LINKS`` links of the undecided, a round lets those lead whom nobody undecided
    precedes; the rest is a walk in order over the links of a key."""

    def walk(own: pd.DataFrame) -> pd.DataFrame:
        following: set[int] = set()
        for a, b in own.sort_values(["b", "a"])[["a", "b"]].itertuples(index=False):
            if a not in following:
                following.add(b)
        return pd.DataFrame({key: own[key].iloc[0], "id": sorted(following)})

    told = []
    while links.count() > LINKS:
        heads = links.select(key, F.col("a").alias("id")).distinct().join(links.select(key, F.col("b").alias("id")).distinct(), [key, "id"], "left_anti")
        led = shared.written(links.join(heads.withColumnRenamed("id", "a"), [key, "a"], "left_semi").select(key, F.col("b").alias("id")).distinct(), "led")
        decided = shared.written(led.union(heads), "decided")
        rest = links
        for end in ("a", "b"):
            rest = rest.join(decided.withColumnRenamed("id", end), [key, end], "left_anti")
        told.append(led)
        links = shared.written(rest, "links")
    return reduce(DataFrame.union, [*told, links.groupBy(key).applyInPandas(walk, f"{key} string, id long")])


def first_like(descriptions: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """(key, id, leader): each description joins the first earlier leader whose words it shares by more than half, or leads. ids are unique; equal sets are one, and empty ones lead.
    Who is like whom is found by ``like_pairs``, so that the walk in order has links alone."""
    whole = descriptions.select(F.coalesce(F.concat(F.lit("="), F.col(key)), F.lit("")).alias("_key"), F.col("id").cast("long").alias("id"), F.array_sort(F.array_distinct("words")).alias("words"))
    whole = shared.written(whole.withColumns({"n": F.size("words"), "same": F.when(F.size("words") > 0, F.sha2(F.to_json("words"), 256)).otherwise(F.col("id").cast("string"))}), "words")
    first = whole.groupBy("_key", "same").agg(F.min("id").alias("first"))
    # of equal descriptions the first alone; which those are is told without their words
    sets = whole.join(joins.small(shared.written(whole.where("n > 0").groupBy("_key", "same").agg(F.min("id").alias("id")).select("_key", "id"), "firsts")), ["_key", "id"], "left_semi").select("_key", "id", "n", "words")
    links = like_pairs(sets, "_key", least)
    following = shared.written(_followers(links, "_key"), "following")
    leads = links.join(following.select("_key", F.col("id").alias("a")), ["_key", "a"], "left_anti").groupBy("_key", F.col("b").alias("first")).agg(F.min("a").alias("leader"))
    rows = whole.select("_key", "id", "same").join(first, ["_key", "same"]).join(leads, ["_key", "first"], "left")
    return rows.select(F.when(F.col("_key") != "", F.substr("_key", F.lit(2))).alias(key), "id", F.coalesce("leader", "first").alias("leader"))


def usable_face(score: Column, width: Column, height: Column, frame_width: Column, frame_height: Column, crop: Column, side: Column) -> Column:
    """Good enough to be recognised: detected surely, of some size against the frame, its crop too, and not from the side."""
    short, frame = F.least(width, height), F.least(frame_width, frame_height)
    return (score >= LEAST_DET) & (short >= F.greatest(F.lit(16.0), 0.05 * frame)) & (crop >= F.greatest(F.lit(48.0), 0.08 * frame)) & ~side


def side_face(yaw: Column, nose: Column, middle: Column, eyes: Column) -> Column:
    """Turned by more than 35 degrees, or the nose off the eyes' middle by more than 0.35 of their distance; what is unknown counts for the face."""
    return F.coalesce(F.abs(yaw) > SIDE_YAW, F.lit(False)) | F.coalesce(F.try_divide(F.abs(nose - middle), eyes) > SIDE_OFFSET, F.lit(False))
