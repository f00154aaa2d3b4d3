import math

import numpy as np
import pytest

from framelode.llm import neighbours as nn


def plain(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 100 == 0:
            out[i] = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good if j != i and len(w) == len(v))[:k]
    return out


def held(out):
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def same(a, b):
    return [j for _, j in a] == [j for _, j in b] and np.allclose([d for d, _ in a], [d for d, _ in b], rtol=1e-12)


def test_odd_vectors_copies_and_ties(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[100][1]) for i in range(40)]  # copies of a query, 1000 a query itself
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [None] + [1.0] * 15), (2100, [math.nan] * 16), (2101, [math.inf] * 16), (None, rows[0][1]), (2200, []), (2300, [1.0, 2.0]), (2301, [1.0, 2.5]), (5, rows[5][1])]
    spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, bucket int, Code int").write.parquet(f"{tmp_path}/embeddings.parquet")
    expected = plain(dict(rows[:-1]).items())
    assert held(nn.op3_neighbours(spark, str(tmp_path))).keys() == {q for q, v in expected.items() if v}
    table = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    found = held(nn.neighbours(table, table.where("vec_id % 100 = 0"), catch=2.0))
    for q, v in found.items():
        assert same(v, expected[q]), q


def simulated(rows, queries, k=10):
    """Recall at k of the hashes, and the share of all rows that become candidates, without Spark."""
    polytope = nn.CrossPolytope(rows.shape[1])
    unit = nn._on_sphere(rows)
    buckets = [polytope.nearest(unit, t)[:, 0] for t in range(nn.TABLES)]
    met = np.zeros((len(queries), len(rows)), bool)
    for t in range(nn.FIRST_TABLES):
        near = polytope.nearest(unit[queries], t, nn.FIRST_PROBES)
        met |= (buckets[t][None, :, None] == near[:, None, :]).any(axis=2)
    distance = np.stack([np.sqrt(((rows - rows[q]) ** 2).sum(axis=1)) for q in queries])
    found = np.where(met, distance, np.inf)
    reach = np.sort(found, axis=1)[:, k]
    apart = np.minimum(reach / np.linalg.norm(rows[queries], axis=1), np.sqrt(2))
    for t in range(nn.TABLES):
        for n, likely in enumerate(polytope.likely(unit[queries], t, apart, nn.CATCH)):
            met[n] |= np.isin(buckets[t], likely)
    distance[np.arange(len(queries)), queries] = np.inf
    nearest = np.argpartition(distance, k, axis=1)[:, :k]
    return np.take_along_axis(met, nearest, axis=1).mean(), met.mean()


@pytest.mark.parametrize(("dimension", "n"), [(64, 20_000), (64, 500), (128, 6000), (256, 4000), (768, 3000)])
def test_recall_and_share_of_candidates_by_dimension(dimension, n):
    rng = np.random.default_rng(dimension)
    queries = np.arange(0, n, max(1, n // 60))
    recall, _ = simulated(rng.normal(size=(n, dimension)), queries)
    assert recall >= 0.9
    groups = rng.normal(size=(max(5, n // 100), dimension))
    recall, share = simulated(groups[rng.integers(0, len(groups), n)] + 0.4 * rng.normal(size=(n, dimension)), queries)
    assert recall >= 0.97 and (share < 0.2 or n < 1000)


def test_recall_through_spark(spark, monkeypatch):
    monkeypatch.setattr(nn, "BLOCK", 500)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(20_000, 64)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), "x", 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, code string, size int")
    found, hits = held(nn.neighbours(table, table.where("vec_id % 200 = 0"))), []
    for q in range(0, 20_000, 200):
        every = np.sqrt(((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(axis=1))
        every[q] = np.inf
        hits.append(len(set(np.argsort(every)[:10].tolist()) & {j for _, j in found[q]}) / 10)
        assert sorted(found[q]) == found[q] and np.allclose([d for d, _ in found[q]], every[[j for _, j in found[q]]], rtol=1e-14)
    assert np.mean(hits) > 0.9


@pytest.mark.parametrize(("n", "far"), [(3, 0), (11, 0), (12, 0), (40, 0), (40, 35)])
def test_small_tables_give_whole_lists(spark, n, far):
    rng = np.random.default_rng(n + far)
    vectors = rng.normal(size=(n, 64))
    vectors[:far] = vectors[0] + 1e-3 * vectors[:far]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    found = held(nn.neighbours(table, table))
    assert {q: len(v) for q, v in found.items()} == dict.fromkeys(range(n), min(10, n - 1))
    if far == 0:
        expected = {i: sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in enumerate(vectors) if j != i)[:10] for i, v in enumerate(vectors)}
        assert sum(same(found[q], expected[q]) for q in found) >= 0.75 * n


def test_distances_are_exact_for_near_copies_and_large_values(monkeypatch):
    monkeypatch.setattr(nn, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(9)
    rows = np.concatenate([rng.normal(size=(40, 8)) * 1e-9 + 1e6, rng.normal(size=(5, 8)) * 1e200])
    for n, near, distance in nn._nearest_of(rows, rows[:4], 3):
        every = np.sqrt(((rows[:40] - rows[n]) ** 2).sum(axis=1))
        assert sorted(distance.tolist())[:3] == sorted(every.tolist())[:3] and set(near) >= set(np.argsort(every, kind="stable")[:2])


def test_rotations_keep_lengths_and_angles():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(20, 48))
    turned = nn.CrossPolytope(48).rotated(rows, 3)
    assert np.allclose(turned @ turned.T, rows @ rows.T)


def test_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nn.neighbours(none, none).count() == 0
