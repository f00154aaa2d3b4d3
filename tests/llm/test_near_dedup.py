import random
import re

import numpy as np
import pytest

from framelode.llm import cc, common, near_dedup


def plain_components(rows, size, percent=80):
    def shingles(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x20\x09-\x0d]+", lowered)
        if not words:
            return frozenset()
        return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    smallest = {}
    for (doc, _), x in zip(rows, label, strict=True):
        smallest[x] = min(doc, smallest.get(x, doc))
    return sorted((doc, len(s), smallest[x]) for (doc, _), s, x in zip(rows, sets, label, strict=True))


def corpus(seed=5, n=260):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["É", "été", "the", "The"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 12, 40, 120]))) for _ in range(n)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    for i in range(0, n, 3):
        source = texts[rng.randrange(n)].split()
        for _ in range(rng.randrange(0, 4)):
            source[rng.randrange(len(source))] = rng.choice(vocabulary)
        texts[i] = " ".join(source)
    for i in range(1, n, 5):
        texts[i] = passage + " " + texts[i]
    # a chain of edits: each is linked with the next, the ends are not
    chain = [rng.choice(vocabulary) for _ in range(60)]
    for at in range(0, 60, 2):
        chain = [*chain[:at], "edit", *chain[at + 1 :]]
        texts.append(" ".join(chain))
    return [*texts, "", " \n", "one", "one", "ONE", "a b c", "a b c d", "A b\tc\nd"]


@pytest.fixture
def tables(spark, tmp_path):
    rows = list(enumerate(corpus()))
    random.Random(1).shuffle(rows)
    rows.append((9999, None))
    return rows, spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")


def test_classes_are_those_of_all_pairs(spark, tables, tmp_path):
    rows, docs = tables
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = near_dedup.op10_near_dedup(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == plain_components(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_blocks_change_nothing(spark, tables, monkeypatch):
    rows, docs = tables
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 4)
    out = near_dedup.components(docs, 4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == plain_components(rows, 4)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(3, text), (2, text + " more"), (2, text + " more"), (7, "clean and short"), (None, text), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, _gone string").select("doc_id", "text")
    out = [(r.doc_id, r.text) for r in near_dedup.deduplicated(docs).collect()]
    assert sorted(map(str, out)) == sorted(map(str, [rows[1], *rows[3:]]))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.components(empty).count() == 0
    assert near_dedup.deduplicated(empty).count() == 0


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for kept in (0, 500, 1500, 2700, 3000):
        other = np.concatenate([base[:kept], rng.integers(0, 1 << 63, 3000 - kept, dtype=np.uint64)])
        signature = near_dedup.packed(np.stack([near_dedup.minima(base), near_dedup.minima(other)]))
        assert abs(float(near_dedup.estimated(signature[0], signature[1])) - kept / (6000 - kept)) < 0.15


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    out = {(r.id, r.component) for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)} | {(200, 200), (201, 200)}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_vertices_and_small_shares(spark, monkeypatch):
    monkeypatch.setattr(cc, "HOT_SHARE", 4)
    edges = [(5, i) for i in range(6, 300)] + [(i, i + 1) for i in range(400, 420)] + [(3, 250)]
    out = {(r.id, r.component) for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {(i, 3) for i in [3, *range(5, 300)]} | {(i, 400) for i in range(400, 421)}


def test_any_column_names(spark):
    text = " ".join(f"word{i}" for i in range(50))
    kind = "doc_id long, text string, gone string, _gone string, N int, _again int, component string, n_shingles int, place int"
    rows = [(1, text, "g", "h", 1, 2, "c", 3, 4), (2, text, "i", "j", 5, 6, "d", 7, 8), (4, text + " x", None, None, None, None, None, None, None), (5, "clean", "k", None, 9, 9, "e", 9, 9), (5, "clean", "k", None, 9, 9, "e", 9, 9)]
    docs = spark.createDataFrame(rows, kind)
    out = near_dedup.deduplicated(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[3]]
    assert sorted((r.doc_id, r.component_id) for r in near_dedup.components(docs).collect()) == [(1, 1), (2, 1), (4, 1), (5, 5), (5, 5)]


def test_no_row_that_is_wanted_is_filtered(spark):
    rows = spark.range(0, 20_000).selectExpr("id AS doc_id", "id AS place", "id AS mask")
    keys = spark.createDataFrame([(i * 37,) for i in range(500)] + [(-5,), (None,)], "id long")
    out = [r.doc_id for r in common.may_hold(rows, "doc_id", keys, "id").collect()]
    assert {i * 37 for i in range(500)} <= set(out) and len(out) == len(set(out)) < 700
    few = {r.doc_id for r in common.may_hold(rows, "doc_id", keys, "id", bits=8).collect()}
    assert {i * 37 for i in range(500)} <= few


def test_intermediate_tables_can_be_removed(spark, tables):
    before = len(common._MADE)
    near_dedup.components(tables[1], 4).count()
    assert len(common._MADE) > before
    common.cleaned(spark)
    assert not common._MADE
