import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from framelode.llm import lexical as lx
from tests.oracle import connect, differs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=10):
    """Every document scored for every item."""
    rows = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs if i is not None]
    rows = [(i, c) for i, c in rows if c]
    total, occurrences = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c in rows:
            m = 100 - 90 + (90 * sum(c.values()) * total) // occurrences
            scored.append((-sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c), i))
        out += [(item, n + 1, i, -s) for n, (s, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return sorted(out)


def tables(seed, n=700):
    rng = random.Random(seed)
    vocabulary = [f"w{x}" for x in range(80)] + ["É", "é", "中文", "x9", "A1"]
    words = lambda most: [rng.choice(vocabulary[: rng.choice([4, 30, 85])]) for _ in range(rng.randint(0, most))]
    docs = [(i, rng.choice([" ", "-", "\n", "\x00"]).join(words(rng.choice([5, 60])))) for i in range(n)]
    docs += [(n + i, docs[i % 9][1]) for i in range(60)]
    items = [(i, " ".join(words(25))) for i in range(40)] + [(50, "w1"), (51, "W1 w1, w1!"), (52, "nothing known"), (53, None), (54, "  "), (None, "w3"), (50, "w2"), (55, docs[3][1])]
    return docs, items


def test_terms():
    for text in ("Ab c-D\x7fe_f é É 中 文　x", "", None, "\x00A\x2f9:@Z[`a{z|", "İI ß"):
        assert [t.decode() for t in lx.terms(text)] == TERM.findall((text or "").translate(LOWER))


@pytest.mark.parametrize(("fan", "block", "most"), [(16, 4096, 2_000_000), (2, 100, 2_000_000), (4, 64, 150), (3, 1, 10)])
def test_ranks_against_all_scores(spark, tmp_path, monkeypatch, fan, block, most):
    monkeypatch.setattr(lx, "FAN", fan)
    monkeypatch.setattr(lx, "BLOCK_DOCS", block)
    monkeypatch.setattr(lx, "BLOCK_TERMS", most)
    docs, items = tables(fan, 700 if block > 1 else 60)
    docs += [(2000, None), (2001, ""), (2002, "?!"), (None, "w1 w2 w3"), (2003, "w1 " * 40_000), (2004, "w" * 100_000)]
    spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id int, text string, n int, TF string, terms int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t, 0) for i, t in items], "item_id int, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(tuple(r) for r in lx.op12_lexical_search(spark, str(tmp_path)).collect()) == plain(docs, items)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lx, "QUERY_TERMS", 60)
    docs, items = tables(9, 200)
    index = lx.indexed(spark.createDataFrame(docs, "doc_id long, text string"))
    found = lx.search(index, spark.createDataFrame(items, "item_id long, text string"), 3)
    assert sorted(tuple(r) for r in found.collect()) == plain(docs, items, 3)


def test_repeated_ids_and_ties(spark):
    docs = [(5, "a b"), (5, "a b"), (7, "a c"), (6, "a c"), (8, "d"), (9, "d")]
    index = lx.indexed(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(tuple(r) for r in lx.search(index, spark.createDataFrame([(1, "a"), (2, "b c d")], "item_id long, text string"), 3).collect()) == plain(docs, [(1, "a"), (2, "b c d")], 3)


def test_few_nodes_are_opened_where_one_document_stands_out():
    rng = np.random.default_rng(2)
    place = np.arange(4096)
    impact = rng.integers(1, 50, 4096)
    impact[1234] = 900
    trees = lx.MaxTrees(np.zeros(4096, np.int64), place, impact, 4096)
    opened = []

    class Counted(list):
        def __getitem__(self, at):
            opened.append(at)
            return list.__getitem__(self, at)

    trees.levels = Counted(trees.levels)
    found = []
    trees.best({0: 3}, 1, place, found)
    assert found == [(2700, -1234)] and len(opened) <= 12


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lx.search(lx.indexed(none), one).count() == 0
    assert lx.search(lx.indexed(one.withColumnRenamed("item_id", "doc_id")), none.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_rows_are_those_of_the_sql(spark):
    small = "/root/testdata/sf0.001"
    assert differs(lx.op12_lexical_search(spark, small), lx.SQL, connect(small)) is None
