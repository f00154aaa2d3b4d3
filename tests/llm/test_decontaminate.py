import random
import re

import pyarrow as pa

from framelode.llm import decontaminate
from framelode.llm.near_dedup import shingle_set


def corpus():
    rng = random.Random(11)
    word = lambda: "w%d" % rng.randrange(3000)
    items = [" ".join(word() for _ in range(n)) for n in (5, 6, 7, 8, 9, 12, 15, 20, 31, 36, 60, 90, 200)]
    items += [items[5], "Too short now", "", items[6].upper(), "w7", "w8 w9", "W1 w2 w3 w4"]
    docs = []
    for n in range(150):
        own = [word() for _ in range(rng.choice([0, 3, 30, 400, 3000]))]
        if n % 3 == 0:
            part = items[rng.randrange(len(items))].split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                if part:
                    part[rng.randrange(len(part))] = word()
            at = rng.randrange(len(own) + 1)
            cut = rng.randrange(len(part) + 1) if n % 2 else 0
            own = [*own[:at], *part[:cut], *[word()] * (n % 4), *part[cut:], *own[at:]]
        docs.append(" ".join(own))
    docs += ["it is too SHORT now", "too short", "now too short", "w8", "w9 w8", "x w8 w9", "w1 w2 w3 w4", "w2 w3 w4", "too short", "now"]
    return [*docs, docs[0], None, items[16].lower() + "\n\n"], items


def plain(docs, items):
    out = set()
    for i, text in enumerate(docs):
        for item in set(items):
            want = shingle_set(item, 5)
            words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
            size = min(5, len(next(iter(want), ())) or 5)
            own = {tuple(words[n : n + size]) for n in range(len(words) - size + 1)}
            if want and len(want & own) * 100 >= 80 * len(want):
                ids = tuple(n for n, other in enumerate(items) if other == item)
                out.add((i, ids[0], ids, len(want & own), len(want)))
    return out


def test_every_leak_is_found_and_nothing_else(spark, tmp_path, monkeypatch):
    docs, items = corpus()
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = plain(docs, items)
    assert len({i for i, *_ in expected}) > 10
    for block, blocks in ((4096, 4), (5, 2), (5, 1)):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
        monkeypatch.setattr(decontaminate, "PASS_BLOCKS", blocks)
        out = decontaminate.op9_decontaminate(spark, str(tmp_path))
        assert {(r.doc_id, r.item_id, tuple(r.item_ids), r.n_shared, r.n_item) for r in out.collect()} == expected
        table = spark.read.parquet(f"{tmp_path}/documents.parquet")
        clean = decontaminate.decontaminated(table, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
        assert clean.columns == table.columns
        assert sorted(r.doc_id for r in clean.collect()) == sorted(set(range(len(docs))) - {i for i, *_ in expected})


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words of a document here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).count() == 0
    assert decontaminate.decontaminated(docs, none).count() == 1
    assert decontaminate.leaks(docs.limit(0), none).count() == 0


def test_scattered_shingles_of_an_item_are_enough():
    rng = random.Random(2)
    item = ["i%d" % n for n in range(44)]
    parts = [item[a : a + 12] for a in range(0, 33, 8)]
    doc = " ".join(w for p in parts for w in [*p, *("x%d" % rng.randrange(10**6) for _ in range(2000))])
    index = decontaminate.ItemIndex([([1], " ".join(item))])
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([doc])], ["doc_id", "text"])
    assert [(row, n) for row, _, n, _ in decontaminate._held(batch, [index])] == [(0, 0)]
