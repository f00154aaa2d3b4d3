import random
import re

import numpy as np
import pytest
import xxhash

from framelode.llm import simhash as sh

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_fingerprint(text, size=4):
    words = WORD.findall((text or "").translate(LOWER))
    parts = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows, distance=4):
    """The class of every row, by comparing all."""
    prints = [plain_fingerprint(t) for _, t in rows]
    own = {p for p, (i, _) in zip(prints, rows, strict=True) if i is not None}
    root = {p: p for p in own}

    def up(p):
        while root[p] != p:
            p = root[p]
        return p

    each = sorted(own)
    bits = np.array(each, np.uint64)
    for n, p in enumerate(each):
        for m in np.flatnonzero(np.bitwise_count(bits ^ bits[n]) <= distance).tolist():
            root[up(p)] = up(each[m])
    least = {}
    for p, (i, _) in zip(prints, rows, strict=True):
        if i is not None:
            least[up(p)] = min(i, least.get(up(p), i))
    return sorted(((i, f"{p:016x}", least[up(p)] if p in own else None) for p, (i, _) in zip(prints, rows, strict=True)), key=str)


def documents(seed, n):
    rng = random.Random(seed)
    words = [f"w{x}" for x in range(400)]
    rows = []
    while len(rows) < n:
        text = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 30, 120, 400]))]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            rows.append((len(rows), rng.choice([" ", "\n", " \t"]).join(text)))
            if rng.random() < 0.8:
                text = text.copy()
                text[rng.randrange(len(text))] = rng.choice(words).upper()
    return rows


def test_fingerprints():
    rng = random.Random(1)
    for _, text in documents(1, 60):
        assert sh.fingerprint(text) == plain_fingerprint(text)
    for text in (None, "", " \t ", "a", "A b C", "É é İ 中 文 字", "x\x0by\x0cz\x1cq", "a b c d e", "long " * 3):
        assert sh.fingerprint(text) == plain_fingerprint(text)
    assert sh.fingerprint("A  b\tc D e") == sh.fingerprint("a b c d e") != 0
    long = " ".join(str(rng.randrange(9000)) for _ in range(70_000))
    whole = sh.fingerprint(long)
    sh._CHUNK, before = 1000, sh._CHUNK
    assert sh.fingerprint(long) == whole
    sh._CHUNK = before


@pytest.mark.parametrize("distance", [2, 3, 4, 5, 7])
def test_every_link_shares_its_first_variant(distance):
    rng = np.random.default_rng(distance)
    parts = sh.segments(distance)
    assert sum(w for _, w in parts) == 64
    keys = lambda v: {(first + i, (v >> first & (1 << w) - 1) & ~(1 << i)) for first, w in parts for i in range(w)}
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63)) * 2 + 1
        b = a
        for bit in rng.choice(64, rng.integers(1, distance + 1), replace=False).tolist():
            b ^= 1 << bit
        shared = {k for k, _ in keys(a) & keys(b)}
        assert shared and min(shared) == sh._first_shared(np.array([a ^ b], np.uint64), distance)[0]


@pytest.mark.parametrize("block", [8192, 5])
def test_classes_against_all_pairs(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(sh, "BLOCK", block)
    rows = documents(2, 500)
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(900, None), (901, ""), (902, "  "), (5, rows[5][1]), (5, "quite another text of its own"), (None, rows[3][1]), (None, "a text that no other row has"), (903, "w" * 100_000), (904, "z " * 60_000)]
    spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id int, text string, bits int, Component_id string, id int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((tuple(r) for r in sh.op13_simhash(spark, str(tmp_path)).collect()), key=str)
    expected = plain(rows)
    assert found == expected
    assert len({r[2] for r in expected}) < len({r[1] for r in expected}) - 20


def test_chains_of_fingerprints(spark):
    rng = np.random.default_rng(4)
    chain, at = [], 0x0123456789ABCDEF
    for _ in range(300):
        chain.append(at)
        for bit in rng.choice(64, 4, replace=False).tolist():
            at ^= 1 << bit
    bits = np.array(chain + [int(x) for x in rng.integers(0, 1 << 63, 300)], np.uint64)
    table = spark.createDataFrame([(int(x),) for x in np.unique(bits.view(np.int64))], "id long")
    edges = [tuple(r) for r in sh.links(table).collect()]
    root = {int(x): int(x) for x in bits.view(np.int64)}

    def up(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in edges:
        root[up(a)] = up(b)
    assert len({up(int(x)) for x in bits[:300].view(np.int64)}) == 1
    assert len({up(int(x)) for x in bits.view(np.int64)}) == 301


def test_empty_table(spark):
    assert sh.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
