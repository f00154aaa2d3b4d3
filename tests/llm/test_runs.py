import random
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from framelode.llm import runs as rn

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(words, least=6, folds=4):
    """Every maximal stretch of every lag; smallest periods by comparing words."""
    n, out = len(words), []
    for q in range(1, n // folds + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, folds * q):
                part = words[i : i + length]
                if not any(all(part[x] == part[x + d] for x in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng, n, letters):
    out = []
    while len(out) < n:
        part = [rng.choice(letters) for _ in range(rng.randint(1, 40))]
        out += part * rng.choice([1, 1, 1, 2, 4, 5, 9])
    return out[:n]


@pytest.mark.parametrize("anchored", [1, 4, 64])
def test_runs_are_those_of_a_plain_walk(monkeypatch, anchored):
    monkeypatch.setattr(rn, "ANCHORED", anchored)
    rng = random.Random(anchored)
    for case in range(250):
        words = made(rng, rng.randint(0, 300), [b"a", b"b"] if case % 3 == 0 else [b"a", b"b", b"c", b"d", b"e"] if case % 3 == 1 else [str(x).encode() for x in range(500)])
        assert rn.runs(words) == plain(words), words
        assert rn.runs(words, 3, 3) == plain(words, 3, 3)


def test_long_periods_and_long_texts():
    rng = random.Random(5)
    loop = [str(rng.randrange(5000)).encode() for _ in range(3001)]
    words = [b"x", b"y"] + loop * 4 + loop[:7] + [b"z"]
    assert (2, 4 * 3001 + 7, 3001) in rn.runs(words)
    assert rn.runs([b"a"] * 400_000) == [(0, 400_000, 1)]
    assert rn.runs([b"a", b"b"] * 100_000) == [(0, 200_000, 2)]
    other = [str(x).encode() for x in range(300_000)]
    assert rn.runs(other) == []
    assert rn.runs(other + [b"q", b"r", b"s"] * 4 + other) == [(300_000, 12, 3)]
    nested = ([b"a"] * 6 + [b"b"]) * 1000
    assert rn.runs(nested) == sorted([(0, 7000, 7), *((7 * i, 6, 1) for i in range(1000))], key=lambda r: (r[0], r[2]))


def test_bits():
    bits = [int(x) for x in np.random.default_rng(3).integers(0, 4, 500) > 0]
    whole = sum(b << i for i, b in enumerate(bits))
    for length in (1, 2, 3, 5, 8, 13):
        expected = [i for i in range(500) if i + length <= 500 and all(bits[i : i + length])]
        assert [i for i in range(500) if rn.beginnings(whole, length) >> i & 1] == expected
    assert rn.stretches(0b1101110, 7).tolist() == [[1, 3], [5, 6]]
    assert sorted(rn._shorter(12)) == [4, 6] and rn._shorter(7) == [1] and rn._shorter(1) == []


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = plain(words)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    return (doc_id, len(found), *(top or (None, None, None)), top and 1000 * top[1] // top[2], sha256(lines.encode()).hexdigest(), sha256(left.encode()).hexdigest())


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(w.decode() for w in made(rng, rng.randint(0, 120), [b"a", b"b", b"c", "é中".encode()]))) for i in range(300)]
    rows += [(None, "a a a a a a a"), (400, None), (401, ""), (402, " \t\n "), (403, "a\x0ba\x0ca\ra\na\ta b"), (404, "\x1c\x1d\x85    " * 9), (5, rows[5][1]), (5, "other text"), (405, "A a " * 7), (406, "z " * 50_000), (407, "w" * 200_000)]
    spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id int, text string, Runs int, collapsed string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((tuple(r) for r in rn.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    expected = sorted((plain_row(i, t) for i, t in rows if i not in (406,)), key=str)
    assert [r for r in found if r[0] != 406] == expected
    assert next(r for r in found if r[0] == 406)[1:5] == (1, 0, 50_000, 1)
    assert sum(r[1] > 0 for r in found) > 50
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rn.collapsed_runs(rn.looped(none)).count() == 0
