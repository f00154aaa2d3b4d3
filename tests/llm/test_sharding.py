import random
import zlib
from hashlib import md5

import pytest

from framelode.llm import sharding


def plain(rows, shards):
    """The least capacity and the walk over all groups, one by one."""
    groups = {}
    for _, text in rows:
        text = (text or "").encode()
        groups[md5(text).hexdigest()] = groups.get(md5(text).hexdigest(), 0) + len(text) + 1
    order = sorted(groups)

    def walk(capacity):
        out, shard, held = {}, 0, 0
        for g in order:
            if groups[g] > capacity:
                return None
            if held + groups[g] > capacity:
                shard, held = shard + 1, 0
            held += groups[g]
            out[g] = shard
        return out if shard < shards else None

    low, high = 1, sum(groups.values())
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if walk(middle) else (middle + 1, high)
    return walk(low) if groups else {}


def check(rows, out, shards=8):
    where = plain(rows, shards)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    expected = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), where[md5((t or "").encode()).hexdigest()]) for i, t in rows]
    assert sorted([(r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in out], key=key) == sorted(expected, key=key)
    for shard in range(shards):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("kind", ["plain", "hot", "few", "long", "odd"])
def test_shards_are_those_of_a_walk_over_all_groups(spark, tmp_path, kind, monkeypatch):
    rng = random.Random(kind)
    text = lambda: "t%d " % rng.randrange(10**9) * rng.choice([1, 3, 30, 90])
    texts = [text() for _ in range(900)]
    if kind == "hot":
        texts += ["the hot one é" * 9] * 500
        monkeypatch.setattr(sharding, "DIGITS", 1)
        monkeypatch.setattr(sharding, "BINS", 16)
    elif kind == "few":
        texts = ["a", "bb", "a"]
    elif kind == "long":
        texts += ["x" * 40_000, "y" * 90_000]
        monkeypatch.setattr(sharding, "DIGITS", 2)
        monkeypatch.setattr(sharding, "BINS", 256)
    rows = list(enumerate(texts))
    if kind == "odd":
        rows += [(7, texts[7]), (7, texts[7]), (None, texts[7]), (None, None), (8, None), (9, ""), (-3, "")]
    spark.createDataFrame([(i, t, 5, "s") for i, t in rows], "doc_id long, text string, slot int, Shard string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op1_sharding(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(rows, out.collect())


def test_empty_table(spark):
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
