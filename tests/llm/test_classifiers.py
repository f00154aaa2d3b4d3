import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from framelode.llm import quality, shingles, toxicity

BAD = ["idiot", "moron", "scum"]


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def corpus(n, kind, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "on", "an", "é", "st", "ly"]) for _ in range(rng.randint(1, 5))) for _ in range(600)]
    rows = []
    for i in range(n):
        own, y = [rng.choice(words) for _ in range(rng.choice([20, 60, 400]))], rng.random() < 0.3
        if y and kind == "toxic":
            for _ in range(1 + len(own) // 30):
                own[rng.randrange(len(own))] = rng.choice(BAD).upper()
        if not y and kind == "quality":
            own = [w + rng.choice(["!!", "$$$", "%%%", "***"]) for w in own]
        rows.append((i, " ".join(own), int(y)))
    return rows


@pytest.mark.parametrize("kind,module,parts,held", [("toxic", toxicity, 4, 2), ("quality", quality, 3, 1)])
def test_held_out_accuracy_and_every_row(spark, tmp_path, kind, module, parts, held):
    rows = corpus(700, kind)
    docs = [(i, t, "s") for i, t, _ in rows] + [(5, rows[5][1], "again"), (10_000, None, None), (10_001, "", "x"), (None, "no id", "x"), (10_002, "w " * 200_000, "x")]
    spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, y) for i, _, y in rows] + [(0, None), (None, 1), (99_999, 1), (10_000, 0)]
    spark.createDataFrame([(i, y, y, "z") for i, y in labels], "doc_id long, toxic int, quality int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    query = toxicity.op5_toxicity if kind == "toxic" else quality.op6_quality
    out = query(spark, str(tmp_path)).collect()
    assert len(out) == len(docs)
    threshold = 0.3 if kind == "toxic" else 0.5
    known = {i: y for i, _, y in rows}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % parts == held)
    test = [(r["score"], known[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and r["doc_id"] in known]
    score, label, predicted = map(np.array, zip(*test, strict=True))
    assert len(test) > 100 and auc(score, label) > 0.97 and (label == predicted).mean() > 0.93


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows = corpus(300, "toxic")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    turned = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y
    models = [toxicity.train(docs, spark.createDataFrame([(i, f(i, y)) for i, _, y in rows], "doc_id long, toxic int")) for f in (lambda i, y: y, turned)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].intercept == models[1].intercept
    assert (models[0].weights != 0).sum() > 10


def test_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r.score for r in toxicity.scored(docs, toxicity.train(docs, none)).collect()} == {0.5}
    stats = quality.measured(docs)
    assert {r.score for r in quality.scored(stats, quality.train(stats, none)).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0
    assert quality.scored(stats.limit(0), quality.train(stats.limit(0), none)).count() == 0


def test_statistics_of_a_text():
    text = "AB cd, cd\nab 12!\ncd cd, x\n"
    rows = dict(zip(quality.STATISTICS, quality.statistics(pa.array([text, None, ""]))[0], strict=True))
    share = lambda a, b: np.arcsin(np.sqrt(a / b))
    assert rows["words"] == np.log1p(8) and rows["lines"] == np.log1p(3)
    assert np.isclose(rows["distinct_words"], share(5, 8)) and np.isclose(rows["top_word"], share(2, 8))
    assert np.isclose(rows["upper"], share(2, sum(map(str.isalpha, text)))) and np.isclose(rows["digits"], share(2, len(text)))
    assert np.isclose(rows["repeated_lines"], 0) and np.isclose(rows["distinct_triples"], share(6, 6))
    repeated = dict(zip(quality.STATISTICS, quality.statistics(pa.array(["a b\na b\nb a\n a b"]))[0], strict=True))
    assert np.isclose(repeated["repeated_lines"], share(2, 4))


def test_words_and_shingles_are_those_of_the_pattern():
    import re

    rng = random.Random(9)
    texts = ["".join(rng.choice("aB é\t\n\x0b😀.") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    data, offsets = shingles.utf8(pa.array([*texts, None]))
    hashes, _, bounds = shingles.words(data, offsets)
    known, back = {}, {}
    for n, text in enumerate(texts):
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x20\x09-\x0d]+", text)]
        own = hashes[bounds[n] : bounds[n + 1]].tolist()
        assert len(own) == len(words)
        for w, h in zip(words, own, strict=True):
            assert known.setdefault(w, h) == h and back.setdefault(h, w) == w


MASK = (1 << 64) - 1


def mixed(x):
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def plain_buckets(text):
    low = "".join(" " if c.isspace() else c for c in (text or "").lower())
    return {mixed(sum(mixed(ord(c) + (1 << 20)) * pow(0x5851F42D4C957F2D, n, 1 << 64) for n, c in enumerate(low[at : at + size])) + size & MASK) >> 44 for size in (3, 4, 5, 6) for at in range(len(low) - size + 1)}


def test_toxicity_is_the_plain_fit(spark, tmp_path):
    rows = [(i, t[:160] + (" ÉÀ😀 中文字" if i % 3 else ""), y) for i, t, y in corpus(260, "toxic", seed=4)]
    spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x")], "doc_id long, text string, weights string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    has = {i: plain_buckets(t) for i, t, _ in rows} | {900: set()}
    train = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    total = [sum(y == c for _, y in train) for c in (0, 1)]
    counts = {}
    for i, y in train:
        for b in has[i]:
            counts.setdefault(b, [0, 0])[y] += 1
    share = {b: [(n[c] + 1) / (total[c] + 2) for c in (0, 1)] for b, n in counts.items()}
    rate = {b: (sum(n) + 1) / (sum(total) + 2) for b, n in counts.items()}
    telling = {b: abs(share[b][1] - share[b][0]) / (rate[b] * (1 - rate[b]) * (1 / total[0] + 1 / total[1])) ** 0.5 for b in counts}
    best = sorted(sorted((b for b in counts if telling[b] > toxicity.LEAST_TELLING), key=lambda b: (-telling[b], b))[: toxicity.FEATURES])
    assert len(best) > 20
    scale = np.array([np.log(share[b][1] / share[b][0]) for b in best])
    x = np.array([[float(b in has[i]) for b in best] for i, _ in train]) * scale
    x, y = np.column_stack([x, np.ones(len(x))]), np.array([y for _, y in train])
    ridge = np.diag([toxicity.RIDGE] * len(best) + [0.0])
    beta = np.append(np.zeros(len(best)), np.log(total[1] / total[0]))
    for _ in range(40):
        chance = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve(x.T * (chance * (1 - chance)) @ x + ridge, x.T @ (chance - y) + ridge @ beta)
    out = {r.doc_id: r.score for r in toxicity.op5_toxicity(spark, str(tmp_path)).collect()}
    for i, own in has.items():
        logit = sum(scale[n] * beta[n] for n, b in enumerate(best) if b in own) + beta[-1]
        assert abs(out[i] - 1 / (1 + np.exp(-logit))) < 2e-3, i


def test_case_and_accents_of_any_alphabet_fold():
    buckets = lambda t: set(toxicity.present(*toxicity.points(pa.array([t])))[1].tolist())
    assert buckets("ÉCOLE ДОМ Ωμέγα") == buckets("école дом ωμέγα") == plain_buckets("ÉCOLE ДОМ Ωμέγα")
    assert buckets("中文") == set() and len(buckets("中文字")) == 1 and buckets("a\n\u3000b") == plain_buckets("a  b")


def test_quality_is_the_plain_discriminant(spark, tmp_path):
    rows = corpus(300, "quality", seed=6)
    spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, stats string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stats = quality.statistics(pa.array([t for _, t, _ in rows]))
    train = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i, *_ in rows])
    y = np.array([y for *_, y in rows])
    own = [stats[train & (y == c)] for c in (0, 1)]
    count = np.array(list(map(len, own)))
    spread = [np.cov(part.T, bias=True) for part in own]
    target = np.diag(np.diagonal(sum(s * n for s, n in zip(spread, count, strict=True)) / count.sum()) + 1e-6)
    density = []
    for c in (0, 1):
        shrink = min(1.0, quality.SHRINK + stats.shape[1] / (stats.shape[1] + count[c]))
        whole = (1 - shrink) * spread[c] + shrink * target
        apart = stats - own[c].mean(axis=0)
        density.append(np.log(count[c] / count.sum()) - 0.5 * np.linalg.slogdet(whole)[1] - 0.5 * np.einsum("ij,jk,ik->i", apart, np.linalg.inv(whole), apart))
    expected = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / quality.TEMPER, -60, 60)))
    out = {r.doc_id: r.score for r in quality.op6_quality(spark, str(tmp_path)).collect()}
    assert np.allclose([out[i] for i, *_ in rows], expected, atol=1e-7)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id int, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.op5_toxicity(spark, str(tmp_path)).count() == 0 and quality.op6_quality(spark, str(tmp_path)).count() == 0
