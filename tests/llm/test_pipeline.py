import random

import corpus_pipeline
import pyarrow as pa
from tokenizers import Tokenizer

from framelode.llm import bpe, pii, toxicity
from tests.llm.test_classifiers import corpus
from tests.llm.test_decontaminate import plain as plain_leaks
from tests.llm.test_near_dedup import plain_components


def test_rows_are_those_of_each_stage_done_plainly(spark, tmp_path):
    rng = random.Random(6)
    rows = corpus(160, "toxic", seed=8)
    texts, labels = [t for _, t, _ in rows], [y for *_, y in rows]
    item = " ".join(f"item{n}" for n in range(20))
    texts[3] = texts[4] + " tail"
    texts[9] = "mail jo@ex.org " + texts[9]
    texts[12] = texts[12] + " " + item + " end"
    texts[15] = texts[9]
    docs = [(i, t, rng.choice(["en", "de"]), "s", len(t)) for i, t in enumerate(texts)] + [(900, None, "en", None, None), (901, "", "en", "s", 0)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kind).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "other words that nobody ever wrote")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = toxicity.train(spark.createDataFrame(docs, kind), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [(r[0], r[1]) for r in docs if model.scores(pa.array([r[1]], pa.string()))[0] < corpus_pipeline.REJECT]
    assert 50 < len(left) < len(docs) - 20
    left = [(i, t) for i, t in left if i in {d for d, _, c in plain_components(left, 5) if d == c}]
    leaked = {left[n][0] for n, *_ in plain_leaks([t for _, t in left], [item, "other words that nobody ever wrote"])}
    library = Tokenizer.from_file(bpe.default_vocabulary())
    expected = {i: library.encode(pii.redact(t) or "", add_special_tokens=False).ids for i, t in left if i not in leaked}

    out = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == expected and 12 not in out and 15 not in out

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == [c.split()[0] for c in kind.split(", ")]
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_what_the_operator_calls_toxic_is_dropped(spark, tmp_path, monkeypatch):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "mild", "en", "s", 4), (2, "between", "en", "s", 7), (3, "worst", "en", "s", 5)], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    score = {"mild": 0.29, "between": 0.4, "worst": 0.9}
    monkeypatch.setattr(toxicity, "train", lambda *_: None)
    monkeypatch.setattr(toxicity, "scored", lambda docs, _: docs.join(spark.createDataFrame(list(score.items()), "text string, score double"), "text"))
    called = {r["doc_id"] for r in toxicity.op5_toxicity(spark, str(tmp_path)).collect() if r["predicted"]}
    left = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert called == {2, 3} and left == {1}


def test_stages_keep_columns_of_any_name_and_odd_rows(spark, tmp_path):
    rows = corpus(160, "toxic", seed=8)
    names = "score _score _gone _again gone n token_ids decoded pii stats weights place".split()
    docs = [(i, t, "en", "s", len(t), *[float(i)] * len(names)) for i, t, _ in rows] + [(900, None, None, None, None, *[None] * len(names)), (901, "", "en", "s", 0, *[1.0] * len(names)), (None, "no id", "en", "s", 5, *[2.0] * len(names)), (902, "é" * 50_000, "en", "s", 50_000, *[3.0] * len(names))]
    docs += [docs[-1], docs[0]]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} double" for n in names)
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "words that nobody here ever wrote down")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.createDataFrame(docs, kind)
    given = {(r[0], r[1]): r[5:] for r in docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns and out.schema == table.schema, name
        for r in out.collect():
            assert name == "pii" or tuple(r)[5:] == given[r[0], r[1]]
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path))
    assert last.count() == len(docs) and last.columns == ["doc_id", "lang", "source", "token_ids", "n_tokens", "decoded"]
