import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from framelode.llm import bpe, token_output
from tests.llm.test_bpe import long_texts, odd_texts


def plain(rows):
    library, start, out = Tokenizer.from_file(bpe.default_vocabulary()), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def rows_of(n, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["the", "été", "shot,", "scene's", "42", "x\x1cy", "<|endoftext|>", "a" * rng.randrange(1, 30)]) for _ in range(rng.choice([0, 1, 5, 60, 900]))) for _ in range(n)]
    return [(i * 3 - 50, t) for i, t in enumerate(texts)]


def test_what_is_read_back_is_the_librarys_ids_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_BYTES", 3000)
    rows = [*rows_of(700, 2), (None, "no id"), (10**15, None), (10**15 + 1, ""), (10**15 + 2, "word " * 40_000)]
    shuffled = random.Random(1).sample(rows, len(rows))
    spark.createDataFrame([(i, t, 1) for i, t in shuffled], "doc_id long, text string, shard int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = [tuple(r) for r in token_output.op4_token_output(spark, str(tmp_path)).collect()]
    assert sorted(out, key=lambda r: r[1]) == plain(rows)


def test_repeated_rows_small_and_empty_tables(spark, tmp_path):
    for n, rows in enumerate(([(1, "a b"), (1, "a b"), (0, "c")], [(5, None)], [])):
        path = f"file://{tmp_path}/{n}"
        token_output.write(spark.createDataFrame(rows, "doc_id long, text string"), path)
        assert sorted((tuple(r) for r in token_output.read(spark, path).collect()), key=lambda r: r[1]) == plain(rows)


def test_one_document_from_its_block(spark, tmp_path):
    rows = rows_of(400, 5)
    path = f"file://{tmp_path}/files"
    token_output.write(spark.createDataFrame(rows, "doc_id long, text string"), path)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    dictionary = bytes(spark.read.format("binaryFile").load(f"{path}/dictionary").first().content)[:-1]
    assert len(dictionary) > 100
    texts, seen = dict(rows), 0
    for r in spark.read.format("binaryFile").load(f"{path}/ids").collect():
        for _, _, entries, ids in token_output.read_blocks(bytes(r.content), dictionary):
            for e, own in zip(entries, ids, strict=True):
                assert own.tolist() == [*library.encode(texts[int(e["doc_id"])], add_special_tokens=False).ids, 2]
                seen += 1
    assert seen == len(rows)


def test_words_of_any_length_and_clashing_columns(spark, tmp_path):
    rows = list(enumerate(long_texts()))
    path = f"file://{tmp_path}/long"
    docs = spark.createDataFrame([(i, t, "x", 7, None) for i, t in rows], "doc_id long, text string, Shard string, n_tokens int, blob string")
    token_output.write(docs, path)
    assert sorted((tuple(r) for r in token_output.read(spark, path).collect()), key=lambda r: r[1]) == plain(rows)


def test_a_cache_that_overflows(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE_UNITS", 40)
    own, library = token_output.Encoder(bpe.default_vocabulary()), Tokenizer.from_file(bpe.default_vocabulary())
    texts = odd_texts()
    for at in range(0, len(texts), 41):
        part = texts[at : at + 41]
        for text, ids in zip(part, own.encode(part), strict=True):
            assert np.frombuffer(ids, own.kind).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
