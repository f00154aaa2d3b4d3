import random
from hashlib import sha256
from time import process_time

from tokenizers import Tokenizer

from framelode.llm import bpe

PATH = bpe.default_vocabulary()


def odd_texts():
    rng = random.Random(7)
    letters = "abcdefghijABC  ''stre0123.,!\t\n\x1c\x1f  \x85éÉßΣσςİǅ中文字кириáﬁ😀👍<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += ["".join(rng.choice("aaabbththeernn") for _ in range(rng.randint(1, 80))) for _ in range(600)]
    return texts + ["", " \n\t", "a" * 5000, "x<|endoftext|>y <|startoftext|><|endoftext|>", "it's we'll 'S İSTANBUL", "word " * 3000]


def test_every_id_and_the_decoded_text_are_the_librarys():
    own, library = bpe.TrieBpe(PATH), Tokenizer.from_file(PATH)
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_the_batch_form_and_a_cache_that_overflows(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 30)
    own, library = bpe.TrieBpe(PATH), Tokenizer.from_file(PATH)
    texts = odd_texts()
    for at in range(0, len(texts), 37):
        for text, (joined, shown) in zip(texts[at : at + 37], own.encode_texts(texts[at : at + 37]), strict=True):
            ids = library.encode(text, add_special_tokens=False).ids
            assert joined == " ".join(map(str, ids))
            assert shown == own.decode_decimal(joined) == library.decode(ids, skip_special_tokens=False)


def long_texts():
    rng = random.Random(11)
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(100_000))
    return [letters, chinese, letters[:100_000] + "x", "é" * 30_000, "'" * 50_000, "before " + letters[:5000] + " <|endoftext|> " + chinese[:3000]]


def test_words_of_any_length_in_linear_time_and_memory():
    own, library = bpe.TrieBpe(PATH), Tokenizer.from_file(PATH)
    texts = long_texts()
    for text, (joined, shown) in zip(texts, own.encode_texts(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert joined == " ".join(map(str, ids)) and shown == library.decode(ids, skip_special_tokens=False)
    assert max(map(len, own.codes), default=0) <= bpe.CACHE_LENGTH
    seconds = []
    for n in (50_000, 200_000):
        since = process_time()
        own.encode(texts[0][:n])
        seconds.append(process_time() - since)
    assert seconds[1] < 12 * max(seconds[0], 0.02)


def test_plain_text_and_its_pieces_have_the_same_ids():
    own, library = bpe.TrieBpe(PATH), Tokenizer.from_file(PATH)
    every = [chr(c) for c in range(0x2100) if chr(c) != "<"]
    for a in range(0, len(every), 7):
        text = " x".join(every[a : a + 7]) + "y" + "".join(every[a : a + 7]) + "'re\u2019s"
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    for c in filter(bpe._PLAIN, every):
        text = f"it{c}s 'll{c}{c}d{c}'S"
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_long_words_through_the_operator(spark):
    texts = long_texts()
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.token_ids for r in bpe.encoded(docs).collect()}
    assert found == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_query_and_operator_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    texts = [*odd_texts()[:40], None, "same", "same"]
    rows = [(i if i != 5 else None, t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, Token_IDs string").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(PATH)
    expected = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(shown.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, bpe.op2_bpe(spark, str(tmp_path)).collect()), key=key) == sorted(expected, key=key)
    out = bpe.encoded(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    assert {(r.text or "", tuple(r.token_ids)) for r in out.collect()} == {(t or "", tuple(library.encode(t or "", add_special_tokens=False).ids)) for t in texts}


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(empty).count() == 0
    assert bpe.encoded(empty).count() == 0
