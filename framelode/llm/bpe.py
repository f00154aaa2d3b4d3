"""BPE encoding and decoding by prefix-sharing trie traversal.

Each distinct word is encoded once. The distinct words of a batch, sorted, are a trie in depth-first order:
the prefix a word shares with the one before it is the path they share from the root. Walking that path, each
node keeps the last token of its prefix's encoding and where that token starts, so the encoding of a shared prefix is
found once. A token that ends at a node is that last token if and only if it follows the last token of what stands before
it without the two merging differently, which depends on the two tokens alone and is remembered. A word's tokens are read
off its path from the end, so time and memory are linear in its length.

A text is taken apart into units: its words, where the whole text is of characters that are in normal form and whose
class is known here, else its pieces between white space (neither normalising nor splitting ever reaches across
that), which the vocabulary's own rules turn into words. Codes of units are kept in a cache that is bounded in their number
and length; a unit that falls out of it, or is too long for it, is encoded again.

Defined cases: null text is empty; empty and white-space texts have no ids; special tokens that stand in a text
become their ids, as the library does it; words of any length; repeated rows each get their row; an empty table gives no rows; other columns are not
read, and those that clash with an added one are replaced.
"""

from __future__ import annotations

import gc
import json
import re
from collections import ChainMap
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from framelode.llm import common

#: Units whose codes a worker keeps, at most twice over, and how long the longest of them is.
CACHE_WORDS, CACHE_LENGTH = 100_000, 64
#: Pairs of tokens whose compatibility a worker keeps.
CACHE_PAIRS = 200_000

#: Python's str.split() also splits at these four, the vocabulary's white space does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: ASCII but for control characters, Latin-1 letters and signs, dashes, quotes, dots and currency signs: each is in normal form, none joins with another.
_PLAIN = re.compile("[\t-\r -~\xa0-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*").fullmatch
#: Words of such text in lower case: letters, a digit, an English ending, or what is neither of these nor white space.
_WORDS = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \xa00-9a-zß-öø-ÿ]+").findall


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(text: str) -> list[str]:
    """What stands between the vocabulary's white space."""
    return _WHITE.findall(text) if _SEPARATORS.search(text) else text.split()


def units(text: str) -> list[str]:
    """The text's words if it is plain, else its pieces; each has ids of its own, in either case the same."""
    return _WORDS(text.lower()) if _PLAIN(text) else pieces(text)


def _byte_letters() -> dict[int, str]:
    """Byte to letter, as byte-level vocabularies write bytes: printable ones are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}


_BYTE_LETTERS = _byte_letters()


class Splitter:
    """Units to words in the vocabulary's byte letters: plain ones here, all others by the vocabulary's own rules. Special
    tokens are not looked for."""

    def __init__(self, library):
        self.normalize, self.words_of = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def __call__(self, unit: str) -> list[str]:
        if not _PLAIN(unit):
            return [w for w, _ in self.words_of(self.normalize(unit))]
        words = _WORDS(unit.lower())
        return words if unit.isascii() else [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LETTERS) for w in words]


class TrieBpe:
    """Encoder and decoder of one vocabulary file of the kind "BPE with word ends"."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.end: str = spec["model"]["end_of_word_suffix"]
        merges = spec["model"]["merges"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): n for n, m in enumerate(merges)}
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that strip or are normalised are not supported")
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split_words = Splitter(Tokenizer.from_file(path))
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        #: By pair of tokens: the rank of the rule that joins them. By token: the rank that makes it, and from what; -1 for a single symbol.
        self.joins = {self.vocab[a] << 32 | self.vocab[b]: n for (a, b), n in self.ranks.items()}
        self.parts = {i: (-1, i, i) for i in self.names}
        for (a, b), n in reversed(self.ranks.items()):
            self.parts[self.vocab[a + b]] = (n, self.vocab[a], self.vocab[b])
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.codes: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.older_text: dict[str, str] = {}
        self.decimal = {i: str(i) for i in self.names}
        self.named = {str(i): t for i, t in self.names.items()}

    def symbols(self, token: int) -> list[str]:
        name = self.names[token]
        if name.endswith(self.end) and len(name) > len(self.end):
            body = name.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return [*name]

    def merged(self, symbols: list[str]) -> list[str]:
        """The merge rules applied in the order of their rank, leftmost first: the definition itself, for single pairs."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 30), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 30:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are the encoding of their text: no rule joins what stands at their
        border at some time before the one or the other is built into what holds it. At one rank the leftmost goes first."""
        key = left << 32 | right
        if (known := self.pairs.get(key)) is not None:
            return known
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        joins, parts, never = self.joins.get, self.parts, 1 << 30
        a, b, a_until, b_until, known = left, right, never, never, True
        while True:
            rank = joins(a << 32 | b, never)
            if rank < a_until and rank <= b_until and rank < never:
                known = False
                break
            (ra, _, a_next), (rb, b_next, _) = parts[a], parts[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                a, a_until = a_next, ra
            else:
                b, b_until = b_next, rb
        self.pairs[key] = known
        return known

    def stands(self, token: int) -> bool:
        """Whether the token is the encoding of its own text."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merged(self.symbols(token)) == [self.names[token]]
        return known

    def encode_words(self, words: list[str]) -> dict[str, str]:
        """The decimal ids of each distinct word, joined by spaces, by a depth-first walk of the words' trie."""
        get, end, longest, follows, stands, shown = self.vocab.get, self.end, self.longest, self.follows, self.stands, self.decimal
        out: dict[str, str] = {}
        #: At each depth, for the prefix: its last token, and where that starts.
        last, starts, before = [-1], [0], ""

        def elsewhere(word: str, depth: int, suffix: str, near: int) -> tuple[int, int]:
            for start in range(near - 1, max(-1, depth - longest - 1), -1):
                token = get(word[start:depth] + suffix)
                if token is not None and (follows(last[start], token) if start else stands(token)):
                    return token, start
            raise ValueError(f"no token of the vocabulary ends {word[:depth][-longest:]!r}")

        for word in sorted(words):
            shared, size = 0, len(word)
            most = min(len(before), size) - 1
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], starts[shared + 1 :]
            for depth in range(shared + 1, size):
                # exactly one token can be the last one; those that grow from the node before are tried first
                for start in range(starts[depth - 1], depth):
                    token = get(word[start:depth])
                    if token is not None and (follows(last[start], token) if start else stands(token)):
                        break
                else:
                    token, start = elsewhere(word, depth, "", starts[depth - 1])
                last.append(token)
                starts.append(start)
            for start in range(starts[size - 1], size):
                token = get(word[start:] + end)
                if token is not None and (follows(last[start], token) if start else stands(token)):
                    break
            else:
                token, start = elsewhere(word, size, end, starts[size - 1])
            code = [shown[token]]
            while start:
                code.append(shown[last[start]])
                start = starts[start]
            code.reverse()
            out[word] = " ".join(code)
            before = word
        return out

    def learn(self, wanted: set[str]) -> dict[str, str]:
        """Put the codes of these units into the cache, where those that were there before may go, and what they decode to
        beside them; the codes of the units that are too long for it are returned."""
        if len(self.codes) > CACHE_WORDS:
            self.older, self.codes, self.older_text, self.decoded = self.codes, {}, self.decoded, {}
        fresh, words = [], set()
        for unit in wanted.difference(self.codes):
            if (code := self.older.get(unit)) is not None:
                self.codes[unit], self.decoded[unit] = code, self.older_text[unit]
                continue
            own = self.split_words(unit)
            fresh.append((unit, own))
            words.update(own)
        known = self.encode_words(list(words))
        long = {}
        for unit, own in fresh:
            code = known[own[0]] if len(own) == 1 else " ".join([known[w] for w in own])
            if len(unit) > CACHE_LENGTH:
                long[unit] = code
            else:
                self.codes[unit], self.decoded[unit] = code, self.decode_decimal(code)
        return long

    def parts_of(self, text: str) -> list[str]:
        """The text's units, special tokens apart."""
        if not any(t in text for t in self.special):
            return units(text)
        return [p for part in self.cut_special.split(text) for p in ([part] if part in self.special else pieces(part))]

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its decimal ids, joined by spaces, and what they decode to."""
        every = [self.parts_of(text) for text in texts]
        wanted = set().union(*every)
        special = wanted.intersection(self.special)
        codes, decoded = {t: str(self.special[t]) for t in special}, {t: t for t in special}
        codes |= self.learn(wanted - special)
        if not codes:
            codes, decoded = self.codes, self.decoded
        else:
            decoded |= {u: self.decode_decimal(c) for u, c in codes.items() if u not in special}
            codes, decoded = ChainMap(codes, self.codes), ChainMap(decoded, self.decoded)
        for own in every:
            yield " ".join(filter(None, map(codes.__getitem__, own))), " ".join(filter(None, map(decoded.__getitem__, own)))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in next(self.encode_texts([text or ""]))[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Special tokens stay; without a decoder in the file, the tokens stand joined by spaces."""
        return " ".join(self.names[i] for i in ids if i in self.names)

    def decode_decimal(self, joined: str) -> str:
        """The same for ids as this encoder writes them."""
        return " ".join(map(self.named.__getitem__, joined.split(" "))) if joined else ""


def _each(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, str]]]]:
    """Slices of the batches, with each text's ids, decimal and joined by spaces, and what they decode to."""
    bpe = TrieBpe(path or default_vocabulary())
    gc.disable()  # the caches hold no cycles, and walking them again and again costs more than all the rest
    try:
        for batch in common.by_text_bytes(batches, most=2 << 20):
            yield batch, list(bpe.encode_texts([t or "" for t in batch.column("text").to_pylist()]))
    finally:
        gc.enable()


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``token_ids`` array<int> and ``decoded`` string. ``vocabulary``: the file's path on every executor."""
    docs = common.clear_of(docs, "token_ids", "decoded")
    schema = StructType([*docs.schema.fields, StructField("token_ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _each(batches, vocabulary):
            each = [np.fromstring(joined, np.int32, sep=" ") for joined, _ in rows]
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), pa.array(np.concatenate(each)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array([d for _, d in rows], pa.string())], [*batch.schema.names, "token_ids", "decoded"])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document's ids and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _each(batches, vocabulary):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([j.count(" ") + 1 if j else 0 for j, _ in rows], pa.int64()),
                    pa.array([sha256(j.encode()).hexdigest() for j, _ in rows], pa.string()),
                    pa.array([sha256(d.encode()).hexdigest() for _, d in rows], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.light_batches(spark)
    return digests(common.documents(spark, sf_dir))
