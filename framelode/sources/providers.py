"""Interfaces of what the engine asks outside itself, and stand-ins that always answer the same.

Models, detectors and media tools are not part of this engine. A provider answers a batch of requests; ``asked`` calls it for the rows
of a table in batches of bounded size, retries an empty answer with growing pauses, and gives null where it stays empty.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIES, BATCH, MOST_CHARS = 3, 20, 8000


class TextProvider(Protocol):
    def answer(self, prompts: list[str]) -> list[str | None]: ...


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Recorded:
    """Answers from a table of recorded ones; none for what was never asked."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def answer(self, prompts: list[str]) -> list[str | None]:
        return [self.answers.get(p) for p in prompts]


class HashEmbedding:
    """Unit vectors that follow from the text's words alone."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            total = np.zeros(self.size)
            for word in text.lower().split() or [" "]:
                seed = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "little")
                total += np.random.default_rng(seed).normal(size=self.size)
            out.append((total / np.linalg.norm(total)).tolist())
        return out


class EvenRelevance:
    """A reranker that answers with the share of the query's words in each candidate."""

    def answer(self, prompts: list[str]) -> list[str | None]:
        out = []
        for prompt in prompts:
            query, *candidates = prompt.split("\n")
            words = query.lower().split()
            out.append(json.dumps([{"index": i, "relevance_score": sum(w in c.lower() for w in words) / max(len(words), 1)} for i, c in enumerate(candidates)]))
        return out


def _retried(call, requests: list[str], pause: float) -> list:
    left, out = list(range(len(requests))), [None] * len(requests)
    for n in range(TRIES):
        for i, found in zip(left, call([requests[i] for i in left]), strict=True):
            out[i] = found or None
        left = [i for i in left if out[i] is None]
        if not left:
            break
        if n + 1 < TRIES:
            time.sleep(pause * 2**n)
    return out


def asked(rows: DataFrame, column: str, provider: TextProvider, name: str = "answer", pause: float = 1.0) -> DataFrame:
    """``rows`` with the provider's answer to each prompt of ``column``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), BATCH):
                own = part.iloc[at : at + BATCH]
                yield own.assign(**{name: _retried(provider.answer, own[column].tolist(), pause)})

    return rows.mapInPandas(run, f"{', '.join(f'`{c}` {t}' for c, t in rows.dtypes)}, `{name}` string")


def embedded(rows: DataFrame, column: str, provider: EmbeddingProvider, name: str = "embedding") -> DataFrame:
    """``rows`` with vectors of the first 8000 characters of ``column``, blank texts as one space."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), BATCH):
                own = part.iloc[at : at + BATCH]
                texts = [(t or "")[:MOST_CHARS].strip() or " " for t in own[column]]
                yield own.assign(**{name: provider.embed(texts)})

    return rows.mapInPandas(run, f"{', '.join(f'`{c}` {t}' for c, t in rows.dtypes)}, `{name}` array<double>")


def rerank_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """(query_id, index, relevance, pos) from a reranker's JSON lists; what can't be read gives no rows."""
    from framelode.functions import text as T

    items = F.from_json(T.json_block(F.col(column)), "array<struct<index: int, relevance_score: double>>")
    return answers.select("query_id", F.posexplode(items).alias("pos", "x")).select("query_id", F.col("x.index").alias("index"), F.coalesce("x.relevance_score", F.lit(0.0)).alias("relevance"), "pos")
