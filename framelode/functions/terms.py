"""Which of a stated set of terms a text holds, all of them in one pass over it."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np

#: Texts that are looked at to learn which terms are common, and how often a common one is found in a text of them, on average: such a term is looked for alone, which ends where it first stands.
PROBED, COMMON = 64, 16


class TermTable:
    """The terms of some queries: (id, terms) each, repeated terms counting each time."""

    def __init__(self, queries: list[tuple[object, list[str]]]):
        self.ids = [i for i, _ in queries]
        self.sizes = np.array([len(terms) for _, terms in queries], np.int64)
        of: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, terms) in enumerate(queries):
            for term, times in Counter(terms).items():
                of[term].append((n, times))
        #: By term: the places of the queries that have it, and how often each does.
        self.of = {term: (np.array([n for n, _ in own], np.int64), np.array([k for _, k in own], np.int64)) for term, own in of.items()}
        #: The terms and their places, and by place where its queries start in ``_queries`` and how many they are.
        self.terms = list(self.of)
        self.at = {term: i for i, term in enumerate(self.terms)}
        none = np.zeros(0, np.int64)
        self._queries, self._times = (np.concatenate([none, *(own[k] for own in self.of.values())]) for k in (0, 1))
        self._many = np.array([len(n) for n, _ in self.of.values()], np.int64)
        self._starts = np.cumsum(self._many) - self._many
        self._forget()

    def _forget(self) -> None:
        self._automaton, self._common, self._probed, self._often = None, [], 0, Counter()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_common": [], "_probed": 0, "_often": Counter()}

    @property
    def pairs(self) -> int:
        """Pairs of a term and a query that has it."""
        return len(self._queries)

    def _build(self, common: set[int]) -> None:
        import ahocorasick

        self._common = [(i, self.terms[i]) for i in sorted(common)]
        self._automaton = ahocorasick.Automaton()
        for i, term in enumerate(self.terms):
            if i not in common:
                self._automaton.add_word(term, i)
        self._automaton.make_automaton()

    def places(self, text: str | None) -> set[int]:
        """The places of the terms that are substrings of the text."""
        if not text or not self.terms:
            return set()
        if self._automaton is None:
            self._build(set())
        if self._probed < PROBED:
            every = Counter(i for _, i in self._automaton.iter(text)) if len(self._automaton) else Counter()
            self._often.update(every)
            self._probed += 1
            if self._probed == PROBED and (common := {i for i, k in self._often.items() if k > COMMON * PROBED}):
                self._build(common)
            return set(every)
        out = {i for _, i in self._automaton.iter(text)} if len(self._automaton) else set()
        out.update(i for i, term in self._common if term in text)
        return out

    def held(self, text: str | None) -> set[str]:
        """The terms that are substrings of the text."""
        return {self.terms[i] for i in self.places(text)}

    def counted(self, rows: Iterable[Iterable[int]]) -> np.ndarray:
        """For each row of places of terms, and each query, how many of the query's terms are among them; a place counts each time."""
        rows = [np.fromiter(r, np.int64) for r in rows]
        every = np.concatenate([np.zeros(0, np.int64), *rows])
        many = self._many[every]
        pair = np.repeat(self._starts[every] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        row = np.repeat(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), many)
        cells = np.bincount(row * len(self.ids) + self._queries[pair], self._times[pair], len(rows) * len(self.ids))
        return cells.astype(np.int64).reshape(len(rows), len(self.ids))

    def counts(self, held: Iterable[str]) -> np.ndarray:
        """For each query, how many of its terms are among these."""
        own = [self.of[term] for term in held if term in self.of]
        if not own:
            return np.zeros(len(self.ids), np.int64)
        return np.bincount(np.concatenate([n for n, _ in own]), np.concatenate([k for _, k in own]), len(self.ids)).astype(np.int64)
