"""Sums of per-word results over whole texts, with a bounded memo of words.

A linear model scores a text as a sum over its words of a function of the word alone. Words repeat, so each worker keeps what it has computed; the memo is emptied when its keys reach ``MEMO_BYTES``, which
changes the time and never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from ._common import words_of

CHUNK_CHARS = 1_500_000
MEMO_WORDS = 350_000
MEMO_BYTES = 12_000_000


class WordSums:
    """``score``: a list of words -> an array with a row of ``width`` numbers for each. ``tokens``: a text's words."""

    def __init__(self, score: Callable[[list[bytes]], np.ndarray], width: int, tokens: Callable[[str | None], list[bytes]] = words_of) -> None:
        self.score, self.width, self.tokens = score, width, tokens
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((1024, self.width), np.float32)
        self.bytes = 0

    def _learn(self, words: list[bytes]) -> None:
        at = len(self.index)
        if at + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(words), at), self.width), np.float32)])
        self.table[at : at + len(words)] = self.score(words)
        self.index.update(zip(words, range(at, at + len(words)), strict=True))
        self.bytes += sum(map(len, words))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """A row of sums per text; zeros for a text without words."""
        parts = [self._sums(c) for c in _chunks(texts)]
        return np.concatenate(parts) if parts else np.zeros((0, self.width))

    def _sums(self, texts: list[str | None]) -> np.ndarray:
        if len(self.index) > MEMO_WORDS or self.bytes > MEMO_BYTES:
            self._forget()
        lists = [self.tokens(t) for t in texts]
        fresh = set().union(*lists).difference(self.index) if lists else set()
        if fresh:
            self._learn(sorted(fresh))
        out = np.zeros((len(texts), self.width))
        get = self.index.__getitem__
        for i, words in enumerate(lists):
            if words:
                out[i] = self.table[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        return out


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= CHUNK_CHARS):
            size += len(texts[upto] or "")
            upto += 1
        yield texts[at:upto]
        at = upto


_current: tuple[str, WordSums] | None = None


def of_model(model_id: str, make: Callable[[], WordSums]) -> WordSums:
    """The worker's memo for a model; tasks of one worker share it, another model replaces it."""
    global _current
    if _current is None or _current[0] != model_id:
        _current = (model_id, make())
    return _current[1]
