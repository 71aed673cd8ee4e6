"""Periodic runs of words by bit-parallel lags.

A text's words get small ids, and the ids are laid out as bit planes: plane k is one big integer whose bit i is bit
k of word i's id. For a lag q, ``plane ^ (plane >> q)`` marks the words that differ from the word q further on in that
bit; the planes' marks are joined by OR, and what stays unmarked is equal in all bits. A run of period q and
length m is a stretch of m - q unmarked bits, so stretches of max(12 - q, q) bits are sought: AND with itself, shifted
by 1, 2, 4 and so on, leaves a bit only where such a stretch starts. Most lags have none in their first plane
and end there after a few operations on whole integers.

Lags of 2 * BLOCK and more need a stretch that holds a whole aligned block of BLOCK words, which then stands again one
lag further on. Only lags at which some aligned block does so are tried, unless blocks recur so often that listing
their distances would cost more than trying every lag; the runs found are the same.

The work on one text is at most quadratic in its words over the machine's word, and nearly linear where few blocks
recur. Texts are independent, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import words_of

LEAST, BLOCK = 12, 8
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
FIELDS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def ids_of(words: list) -> np.ndarray:
    """Words numbered in order of first appearance."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def planes_of(ids: np.ndarray) -> list[int]:
    """Bit planes of the ids; one plane at least."""
    width = max(1, int(ids.max(initial=0)).bit_length())
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(width)]


def long_ones(bits: int, length: int) -> int:
    """Bit i stays where ``length`` set bits begin at i."""
    have = 1
    while have < length and bits:
        step = min(have, length - have)
        bits &= bits >> step
        have += step
    return bits


def stretches(bits: int) -> list[tuple[int, int]]:
    """First and last place of each stretch of set bits."""
    flags = np.unpackbits(np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little")
    steps = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return list(zip(np.flatnonzero(steps == 1).tolist(), (np.flatnonzero(steps == -1) - 1).tolist(), strict=True))


def lags_of(ids: np.ndarray) -> Iterable[int]:
    """The lags, ascending, that can have a run: all short ones, and those at which an aligned block stands again."""
    n, short = len(ids), 2 * BLOCK
    every = range(1, n // 2 + 1)
    if n < 2 * short:
        return every
    # Equal blocks have equal sums; unequal ones that happen to agree only add a lag to try.
    sums = np.zeros(n - BLOCK + 1, np.int64)
    for i in range(BLOCK):
        sums = sums * 1_000_003 + ids[i : n - BLOCK + 1 + i]
    aligned = np.argsort(sums[::BLOCK], kind="stable") * BLOCK
    values = sums[aligned]
    low, high = np.searchsorted(values, sums, "left"), np.searchsorted(values, sums, "right")
    n_pairs = high - low
    if n_pairs.sum() > 8 * n:
        return every
    place = np.repeat(np.arange(len(sums)), n_pairs)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(n_pairs) - n_pairs, n_pairs)
    lags = place - aligned[low[place] + nth]
    return [*range(1, short), *np.unique(lags[(lags >= short) & (lags <= n // 2)]).tolist()]


def runs_of(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run, by start, then period.

    A run is a stretch with smallest period q and at least max(least, 2 q) words that can't be extended at that period.
    A multiple of a run's smallest period gives the same stretch again, which is left out.
    """
    n = len(words)
    if n < least:
        return []
    ids = ids_of(words)
    first, *rest = planes_of(ids)
    full, at = (1 << n) - 1, 0
    found: dict[tuple[int, int], int] = {}
    for q in lags_of(ids):
        full, at = full >> (q - at), q  # the last q words have no word q further on
        need = max(1, least - q, q)
        differ = first ^ (first >> q)
        if not long_ones((differ & full) ^ full, need):
            continue
        for plane in rest:
            differ |= plane ^ (plane >> q)
        left = long_ones((differ & full) ^ full, need)
        for a, b in stretches(left) if left else ():
            found.setdefault((a, b + need + q - a), q)
    return sorted((start, length, q) for (start, length), q in found.items())


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(edge[:-1]) > 0, strict=True) if not inside]


def planted(words: list, h: int) -> list:
    """The contract's change to a text: from word a on, a tenth of the texts repeat a passage of p words."""
    n, g = len(words), h // 10
    if h < 0 or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(words: list) -> tuple:
    """A document's row: runs, the longest of them, and the two hashes."""
    runs = runs_of(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, number of runs, the longest run and hashes of all runs and of the collapsed text.

    A null, empty or blank text has no words: no run, four nulls, hashes of nothing. Repeated rows and rows with a null
    doc_id are documents of their own. Equally long runs: the first start, then the smallest period. Very long
    texts are read whole, each in one task. An empty table gives an empty result; further columns are ignored. With ``plant``,
    texts first get the contract's periodic passages, which a null doc_id never has.
    """
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(-1)) if plant else F.lit(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [digest(planted(words_of(t.as_py()), h)) for t, h in zip(b.column("text"), b.column("h").to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(FIELDS)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *FIELDS])

    return docs.select("doc_id", "text", h.cast("long").alias("h")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with every run cut down to its first period: ``text`` keeps the words outside, joined by one space.

    A text without a run, and a null text, stay as they are, white space included. All columns and rows are kept.
    """
    at = docs.columns.index("text")

    def one(text: str | None) -> str | None:
        words = words_of(text)
        runs = runs_of(words)
        return b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass") if runs else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([one(t.as_py()) for t in b.column(at)], b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
