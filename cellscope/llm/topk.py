"""Exact top-k search by a three-phase uniform threshold over slices of the vectors.

The score, an inner product, is a sum over slices of the dimensions; each slice gives a score list of its own.
Queries come in blocks of bounded size; the rows stay where they are and are never copied for a block.

1. Gather: over one row in SAMPLE_SHARE (SAMPLE_ROWS at least), chosen by hash, each task gives the entries at the head of every
   slice's list, with their full scores. The k-th best of them is a safe cutoff c for a query: no more than
   k - 1 rows of the table can be missing from the answer below it.
2. Collect: the block of queries with its cutoffs is broadcast. A row whose sum over m slices reaches c has a
   slice that reaches c / m, so from each list only the entries from c / m up are collected.
3. Resolve: collected rows get their exact score, the sum of their slices. A task keeps its k best per query,
   ties to smaller ids, and raises its own cutoff to the k-th of them; one window ranks what the tasks return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

QUERY_BLOCK, SAMPLE_ROWS, STRIP, SLICES = 8192, 4096, 64, 4
# One row in so many is gathered first, SAMPLE_ROWS at least: cutoffs tighten with the table, and the rows that pass one stay about k times this.
SAMPLE_SHARE = 64
# Rows of a batch that are scored together.
ROWS = 8192


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component as long.

    Rows with a null id, a null vector, or a null, NaN or infinite component take no part. Rows that
    repeat an id are one vector: the smallest in array order. Further columns are ignored.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("long"))
    usable = rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    return usable.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of longs, filled with zeros where a vector is shorter."""
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v[:width]
    return out


def _same_width(a: np.ndarray, column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The queries' matrix and that of ``column``, over the components that the queries have."""
    b = _matrix(column, a.shape[1])
    # Floats multiply faster and are exact while every sum stays below 2**53.
    if a.size and float(np.abs(a).max()) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return a.astype(np.float64), b.astype(np.float64)
    return a, b


def slices_of(width: int) -> list[slice]:
    cuts = np.linspace(0, width, min(SLICES, max(1, width)) + 1).astype(int)
    return [slice(x, y) for x, y in zip(cuts, cuts[1:], strict=False)]


def _lists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Score lists (slices, queries, rows)."""
    return np.stack([a[:, s] @ b[:, s].T for s in slices_of(a.shape[1])])


def best_of(at: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, then smaller id) of each query, by query, and which of them is a query's k-th."""
    order = np.lexsort((row, -score, at))
    at, row, score = at[order], row[order], score[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    keep = place < k
    return at[keep], row[keep], score[keep], place[keep] == k - 1


def gathered(qid: np.ndarray, a: np.ndarray, rid: np.ndarray, b: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query's place, row id and full score of the k + 1 highest entries of every list, some queries at a time."""
    n = min(k + 1, len(rid))  # one more than k: the query itself may be among them
    for at in range(0, len(a), STRIP):
        lists = _lists(a[at : at + STRIP], b)
        seen = np.argpartition(-lists, n - 1, axis=2)[:, :, :n]
        i = np.broadcast_to(np.arange(lists.shape[1])[None, :, None], seen.shape).ravel()
        pair = np.unique(i.astype(np.int64) * len(rid) + seen.ravel())
        i, j = pair // len(rid), pair % len(rid)
        own = qid[at + i] != rid[j]
        yield (at + i)[own], rid[j[own]], lists[:, i[own], j[own]].sum(axis=0)


def resolved(qid: np.ndarray, a: np.ndarray, cut: np.ndarray, rid: np.ndarray, b: np.ndarray, k: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query's place, row id and exact score of the rows with an entry from c / m up, where the score reaches c.

    With ``k``, only a query's k best of these rows: however many tie, no more than k go on.
    """
    for at in range(0, len(a), STRIP):
        lists = _lists(a[at : at + STRIP], b)
        c = cut[at : at + STRIP]
        i, j = np.nonzero((lists * len(lists) >= c[None, :, None]).any(axis=0))
        exact = lists[:, i, j].sum(axis=0)
        good = (exact >= c[i]) & (qid[at + i] != rid[j])
        found = at + i[good], rid[j[good]], exact[good]
        yield found if k is None else best_of(*found, k)[:3]


class Best:
    """The k best (score, then smaller id) of each query so far."""

    def __init__(self, k: int) -> None:
        self.k, self.at, self.row, self.score = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], cut: np.ndarray) -> None:
        """Take what is ``found``, and raise the cutoffs of queries that have k."""
        parts = list(zip(*found, strict=True)) or [[], [], []]
        at, row = (np.concatenate([own, *map(np.asarray, p)]).astype(np.int64) for own, p in ((self.at, parts[0]), (self.row, parts[1])))
        score = np.concatenate([self.score, *[np.asarray(p, np.int64) for p in parts[2]]])
        self.at, self.row, self.score, last = best_of(at, row, score, self.k)
        cut[self.at[last]] = np.maximum(cut[self.at[last]], self.score[last])


def _search(rows: DataFrame, block, k: int, gather: bool) -> DataFrame:
    """``query_id, vec_id, score``: the k best of each task for each query of the broadcast block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, queries, cut = block.value
        cut, best = cut.copy(), Best(k)
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                part = whole.iloc[at : at + ROWS]
                a, b = _same_width(queries, part["v"])
                rid = part["vec_id"].to_numpy()
                best.add(gathered(qid, a, rid, b, k) if gather else resolved(qid, a, cut, rid, b, k), cut)
        yield pd.DataFrame({"query_id": qid[best.at], "vec_id": best.row, "score": best.score})

    return rows.select("vec_id", "v").mapInPandas(run, "query_id long, vec_id long, score long")


def topk(queries: DataFrame, rows: DataFrame, k: int = 20) -> DataFrame:
    """Each query's k best rows by integer inner product: ``query_id, rank, vec_id, score``.

    Both tables have ``vec_id, v`` with one row per id, as ``integer_vectors`` gives them. A row is no
    candidate of the query of the same id. Ties go to the smaller vec_id; fewer than k candidates are
    all returned; vectors of different lengths are compared over their common components. Vectors may be
    long, in blocks of as many as fit. Empty tables give an empty result.

    A block is about QUERY_BLOCK queries, dealt by hash: only that many vectors ever reach the driver.
    """
    context = rows.sparkSession.sparkContext
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    sample = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, min(SAMPLE_SHARE, rows.count() // SAMPLE_ROWS)))) == 0
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda d: d.withColumn("rank", F.row_number().over(order))
    parts = []
    for n in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).select("vec_id", "v").toPandas().sort_values("vec_id")
        qid, matrix = own["vec_id"].to_numpy(np.int64), _matrix(own["v"], int(own["v"].map(len).max()) if len(own) else 0)
        cut = np.full(len(own), -np.inf)
        first = context.broadcast((qid, matrix, cut))
        safe = ranked(_search(rows.filter(sample), first, k, True)).filter(F.col("rank") == k).select("query_id", "score").toPandas()
        cut[np.searchsorted(qid, safe["query_id"].to_numpy(np.int64))] = safe["score"]
        block = context.broadcast((qid, matrix, cut))
        parts.append(stored(ranked(_search(rows, block, k, False)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best"))
        first.unpersist()
        block.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
