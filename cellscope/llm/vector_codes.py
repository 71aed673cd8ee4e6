"""Vector code compression: product quantisation with integer codebooks.

Vectors are cut into equal parts, and each part is coded by the nearest entry of its part's codebook. Codebooks are a
few thousand integers and are broadcast. A task takes Arrow batches of vectors and gets all distances of a part at
once from |x|^2 - 2 x c + |c|^2, with matrix products of 64-bit integers, which are exact; the first of the least
distances wins. Each round, tasks return one sum and count per entry, a shuffle grouped by part and entry merges
them, and the merged sums, whose number depends on the codebooks alone, become the next codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard
from ._common import hub_join, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
# Rows of a batch that are compared with a codebook at once.
STRIP = 4096
# With components below this, no square, product or sum over a part of up to 2**10 components leaves 64 bits.
LARGEST = 2**25


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: float = 256.0) -> DataFrame:
    """``vec_id, label, v``: floor(scale * x) of each component, as long.

    Rows with a null vector, or a null, NaN or infinite component, are dropped. Rows that repeat an id are rows of
    their own; a null id and a null label stay. Further columns are ignored.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("long"))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return rows.filter(F.col(vector_col).isNotNull() & ~bad).select(F.col(id_col).alias("vec_id"), label.alias("label"), v.alias("v"))


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """``(parts, entries, width)``: the vectors of the smallest ids, ascending; equal ids in array order, null ids last.

    With fewer vectors there are fewer entries. Their length has to be a multiple of ``parts``.
    """
    head = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.array([r["v"] for r in head], np.int64) if head else np.zeros((0, parts), np.int64)
    if start.shape[1] % parts or not start.shape[1]:
        raise ValueError(f"vectors of {start.shape[1]} components can't be cut into {parts} equal parts")
    return np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2))


def matrix_of(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix of 64-bit integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width or (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError(f"all vectors must have {width} components, as that of the smallest id has")
    if np.abs(flat).max(initial=0) >= LARGEST:
        raise ValueError(f"scaled components must stay below {LARGEST} for exact distances")
    return flat.reshape(len(column), width)


def nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, ties to the first, and its squared distance."""
    distances = (x * x).sum(axis=1)[:, None] - 2 * (x @ codebook.T) + (codebook * codebook).sum(axis=1)[None, :]
    code = distances.argmin(axis=1)
    return code, distances[np.arange(len(x)), code]


def _strips(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Pieces of the batches, and for each part its vectors, codes and distances."""
    parts, _, width = books.shape
    for whole in batches:
        for at in range(0, whole.num_rows, STRIP):
            b = whole.slice(at, STRIP)
            cut = matrix_of(b.column("v"), parts * width).reshape(b.num_rows, parts, width)
            yield b, [(x, *nearest(x, book)) for x, book in zip(cut.transpose(1, 0, 2), books, strict=True)]


def next_codebooks(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the componentwise floor of its parts' mean; an entry without parts stays."""
    parts, entries, width = books.shape
    context = vectors.sparkSession.sparkContext
    sent = context.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for _, cut in _strips(batches, books):
            for p, (x, code, _) in enumerate(cut):
                np.add.at(sums[p], code, x)
                counts[p] += np.bincount(code, minlength=entries)
        part, entry = np.nonzero(counts)
        columns = [part, entry, counts[part, entry]]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    tasks = vectors.select("v").mapInArrow(run, "part long, entry long, n long, total array<long>")
    # Decimals, as long sums could overflow over all tasks.
    merged = tasks.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(width)]).alias("total")).collect()
    out = books.copy()
    for r in merged:
        out[r["part"], r["entry"]] = [int(t) // r["n"] for t in r["total"]]
    sent.unpersist()
    return out


def encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error``: two hex digits for each part's entry, and the squared distances' sum."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, cut in _strips(batches, sent.value):
            digits = np.stack([code for _, code, _ in cut], axis=1).astype(np.uint8).tobytes().hex()
            step = 2 * len(cut)
            codes = pa.array([digits[i : i + step] for i in range(0, len(digits), step)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), codes, pa.array(sum(e for _, _, e in cut), pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = [f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label")]
    return vectors.select("vec_id", "label", "v").mapInArrow(run, ", ".join([*kinds, "code string, error long"]))


def decoded(codes: list[str], books: np.ndarray) -> np.ndarray:
    """The integer vectors that the codes stand for."""
    at = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(len(codes), len(books))
    return np.concatenate([book[at[:, p]] for p, book in enumerate(books)], axis=1)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over equal labels, nulls together.

    Sums are made before any shuffle of rows; labels that many rows have meet their sum by broadcast.
    """
    own = stored(coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes")
    sums = stored(own.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return hub_join(own, sums, "key", own.count()).drop("key")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every usable row.

    Rows with a null vector or a null or non-finite component are dropped; rows that repeat an id, and rows with a null
    id, are coded each for itself. Ties go to the lower entry. All vectors must have one length, a multiple of
    ``parts``; long vectors make wider parts. Scaled components must stay below LARGEST. ``entries`` is 256 at most.
    Without usable rows the result is empty. Further columns are ignored.
    """
    vectors = stored(integer_vectors(rows, id_col, vector_col, label_col), "vectors")
    if vectors.isEmpty():
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds):
        books = next_codebooks(vectors, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = with_label_error(encoded(vectors, books)).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
    discard(vectors)
    return out
