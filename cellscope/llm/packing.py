"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

Every task packs the documents it reads, in one pass: texts are tokenized once, nothing is shuffled, and
a lost task packs the same rows into the same windows again. Documents gather into batches of about
``BATCH_WINDOWS`` windows of tokens, so memory is bounded by the batch and one document.

Of each document, whole windows are cut off first. What remains is cut into parts of at most ``GRAIN``
tokens; differencing then deals the parts of the batch into k windows: each part starts as a partition
of its own with k subsets, and the two partitions with the largest imbalance are merged again and again,
the fullest subset of one meeting the emptiest of the other. k starts at the least that could hold all
tokens and rises whenever a window exceeds the capacity. Parts of one document that meet in a window and
follow each other are joined into one piece.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 2048
END_ID = 1
BATCH_WINDOWS = 192
GRAIN = 256
# Fixed value: how byte-level vocabularies of this kind split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in k subsets of nearly equal sum. Ties go by index, so reruns agree.

    Subsets that are still empty are not stored: a partition is its non-empty subsets, largest first.
    """
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    stamp = len(sizes)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        # Largest of a meets smallest of b; as both may have empty subsets, only the overlap is merged.
        spare = max(0, len(a) + len(b) - k)
        merged = a[: len(a) - spare] + b[: len(b) - spare]
        for (x, xs), (y, ys) in zip(a[len(a) - spare :], reversed(b[len(b) - spare :]), strict=True):
            merged.append((x + y, xs + ys))
        merged.sort(key=lambda s: -s[0])
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[0][0], stamp, merged))
        stamp += 1
    return [members for _, members in heap[0][2]] if heap else []


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Subsets whose sums stay within ``capacity``, as few as differencing reaches."""
    k = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    while True:
        subsets = differencing(sizes, k) if k else []
        if all(sum(sizes[i] for i in s) <= capacity for s in subsets):
            return subsets
        k += max(1, k // 200)


def _parts(n: int, capacity: int, grain: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's whole windows, then of the parts of what remains."""
    whole = n // capacity * capacity
    yield from ((s, capacity) for s in range(0, whole, capacity))
    rest = n - whole
    if rest:
        count = -(-rest // grain)
        cuts = [whole + rest * i // count for i in range(count + 1)]
        yield from ((a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))


def pack_batch(docs: list[np.ndarray], first: int, capacity: int = WINDOW, grain: int = GRAIN) -> tuple[list[tuple], int]:
    """Pieces of the given documents' token ids, each with its document's place among them, and the next free sequence number."""
    out, parts, sequence = [], [], first
    for d, ids in enumerate(docs):
        for start, length in _parts(len(ids), capacity, grain):
            if length == capacity:
                out.append((d, start, length, sequence, 0))
                sequence += 1
            else:
                parts.append((d, start, length))
    for members in windows_of([p[2] for p in parts], capacity):
        offset, pieces = 0, []
        for d, start, length in sorted(parts[i] for i in members):
            if pieces and pieces[-1][0] == d and pieces[-1][1] + pieces[-1][2] == start:
                pieces[-1][2] += length
            else:
                pieces.append([d, start, length, sequence, offset])
            offset += length
        out += map(tuple, pieces)
        sequence += 1
    crc = zlib.crc32
    return [(d, s, n, crc(docs[d][s : s + n].tobytes()), len(docs[d]), q, o) for d, s, n, q, o in out], sequence


def _byte_chars() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself, or the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(tokenizer: str):
    """texts -> ids as unsigned 32-bit little-endian, with the end id.

    ``tokenizer`` is a file's path, or the name of a public vocabulary; it is looked up and read where this
    runs, on the executors.

    The ids are those of the ``tokenizers`` library. For Latin-1 texts without a special token's name
    they are taken from an encoder that is built from the same file's vocabulary and gives the same ids
    at a fifth of the time (a test compares the two); any other text goes through the library itself.
    """
    import json

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if not os.path.exists(tokenizer):
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    chars = _byte_chars()
    ranks = {bytes(chars[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    quick = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: Iterable[str]) -> Iterator[np.ndarray]:
        for text in texts:
            if text.isascii() or _latin(text):
                if not any(s in text for s in special):
                    yield np.array([*quick.encode_ordinary(text), END_ID], "<u4")
                    continue
            yield np.array([*library.encode(text, add_special_tokens=False).ids, END_ID], "<u4")

    return encode


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pack(docs: DataFrame, tokenizer: str, capacity: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the end id alone. Repeated rows and rows with a null doc_id are documents of
    their own. sequence_id is unique over all tasks: the task's partition number in the upper bits, a
    running number below. A very long text is cut into whole windows. An empty table gives no pieces. Ids
    pass through as Arrow values of their own type. Further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        names: list[pa.Array] = []  # ids of the held documents, a slice per batch they came in
        held: list[np.ndarray] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, names, held, tokens
            rows, sequence = pack_batch(held, sequence, capacity, grain)
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            ids = pa.concat_arrays(names).take(cols[0])
            names, held, tokens = [], [], 0
            return pa.RecordBatch.from_arrays([ids, *cols[1:]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            ids, first = b.column("doc_id"), 0
            for i, e in enumerate(encode(t.as_py() or "" for t in b.column("text"))):
                held.append(e)
                tokens += len(e)
                if tokens >= BATCH_WINDOWS * capacity:
                    names.append(ids.slice(first, i + 1 - first))
                    first = i + 1
                    yield flush()
            names.append(ids.slice(first))
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
