"""Substring dedup: words inside a passage that has already appeared are removed, found behind a count-min prefilter.

A window is ``size`` consecutive words of one document; a word goes if a window over it has the same words as a window
that starts earlier. Few windows repeat, so those that can't are kept out of the shuffle first:

1. Each window is counted by its anchor, the ten-word stretch in it with the greatest hash. Equal windows have equal
   anchors at equal places, so an anchor occurs at least as often as any of its windows, and neighbouring windows share one:
   there is an anchor to five or six words. A task counts the anchors of some documents at a time and sends
   this sketch in pieces, one to each shard of the hash space: 32-bit codes with counts.
2. A shard merges its pieces into two rows of counters. The lesser of an anchor's two counters is never below its
   count, so whatever occurs twice is estimated to; the shard answers each sketch which of its codes are.
3. The second pass hashes only windows with such an anchor, to 128 bits, and groups them exactly; a task sends each
   distinct window once. Each group's smallest (doc_id, start) is its first place.
4. First places go back to their documents. A document loses what its repeated windows cover, those in first place
   aside.

The sketch grows with the corpus and is never whole in one place; nothing is broadcast, and a window that half of
all documents have is one entry per task. Texts are shuffled once, to meet the answers; both passes after that read the same shuffle.
Windows estimated to repeat that don't are groups of one, so their first place keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.tables import sequential_ids
from ._common import SPACE, stored, words_of

SIZE, GRAM = 20, 10
# Anchors in a task's sketch, and aimed at in a shard; counters for each of them; windows aimed at in a group of the second pass.
SKETCH, SHARD, COUNTERS, GROUP = 1 << 20, 1 << 17, 8, 1 << 18
# Words of a batch that are looked at together, unless one document has more.
WORDS = 1 << 18
MOST_SHARDS = 1 << 17
NULL_ID = -(2**63)
SKETCH_SCHEMA = "shard int, chunk long, codes binary, places binary, counts binary, flags binary"
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_POWERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of each ``size`` consecutive hashes."""
    out, have, rest = None, h, size
    width, start = 1, 0
    while rest:
        if rest & 1:
            take = have[start : start + len(h) - size + 1]
            out = take if out is None else out * np.uint64(pow(base, width, 2**64)) + take
            start += width
        rest >>= 1
        if rest:
            have = have[:-width] * np.uint64(pow(base, width, 2**64)) + have[width:]
            width *= 2
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in zip((30, 27), _MIX, strict=True):
        x = (x ^ (x >> np.uint64(shift))) * factor
    return x ^ (x >> np.uint64(31))


class Windows:
    """The windows of a batch of documents, given their words' hashes, and the windows' anchors.

    ``start``: places of windows in the batch; ``anchor``: for each the number of its anchor, counted over the batch;
    ``values``: the anchors' hashes; ``per_doc``: anchors of each document.
    """

    def __init__(self, h: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> None:
        gram, m = min(GRAM, size), len(h) - size + 1
        lengths = np.diff(offsets)
        self.doc_of_word = np.repeat(np.arange(len(lengths)), lengths)
        if m <= 0:
            self.start = self.anchor = np.zeros(0, np.int64)
            self.values, self.per_doc = np.zeros(0, np.uint64), np.zeros(len(lengths), np.int64)
            return
        g = mixed(rolling(h, gram, _POWERS[0]))
        best = g[:m].copy()
        for j in range(1, size - gram + 1):
            np.maximum(best, g[j : j + m], out=best)
        at = np.zeros(m, np.int64)
        for j in range(size - gram + 1):
            np.copyto(at, np.arange(j, j + m), where=g[j : j + m] == best)
        self.start = np.flatnonzero(self.doc_of_word[:m] == self.doc_of_word[size - 1 :])
        at = at[self.start]
        new = np.diff(at, prepend=-1) != 0
        self.anchor = np.cumsum(new) - 1
        self.values = g[at[new]]
        self.per_doc = np.bincount(self.doc_of_word[at[new]], minlength=len(lengths))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow list column of longs as unsigned values and offsets from 0; null lists are empty."""
    offsets = np.concatenate([[0], np.cumsum(np.nan_to_num(np.asarray(column.value_lengths().fill_null(0)), nan=0).astype(np.int64))])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), offsets


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' documents in pieces of WORDS words or one document, so that memory doesn't follow the batches' size."""
    for b in batches:
        upto, at = np.cumsum(np.asarray(b.column("h").value_lengths().fill_null(0)).astype(np.int64)), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WORDS, "right")))
            yield b.slice(at, end - at)
            at = end


def _packed(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def sketched(chunk: int, d: np.ndarray, th: np.ndarray, values: np.ndarray, per_doc: np.ndarray, shards: int) -> pa.RecordBatch:
    """One sketch: a row per shard with the codes of the anchors, where each is first, and counts; a row for the documents.

    Anchors that this sketch has twice need no answer: ``flags`` marks them.
    """
    key = (values >> np.uint64(32)) % np.uint64(shards) << np.uint64(32) | values & np.uint64(0xFFFFFFFF)
    distinct, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    shard = (distinct >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True):
        order = a + np.argsort(first[a:b])
        rows.append((int(shard[a]), chunk, *_packed(distinct[order].astype(np.uint32), np.diff(first[order], prepend=0).astype(np.uint32), np.minimum(counts[order], 255).astype(np.uint8)), None))
    rows.append((-1, chunk, *_packed(d, th, per_doc.astype(np.uint32), np.packbits(counts[inverse] > 1))))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), *[pa.binary()] * 4], strict=True)], names=["shard", "chunk", "codes", "places", "counts", "flags"])


def repeated_codes(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a code's estimate, the lesser of its counters in two rows, is 2 or more."""
    bits = max(12, int(COUNTERS * len(codes)).bit_length())
    wide = codes.astype(np.uint64)
    cells = (wide & np.uint64((1 << bits) - 1), wide * np.uint64(_POWERS[1]) >> np.uint64(64 - bits))
    rows = [np.bincount(c.astype(np.int64), counts, 1 << bits)[c.astype(np.int64)] for c in cells]
    return np.minimum(*rows) >= 2


def merged(lists: pd.DataFrame) -> pd.DataFrame:
    """A shard's merged sketch, as answers: ``chunk`` and the places whose anchors are estimated to repeat."""
    codes = [np.frombuffer(c, np.uint32) for c in lists["codes"]]
    twice = repeated_codes(np.concatenate(codes), np.concatenate([np.frombuffer(c, np.uint8) for c in lists["counts"]]))
    out, at = [], 0
    for chunk, own, places in zip(lists["chunk"], codes, lists["places"], strict=True):
        found = np.cumsum(np.frombuffer(places, np.uint32), dtype=np.uint32)[twice[at : at + len(own)]]
        at += len(own)
        if len(found):
            out.append((chunk, found.tobytes()))
    return pd.DataFrame(out, columns=["chunk", "places"])


def answered(answers: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
    """``d, th, bits, n`` of the documents of one sketch that have an anchor estimated to repeat: a bit per anchor."""
    out = []
    for row in docs.itertuples():
        d, th, n = np.frombuffer(row.codes, np.int64), np.frombuffer(row.places, np.int64), np.frombuffer(row.counts, np.uint32).astype(np.int64)
        flags = np.unpackbits(np.frombuffer(row.flags, np.uint8))[: n.sum()].astype(bool)
        for places in answers["places"]:
            flags[np.frombuffer(places, np.uint32)] = True
        ends = np.cumsum(n)
        total = np.concatenate([[0], np.cumsum(flags)])
        many = total[ends] - total[ends - n]
        out += [(d[i], th[i], np.packbits(flags[ends[i] - n[i] : ends[i]]).tobytes(), many[i]) for i in np.flatnonzero(many)]
    return pd.DataFrame(out, columns=["d", "th", "bits", "n"])


def _flagged(windows: Windows, bits: list[bytes | None]) -> np.ndarray:
    """Which windows have an anchor that is estimated to repeat."""
    parts = [np.zeros(n, bool) if b is None else np.unpackbits(np.frombuffer(b, np.uint8))[:n].astype(bool) for b, n in zip(bits, windows.per_doc, strict=True)]
    return np.concatenate([*parts, np.zeros(0, bool)])[windows.anchor]


def first_places(h1: np.ndarray, h2: np.ndarray, d: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Indexes, ordered by window, of the occurrences at the smallest (d, start) of their window."""
    order = np.lexsort((start, d, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order[(d[order] == d[head]) & (start[order] == start[head])]


def _word_hashes(lane: int):
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w) if lane == 1 else F.xxhash64(F.lit(lane), w))


def _marked(docs: DataFrame, size: int) -> DataFrame:
    """``row, text, bits, firsts``: flagged anchors, and the starts of windows in first place, packed; both null where there are none."""
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        # Other ids are numbered in their order.
        numbers = sequential_ids(docs.select("doc_id").filter("doc_id is not null").distinct(), ["doc_id"], "__d").withColumnRenamed("doc_id", "__doc")
        docs, d = docs.join(numbers, docs["doc_id"] == numbers["__doc"], "left").drop("__doc"), F.coalesce("__d", F.lit(NULL_ID))
    keyed = docs.select(F.struct(*[c for c in docs.columns if c not in ("text", "__d")]).alias("row"), "text", d.alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    chars = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, chars // 36 // SHARD))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, n = TaskContext.get().partitionId() << 24, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal chunk, held, n
            out = sketched(chunk, *map(np.concatenate, zip(*held, strict=True)), shards)
            chunk, held, n = chunk + 1, [], 0
            return out

        for b in _pieces(batches):
            w = Windows(*_lists(b.column("h")), size)
            held.append((b.column("d").to_numpy(), b.column("th").to_numpy(), w.values, w.per_doc))
            n += len(w.values)
            if n >= SKETCH:
                yield flush()
        if n:
            yield flush()

    sketches = stored(keyed.select("d", "th", _word_hashes(1).alias("h")).mapInArrow(sketch, SKETCH_SCHEMA), "sketches")
    answers = sketches.filter("shard >= 0").select("shard", "chunk", "codes", "places", "counts").groupBy("shard").applyInPandas(merged, "chunk long, places binary")
    of_sketch = sketches.filter("shard < 0").groupBy("chunk")
    flags = stored(answers.groupBy("chunk").cogroup(of_sketch).applyInPandas(answered, "d long, th long, bits binary, n long"), "flags")
    groups = min(MOST_SHARDS, max(1, (flags.agg(F.sum("n")).first()[0] or 0) * 6 // GROUP))
    met = keyed.join(flags.groupBy("d", "th").agg(F.max("bits").alias("bits")), ["d", "th"], "left")

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, n
            h1, h2, d, th, start = map(np.concatenate, zip(*held, strict=True))
            held, n = [], 0
            keep = first_places(h1, h2, d, start)
            part = (h1[keep] % np.uint64(groups)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keep, part = keep[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            rows = [(int(part[a]), *_packed(*(x[keep[a:b]] for x in (h1, h2, d, th, start)))) for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), *[pa.binary()] * 5], strict=True)], names=["part", "h1", "h2", "d", "th", "start"])

        for b in _pieces(batches):
            h, offsets = _lists(b.column("h"))
            w = Windows(h, offsets, size)
            at = w.start[_flagged(w, b.column("bits").to_pylist())]
            if len(at):
                doc = w.doc_of_word[at]
                other = _lists(b.column("other"))[0]
                held.append((rolling(h, size, _POWERS[0])[at], rolling(other, size, _POWERS[1])[at], b.column("d").to_numpy()[doc], b.column("th").to_numpy()[doc], (at - offsets[doc]).astype(np.uint32)))
                n += len(at)
            if n >= SKETCH:
                yield flush()
        if n:
            yield flush()

    def grouped(lists: pd.DataFrame) -> pd.DataFrame:
        h1, h2, d, th, start = (np.concatenate([np.frombuffer(x, kind) for x in lists[c]]) for c, kind in (("h1", np.uint64), ("h2", np.uint64), ("d", np.int64), ("th", np.int64), ("start", np.uint32)))
        keep = first_places(h1, h2, d, start)
        keep = keep[np.lexsort((th[keep], d[keep]))]
        d, th, start = d[keep], th[keep], start[keep]
        cuts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (th[1:] != th[:-1])]))
        return pd.DataFrame([(d[a], th[a], start[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(d)], strict=True)], columns=["d", "th", "firsts"])

    # The row goes along, so that this join reads the very shuffle of texts that the last one reads.
    windows = met.filter("bits is not null").select("row", "d", "th", "bits", _word_hashes(1).alias("h"), _word_hashes(2).alias("other"))
    sent = windows.mapInArrow(repeated, "part long, h1 binary, h2 binary, d binary, th binary, start binary")
    firsts = sent.groupBy("part").applyInPandas(grouped, "d long, th long, firsts binary").groupBy("d", "th").agg(F.collect_list("firsts").alias("firsts"))
    return met.join(firsts, ["d", "th"], "left").select("row", "text", "bits", "firsts", F.when(F.col("bits").isNotNull(), _word_hashes(1)).alias("h"))


def _kept(b: pa.RecordBatch, size: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Each document's words, and which stay."""
    h, offsets = _lists(b.column("h"))
    w = Windows(h, offsets, size)
    flagged = w.start[_flagged(w, b.column("bits").to_pylist())]
    doc = np.searchsorted(offsets, flagged, "right") - 1
    at = np.searchsorted(doc, np.arange(b.num_rows + 1))
    for i, (text, firsts) in enumerate(zip(b.column("text"), b.column("firsts").to_pylist(), strict=True)):
        words = words_of(text.as_py())
        again = flagged[at[i] : at[i + 1]] - offsets[i]
        if firsts:
            again = again[~np.isin(again, np.concatenate([np.frombuffer(f, np.uint32) for f in firsts]))]
        edge = np.zeros(len(words) + 1, np.int64)
        edge[again] += 1
        np.subtract.at(edge, again + size, 1)
        yield words, np.cumsum(edge[:-1]) == 0


def digest(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: a row per document.

    Which is earlier is decided by doc_id, a null before all others, then by start. Rows that share a doc_id share its
    places: repeated rows all get the same result, and neither of two windows at one place is earlier than the other. A
    null, empty or blank text has no words; one of fewer than ``size`` words no window. Long texts are read
    whole, each in one task. An empty table gives an empty result. Further columns are ignored. Windows are
    told apart by 128-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            rows = [(len(words), len(words) - int(keep.sum()), hashlib.sha256(b" ".join([x for x, k in zip(words, keep.tolist(), strict=True) if k])).hexdigest()) for words, keep in _kept(b, size)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("row"), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]], names=["row", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = _marked(docs.select("doc_id", "text"), size).mapInArrow(run, f"row struct<doc_id:{kind}>, n_words long, n_removed long, kept_sha256 string")
    return out.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def deduplicated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` without the words that ``digest`` counts as removed; a text that loses words is its other words, joined by one space.

    Other texts stay as they are, white space included; all rows and columns are kept, whatever they are named.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            cut = [None if keep.all() else b" ".join([x for x, k in zip(words, keep.tolist(), strict=True) if k]).decode("utf-8", "surrogatepass") for words, keep in _kept(b, size)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pc.coalesce(pa.array(cut, b.column("text").type), b.column("text"))], names=["row", "text"])

    marked = _marked(docs, size)
    cut = marked.mapInArrow(run, marked.select("row", "text").schema)
    return cut.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
