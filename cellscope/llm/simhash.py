"""SimHash near-duplicates through an inverted index over byte positions with count filtering.

A fingerprint of B bytes is B (position, byte) entries. Two fingerprints that differ in at most d bits
differ in at most d bytes, so they share at least B - d positional bytes: the guaranteed minimum. Lists of
the index are keyed by several entries at once, so that they are short; for the pairs of a list the shared
positional bytes are tallied over all positions, pairs below the minimum are dropped, and the others are
verified by their Hamming distance.

* With a guaranteed minimum (64 bits, d = 2: 6 of 8) positions form d + 2 blocks, of which a linked pair
  shares two or more whole: there is a list for each two blocks, six of four bytes each. A list that grows
  frequent is split by two further positions, six ways, as its linked pairs share at least two of the rest;
  such a list holds at most 256**d different fingerprints. Nothing is lost on the way.
* Wide fingerprints for similarity thresholds (512 bits for 0.8) have no guaranteed minimum. The tally asks
  for LEAST of 64, and for two within one group of eight positions: every pair of positions of a group
  makes lists, which are dealt out by the first byte and divided by the second where they arrive. By
  calculation a pair at 0.80 misses all groups with probability 1.2e-4, the tally with 2e-4, and the wider
  distance with 0.7e-4; 17 shared bytes are expected of it. Long lists are dealt out in tiles.

Only links that connect are returned: all of a short list, a spanning forest of a long one, so groups of
thousands of copies never become all pairs. Equal fingerprints are collapsed before the index is built.

Where texts must reach a similarity, the distance only proposes. Links too close to be in doubt are taken, as
above. Of all others up to a wider distance no pair is made: their members are marked, and marked texts
are compared exactly. Each is listed under the rarest of its shingles, as many as it must share one of with
any text alike, and pairs that are still in different components are checked where their sizes and places
in the list leave room for the similarity. No pair is left undecided, and of the many pairs of a crowd that
are near but not alike hardly any is ever made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import hub_join, stored, words_of
from .components import connected_components

SEED = 42
SHORT_LIST = 32
TILE = 20_000
# Positions whose pairs are all tried; pairs of fingerprints looked at together.
GROUP = 8
BLOCK = 1 << 18
# Shared positional bytes that a pair of wide fingerprints needs; members from which a list is frequent.
LEAST = 6
FREQUENT = 4096
BROADCAST_LISTS = 100_000
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
# Estimated similarities are off by 0.036 at 0.8 (512 bits): proposals start WIDER below, doubt ends MARGIN above.
WIDER = 0.15
MARGIN = 0.12
_STEP = 0x9E3779B97F4A7C15


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """The ``size``-word shingles of a text, repeats included; a shorter text is one shingle."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [joined[starts[i] : ends[i + size - 1] - 1] for i in range(len(words) - size + 1)]


def _mixed(h: np.ndarray, block: int) -> np.ndarray:
    """Further 64 bits from a hash: block 0 is the hash itself."""
    if not block:
        return h
    z = h + np.uint64(_STEP * block % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    digest = xxhash.xxh64_intdigest
    parts = shingles([w.lower() for w in words_of(text)], size)
    return np.fromiter((digest(s, SEED) for s in parts), np.uint64, len(parts))


def fingerprint(text: str | None, size: int = 3, bits: int = 64, distinct: bool = False) -> bytes:
    """A bit is 1 if set in over half the (distinct) shingles' hashes; a text without words is all zero."""
    h = shingle_hashes(text, size)
    if distinct:
        h = np.unique(h)
    if not len(h):
        return bytes(bits // 8)
    total = np.zeros(bits, np.int64)
    for at in range(0, len(h), 255 * 64):
        part = h[at : at + 255 * 64]
        wide = np.stack([_mixed(part, b) for b in range(bits // 64)], axis=1).astype(">u8")
        ones = np.unpackbits(wide.view(np.uint8).reshape(len(part), bits // 8), axis=1)
        full = len(ones) // 255 * 255
        if full:
            total += ones[:full].reshape(-1, 255, bits).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += ones[full:].sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(h)).tobytes()


def fingerprints(docs: DataFrame, size: int = 3, bits: int = 64, distinct: bool = False) -> DataFrame:
    """``doc_id, text_hash, fp``: one row per row of ``docs``, in one pass without a shuffle. Only texts go to Python."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size, bits, distinct) for t in texts], dtype=object)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.pandas_udf(run, "binary")("text").alias("fp"))


def least_shared(bits: int, distance: int) -> int:
    """Positional bytes that a pair must share: the guaranteed minimum, or LEAST where there is none."""
    least = bits // 8 - distance
    return least if least >= 1 else LEAST


def blocks_of(bits: int, distance: int) -> list[tuple[int, ...]]:
    """The positions in ``distance`` + 2 blocks; empty if they are too few for that."""
    n, k = bits // 8, distance + 2
    return [tuple(range(n * i // k, n * (i + 1) // k)) for i in range(k)] if 2 <= k <= n else []


def _rows(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, width)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _near(a: np.ndarray, b: np.ndarray, least: int, distance: int) -> np.ndarray:
    """Which pairs share ``least`` positional bytes or more, by tally, and differ in at most ``distance`` bits."""
    x = np.bitwise_xor(a, b).view(np.uint64)
    shared = np.bitwise_count(~(((x & _LOW) + _LOW) | x | _LOW)).sum(axis=-1, dtype=np.int64)  # bytes of x that are zero
    hit = shared >= least
    hit[hit] = np.bitwise_count(x[hit]).sum(axis=-1, dtype=np.int64) <= distance
    return hit


def _short_links(starts: np.ndarray, sizes: np.ndarray, fps: np.ndarray, least: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All links inside lists of at most SHORT_LIST members: rows i and i + lag of the same list."""
    left, right = [], []
    group = np.repeat(np.arange(len(starts)), sizes)
    rows = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes, strict=True)]) if len(starts) else np.empty(0, np.int64)
    for lag in range(1, int(sizes.max(initial=0))):
        i = np.flatnonzero(group[:-lag] == group[lag:])
        if not len(i):
            break
        a, b = rows[i], rows[i + lag]
        hit = _near(fps[a], fps[b], least, distance)
        left.append(a[hit])
        right.append(b[hit])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def _long_links(at: int, n: int, fps: np.ndarray, least: int, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of a long list: each member looks only among those not reached yet."""
    out, rest = [], np.arange(at, at + n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = _near(fps[rest], fps[x][None, :], least, distance)
            if hit.any():
                new = rest[hit].tolist()
                out += [(x, y) for y in new]
                queue += new
                rest = rest[~hit]
    return out


def _in_doubt(at: int, n: int, fps: np.ndarray, least: int, distance: int, sure: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of a long list that are near another one, but not so near that there is no doubt; the nearest such one, and its distance."""
    who, other, far, step = [], [], [], max(1, BLOCK // n)
    for x in range(at, at + n, step):
        rows, every = fps[x : min(x + step, at + n), None, :], fps[None, at : at + n, :]
        d = np.where(_near(rows, every, least, distance) & ~_near(rows, every, least, sure), _far(rows, every), 1 << 30)
        best = d.argmin(axis=1)
        d = d[np.arange(len(d)), best]
        who.append(np.flatnonzero(d <= distance) + x)
        other.append(best[d <= distance] + at)
        far.append(d[d <= distance])
    return np.concatenate(who), np.concatenate(other), np.concatenate(far)


def links_in_lists(batches: Iterator[pd.DataFrame], width: int, distance: int, least: int, sure: int | None = None, firsts: tuple[int, ...] = ()) -> Iterator[pd.DataFrame]:
    """Links ``u, v, kind`` of lists that arrive sorted by key; a list may go over several batches.

    With ``sure`` the links of kind 0 are those of at most this distance; whatever has another within ``distance``
    is marked by a link of kind 1 to the nearest of them. ``firsts`` has the position of each list's byte if the lists are to be divided by a second byte of its
    GROUP here.
    """
    link = distance if sure is None else sure

    def divided(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers in the order of the lists, and where each list starts."""
        own = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
        if not firsts:
            yield np.arange(len(keys)), own
            return
        first = np.array([firsts[k[0]] for k in keys])
        for lag in range(1, GROUP):
            rows = np.flatnonzero((first % GROUP + lag < GROUP) & (first + lag < width))
            if len(rows):
                second = own[rows] * 256 + fps[rows, first[rows] + lag]
                order = np.argsort(second, kind="stable")
                yield rows[order], second[order]

    def emit(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fps, raw = np.ascontiguousarray(_rows(frame["fp"], width)), frame["fp"].tolist()
        found: set[tuple[bytes, bytes]] = set()
        nearest, away = np.full(len(raw), -1), np.full(len(raw), 1 << 30)

        def mark(who: np.ndarray, other: np.ndarray, far: np.ndarray) -> None:
            order = np.argsort(-far, kind="stable")  # the nearest is written last
            who, other, far = who[order], other[order], far[order]
            closer = far < away[who]
            nearest[who[closer]], away[who[closer]] = other[closer], far[closer]

        for rows, lists in divided(frame["key"].to_numpy(), fps):
            own = fps[rows]
            cut = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
            sizes = np.diff(np.r_[cut, len(lists)])
            small = (sizes > 1) & (sizes <= SHORT_LIST)
            i, j = _short_links(cut[small], sizes[small], own, least, distance)
            if sure is not None:
                d = _far(own[i], own[j])
                a, b, far = rows[i[d > sure]], rows[j[d > sure]], d[d > sure]
                mark(np.r_[a, b], np.r_[b, a], np.r_[far, far])
                i, j = i[d <= sure], j[d <= sure]
            pairs = list(zip(i.tolist(), j.tolist(), strict=True))
            for at, n in zip(cut[sizes > SHORT_LIST].tolist(), sizes[sizes > SHORT_LIST].tolist(), strict=True):
                pairs += _long_links(at, n, own, least, link)
                if sure is not None:
                    who, other, far = _in_doubt(at, n, own, least, distance, sure)
                    mark(rows[who], rows[other], far)
            names = [raw[r] for r in rows.tolist()] if pairs else []
            found.update((names[x], names[y]) if names[x] > names[y] else (names[y], names[x]) for x, y in pairs)
        out = [(u, v, 0) for u, v in sorted(found)] + [(raw[x], raw[nearest[x]], 1) for x in np.flatnonzero(nearest >= 0).tolist()]
        if out:
            yield pd.DataFrame(out, columns=["u", "v", "kind"])

    for frame in _whole_lists(batches):
        yield from emit(frame)


def _whole_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``key`` in frames that no list is cut by."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = b["key"].iloc[-1]
        split = int(np.searchsorted((b["key"] == last).to_numpy(), True))
        if split:
            yield pd.concat([*held, b.iloc[:split]], ignore_index=True)
            held = [b.iloc[split:]]
        elif held and held[-1]["key"].iloc[-1] != last:
            yield pd.concat(held, ignore_index=True)
            held = [b]
        else:
            held.append(b)
    if held:
        yield pd.concat(held, ignore_index=True)


def _bytes_at(positions: tuple[int, ...]):
    return [F.substring("fp", p + 1, 1) for p in positions]


def _block_lists(distinct: DataFrame, bits: int, distance: int) -> DataFrame:
    """``fp, key``: a list for each two blocks; frequent lists are split by as many further positions as reach the minimum."""
    blocks, n = blocks_of(bits, distance), bits // 8
    keyed = [blocks[a] + blocks[b] for a, b in combinations(range(len(blocks)), 2)]
    lists = distinct.select("fp", F.explode(F.array(*[F.concat(F.lit(bytes([i])), *_bytes_at(p)) for i, p in enumerate(keyed)])).alias("key"))
    frequent = stored(lists.groupBy("key").count().filter(F.col("count") > FREQUENT).select("key", F.lit(True).alias("frequent")), "frequent")
    lists = lists.join(F.broadcast(frequent) if frequent.count() <= BROADCAST_LISTS else frequent, "key", "left")
    further = []
    for p in keyed:
        rest = [x for x in range(n) if x not in p]
        more = combinations(rest, max(0, n - distance - len(p)))
        further.append(F.array(*[F.concat("key", F.lit(bytes(m)), *_bytes_at(m)) for m in more]))
    which = F.conv(F.hex(F.substring("key", 1, 1)), 16, 10).cast("int")
    keys = F.when(F.col("frequent"), F.get(F.array(*further), which)).otherwise(F.array("key"))
    return lists.select("fp", F.explode(keys).alias("key"))


def _group_lists(distinct: DataFrame, firsts: tuple[int, ...]) -> DataFrame:
    """``fp, key`` and the other columns: a list for each position and byte; one beyond TILE members becomes a list for each pair of its parts."""
    entries = [F.concat(F.lit(bytes([i])), *_bytes_at((p,))) for i, p in enumerate(firsts)]
    lists = distinct.select("*", F.explode(F.array(*entries)).alias("key"))
    # At most 256 rows for each position, whatever the corpus.
    return _tiled(lists, F.broadcast(lists.groupBy("key").count().filter(F.col("count") > TILE)))


def _tiled(lists: DataFrame, counts: DataFrame) -> DataFrame:
    """``lists(fp, key, ...)`` with each list that ``counts(key, count)`` names dealt out: one list for each pair of its parts."""
    parts = F.coalesce(F.ceil(F.col("count") / TILE), F.lit(1)).cast("int")
    own = F.pmod(F.hash("fp"), F.col("parts"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.concat("key", F.unhex(F.format_string("%08x%08x", F.least(own, o), F.greatest(own, o)))))
    return lists.join(counts, "key", "left").withColumn("parts", parts).select(*[c for c in lists.columns if c != "key"], F.explode(tiles).alias("key"))


def linked_fingerprints(distinct: DataFrame, bits: int, distance: int, sure: int | None = None) -> DataFrame:
    """Links ``u, v, kind`` between different fingerprints of ``distinct(fp)`` at ``distance`` bits or fewer.

    With ``sure``, at so many bits or fewer, and of kind 1 from each u that has others within ``distance`` to near ones.
    """
    width, least = bits // 8, least_shared(bits, distance)
    if blocks_of(bits, distance):
        firsts, lists = (), _block_lists(distinct.select("fp"), bits, distance)
    else:
        firsts = tuple(i for i in range(width - 1) if i % GROUP < GROUP - 1)
        lists = _group_lists(distinct.select("fp"), firsts)
    found = (
        lists.repartition("key").sortWithinPartitions("key").select("key", "fp")
        .mapInPandas(lambda it: links_in_lists(it, width, distance, least, sure, firsts), "u binary, v binary, kind int")
    )
    return found.distinct()


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """``fp, set``: the distinct shingles' hashes of one text for each fingerprint of ``docs(fp, text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                yield pd.DataFrame({"fp": part["fp"], "set": [np.unique(shingle_hashes(t, size)).view(np.int64) for t in part["text"]]})

    return docs.select("fp", "text").mapInPandas(run, "fp binary, set array<bigint>")


def sets_of(wanted: DataFrame, rows: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``fp, set`` for the fingerprints of ``wanted(fp)``; ``rows(fp, doc_id, text_hash)`` says which text stands for one.

    Only these texts are read again, each once. While they are few, their ids are broadcast and no text is shuffled.
    """
    one = stored(rows.groupBy("fp").agg(F.min(F.struct("text_hash", "doc_id")).alias("k")).join(wanted, "fp", "left_semi"), "ends")
    own = docs.select(F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__hash"), "text")
    same = F.col("__doc").eqNullSafe(F.col("k.doc_id")) & (F.col("__hash") == F.col("k.text_hash"))
    found = own.join(F.broadcast(one) if one.count() <= BROADCAST_LISTS else one, same)
    return stored(shingle_sets(found, size).groupBy("fp").agg(F.any_value("set").alias("set")), "shingles")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``u, v`` whose sets have a Jaccard similarity of ``similarity`` or more."""
    both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("set").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(shared / (F.size("a") + F.size("b") - shared) >= similarity).select("u", "v")


def pairs_in_prefixes(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Pairs ``u, v`` of different ``label`` in lists (``key, fp, label, n, place``) that may have the similarity.

    Two sets of n and m members that meet first at places p and q share at most 1 + min(n - p, m - q), and
    need similarity / (1 + similarity) * (n + m).
    """
    for frame in _whole_lists(batches):
        keys, raw = frame["key"].to_numpy(), frame["fp"].tolist()
        label = pd.factorize(frame["label"])[0]
        n, left = frame["n"].to_numpy(np.int64), frame["n"].to_numpy(np.int64) - frame["place"].to_numpy(np.int64)
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for at, upto in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
            if upto - at < 2 or (label[at:upto] == label[at]).all():
                continue
            step = max(1, BLOCK // (upto - at))
            for x in range(at, upto, step):
                i, j = slice(x, min(x + step, upto)), slice(x, upto)
                room = 1 + np.minimum(left[i, None], left[None, j])
                fits = (room * (1 + similarity) >= similarity * (n[i, None] + n[None, j]) - 1e-9) & (label[i, None] != label[None, j])
                a, b = np.nonzero(fits)
                a, b = a[a < b] + x, b[a < b] + x
                if len(a):
                    yield pd.DataFrame([(max(raw[k], raw[m]), min(raw[k], raw[m])) for k, m in zip(a.tolist(), b.tolist(), strict=True)], columns=["u", "v"])


def crowd_links(crowd: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All pairs ``u, v`` of ``crowd(fp, label)`` with different labels whose texts are alike.

    A set of n shingles shares one of its first n - ceil(similarity * n) + 1 with any set alike, in an order that
    is the same for all: rare ones first. Only these make lists.
    """
    named = stored(sets.join(crowd, "fp").withColumn("id", F.monotonically_increasing_id()), "named")
    postings = named.select("id", F.explode("set").alias("s"))
    often = stored(postings.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    total = often.agg(F.sum("n")).first()[0] or 0
    # A shingle of one text alone comes first in its order and can be left out: only its number counts.
    counted = hub_join(postings, often.withColumn("f", F.col("n")), "s", total)
    ordered = counted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("o")).join(named.select("id", "fp", "label", F.size("set").alias("n")), "id")
    alone = F.col("n") - F.size("o")
    first = F.slice("o", 1, F.greatest(F.lit(0), F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1 - alone).cast("int"))
    lists = ordered.select("fp", "label", "n", alone.alias("alone"), F.posexplode(first).alias("i", "e"))
    lists = stored(lists.select("fp", "label", "n", (F.col("alone") + F.col("i") + 1).alias("place"), F.unhex(F.lpad(F.hex("e.s"), 16, "0")).alias("key")), "prefixes")
    long = stored(lists.groupBy("key").count().filter(F.col("count") > TILE), "long")
    lists = _tiled(lists, F.broadcast(long) if long.count() <= BROADCAST_LISTS else long)
    pairs = lists.repartition("key").sortWithinPartitions("key").mapInPandas(lambda it: pairs_in_prefixes(it, similarity), "u binary, v binary").distinct()
    return alike(stored(pairs, "pairs"), sets, similarity)


def bits_at(similarity: float, bits: int) -> int:
    """Differing bits to expect of two texts: J = c / (2 - c) for the cosine c of their shingles."""
    return round(math.acos(2 * similarity / (1 + similarity)) / math.pi * bits)


def simhash_components(docs: DataFrame, size: int = 3, bits: int = 64, distance: int = 2, similarity: float | None = None) -> DataFrame:
    """Fingerprint and component of every row: ``doc_id, text_hash, fp, component_id``.

    With ``similarity`` each shingle of a text counts once, and links are verified on the shingles: to this
    similarity, unless the fingerprints say MARGIN more.

    component_id is the smallest doc_id in the component. A null text counts as a text without words; all
    of these share the zero fingerprint and are linked like any others. Rows with a null doc_id take part
    under no id (component_id is null if nothing else is linked). Repeated rows come back as often as they
    came. An empty table gives an empty result. Further columns are ignored, whatever their names.
    """
    rows = stored(fingerprints(docs.select("doc_id", "text"), size, bits, similarity is not None), "fingerprints")
    least = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct")
    total = rows.count()
    if similarity is None:
        links = linked_fingerprints(least.select("fp"), bits, distance)
    else:
        sure = bits_at(min(1.0, similarity + MARGIN), bits)
        found = stored(linked_fingerprints(least.select("fp"), bits, distance, sure), "links")
        links = found.filter("kind = 0")
    roots = stored(connected_components(links.select("u", "v")), "roots")
    if similarity is not None and not found.filter("kind = 1").isEmpty():
        # The nearest first: most of a crowd is one component then, and few pairs of it are left to look at.
        edges = lambda: roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        marked = found.filter("kind = 1")
        sets = sets_of(marked.select(F.col("u").alias("fp")).unionByName(marked.select(F.col("v").alias("fp"))).distinct(), rows, docs, size)
        pairs = marked.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        roots = stored(connected_components(edges().unionByName(alike(pairs, sets, similarity))), "roots")
        crowd = sets.select("fp").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("label"))
        roots = connected_components(edges().unionByName(crowd_links(stored(crowd, "crowd"), sets, similarity)))
    member = least.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id", F.col("n").alias("times"))
    member = stored(member, "members")
    smallest = member.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    named = stored(hub_join(member, smallest, "root", total).select("fp", "component_id", F.col("times").alias("n")), "named")
    return hub_join(rows, named, "fp", total).select("doc_id", "text_hash", "fp", "component_id")


def near_dedup(docs: DataFrame, size: int = 5, bits: int = 512, similarity: float = 0.8) -> DataFrame:
    """Keep one row of each group of near copies: that with the smallest doc_id, then text hash.

    Texts are near copies when the Jaccard similarity of their ``size``-word shingles is ``similarity`` or
    more: fingerprints propose, the shingles decide. Groups are connected components. Columns are those of ``docs``, whatever their names. Texts without words form one group. Rows that repeat in full
    are one document.
    """
    found = simhash_components(docs, size, bits, bits_at(max(0.0, similarity - WIDER), bits), similarity)
    # The group is named by its smallest id; without one, by its own fingerprint.
    group = F.coalesce(F.col("component_id").cast("string"), F.hex("fp"))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    ids = found.groupBy(group.alias("g"), "doc_id", "text_hash").agg(F.count("*").alias("n"))
    keep = ids.groupBy("g").agg(F.min_by(F.struct("doc_id", "text_hash", "n"), rank).alias("k"))
    keep = stored(keep.select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash"), F.col("k.n").alias("__n")).distinct(), "kept")
    # The whole row travels as one struct, so no name in it can clash.
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__row_hash"))
    same = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__row_hash") == F.col("__hash"))
    once = own.join(keep.filter("__n = 1"), same, "left_semi").select("row.*")
    if keep.filter("__n > 1").isEmpty():
        return once
    more = own.join(keep.filter("__n > 1"), same, "left_semi").dropDuplicates(["__doc", "__row_hash"]).select("row.*")
    return once.unionByName(more)
