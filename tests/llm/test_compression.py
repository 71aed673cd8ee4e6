"""Substring dedup, vector codes and periodic runs against brute force, and on awkward tables."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellscope.llm import periodic, queries, substrings, vector_codes

SCHEMA = "doc_id long, text string"


def brute_removed(docs, size):
    """``doc_id, words, removed places`` by comparing whole windows."""
    first, out = {}, {}
    words = {d: ("" if t is None else t).encode().split() for d, t in docs}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), (d, i))
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] != (d, i):
                gone |= set(range(i, i + size))
        out[d] = (w, gone)
    return out


def planted_docs(seed=3, n=60):
    r = random.Random(seed)
    fresh = lambda m: [f"w{r.randrange(4000)}" for _ in range(m)]
    passage, line = fresh(55), fresh(20)
    docs = []
    for i in range(n):
        w = fresh(r.choice([0, 3, 19, 20, 21, 200]))
        at = r.randrange(len(w) + 1)
        w[at:at] = {0: passage, 1: line, 2: passage[5:40], 3: line[1:], 4: ["a", "b", "c"] * 30, 5: ["same"] * 70}.get(i % 9, [])
        docs.append((i * 7 - 50, " \t".join(w)))
    docs += [(1000 + i, docs[8][1]) for i in range(15)] + [(2000, None), (2001, ""), (2002, " \n\x0b ")]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize(("size", "sketch", "words"), [(20, 1 << 20, 1 << 18), (20, 64, 100), (5, 300, 50), (1, 500, 64)])
def test_substrings_equal_brute_force(spark, monkeypatch, size, sketch, words):
    monkeypatch.setattr(substrings, "SKETCH", sketch)
    monkeypatch.setattr(substrings, "WORDS", words)
    monkeypatch.setattr(substrings, "GROUP", 200)
    monkeypatch.setattr(substrings, "SHARD", 50)
    docs = planted_docs()
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.digest(spark.createDataFrame(docs, SCHEMA).repartition(5), size).collect()}
    for d, (w, gone) in brute_removed(docs, size).items():
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert got[d] == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert sum(r[1] for r in got.values()) > 1500


def test_estimates_are_never_below_counts():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**32, 3000, dtype=np.uint32)
    codes = np.concatenate([codes, codes[:400]])
    twice = substrings.repeated_codes(codes, np.ones(len(codes), np.uint8))
    assert twice[:400].all() and twice[3000:].all() and twice[400:3000].mean() < 0.1
    assert substrings.repeated_codes(codes[400:401], np.array([2], np.uint8)).all()


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 5, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h[100:140] = h[700:740]
    offsets = np.array([0, 0, 650, 660, 3000])
    w = substrings.Windows(h, offsets)
    assert len(w.start) == 631 + 2321 and w.per_doc.sum() == len(w.values) < len(w.start) / 2
    by = {}
    for s, a in zip(w.start.tolist(), w.values[w.anchor].tolist(), strict=True):
        by.setdefault(tuple(h[s : s + 20].tolist()), set()).add(a)
    assert all(len(v) == 1 for v in by.values())
    # An anchor occurs at least as often as any window that it stands for.
    counts = {}
    for s in w.start.tolist():
        counts[tuple(h[s : s + 20].tolist())] = counts.get(tuple(h[s : s + 20].tolist()), 0) + 1
    values, n = np.unique(w.values, return_counts=True)
    often = dict(zip(values.tolist(), n.tolist(), strict=True))
    assert all(often[next(iter(by[k]))] >= c for k, c in counts.items())


def test_substrings_awkward(spark):
    t = " ".join(f"x{i}" for i in range(30))
    rows = [(None, t, "a"), (None, t, "b"), (5, t, "c"), (5, t, "c"), (5, t + " more", "d"), (6, None, None), (7, "  two  words ", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string").withColumns({c: F.lit(1) for c in ("th", "row", "bits", "firsts", "h")})
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.digest(df).collect()), key=str)
    assert got == sorted([(None, 30, 0), (None, 30, 0), (5, 30, 30), (5, 30, 30), (5, 31, 30), (6, 0, 0), (7, 2, 0)], key=str)
    kept = substrings.deduplicated(df)
    assert kept.columns == df.columns and kept.schema["d"].dataType == df.schema["d"].dataType
    assert sorted((r["d"], r["text"]) for r in kept.filter("doc_id is not null and text is not null").collect()) == [("c", ""), ("c", ""), ("d", "more"), ("e", "  two  words ")]
    assert substrings.digest(df.limit(0)).count() == 0
    # A null id comes before all others; rows of one place are told apart by nothing and both stay.
    other = spark.createDataFrame([(9, t), (9, t.upper() + " " + t)], SCHEMA)
    assert sorted(tuple(r)[1:3] for r in substrings.digest(other).collect()) == [(30, 0), (60, 30)]


def test_substrings_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("op11_substring_dedup", "op12_vector_codes"):
        df, want = queries.queries()[name](spark, sf), con.sql(queries.oracle_sql()[name])
        cols = sorted(df.columns)
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def brute_codes(rows, parts, entries, rounds):
    """Plain integer arithmetic, one vector and entry after the other."""
    v = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e], lab) for i, e, lab in rows]
    w = len(v[0][1]) // parts
    cut = [[x[p * w : (p + 1) * w] for p in range(parts)] for _, x, _ in v]
    order = sorted(range(len(v)), key=lambda j: (v[j][0] is None, v[j][0] or 0, v[j][1]))[:entries]
    books = [[cut[j][p] for j in order] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (dist(x[p], books[p][e]), e)) for p in range(parts)] for x in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[p] for x, c in zip(cut, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes = assign()
    errors = [sum(dist(x[p], books[p][c[p]]) for p in range(parts)) for x, c in zip(cut, codes, strict=True)]
    label = {}
    for (_, _, lab), e in zip(v, errors, strict=True):
        label[lab] = label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for c in code), e, label[lab], digest) for (i, _, lab), code, e in zip(v, codes, errors, strict=True)), key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("n", "parts", "entries", "rounds", "strip"), [(300, 4, 8, 2, 4096), (300, 16, 64, 1, 7), (5, 2, 64, 2, 2), (40, 1, 256, 3, 4096)])
def test_vector_codes_equal_plain_arithmetic(spark, monkeypatch, n, parts, entries, rounds, strip):
    monkeypatch.setattr(vector_codes, "STRIP", strip)
    rng = np.random.default_rng(n)
    rows = [(None if i == 17 else int(i * 37 % 1000 if i % 50 else 3), rng.integers(-6, 7, 16).astype(float).tolist() if i % 3 else [0.1 * (i % 4)] * 16, None if i % 5 == 0 else i % 4) for i in range(n)]
    bad = [(1, None, 1), (2, [0.5] * 15 + [None], 1), (3, [float("nan")] * 16, 1), (4, [float("-inf")] + [0.0] * 15, None)]
    df = spark.createDataFrame(rows + bad, VECTORS).repartition(4).withColumns({c: F.lit(1) for c in ("v", "key", "n", "code", "error")})
    got = vector_codes.compress(df, parts, entries, rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(rows, parts, entries, rounds)


def test_vector_codes_edges(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 2)], VECTORS)).count() == 0
    one = vector_codes.compress(spark.createDataFrame([(1, [1.5] * 32, None), (1, [1.5] * 32, None)], VECTORS)).collect()
    assert [tuple(r)[:4] for r in one] == [(1, "00" * 16, 0, 0)] * 2
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 10, 1)], VECTORS))
    books = np.arange(24).reshape(2, 3, 4)
    assert vector_codes.decoded(["0102", "0200"], books).tolist() == [[4, 5, 6, 7, 20, 21, 22, 23], [8, 9, 10, 11, 12, 13, 14, 15]]


def brute_runs(w, least=12):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            m = j - i + q
            if j > i and m >= max(least, 2 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + m - p)) for p in range(1, q)):
                out.append((i, m, q))
            i = max(j, i + 1)
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 30), st.integers(0, 40), st.integers(0, 60))
def test_runs_equal_brute_force(words, p, a, m):
    words = words + [words[(a + i % p) % len(words)] for i in range(m)] if words else words
    assert periodic.runs_of(words) == brute_runs(words)


def test_runs_with_pruned_lags(monkeypatch):
    r = random.Random(4)
    for n in (200, 900):
        w = [r.randrange(10_000) for _ in range(n)]
        w[50:170] = (w[50:80] * 4)[:120]
        w += w[-70:] * 2 + w[:40]
        runs = periodic.runs_of(w)
        assert len(list(periodic.lags_of(periodic.ids_of(w)))) < 150 and runs == brute_runs(w) and len(runs) >= 2
        monkeypatch.setattr(periodic, "lags_of", lambda ids: range(1, len(ids) // 2 + 1))
        assert periodic.runs_of(w) == runs
        monkeypatch.undo()


def test_periodic_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, sf).collect()}
    some = 0
    for doc_id, text in docs.collect():
        w = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        r = got.pop(doc_id)
        if n > 1500:
            continue  # brute force takes too long
        runs = brute_runs(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == (top or (None,) * 3)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if top else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        some += len(runs)
    assert not got and some > 10


def test_periodic_awkward(spark):
    rows = [(1, None), (2, ""), (None, "a b " * 9), (3, "a " * 30), (3, "a " * 30), (4, " ".join(f"é{i}" for i in range(50)))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("h", "start", "period")})
    got = sorted(((r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) for r in periodic.periodic_runs(df, plant=True).filter("doc_id is null or doc_id <> 3").collect()), key=str)
    assert got == sorted([(1, 0, None, None, None, None), (2, 0, None, None, None, None), (None, 1, 0, 18, 2, 9000), (4, 0, None, None, None, None)], key=str)
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    kept = {(r["doc_id"], r["text"]) for r in periodic.collapse(df).collect()}
    assert (3, "a") in kept and (None, "a b") in kept and (1, None) in kept and (2, "") in kept
    assert periodic.runs_of(["a"] * 20_000) == [(0, 20_000, 1)]
