"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in both directions and gives every position a distribution over languages;
a document's distribution is the mean over all its positions. Texts are read whole, in windows of STRIDE
bytes: each is read together with CONTEXT bytes on either side, over which the states of both directions
warm up, and only its own STRIDE positions are labelled. Windows are of one length, so that many texts are
read in one batch; bytes past a text's ends are PAD and have no label. Training is numpy throughout:
backpropagation through time on such windows of whole sample texts, Adam steps, a fixed seed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRIDE, CONTEXT, PAD = 256, 16, 0
HIDDEN = 8
DOCS_PER_LANGUAGE = 300  # bound of the training sample, in documents
SPAN, STEPS, BATCH, RATE = 64, 320, 128, 0.03
ROWS = 768  # windows in a batch
CHARS = 2_000_000  # characters of texts whose windows are made together
UNKNOWN = "und"
SALTS = 8
_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class ByteGRU:
    """Input weights are a row per byte; ``g`` holds update, reset and candidate parts side by side."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.hidden, h = languages, hidden, hidden
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("W", draw(256, 3 * h, s=0.1)), ("U", draw(h, 3 * h, s=h**-0.5)), ("b", np.zeros(3 * h, np.float32)))}
        self.p |= {"V": draw(2 * h, len(languages), s=(2 * h) ** -0.5), "c": np.zeros(len(languages), np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (rows, steps, h) of one direction; ``keep`` gathers what the way back needs."""
        h, n = self.hidden, x.shape[1]
        g = self.p[f"W{d}"][x] + self.p[f"b{d}"]
        state, out = np.zeros((len(x), h), np.float32), np.empty((len(x), n, h), np.float32)
        for t in range(n):
            a = state @ self.p[f"U{d}"]
            zr = _sigmoid(g[:, t, : 2 * h] + a[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(g[:, t, 2 * h :] + r * a[:, 2 * h :])
            if keep is not None:
                keep.append((state, z, r, new, a[:, 2 * h :]))
            state = new + z * (state - new)
            out[:, t] = state
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (rows, steps, languages) for byte sequences of one length."""
        states = np.concatenate([self._run(x, "f"), self._run(x[:, ::-1], "b")[:, ::-1]], axis=2)
        return self._softmax(states @ self.p["V"] + self.p["c"])

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradient by backpropagation through time."""
        h, kept = self.hidden, {"f": [], "b": []}
        fwd, bwd = self._run(x, "f", kept["f"]), self._run(x[:, ::-1], "b", kept["b"])
        states = np.concatenate([fwd, bwd[:, ::-1]], axis=2)
        prob = self._softmax(states @ self.p["V"] + self.p["c"])
        rows = np.arange(len(x))
        loss = float(-np.log(prob[rows, :, y] + 1e-9).mean())
        d_out = prob.copy()
        d_out[rows, :, y] -= 1
        d_out /= x.size
        grad = {"V": states.reshape(-1, 2 * h).T @ d_out.reshape(-1, d_out.shape[2]), "c": d_out.sum(axis=(0, 1))}
        d_states = d_out @ self.p["V"].T
        for d, seq, ds in (("f", x, d_states[:, :, :h]), ("b", x[:, ::-1], d_states[:, ::-1, h:])):
            u, du, dg = self.p[f"U{d}"], np.zeros_like(self.p[f"U{d}"]), np.empty((*seq.shape, 3 * h), np.float32)
            carry = np.zeros((len(x), h), np.float32)
            for t in range(seq.shape[1] - 1, -1, -1):
                before, z, r, new, a = kept[d][t]
                dh = ds[:, t] + carry
                dn = dh * (1 - z) * (1 - new * new)
                dz, dr = dh * (before - new) * z * (1 - z), dn * a * r * (1 - r)
                dg[:, t] = np.concatenate([dz, dr, dn], axis=1)
                da = np.concatenate([dz, dr, dn * r], axis=1)
                du += before.T @ da
                carry = dh * z + da @ u.T
            dw = np.zeros_like(self.p[f"W{d}"])
            np.add.at(dw, seq.ravel(), dg.reshape(-1, 3 * h))
            grad |= {f"W{d}": dw, f"U{d}": du, f"b{d}": dg.sum(axis=(0, 1))}
        return loss, grad

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> list[float]:
        """Adam on batches of spans drawn from whole texts, PAD between them: a language, then one of its positions, each alike."""
        rng = np.random.default_rng(seed)
        between = bytes(CONTEXT)
        whole = {y: np.frombuffer(between + between.join(t for t, l in zip(texts, labels, strict=True) if l == y) + bytes(SPAN), np.uint8) for y in range(len(self.languages))}
        first, second, losses = {}, {}, []
        for step in range(1, steps + 1):
            y = rng.integers(0, len(self.languages), BATCH)
            at = [int(rng.integers(0, len(whole[k]) - SPAN + 1)) for k in y.tolist()]
            x = np.stack([whole[k][a : a + SPAN] for k, a in zip(y.tolist(), at, strict=True)])
            loss, grad = self.gradients(x, y)
            losses.append(loss)
            rate = RATE * (1 - 0.95 * step / steps)
            for k, g in grad.items():
                first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                second[k] = 0.99 * second.get(k, 0) + 0.01 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                self.p[k] -= (rate * move).astype(np.float32)
        return losses

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text (texts, languages); zeros for an empty text."""
        out = np.zeros((len(texts), len(self.languages)))
        windows, owner, length = windows_of(texts)
        read = Reader(self)
        for at in range(0, len(windows), ROWS):
            np.add.at(out, owner[at : at + ROWS], read(windows[at : at + ROWS], length[at : at + ROWS]))
        return out / np.maximum([[len(t)] for t in texts], 1)


class Reader:
    """The trained network as it reads: both directions side by side in one state, a step of all windows at a time.

    The same numbers as ``ByteGRU.positions`` gives. Windows are columns; rows are update, reset and candidate,
    forward before backward in each; the sigmoids' halves are in the weights.
    """

    def __init__(self, model: ByteGRU) -> None:
        h, p = model.hidden, model.p
        half = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), h)
        self.h, self.v, self.c = h, np.ascontiguousarray(p["V"].T), p["c"][:, None]
        self.u, self.w = np.zeros((6 * h, 2 * h), np.float32), []
        for d, name in enumerate("fb"):
            self.u.reshape(3, 2, h, 2 * h)[:, d, :, d * h : (d + 1) * h] = (p[f"U{name}"] * half).T.reshape(3, h, h)
            self.w.append(np.ascontiguousarray(((p[f"W{name}"] + p[f"b{name}"]) * half).T, dtype=np.float32))

    def __call__(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sums of probabilities over each window's own positions (rows, languages)."""
        h, (n, steps) = self.h, x.shape
        index = np.ascontiguousarray(x.T, dtype=np.intp)
        state, out = np.zeros((2 * h, n), np.float32), np.empty((steps, 2 * h, n), np.float32)
        given, a = [np.empty((3 * h, n), np.float32) for _ in "fb"], np.empty((6 * h, n), np.float32)
        gates, new = a[: 4 * h], a[4 * h :]
        both = gates.reshape(2, 2, h, n)
        for t in range(steps):
            np.take(self.w[0], index[t], axis=1, out=given[0], mode="clip")
            np.take(self.w[1], index[steps - 1 - t], axis=1, out=given[1], mode="clip")
            np.matmul(self.u, state, out=a)
            for d in (0, 1):
                both[:, d] += given[d][: 2 * h].reshape(2, h, n)
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new *= a[2 * h : 4 * h]
            new[:h] += given[0][2 * h :]
            new[h:] += given[1][2 * h :]
            np.tanh(new, out=new)
            state -= new
            state *= a[: 2 * h]
            state += new
            out[t] = state
        own = slice(CONTEXT, CONTEXT + STRIDE)
        prob = self.v[:, :h] @ out[own, :h] + self.v[:, h:] @ out[::-1][own, h:] + self.c
        prob -= prob.max(axis=1, keepdims=True)
        np.exp(prob, out=prob)
        prob /= prob.sum(axis=1, keepdims=True)
        prob *= (np.arange(STRIDE)[:, None] < length[None, :])[:, None, :]
        return prob.sum(axis=0, dtype=np.float64).T


def bytes_of(text: str) -> bytes:
    """What the network reads of a text: its UTF-8 bytes, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").lower()


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (rows, CONTEXT + STRIDE + CONTEXT), the text that each is of, and how many own positions it has."""
    count = np.array([-(-len(t) // STRIDE) for t in texts], np.int64)
    parts = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(bytes(CONTEXT) + t + bytes(n * STRIDE - len(t) + CONTEXT), np.uint8), STRIDE + 2 * CONTEXT)[::STRIDE] for t, n in zip(texts, count.tolist(), strict=True) if n]
    owner = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(STRIDE, np.array([len(t) for t in texts], np.int64)[owner] - place * STRIDE)
    return np.concatenate(parts) if parts else np.empty((0, STRIDE + 2 * CONTEXT), np.uint8), owner, length


def sample(learnable: DataFrame) -> pd.DataFrame:
    """``lang, text``: the whole texts of at most DOCS_PER_LANGUAGE documents of each language.

    Documents are chosen by the hash of their id, over salts first, so that no task ranks a whole language.
    An id that comes with several texts counts with the smallest: no more rows than the bound are collected.
    """
    ids = learnable.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id")).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("h", "doc_id")
        ids = ids.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= DOCS_PER_LANGUAGE).drop("n")
    chosen = learnable.join(F.broadcast(ids.select("doc_id", "lang", "h")), ["doc_id", "lang"])
    rows = chosen.groupBy("lang", "h", "doc_id").agg(F.min("text").alias("text"))
    return rows.select("lang", "h", "text").toPandas().sort_values(["lang", "h", "text"], kind="stable")


def train(learnable: DataFrame) -> ByteGRU | None:
    """Fit to ``doc_id, text, lang`` rows, ids of any type; None if there is nothing to learn from."""
    rows = sample(learnable.filter("lang is not null and text <> '' and doc_id is not null"))
    if rows.empty:
        return None
    names = sorted(rows["lang"].unique())
    model = ByteGRU(names)
    model.fit([bytes_of(t) for t in rows["text"]], rows["lang"].map({n: i for i, n in enumerate(names)}).to_numpy())
    return model


def has_letter(text: str | None) -> bool:
    """Letters are what Unicode calls so; fractions and raised digits are none."""
    return text is not None and any(m[0].isalpha() for m in _LETTER.finditer(text))


def predicted(texts: pd.Series, model: ByteGRU | None) -> pd.DataFrame:
    """``lang_pred, score`` of each text."""
    names = np.array([*model.languages, UNKNOWN] if model else [UNKNOWN], dtype=object)
    best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
    known = np.flatnonzero([model is not None and has_letter(t) for t in texts])
    size = np.cumsum([len(texts.iloc[i]) for i in known])
    for group in np.split(known, np.flatnonzero(np.diff(size // CHARS)) + 1) if len(known) else []:
        share = model.pooled([bytes_of(texts.iloc[i]) for i in group])
        best[group], score[group] = share.argmax(axis=1), share.max(axis=1)
    return pd.DataFrame({"lang_pred": names[best], "score": np.clip(score, 0, 1)})


def predict(docs: DataFrame, model: ByteGRU | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every whole text: the pooled distribution's largest entry.

    ``und`` with score 0 for a null text or one without a letter, or without a model. Only texts go to Python.
    A very long text is read window after window. Repeated rows get equal results; an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield predicted(texts, model)

    return docs.select("doc_id", F.pandas_udf(run, "struct<lang_pred:string,score:double>")("text").alias("p")).select("doc_id", "p.*")
