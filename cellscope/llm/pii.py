"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone) follow exact rules and always stay. Besides them, wider candidates
are proposed (local phone numbers, spelled-out addresses, titled names, account numbers, credentials);
labelers of three sorts vote on each: regular expressions (shape), gazetteers (known given names, key
words, country codes) and context (words before the span in its sentence). No span has a longest length. A candidate's votes and shape form a pattern.

Patterns are counted over the whole corpus, map-side first; a count per pattern is all that reaches the
driver (votes are three-valued, so there are at most ``3**LABELERS * kinds * 4`` patterns). There,
expectation-maximisation estimates each labeler's reliability without labels, and a logistic classifier
over votes, kind and shape is fitted to the posterior. Its verdict per pattern goes back as a set.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "address", "localphone", "name", "secret")
LABELERS = 5

# The base patterns' parts, and the gazetteers.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TITLES = ("Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Prof. ", "Herr ", "Frau ", "Monsieur ", "Madame ", "Señor ", "Señora ")
_GIVEN = frozenset(
    "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica"
    " sarah karen hans peter klaus wolfgang jürgen ursula monika petra jean pierre michel andré marie françoise isabelle nathalie"
    " josé antonio manuel francisco juan maría carmen ana isabel dolores".split()
)
_KEYWORDS = ("password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "api-key", "access_key")
_PHONE_WORDS = ("phone", "tel", "call", "fax", "mobile", "telefon", "téléphone", "teléfono")
_ACCOUNT_WORDS = ("iban", "account", "konto", "compte", "cuenta", "bank")
_AGAINST = ("version", "isbn", "issue", "page", "sha", "commit", "checksum", "order", "chapter")
_COUNTRIES = frozenset("DE FR ES GB IT NL BE AT CH PL PT IE SE DK FI NO LU CZ".split())

_SECRET = re.compile(r"(?i:(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key))\s*+[=:]\s*+[\"']?([^\s\"']{6,})")
_CLOUD_KEY = re.compile(r"(?<![A-Z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Z0-9])")
_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ -])[0-9]{3}[ -][0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![A-Z0-9])")
_SPELLED = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)+")
_NAME = re.compile(r"[A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: the run of local characters before it, after the last match, and a domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Dotted numbers are taken four at a time from the left, as a leftmost search does."""
    for m in _DOTTED.finditer(text):
        if "." not in m.group():
            continue
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans in code points, by kind as listed, then start."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    out += [("ip", *s) for s in _ips(text)]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


class Context:
    """Where a text has the labelers' words and where its sentences begin; made once for a text with candidates."""

    _WORDS = {n: re.compile("|".join(map(re.escape, sorted(w, key=len, reverse=True))), re.I) for n, w in (("key", _KEYWORDS), ("phone", _PHONE_WORDS), ("account", _ACCOUNT_WORDS), ("against", _AGAINST), ("mail", ("mail", "contact")))}
    _BEGIN = re.compile(r"(?:[.!?] |\n)\s*")

    def __init__(self, text: str) -> None:
        self.text = text
        self.begins = [0, *[m.end() for m in self._BEGIN.finditer(text)]]
        self.ends = {n: [m.end() for m in p.finditer(text)] for n, p in self._WORDS.items()}

    def has(self, name: str, start: int) -> bool:
        """Is one of these words before ``start`` in its sentence?"""
        begin = self.begins[bisect_right(self.begins, start) - 1]
        i = bisect_right(self.ends[name], start) - 1
        return i >= 0 and self.ends[name][i] > begin

    def assigned(self, start: int) -> bool:
        """Does an equals sign or a colon come just before, but for spaces and quotes?"""
        while start and self.text[start - 1] in " \t\"'":
            start -= 1
        return start > 0 and self.text[start - 1] in "=:"


def _votes(kind: str, text: str, start: int, end: int, context: Context) -> tuple[int, ...]:
    """Shape, gazetteer, key word, context, counter-evidence; each 1 for, -1 against, 0 no opinion."""
    span = text[start:end]
    digits = sum(c in "0123456789" for c in span)
    if kind == "secret":
        mixed = 0 < digits < len(span) and len(set(span)) >= 8
        shape = 1 if mixed or len(span) >= 32 else -1 if digits == 0 else 0
        gazetteer, word, near = int(bool(_CLOUD_KEY.match(span))), int(context.has("key", start)), int(context.assigned(start))
    elif kind == "localphone":
        shape, gazetteer, word = 1, 0, int(context.has("phone", start))
        near = 1 if word else -1 if context.has("account", start) else 0
    elif kind == "account":
        rearranged = span.replace(" ", "")
        value = "".join(str(int(c, 36)) for c in rearranged[4:] + rearranged[:4])
        shape, gazetteer = 1 if int(value) % 97 == 1 else -1, 1 if span[:2] in _COUNTRIES else -1
        word = near = int(context.has("account", start))
    elif kind == "address":
        shape, gazetteer, word, near = 1, int(span.lower().rstrip().endswith((" com", " org", " net", ".com", ".org", ".net", ")com"))), 0, int(context.has("mail", start))
    else:
        first = span.split()[0].lower()
        shape, gazetteer, word, near = 1 if " " in span else 0, 1 if first in _GIVEN else 0, 1, 0
    return shape, gazetteer, word, near, -1 if context.has("against", start) else 0


def pattern_of(kind: str, votes: tuple[int, ...], length: int) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    size = 0 if length < 12 else 1 if length < 24 else 2 if length < 48 else 3
    return (code * len(ADDED) + ADDED.index(kind)) * 4 + size


def features_of(pattern: int) -> tuple[np.ndarray, np.ndarray]:
    """Votes, and the classifier's inputs: votes for, votes against, kind, size, one."""
    pattern, size = divmod(pattern, 4)
    code, kind = divmod(pattern, len(ADDED))
    votes = np.array([code // 3**i % 3 - 1 for i in reversed(range(LABELERS))])
    return votes, np.concatenate([votes > 0, votes < 0, np.eye(len(ADDED))[kind] * 0.3, np.eye(4)[size] * 0.3, [1.0]]).astype(float)


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, pattern) outside base spans and each other, leftmost and longest first.

    Of a candidate that overlaps these, each part outside them stays, under the pattern of the whole.
    """
    found: list[tuple[int, int, str]] = []
    has_digit = _DIGIT.search(text) is not None
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "secret") for m in _SECRET.finditer(text)]
    if has_digit:
        found += [(m.start(), m.end(), k) for p, k in ((_CLOUD_KEY, "secret"), (_HEX, "secret"), (_LOCAL_PHONE, "localphone"), (_ACCOUNT, "account")) for m in p.finditer(text)]
    if "[at" in text or "(at" in text or "[ at" in text or "( at" in text:
        found += [(m.start(), m.end(), "address") for m in _SPELLED.finditer(text)]
    for title in _TITLES:
        at = text.find(title)
        while at >= 0:
            if m := _NAME.match(text, at + len(title)):
                found.append((m.start(), m.end(), "name"))
            at = text.find(title, at + 1)
    if not found:
        return []
    taken = sorted((s, e) for _, s, e in base)
    out, last, j, context = [], 0, 0, Context(text)
    for start, end, kind in sorted(found, key=lambda f: (f[0], -f[1], f[2])):
        at, parts = max(start, last), []
        while j < len(taken) and taken[j][1] <= at:
            j += 1
        i = j
        while i < len(taken) and taken[i][0] < end:
            parts.append((at, taken[i][0]))
            at, i = max(at, taken[i][1]), i + 1
        parts = [(s, e) for s, e in [*parts, (at, end)] if s < e and not text[s:e].isspace()]
        if parts:
            pattern = pattern_of(kind, _votes(kind, text, start, end, context), end - start)
            out += [(kind, s, e, pattern) for s, e in parts]
        last = max(last, end)
    return out


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM for two classes and labelers that may abstain: P(correct | votes) of each pattern, accuracies.

    Starts from accuracy 0.8; estimates are smoothed with ten votes at that accuracy, so a labeler that
    never votes keeps it.
    """
    accuracy, prior = np.full(votes.shape[1], 0.8), 0.5
    post = np.full(len(votes), 0.5)
    for _ in range(rounds):
        weight = np.log(accuracy / (1 - accuracy))
        post = 1 / (1 + np.exp(-(votes @ weight + np.log(prior / (1 - prior)))))
        right = np.where(votes > 0, post[:, None], 1 - post[:, None]) * (votes != 0)
        accuracy = np.clip((counts @ right + 8) / (counts @ (votes != 0) + 10), 0.55, 0.99)
        prior = float(np.clip((counts @ post + 5) / (counts.sum() + 10), 0.05, 0.95))
    return post, accuracy


def fit_spans(patterns: dict[int, int], rounds: int = 400) -> frozenset[int]:
    """Patterns that the classifier, fitted to EM's posterior over all patterns, takes for personal data."""
    if not patterns:
        return frozenset()
    keys = sorted(patterns)
    counts = np.array([patterns[k] for k in keys], float)
    parts = [features_of(k) for k in keys]
    votes, x = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    post, _ = reliabilities(votes, counts)
    weight, theta = np.sqrt(counts) / np.sqrt(counts).sum(), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ theta))
        theta -= 4.0 * (x.T @ (weight * (p - post)) + 1e-4 * theta)
    p = 1 / (1 + np.exp(-x @ theta))
    return frozenset(k for k, v in zip(keys, p, strict=True) if v >= 0.5)


FOUND = "struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base:array<string>,found:array<struct<kind:string,start:long,stop:long,pattern:long>>>"


def scanned_texts(texts: pd.Series) -> pd.DataFrame:
    """Base counts, base spans and candidates of each text; of a null text as of an empty one."""
    rows = []
    for text in texts:
        text = "" if text is None else text
        base = base_spans(text)
        kinds = [k for k, _, _ in base]
        more = [{"kind": k, "start": s, "stop": e, "pattern": p} for k, s, e, p in candidates(text, base)]
        rows.append((*[kinds.count(k) for k in BASE], [f"{k}:{s}:{e}" for k, s, e in base], more))
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "found"])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and what ``scanned_texts`` finds, in one pass over whole texts. Only texts go to Python."""
    return docs.select("doc_id", F.pandas_udf(scanned_texts, FOUND)("text").alias("s")).select("doc_id", "s.*")


def fitted(scanned: DataFrame) -> frozenset[int]:
    """Accepted patterns. What is collected is one count per pattern, a number fixed by the code."""
    counts = scanned.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").count()
    return fit_spans({r["pattern"]: r["count"] for r in counts.collect()})


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``docs``.

    A null text is an empty one: no spans, the hash of the empty string. Spans are ``kind:start:end`` in
    code points, base kinds first. Repeated rows get equal results; an empty table gives an empty one.
    """
    rows = stored(scan(docs), "spans")
    accepted = F.array(*[F.lit(p) for p in sorted(fitted(rows))] or [F.lit(-1)])
    added = F.array_sort(F.filter("found", lambda c: F.array_contains(accepted, c["pattern"].cast("int"))))
    named = F.transform(added, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["stop"].cast("string")))
    return rows.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat("base", named), ",").alias("spans"),
    )


def masked_text(text: str, accepted: frozenset[int]) -> str:
    """The text with every span replaced by its kind, such as ``<EMAIL>``. Spans that overlap become one."""
    base = base_spans(text)
    spans = sorted([(s, e, k) for k, s, e in base] + [(s, e, k) for k, s, e, p in candidates(text, base) if p in accepted])
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked; columns as they are, n_chars counted anew. A null text stays null.

    Texts are scanned twice, once for the patterns' counts and once to mask, so that no text is shuffled.
    Other columns never reach Python.
    """
    accepted = fitted(scan(docs))

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked_text(t, accepted) for t in texts], dtype=object)

    out = docs.withColumn("text", F.pandas_udf(run, "string")("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
