"""Line-first quality rules: judge each line, remove those that fail, reject documents that lose too much.

Everything is DataFrame expressions over one row: no shuffle, no Python. Array work binds its inputs with
``let``, so that no lambda computes an array again for each element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, let

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
LOST_PERCENT = 30

# Phrases of site furniture, lower case.
BOILERPLATE = (
    "all rights reserved|cookie policy|accept cookies|accept all cookies|terms of use|terms of service|privacy policy"
    "|enable javascript|click here to|subscribe to our newsletter|sign up for our|share this page|skip to content|back to top"
    "|tous droits réservés|politique de confidentialité|conditions générales|accepter les cookies|haut de page"
    "|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|cookies akzeptieren|nach oben springen"
    "|todos los derechos reservados|política de privacidad|condiciones de uso|aceptar cookies|volver arriba"
)
WHITE = " \t\n\x0b\f\r"
BARS = "|»•·"


def _marks(c: Column, chars: str) -> Column:
    """How many of ``chars`` a text has: by plain search for one character, by one pattern for several."""
    if len(chars) == 1:
        return F.length(c) - F.length(F.replace(c, F.lit(chars), F.lit("")))
    return F.coalesce(F.regexp_count(c, F.lit(f"[{chars}]")), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text: white space of all kinds becomes blanks, then the text is cut at each."""
    for white in WHITE[1:]:
        text = F.replace(text, F.lit(white), F.lit(" "))
    return F.filter(F.split(text, " "), lambda x: x != "")


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more among ``w``, first occurrences included.

    Windows are hashed in place; most texts have no equal hashes and stop there. Otherwise windows are
    sorted by (hash, place): equal ones are neighbours; the places found are then merged as intervals.
    """
    hashes = let(w, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2))))

    def covered(h: Column) -> Column:
        def places(s: Column) -> Column:
            twin = F.transform(s, lambda e, j: F.when((e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]), e["i"]))
            return F.array_sort(F.filter(twin, lambda p: p.isNotNull()))

        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.aggregate(
            let(ordered, places),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")),
            lambda a: a["n"],
        )

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(found)


def judged_line(line: Column) -> Column:
    """``struct(line, words)`` of a line; words is null unless it fails.

    A line fails by punctuation (symbols or exclamations throughout), navigation bars, or boilerplate.
    """
    words = F.coalesce(F.regexp_count(line, F.lit(WORD)), F.lit(0))

    def verdict(n: Column) -> Column:
        # Whole-line tests: a mark for every other word, bars between most words.
        symbols, shouts, bars = _marks(line, SYMBOLS), _marks(line, "!"), _marks(line, BARS)
        furniture = (n <= 30) & F.lower(line).rlike(BOILERPLATE)
        fails = (symbols >= 3) & (symbols * 2 >= n) | (shouts >= 6) & (shouts * 2 >= n) | (bars >= 3) & (bars * 4 >= n) | furniture
        return F.struct(line.alias("line"), F.when(fails, n).alias("words"))

    return let(words, verdict)


def may_fail(text: Column) -> Column:
    """False only if no line of the text can fail: too few marks in all of it, and no phrase of site furniture."""

    def has_phrase(low: Column) -> Column:
        found = F.lit(False)
        for p in BOILERPLATE.split("|"):
            found = found | low.contains(p)
        return found

    return (_marks(text, SYMBOLS) >= 3) | (_marks(text, "!") >= 6) | (_marks(text, BARS) >= 3) | let(F.lower(text), has_phrase)


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the figures and the verdict to each row; added columns start with ``q_``.

    ``q_n_words, q_word_chars, q_n_symbols, q_n_dup_lines, q_n_repeat_words``, ``q_base_failed``,
    ``q_lost_words`` (words in failing lines), ``q_clean_text`` (the other lines, in order), ``q_kept``.
    A null text counts as an empty one: 0 words, base failed, clean text empty. Line breaks are ``\\n``;
    a line without a word is kept as it is. A very long text or line is judged whole. Rows are independent: repeated rows get equal verdicts, an
    empty table gives an empty result.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n", -1)
    base = docs.withColumns({"q__t": t, "q__w": words_of(t), "q__lines": lines})
    with_word = F.filter("q__lines", lambda x: F.btrim(x, F.lit(WHITE)) != "")
    base = base.withColumn("q__judged", F.when(may_fail(F.col("q__t")), F.transform("q__lines", judged_line)))
    lost = F.aggregate("q__judged", F.lit(0), lambda n, x: n + F.coalesce(x["words"], F.lit(0)))
    good = F.filter("q__judged", lambda x: x["words"].isNull())
    clean = F.when(F.size(good) < F.size("q__lines"), F.array_join(F.transform(good, lambda x: x["line"]), "\n")).otherwise(F.col("q__t"))
    figures = base.withColumns(
        {
            "q_n_words": F.size("q__w").cast("long"),
            "q_word_chars": F.length(F.array_join("q__w", "")).cast("long"),
            "q_n_symbols": _marks(F.col("q__t"), SYMBOLS).cast("long"),
            "q_n_dup_lines": let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "q_n_repeat_words": repeated_words(F.col("q__w")).cast("long"),
            "q_lost_words": F.coalesce(lost, F.lit(0)).cast("long"),
            "q_clean_text": clean,
        }
    )
    failed = (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > REPEAT_PERCENT * F.col("q_n_words"))
    kept = ~failed & (100 * F.col("q_lost_words") <= LOST_PERCENT * F.col("q_n_words"))
    return figures.withColumns({"q_base_failed": failed, "q_kept": kept}).drop("q__t", "q__w", "q__lines", "q__judged")


def digest(docs: DataFrame) -> DataFrame:
    """The figures of ``judged`` under the names of the query's contract."""
    found = judged(docs.select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept"]
    return found.select("doc_id", *[F.col(f"q_{n}").alias(n) for n in names])


def filtered(docs: DataFrame) -> DataFrame:
    """Documents that are kept, with the text that their lines left; columns as in ``docs``."""
    # The whole row travels as one struct, so no name in it can clash.
    found = judged(docs.select(F.struct("*").alias("row"), F.col("text"))).filter("q_kept")
    row = F.col("row").withField("text", F.col("q_clean_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("q_clean_text").cast(docs.schema["n_chars"].dataType))
    return found.select(row.alias("row")).select("row.*")
