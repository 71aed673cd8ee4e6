"""Mixing sources to target weights: repetition rates per source, whole copies plus one Bernoulli copy.

All of it is DataFrame operations. Sizes are counted once per document and stored with its source (no
texts); tokens are summed per source, map-side first, so a hot source costs no more than others. Every
document has a hash-seeded draw in [0, 1), and its further copy when the draw is under the source's
fraction. A few long documents can carry a source far from its target that way, so the cut for all others
moves to where the source's words come nearest to it: documents over 1/LARGE of their source draw against
the fraction itself, the rest against the cut. The cut is found from words by (source, BINS of the draw),
then from the documents of the one bin where the target falls, so no task gets a whole hot source.

Rates are joined by broadcast while the number of sources is within ``BROADCAST_SOURCES``; beyond it each
source's row is dealt over ``SALTS`` salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import n_words, stored, unit_hash

MOST = 3  # times that a document, and so a source, may be taken
WEIGHTS = (1, 2, 3)
BROADCAST_SOURCES = 50_000  # rows of about 60 bytes
SALTS = 64
SEED = 17
LARGE = 25
BINS = 4096


def source_targets(per_source: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the total; a target stops at
    three times its source and the excess is shared by weight among the rest. That ends at one level
    L with target = min(3 * size, weight * L). Ordered by 3 * size / weight, the sources that stop are a
    prefix: it ends where the tokens left, shared by the weight left, first fit under a source's cap.
    The table has a row per source, never per document, so its two global windows are small.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = per_source.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    by_cap = Window.orderBy(MOST * F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before, all_rows = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = ranked.select(
        "*",
        (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0))).alias("tokens"),
        (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("weights"),
        F.row_number().over(by_cap).alias("place"),
    )
    fits = F.col("tokens") * F.col("w") <= MOST * F.col("source_size") * F.col("weights")
    level = left.withColumn("first", F.min(F.when(fits, F.struct("place", "tokens", "weights"))).over(all_rows))
    capped = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    target = F.when(capped, (MOST * F.col("source_size")).cast("double")).otherwise((F.col("w") * F.col("first.tokens")).cast("double") / F.col("first.weights"))
    return level.select("source", "source_size", target.alias("target"))


def draw(key: Column) -> Column:
    """A document's draw in [0, 1), a multiple of 2**-52, from its id."""
    return unit_hash(key, seed=SEED)


def _to_sources(rows: DataFrame, source: str, targets: DataFrame, n: int, key: str) -> DataFrame:
    """``rows`` with the columns of their source in ``targets(__source, ...)``."""
    same = F.col(source).eqNullSafe(F.col("__source"))
    if n <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(targets), same)
    salted = targets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__own", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("__own") == F.col("__salt"))).drop("__own", "__salt")


def with_cuts(sized: DataFrame) -> tuple[DataFrame, int]:
    """``__source, source_size, target, whole, fraction, cut`` of every source of ``sized(doc_id, source, size)``, and their number."""
    per_source = stored(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sources")
    n = per_source.count()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = source_targets(per_source).withColumn("rate", rate).select(F.col("source").alias("__source"), "source_size", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("fraction"))
    rates = stored(rates, "rates")
    large = F.col("size") * LARGE > F.col("source_size")
    drawn = _to_sources(sized, "source", rates, n, "doc_id").select("__source", "size", "source_size", "fraction", draw(F.col("doc_id")).alias("h"), large.alias("large"))
    bins = drawn.groupBy("__source", F.floor(F.col("h") * BINS).alias("bin")).agg(
        F.coalesce(F.sum(F.when(~F.col("large"), F.col("size"))), F.lit(0)).alias("words"),
        F.coalesce(F.sum(F.when(F.col("large") & (F.col("h") < F.col("fraction")), F.col("size"))), F.lit(0)).alias("taken"),
    )
    upto = Window.partitionBy("__source").orderBy("bin")
    whole = Window.partitionBy("__source")
    bins = bins.select("__source", "bin", F.sum("words").over(upto).alias("end"), "words", F.sum("words").over(whole).alias("small"), F.sum("taken").over(whole).alias("taken"))
    same = lambda d: d.withColumnRenamed("__source", "__s")
    want = F.col("target") - F.col("whole") * F.col("source_size") - F.col("taken")
    bins = rates.join(same(bins), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("want", want)
    at = stored(bins.filter((F.col("end") - F.col("words") <= F.col("want")) & (F.col("want") < F.col("end"))).select("__source", "bin", "want", (F.col("end") - F.col("words")).alias("before")), "bins")
    # The documents of one bin for each source; equal draws are one step.
    inside = _to_sources(sized, "source", rates.select("__source", "source_size").join(same(at), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s"), n, "doc_id")
    inside = inside.withColumn("h", draw(F.col("doc_id"))).filter((F.floor(F.col("h") * BINS) == F.col("bin")) & ~large)
    steps = inside.groupBy("__source", "bin", "want", "before", "h").agg(F.sum("size").alias("size"))
    steps = steps.select("__source", "h", (F.col("before") + F.sum("size").over(Window.partitionBy("__source").orderBy("h")) - F.col("want")).alias("miss"))
    # A cut below the whole bin: draws are multiples of 2**-52.
    below = at.select("__source", (F.col("bin") / BINS - F.lit(2.0**-53)).alias("h"), (F.col("before") - F.col("want")).alias("miss"))
    cuts = steps.unionByName(below).groupBy("__source").agg(F.min(F.struct(F.abs("miss").alias("miss"), "h"))["h"].alias("cut"))
    ends = bins.groupBy("__source").agg((F.max("want") < 0).alias("none"))
    named = rates.join(same(cuts), F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s").join(same(ends), F.col("__source").eqNullSafe(F.col("__s")), "left")
    cut = F.coalesce("cut", F.when(F.col("none"), F.lit(-1.0)).otherwise(F.lit(1.0)))
    return stored(named.select("__source", "source_size", "target", "whole", "fraction", cut.alias("cut")), "cuts"), n


def copies(size: Column, key: Column) -> Column:
    """Whole copies, and one more by the draw; from the columns of ``with_cuts``."""
    h = draw(key)
    more = F.when(size * LARGE > F.col("source_size"), h < F.col("fraction")).otherwise(h <= F.col("cut"))
    return (F.col("whole") + (more & (F.col("fraction") > 0)).cast("long")).cast("long")


def mix_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``.

    A null or empty text has size 0. A null source is a source of its own, the last. Rows that repeat a
    doc_id share its draw. Sources without words have the target 0. An empty table gives an empty result.
    A very long document costs no more than its count. Further columns are ignored.
    """
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    cuts, n = with_cuts(sized)
    rated = _to_sources(sized, "source", cuts, n, "doc_id").withColumn("copies", copies(F.col("size"), F.col("doc_id")))
    return rated.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as ``mix_digest`` says, columns unchanged.

    The rows keep their place: only the table of sources is joined to them, so no text is shuffled.
    """
    cuts, n = with_cuts(stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes"))
    # The whole row travels as one struct, so no name in it can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("__doc"), F.col("source").alias("__from"), n_words(F.col("text")).alias("__size"))
    rated = _to_sources(rows, "__from", cuts, n, "__doc").withColumn("__times", copies(F.col("__size"), F.col("__doc")))
    return rated.filter("__times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "__times")).alias("__copy")).select("row.*")
