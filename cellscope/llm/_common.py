"""Helpers that every training-data operator shares: durable intermediate tables, words, documents.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which all executors share, so
that a lost executor never takes an intermediate result with it. Nothing here is kept in a
machine-local folder on a cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable

# The word of every contract: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here."""
    return durable(df, label)


def hub_join(left: DataFrame, right: DataFrame, on: str | list[str], total: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row per key and in ``n`` how often ``left`` has it out of ``total``.

    Keys with over a thousandth of all rows (a hundred rows at least) are at most a thousand: these rows of ``right`` are broadcast, so
    that no task gets a hot key whole. The other keys meet by shuffle. ``n`` is left out.
    """
    hot = F.col("n") > max(100, total // 1000)
    hubs, rest = F.broadcast(right.filter(hot).drop("n")), right.filter(~hot).drop("n")
    return left.join(hubs, on).unionByName(left.join(hubs.select(on), on, "left_anti").join(rest, on))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` cuts at exactly the contract's six characters."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def let(value: Column, use) -> Column:
    """Bind ``value`` once for ``use``: an expression that a lambda names often is still computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def n_words(text: Column) -> Column:
    """Words in a text (null: 0), counted where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the columns' values: equal on every run, machine and layout."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
