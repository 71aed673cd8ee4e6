"""URL filters: fixed rules first, then a tree of path templates per host.

Rules give verdicts to the urls that they cover; these are the labels. Each url is put on a node of its
host's template tree, at its full depth: path segments whose values vary (numbers, hashes, or segments with
many siblings under one parent) are generalised to wildcards. Level by level from the top, labelled sibling
branches are merged when two likelihood-ratio tests find no difference between them: one on their blocked
and allowed urls, one on how their urls spread over the templates below them. A branch without labels joins
the merged branches that its commonest template below is most usual in, if the second test finds no
difference and both sides have ``EVIDENCE``: urls here, labels there. What was below merged branches is
merged in the next level. A template is rejected if its purity reaches the threshold: the share of blocked
among its labelled urls, smoothed towards that of its merged branch, which is smoothed towards that of the
branch above it. A template whose first segment has and gets no labels is allowed. All of it is counting:
aggregation map-side first, joins on (host, branch); no two branches are paired but neighbours and a branch
with its candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard
from ._common import hub_join, stored

# Fixed values: (verdict, host, path) of the rules, longest rule first when several fit.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
VARIES = 24  # different values under one parent from which a segment is a wildcard
PRIOR = 4.0  # labelled urls that the parent's share weighs
BASE_SHARE = 0.25  # share of blocked urls that is assumed where nothing is known
THRESHOLD = 0.8
EVIDENCE = 8  # urls of a branch without labels, and labels of the branches that it joins
# Fixed value: the 95 % point of chi-squared with one degree of freedom; for more degrees see ``unlike``.
CHI_ONE = 3.841
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to /, ?, # or the end, A-Z lowered; then up to ? or #."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null: host and subdomains, path prefix."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _segment(s: Column) -> Column:
    """A segment generalised by its form; its file ending stays."""
    stem, ending = F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, r"(?s)(\.[A-Za-z]{1,5})$", 1)
    form = (
        F.when(stem.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(stem.rlike(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"), F.lit("{date}"))
        .when(stem.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), F.lit("{hex}"))
        .when(stem.rlike(r"[0-9]"), F.lit("{mixed}"))
        .otherwise(stem)
    )
    return F.concat(form, ending)


def template_nodes(path: Column) -> Column:
    """All segments of a path in general form."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _segment)


def wildcards(urls: DataFrame) -> DataFrame:
    """Replace a segment by ``*`` where its parent has more than VARIES different children.

    Level by level from the top, as a wildcard gathers what was below its siblings, until no host has enough
    paths of that depth for another wildcard. Children are counted over distinct (host, parent, child) rows,
    so a hot host is counted in many tasks first. Each level is stored.
    """
    nodes = stored(urls.withColumn("path", F.col("nodes")), "nodes")
    level = 0
    while not nodes.filter(F.size("nodes") > level).groupBy("host").count().filter(F.col("count") > VARIES).isEmpty():
        parent, child = F.slice("nodes", 1, level), F.get(F.col("nodes"), F.lit(level))
        kids = nodes.filter(child.isNotNull()).select("host", parent.alias("parent"), child.alias("child")).distinct()
        wide = kids.groupBy("host", "parent").agg(F.count("*").alias("kids")).filter(F.col("kids") > VARIES).select("host", "parent", F.lit(True).alias("wide"))
        below = F.slice("nodes", level + 2, F.greatest(F.size("nodes") - level - 1, F.lit(0)))
        general = F.when(F.col("wide") & child.isNotNull(), F.concat(parent, F.array(F.lit("*")), below)).otherwise(F.col("nodes"))
        after = stored(nodes.withColumn("parent", parent).join(wide, ["host", "parent"], "left").withColumn("nodes", general).drop("parent", "wide"), "nodes")
        discard(nodes)
        nodes, level = after, level + 1
    return nodes.select("host", F.col("path").alias("raw"), "nodes", "n", "blocked", "labelled")


def _entropy(*counts: Column) -> Column:
    """Sum of n ln n."""
    out = F.lit(0.0)
    for c in counts:
        out = out + F.when(c > 0, c * F.log(c.cast("double"))).otherwise(F.lit(0.0))
    return out


def unlike(g: Column, freedom: Column) -> Column:
    """Is a likelihood ratio beyond the 95 % point of chi-squared (Wilson and Hilferty's form above one degree)?"""
    part = F.lit(2.0) / (9 * F.greatest(freedom, F.lit(1)))
    point = F.when(freedom <= 1, F.lit(CHI_ONE)).otherwise(freedom * F.pow(1 - part + 1.645 * F.sqrt(part), F.lit(3.0)))
    return (freedom > 0) & (g > point)


def alike(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``on, alike`` from two tables ``on, below, m``: do urls spread alike over the templates below?"""
    zero = F.lit(0).cast("long")
    both = left.select(*on, "below", F.col("m").alias("x"), zero.alias("y")).unionByName(right.select(*on, "below", zero.alias("x"), F.col("m").alias("y")))
    x, y = F.col("x"), F.col("y")
    sums = both.groupBy(*on, "below").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    whole = sums.groupBy(*on).agg(F.sum(_entropy(x, y) - _entropy(x + y)).alias("parts"), F.sum("x").alias("x"), F.sum("y").alias("y"), (F.count("*") - 1).alias("freedom"))
    return whole.select(*on, (~unlike(2 * (F.col("parts") + _entropy(x + y) - _entropy(x, y)), F.col("freedom"))).alias("alike"))


def merged_siblings(below: DataFrame, branches: DataFrame) -> DataFrame:
    """``host, parent, child, as, gb, gl`` of the branches that have or get labels.

    ``below(host, parent, child, below, m)`` counts urls, ``branches(host, parent, child, n, b, l)`` sums
    them up. ``as`` is one child for all that merge, ``gb`` and ``gl`` their blocked and labelled urls.
    Labelled siblings are ordered by their share of blocked urls, and neighbours that are alike are merged.
    """
    family = ["host", "parent"]
    along = Window.partitionBy(*family).orderBy(F.col("b") / F.col("l"), "child")
    before = lambda c: F.lag(c).over(along).alias(f"{c}0")
    near = stored(branches.filter("l > 0").select("*", F.row_number().over(along).alias("place"), before("child"), before("b"), before("l")), "branches")
    b, l, b0, l0 = (F.col(c) for c in ("b", "l", "b0", "l0"))  # noqa: E741
    labels = 2 * (_entropy(b, l - b, b0, l0 - b0) + _entropy(l + l0) - _entropy(b + b0, l - b + l0 - b0) - _entropy(l, l0))
    pairs = near.filter("child0 is not null")
    own = pairs.join(below, [*family, "child"])
    other = pairs.select(*family, "place", F.col("child0").alias("child")).join(below, [*family, "child"])
    tested = pairs.join(alike(own, other, [*family, "place"]), [*family, "place"])
    breaks = tested.select(*family, "place", (unlike(labels, F.lit(1)) | ~F.col("alike")).cast("int").alias("break"))
    run = Window.partitionBy(*family).orderBy("place")
    runs = near.join(breaks, [*family, "place"], "left").select(*family, "child", "place", "b", "l", F.sum(F.coalesce("break", F.lit(0))).over(run).alias("g"))
    whole = Window.partitionBy(*family, "g")
    groups = stored(runs.select(*family, "child", "g", F.min_by("child", "place").over(whole).alias("as"), F.sum("b").over(whole).alias("gb"), F.sum("l").over(whole).alias("gl")), "groups")
    # Branches without labels: one candidate for each.
    sums = groups.filter(F.col("gl") >= EVIDENCE).join(below, [*family, "child"]).groupBy(*family, "g", "below").agg(F.sum("m").alias("m"))
    spread = stored(sums.withColumn("part", F.col("m") / F.sum("m").over(whole)), "spread")
    bare = branches.filter((F.col("l") == 0) & (F.col("n") >= EVIDENCE)).join(below, [*family, "child"])
    chief = bare.groupBy(*family, "child").agg(F.min(F.struct((-F.col("m")).alias("m"), "below"))["below"].alias("below"))
    best = stored(chief.join(spread, [*family, "below"]).groupBy(*family, "child").agg(F.min(F.struct((-F.col("part")).alias("part"), "g"))["g"].alias("g")), "candidates")
    fits = alike(best.join(below, [*family, "child"]), best.join(spread, [*family, "g"]), [*family, "child"]).filter("alike")
    named = groups.select(*family, "g", "as", "gb", "gl").distinct()
    joined = best.join(fits, [*family, "child"]).join(named, [*family, "g"])
    columns = [*family, "child", "as", "gb", "gl"]
    return groups.select(columns).unionByName(joined.select(columns))


def merged_level(tree: DataFrame, level: int) -> DataFrame:
    """``tree`` with the segment at ``level`` merged, and ``share`` smoothed by the labels there.

    Below the first level a branch without siblings adds nothing to its parent's share.
    """
    parent, child = F.slice("nodes", 1, level), F.get(F.col("nodes"), F.lit(level))
    rest = F.slice("nodes", level + 2, F.greatest(F.size("nodes") - level - 1, F.lit(0)))
    here = tree.filter((F.size("nodes") > level) & (F.lit(level == 0) | F.col("share").isNotNull()))
    keyed = here.select("host", parent.alias("parent"), child.alias("child"), F.array_join(rest, "/").alias("below"), "n", "blocked", "labelled")
    below = stored(keyed.groupBy("host", "parent", "child", "below").agg(F.sum("n").alias("m"), F.sum("blocked").alias("b"), F.sum("labelled").alias("l")), "below")
    family = Window.partitionBy("host", "parent")
    branches = below.groupBy("host", "parent", "child").agg(F.sum("m").alias("n"), F.sum("b").alias("b"), F.sum("l").alias("l"))
    branches = branches.withColumns({"any": F.sum("l").over(family) > 0, "siblings": F.count("*").over(family)})
    branches = stored(branches.filter(F.col("any") & (F.lit(level == 0) | (F.col("siblings") > 1))), "siblings")
    found = merged_siblings(below.select("host", "parent", "child", "below", "m"), branches)
    joined = tree.withColumns({"parent": parent, "child": child}).join(found, ["host", "parent", "child"], "left")
    above = F.lit(BASE_SHARE) if level == 0 else F.col("share")
    share = F.when(F.col("gl").isNotNull(), (F.col("gb") + PRIOR * above) / (F.col("gl") + PRIOR)).otherwise(F.col("share"))
    own = F.when(F.col("as").isNotNull(), F.concat("parent", F.array("as"), rest)).otherwise(F.col("nodes"))
    return joined.select("host", "raw", "n", "blocked", "labelled", "template", own.alias("nodes"), share.alias("share"))


def judged_templates(counted: DataFrame) -> DataFrame:
    """``host, raw, n, template, purity, rejected`` from ``wildcards``' table; purity is null where no labels reach.

    A round for each level at which a host with labels still has two paths.
    """
    template = F.concat(F.lit("/"), F.array_join("nodes", "/"))
    nodes = F.when(F.size("nodes") == 0, F.array(F.lit(""))).otherwise(F.col("nodes"))
    tree = stored(counted.select("host", "raw", "n", "blocked", "labelled", template.alias("template"), nodes.alias("nodes"), F.lit(None).cast("double").alias("share")), "tree")
    level = 0
    while level == 0 or not tree.filter((F.size("nodes") > level) & F.col("share").isNotNull()).select("host", "nodes").distinct().groupBy("host").count().filter("count > 1").isEmpty():
        after = stored(merged_level(tree, level), "tree")
        discard(tree)
        tree, level = after, level + 1
    templates = tree.groupBy("host", "template").agg(F.sum("blocked").alias("tb"), F.sum("labelled").alias("tl"), F.max("share").alias("share"))
    scored = templates.select("host", "template", ((F.col("tb") + PRIOR * F.col("share")) / (F.col("tl") + PRIOR)).alias("purity"))
    return tree.select("host", "raw", "n", "template").join(scored, ["host", "template"]).select("host", "raw", "n", "template", "purity", F.coalesce(F.col("purity") >= THRESHOLD, F.lit(False)).alias("rejected"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path and is judged like any other, on the
    template ``/`` of the empty host. A very long path has as many nodes as segments. Repeated rows count as often as they come and get equal verdicts. An
    empty table gives an empty result. Only page_id and url are read.
    """
    host, path = parts_of(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    own = own.withColumn("fits", rule_of(F.col("host"), F.col("path"), rules)).withColumn("nodes", template_nodes(F.col("path")))
    own = stored(own, "urls")
    counts = own.groupBy("host", "nodes").agg(
        F.count("*").alias("n"), F.count_if(F.col("fits.verdict") == "block").alias("blocked"), F.count("fits").alias("labelled")
    )
    verdicts = stored(judged_templates(stored(wildcards(counts), "templates")), "verdicts")
    named = hub_join(own, verdicts.withColumnRenamed("raw", "nodes"), ["host", "nodes"], own.count())
    method = F.when(F.coalesce(F.col("rejected"), F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return named.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce(F.col("fits.verdict"), method).alias("verdict"), "template", "purity")
