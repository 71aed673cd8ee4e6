"""Areas mapped as relations: their member ways joined end to end into rings.

Ways whose ends meet in pairs form rings; each way is walked in both directions, and the walk that starts at the smallest way in its
own direction is kept. Rings are found and ordered by pointer doubling over the ways of all relations at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import chains, graph


def rings(members: DataFrame, ways: DataFrame) -> DataFrame:
    """``relation, role, ring, refs``: closed rings of node ids, first and last equal.

    ``members(relation, way, role)`` names the ways, ``ways(k, refs)`` their nodes; a role that is empty or null is outer. A closed
    way is a ring. Open ways are a ring when every end of theirs meets exactly one other; a group of ways with a
    loose end, or an end where three meet, gives none. A ring has three different nodes at least. Members that are missing or have
    fewer than two nodes are left out, repeated ones count once.
    """
    role = F.when(F.coalesce("role", F.lit("")) == "", "outer").otherwise(F.col("role"))
    own = members.select("relation", "way", role.alias("role")).distinct().join(ways.select(F.col("k").alias("way"), "refs").hint("merge"), "way").filter(F.size("refs") >= 2)
    own = durable(own.select("relation", "role", "way", "refs", F.get("refs", F.lit(0)).alias("head"), F.element_at("refs", -1).alias("tail")))
    closed = own.filter((F.col("head") == F.col("tail")) & (F.size("refs") >= 4)).select("relation", "role", F.col("way").cast("string").alias("ring"), "refs")
    open_ = own.filter("head <> tail")
    ends = open_.select("relation", "role", "way", F.explode(F.array("head", "tail")).alias("end"))
    meet = durable(ends.groupBy("relation", "role", "end").agg(F.count("*").alias("n"), F.min("way").alias("one"), F.max("way").alias("other")))
    name = lambda c: F.struct("relation", "role", F.col(c).alias("way"))
    linked = meet.filter("n = 2").select(name("one").alias("a"), name("other").alias("b")).filter("a <> b")
    group = durable(open_.select("relation", "role", "way", name("way").alias("node")).join(graph.components(linked), "node", "left").withColumn("group", F.coalesce("component", "node")))
    loose = ends.join(meet.filter("n <> 2").hint("merge"), ["relation", "role", "end"], "left_semi").select("relation", "role", "way")
    broken = group.join(loose.hint("merge"), ["relation", "role", "way"], "left_semi").select("group").distinct()
    whole = open_.join(group.join(broken.hint("merge"), "group", "left_anti").select("relation", "role", "way").hint("merge"), ["relation", "role", "way"])
    arc = lambda a, b, d: whole.select("relation", "role", "way", F.lit(d).alias("back"), F.col(a).alias("start"), F.col(b).alias("end"))
    arcs = arc("head", "tail", 0).unionByName(arc("tail", "head", 1))
    onward = arcs.select("relation", "role", F.col("start").alias("end"), F.col("way").alias("way2"), F.col("back").alias("back2"))
    met = arcs.join(onward.hint("merge"), ["relation", "role", "end"]).filter("way <> way2")
    ident = lambda w, b: F.struct("relation", "role", F.col(w).alias("way"), F.col(b).alias("back"))
    links = durable(met.select(ident("way", "back").alias("node"), ident("way2", "back2").alias("next")))
    led = chains.ring_leaders(links).filter("leader.back = 0").join(links.hint("merge"), "node")
    led = durable(led)
    cut = led.select("node", F.when(F.col("next") != F.col("leader"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("rest"))
    placed = chains.along(cut, {"rest": lambda a, b: a + b}).join(led.select("node", "leader").hint("merge"), "node")
    placed = placed.select("node.relation", "node.role", "node.way", "node.back", "leader", "rest").join(own.select("relation", "role", "way", "refs").hint("merge"), ["relation", "role", "way"])
    walked = F.when(F.col("back") == 1, F.reverse("refs")).otherwise(F.col("refs"))
    steps = F.array_sort(F.collect_list(F.struct(-F.col("rest"), F.slice(walked, 1, F.size("refs") - 1).alias("refs"))))
    joined = placed.groupBy("relation", "role", F.col("leader.way").cast("string").alias("ring")).agg(F.flatten(F.transform(steps, lambda s: s["refs"])).alias("refs"))
    joined = joined.select("relation", "role", "ring", F.concat("refs", F.slice("refs", 1, 1)).alias("refs")).filter(F.size(F.array_distinct("refs")) >= 3)
    return closed.unionByName(joined)


def area_centres(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """``k, lat, lon, tags`` of multipolygon relations: the middle of the box around their outer rings' nodes.

    ``relations(k, members array<struct<way, role>>, tags)``; other types of relation than multipolygons and boundaries have no area, nor have
    relations without a whole outer ring. Areas that are one closed way are ways already and aren't made again.
    """
    own = relations.filter(F.try_element_at("tags", F.lit("type")).isin("multipolygon", "boundary"))
    members = own.select(F.col("k").alias("relation"), F.explode("members").alias("m")).select("relation", "m.way", "m.role")
    outer = rings(members, ways).filter("role = 'outer'").select("relation", F.explode("refs").alias("node"))
    met = outer.join(nodes.select(F.col("k").alias("node"), "lat", "lon").hint("merge"), "node").filter("lat is not null and lon is not null")
    box = met.groupBy(F.col("relation").alias("k")).agg(((F.min("lat") + F.max("lat")) / 2).alias("lat"), ((F.min("lon") + F.max("lon")) / 2).alias("lon"))
    return box.join(own.select("k", "tags").hint("merge"), "k")
