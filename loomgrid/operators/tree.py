"""Trees given by id and parent: paths, reach and cycles, subtrees, cuts and dependencies.

What lies above a node is found by pointer jumping: each round a node takes over what
the node it points to has found, so it points twice as far, and a tree of any height
takes as many rounds as its height has binary digits. The depths of a tree leave no
gap, so a round in which no node gets done is the last: what is left hangs on a cycle.

Ids are unique. A parent that is no node has no root above it; it is reported, not
followed. Nodes on a cycle, or below one, have no path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.rounds import cut


def _jumped(state: DataFrame, joined: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The done and the undone rows after all rounds; state: id, at, done and what `joined` names of a row and the row `s` it points to."""
    state, before = cut(state), None
    done, open_ = state.filter("done"), state.filter("not done")
    while (left := open_.count()) and left != before:
        before = left
        s = done.unionByName(open_).select(*(F.col(c).alias(f"s_{c}") for c in state.columns))
        # a node that points to none is at an end
        open_ = open_.join(s, F.col("at") == F.col("s_id"), "left")
        met = cut(open_.select("id", F.when(F.col("s_id").isNull(), F.col("at")).otherwise(F.col("s_at")).alias("at"), F.coalesce("s_done", F.lit(True)).alias("done"), *joined))
        done, open_ = done.unionByName(met.filter("done")), met.filter("not done")
    return done, open_


def reach(nodes: DataFrame) -> DataFrame:
    """id, root, depth, state and cycle of every node.

    state: `reached` from a root; `lost` below a parent that is no node; on a `cycle`, or `below` one. cycle: its least id.
    """
    own = nodes.select("id", "parent")
    known = own.join(own.select(F.col("id").alias("parent"), F.lit(True).alias("_known")), "parent", "left")
    root, lost = F.col("parent").isNull(), F.col("_known").isNull()
    begin = known.select("id", F.when(root | lost, F.col("id")).otherwise(F.col("parent")).alias("at"), (root | lost).alias("done"), F.when(root | lost, 0).otherwise(1).cast("long").alias("hops"), (~root & lost).alias("lost"))
    done, open_ = _jumped(begin, [(F.col("hops") + F.coalesce("s_hops", F.lit(0))).alias("hops"), F.coalesce("s_lost", F.lit(True)).alias("lost")])
    reached = done.select("id", F.when(~F.col("lost"), F.col("at")).alias("root"), F.when(~F.col("lost"), F.col("hops")).alias("depth"), F.when(F.col("lost"), "lost").otherwise("reached").alias("state"), F.lit(None).cast(own.schema["id"].dataType).alias("cycle"))
    if open_.isEmpty():
        return reached
    # far enough on, every pointer is on a cycle: once a round no longer lessens the nodes pointed to
    at, before = cut(open_.select("id", "at")), None
    while (ends := at.select("at").distinct().count()) != before:
        before = ends
        at = cut(at.join(at.select(F.col("id").alias("at"), F.col("at").alias("_next")), "at").select("id", F.col("_next").alias("at")))
    on = cut(at.select(F.col("at").alias("id")).distinct())
    low = cut(on.join(own, "id").select("id", F.col("parent").alias("at"), F.least("id", "parent").alias("low")))
    while True:
        s = low.select(F.col("id").alias("at"), F.col("at").alias("_next"), F.col("low").alias("_low"))
        low = cut(low.join(s, "at").select("id", F.col("_next").alias("at"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("_less")))
        if low.filter("_less").isEmpty():
            break
        low = low.drop("_less")
    names = low.select(F.col("id").alias("at"), F.col("low").alias("cycle"))
    hung = at.join(names, "at").join(on.select("id", F.lit(True).alias("_on")), "id", "left")
    return reached.unionByName(hung.select("id", F.lit(None).cast(own.schema["id"].dataType).alias("root"), F.lit(None).cast("long").alias("depth"), F.when(F.col("_on"), "cycle").otherwise("below").alias("state"), "cycle"))


def nearest(nodes: DataFrame, stops: DataFrame) -> DataFrame:
    """id, target and depth: the first ancestor that is among stops (id), and the number of others before it."""
    own = nodes.filter("parent is not null").select("id", "parent").join(stops.select(F.col("id").alias("parent"), F.lit(True).alias("_stop")).distinct(), "parent", "left")
    begin = own.select("id", F.col("parent").alias("at"), F.coalesce("_stop", F.lit(False)).alias("done"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("lost"))
    done, _ = _jumped(begin, [(F.col("depth") + 1 + F.coalesce("s_depth", F.lit(0))).alias("depth"), F.coalesce("s_lost", F.lit(True)).alias("lost")])
    return done.filter("not lost").select("id", F.col("at").alias("target"), "depth")


def paths(nodes: DataFrame) -> DataFrame:
    """id, path (the ids from the root to it) and depth of every node that a root reaches."""
    begin = nodes.select("id", F.col("parent").alias("at"), F.col("parent").isNull().alias("done"), F.array("id").alias("path"), F.lit(False).alias("lost"))
    done, _ = _jumped(begin, [F.when(F.col("s_id").isNull(), F.col("path")).otherwise(F.concat("s_path", "path")).alias("path"), F.coalesce("s_lost", F.lit(True)).alias("lost")])
    return done.filter("not lost").select("id", "path", (F.size("path") - 1).alias("depth"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """id, ancestor and distance, itself left out."""
    walked = paths(nodes)
    return walked.select("id", F.posexplode("path").alias("_p", "ancestor"), "depth").filter("id <> ancestor").select("id", "ancestor", (F.col("depth") - F.col("_p")).cast("long").alias("distance"))


def subtree_counts(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Units of each node's subtree; members: unit, node."""
    up = paths(nodes).select(F.col("id").alias("node"), F.explode("path").alias("id"))
    own = members.join(up, "node").groupBy("id").agg(F.count_distinct("unit").alias("units"))
    return nodes.select("id").join(own, "id", "left").select("id", F.coalesce("units", F.lit(0)).alias("units"))


def sibling_dependencies(nodes: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """a, b and count: links between units, at the first depth at which their nodes' paths part.

    Links are summed by pairs of nodes before any path is looked at.
    """
    own = members.select("unit", "node")
    a, b = own.select(F.col("unit").alias("from"), F.col("node").alias("na")), own.select(F.col("unit").alias("to"), F.col("node").alias("nb"))
    sums = links.filter("`from` <> `to`").join(a, "from").join(b, "to").filter("na <> nb").groupBy("na", "nb").agg(F.sum("count").alias("count"))
    walked = cut(paths(nodes).select("id", "path"))
    met = sums.join(walked.select(F.col("id").alias("na"), F.col("path").alias("pa")), "na").join(walked.select(F.col("id").alias("nb"), F.col("path").alias("pb")), "nb")
    parts = met.withColumn("_d", F.array_position(F.zip_with("pa", "pb", lambda x, y: F.when(x.isNull() | y.isNull(), F.lit("end")).when(x != y, F.lit("part")).otherwise(F.lit("same"))), F.lit("part")))
    short = F.least(F.size("pa"), F.size("pb"))
    return parts.filter((F.col("_d") > 0) & (F.col("_d") <= short)).groupBy(F.element_at("pa", F.col("_d").cast("int")).alias("a"), F.element_at("pb", F.col("_d").cast("int")).alias("b")).agg(F.sum("count").alias("count"))


def cut_at(nodes: DataFrame, members: DataFrame, depth: int) -> DataFrame:
    """unit and its group at this depth, or its own node if that is higher."""
    walked = paths(nodes).select(F.col("id").alias("node"), "path")
    return members.join(walked, "node").select("unit", F.element_at("path", F.least(F.lit(depth + 1), F.size("path"))).alias("group"))


def checks(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """check, ok and detail of a tree's structure."""
    walked = cut(reach(nodes))
    children = nodes.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n"))
    one = lambda name, rows: rows.agg(F.count("*").alias("detail")).select(F.lit(name).alias("check"), (F.col("detail") == 0).alias("ok"), "detail")
    bad_roots = nodes.filter("parent is null").agg(F.count("*").alias("n")).filter("n <> 1")
    return (
        one("single_root", bad_roots)
        .unionByName(one("reachable", walked.filter("state <> 'reached'")))
        .unionByName(one("acyclic", walked.filter("state = 'cycle'")))
        .unionByName(one("unique_owner", members.groupBy("unit").agg(F.count_distinct("node").alias("n")).filter("n > 1")))
        .unionByName(one("known_parent", nodes.filter("parent is not null").join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti")))
        .unionByName(one("no_empty_node", nodes.select("id").join(members.select(F.col("node").alias("id")), "id", "left_anti").join(children.select(F.col("parent").alias("id")), "id", "left_anti")))
        .unionByName(one("distinct_titles", nodes.groupBy("parent", "title").agg(F.count("*").alias("n")).filter("n > 1")))
        .unionByName(one("group_sizes", children.filter("n < 2 or n > 12")))
    )
