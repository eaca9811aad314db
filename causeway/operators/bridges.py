"""Clusters that hang together by one weakly linked signal fall apart there.

A bridge is a signal of a connected cluster of LEAST or more whose best link is under WEAK_BRIDGE and without which two
or more parts of at least two signals remain. Of several the one with the smallest id is taken; it stays with the part
of its best link (the smallest other id on ties), and all parts are looked at again.

Both ends of a link of WEAK_BRIDGE or more are never a bridge, and only links of bridges are cut. So what such signals and
the links between them tie together (a core) never falls apart and counts as one node of its size; so does a weak signal
with links to one core only. What is left, the weak signals between cores, is a small part of the links.

Clusters of which up to `most` links are left are solved one group each, in time linear in links for each split. Larger
ones are split by joins, all clusters of a round at once:

1. a spanning tree by breadth first, each node with the path that leads to it; every other link of such a tree joins
   nodes of which neither lies above the other;
2. such a link closes a cycle through the lowest common node of its ends: the tree links of the cycle are one block, so
   what the links tie together are the blocks (components over tree links, named after their lower node);
3. without a node, the children whose links upward are in a block of their own are a part, as large as what lies below
   them; the rest is the part above.

Rounds grow with the diameter of a cluster and with the number of splits after each other.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .components import components

WEAK_BRIDGE, LEAST = 0.50, 5
#: Links of a cluster, without those inside cores, that one task holds.
MOST_LINKS = 500_000


def _below(nodes: list, near: dict, weight: dict) -> tuple[list, dict, dict, dict]:
    """A depth-first tree from the smallest node: (nodes in order of visit, parent, size below, lowest visit reachable)."""
    parent, order, seen = {nodes[0]: None}, [], {}
    stack = [(nodes[0], None)]
    while stack:
        x, up = stack.pop()
        if x in seen:
            continue
        seen[x], parent[x] = len(order), up
        order.append(x)
        stack += [(y, x) for y, *_ in near[x] if y not in seen]
    size, low = {x: weight[x] for x in order}, dict(seen)
    for x in reversed(order):
        for y, *_ in near[x]:
            if y != parent[x]:
                low[x] = min(low[x], low[y] if parent.get(y) == x else seen[y])
        if parent[x] is not None:
            size[parent[x]] += size[x]
    return order, parent, size, low


def _bridge(nodes: list, near: dict, weight: dict) -> tuple | None:
    """(bridge, parts without it) of a connected cluster, or None."""
    n = sum(weight[x] for x in nodes)
    if n < LEAST:
        return None
    order, parent, size, low = _below(nodes, near, weight)
    if len(order) < len(nodes):
        return None
    visit = {x: k for k, x in enumerate(order)}
    last: dict = {}  # the last visit below a node
    for x in reversed(order):
        last[x] = max(last.get(x, 0), visit[x])
        if parent[x] is not None:
            last[parent[x]] = max(last.get(parent[x], 0), last[x])
    apart = defaultdict(list)  # children that nothing but their parent ties to the rest
    for x in order[1:]:
        p = parent[x]
        if parent[p] is None or low[x] >= visit[p]:
            apart[p].append(x)
    for x in sorted(apart):
        if weight[x] > 1 or max(e[1] for e in near[x]) >= WEAK_BRIDGE:
            continue
        rest = n - 1 - sum(size[c] for c in apart[x])
        if sum(size[c] >= 2 for c in apart[x]) + (rest >= 2) < 2:
            continue
        side = {y: c for c in apart[x] for y in order[visit[c] : last[c] + 1]}
        parts = defaultdict(list)
        for y in nodes:
            if y != x:
                parts[side.get(y)].append(y)
        best = min(near[x], key=lambda e: (-e[1], e[2]))[0]
        parts[side.get(best)].append(x)
        return x, [sorted(p) for p in parts.values()]
    return None


def solve(nodes: list, links: list[tuple], weight: dict | None = None) -> list[list]:
    """Parts of one cluster; links are (a, b, similarity). With weight, the signals of each node (one weak signal, or a core),
    they are (a, b, similarity, first, second) with the signals at either end that count on ties."""
    weight = weight or dict.fromkeys(nodes, 1)
    done, todo = [], [(sorted(nodes), links)]
    while todo:
        now, own = todo.pop()
        near = defaultdict(list)
        for a, b, w, *ends in own:
            first, second = ends or (a, b)
            near[a].append((b, w, second))
            near[b].append((a, w, first))
        cut = _bridge(now, near, weight)
        if cut is None:
            done.append(now)
            continue
        part = {x: k for k, p in enumerate(cut[1]) for x in p}
        inside = defaultdict(list)
        for e in own:
            if part[e[0]] == part[e[1]]:
                inside[part[e[0]]].append(e)
        todo += [(p, inside[k]) for k, p in enumerate(cut[1])]
    return done


def _inside(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(part, a, b, sim) of links whose ends are in one part of nodes(part, id)."""
    left = nodes.select(F.col("part"), F.col("id").alias("a"))
    right = nodes.select(F.col("part").alias("other"), F.col("id").alias("b"))
    return links.join(left, "a").join(right, "b").where("part = other").select("part", "a", "b", "sim")


def _tree(nodes: DataFrame, both: DataFrame) -> DataFrame:
    """(part, id, path) by breadth first from each part's smallest id; path leads from there to id."""
    level = nodes.groupBy("part").agg(F.min("id").alias("id")).withColumn("path", F.array("id"))
    level = written(level, "bridge-tree")
    tree = level
    while not level.isEmpty():
        step = both.join(level.withColumnRenamed("id", "a"), ["part", "a"]).groupBy("part", F.col("b").alias("id")).agg(
            F.min(F.struct("a", "path"))["path"].alias("path"))
        step = step.join(tree.select("part", "id"), ["part", "id"], "left_anti")
        level = written(step.select("part", "id", F.concat("path", F.array("id")).alias("path")), "bridge-tree")
        tree = tree.unionByName(level)
    return written(tree, "bridge-tree")


def _cut(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(part, id) of connected clusters to (part, id, new): the parts after one split, null where nothing is split."""
    own = written(_inside(nodes, links), "bridge-links")
    both = own.select("part", "a", "b", "sim").union(own.select("part", F.col("b"), F.col("a"), "sim")).toDF("part", "a", "b", "sim")
    tree = _tree(nodes, both)
    path = lambda side: tree.select(F.col("part").alias(f"p{side}"), F.col("id").alias(side), F.col("path").alias(f"path_{side}"))
    cross = own.join(path("a"), "a").where("part = pa").join(path("b"), "b").where("part = pb")
    up = lambda c: F.element_at(c, -2)
    cross = cross.where((F.size("path_a") < 2) | (up(F.col("path_a")) != F.col("b"))).where((F.size("path_b") < 2) | (up(F.col("path_b")) != F.col("a")))
    # both ends' paths below their lowest common node, where the paths part
    shared = F.size(F.filter(F.zip_with("path_a", "path_b", lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    below = F.concat(F.slice("path_a", shared + 1, F.size("path_a")), F.slice("path_b", shared + 1, F.size("path_b")))
    tied = cross.select(F.explode(below).alias("x"), F.col("a").alias("y"))
    blocks = components(tied.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    # (part, id, up, block): each node's link upward and its block
    edge = tree.where(F.size("path") > 1).select("part", "id", F.element_at("path", -2).alias("up"))
    edge = edge.join(blocks.withColumnRenamed("label", "block"), "id", "left").withColumn("block", F.coalesce("block", "id"))
    size = tree.select("part", F.explode("path").alias("id")).groupBy("part", "id").agg(F.count("*").alias("below"))
    whole = tree.groupBy("part").agg(F.count("*").alias("n"))
    edge = written(edge.join(size, ["part", "id"]), "bridge-edges")
    above = edge.select("part", F.col("id").alias("up"), F.col("block").alias("own"))
    hang = edge.join(above, ["part", "up"], "left").where("own is null or own <> block")
    sides = hang.groupBy("part", F.col("up").alias("x"), "block").agg(F.sum("below").alias("below"))
    best = both.groupBy("part", F.col("a").alias("x")).agg(F.max(F.struct("sim", -F.col("b")))["sim"].alias("best"))
    sides = sides.groupBy("part", "x").agg(F.sum("below").alias("hanging"), F.sum((F.col("below") >= 2).cast("int")).alias("large"))
    weak = sides.join(best, ["part", "x"]).join(whole, "part").where(F.col("best") < WEAK_BRIDGE).where(
        F.col("large") + (F.col("n") - 1 - F.col("hanging") >= 2).cast("int") >= 2)
    chosen = written(weak.groupBy("part").agg(F.min("x").alias("x")), "bridge-chosen")
    # the block in which a node hangs below the bridge, null above it
    at = tree.join(chosen, "part").withColumn("k", F.array_position("path", F.col("x")))
    child = F.when((F.col("k") > 0) & (F.col("k") < F.size("path")), F.get("path", F.col("k").cast("int")))
    at = at.select("part", "id", "x", child.alias("child"))
    hanging = hang.select("part", F.col("up").alias("x"), F.col("id").alias("child"), "block")
    at = at.join(hanging, ["part", "x", "child"], "left")
    friend = both.join(chosen.withColumnRenamed("x", "a"), ["part", "a"]).groupBy("part").agg(
        F.min(F.struct(-F.col("sim"), F.col("b")))["b"].alias("friend"))
    stays = at.join(friend, "part").where("id = friend").select("part", F.col("block").alias("side"))
    at = at.join(stays, "part").withColumn("block", F.when(F.col("id") == F.col("x"), F.col("side")).otherwise(F.col("block")))
    new = F.min("id").over(Window.partitionBy("part", "block"))
    split = written(at.select("part", "id", new.alias("new")), "bridge-split")
    return nodes.join(split, ["part", "id"], "left")


def split_large(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(part, id) for nodes(part, id), links(a, b, sim): what solve() gives, by joins."""
    roots = components(_inside(nodes, links).select("a", "b"))
    tied = nodes.join(roots, "id", "left").groupBy("part").agg(
        F.countDistinct("label").alias("parts"), F.count_if(F.col("label").isNull()).alias("alone"), F.count("*").alias("n"))
    able = tied.where(f"parts = 1 and alone = 0 and n >= {LEAST}").select("part")
    done = nodes.join(able, "part", "left_anti")
    now = written(nodes.join(able, "part", "left_semi"), "bridge-parts")
    while not now.isEmpty():
        cut = written(_cut(now, links), "bridge-parts")
        done = done.unionByName(cut.where("new is null").select("part", "id"))
        parts = cut.where("new is not null").select(F.col("new").alias("part"), "id")
        n = F.count("*").over(Window.partitionBy("part"))
        parts = parts.withColumn("n", n)
        done = done.unionByName(parts.where(F.col("n") < LEAST).select("part", "id"))
        now = written(parts.where(F.col("n") >= LEAST).select("part", "id"), "bridge-parts")
    return done


def _cores(inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held, left) of inside(part, a, b, sim): held(id, core) names the core of each signal that isn't alone; left(part, x, y,
    sim, x_end, y_end) are the links between cores and what is alone, the best for each weak signal and core."""
    ends = inside.select("a", "b", "sim").union(inside.select("b", "a", "sim")).toDF("a", "b", "sim")
    weak = written(ends.groupBy("a").agg(F.max("sim").alias("best")).where(F.col("best") < WEAK_BRIDGE).select(F.col("a").alias("weak")), "weak-signals")
    sure = inside.join(weak, F.col("a") == F.col("weak"), "left_anti").join(weak, F.col("b") == F.col("weak"), "left_anti")
    core = written(components(sure.select("a", "b")).withColumnRenamed("label", "core"), "cores")
    own = ends.join(weak, F.col("a") == F.col("weak"), "left_semi").join(core, F.col("b") == core.id, "left").select(
        F.col("a").alias("x"), F.col("b").alias("end"), F.coalesce("core", "b").alias("y"), F.col("core").isNull().alias("loose"), "sim")
    own = written(own, "weak-links")
    leaf = own.groupBy("x").agg(F.min("y").alias("y"), F.max("y").alias("last"), F.bool_or("loose").alias("loose")).where(
        "y = last and not loose").select(F.col("x").alias("id"), F.col("y").alias("core"))
    held = written(core.unionByName(leaf), "held")
    # of two weak signals the smaller one comes first, and each link once
    left = own.where("not loose or x < end").join(leaf.select(F.col("id").alias("x")), "x", "left_anti")
    best = F.min(F.struct((-F.col("sim")).alias("neg"), "end")).alias("m")
    left = left.groupBy("x", "y").agg(best).select("x", "y", (-F.col("m.neg")).alias("sim"), F.col("x").alias("x_end"), F.col("m.end").alias("y_end"))
    return held, left


def split_weak_bridges(members: DataFrame, links: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """(id, label, part) of members(id, label): part is the smallest id of the part a signal ends up in. links(a_id, b_id,
    sim) between members of one cluster count."""
    own = links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "sim")
    inside = written(_inside(members.select(F.col("label").alias("part"), "id"), own), "cluster-links")
    held, left = _cores(inside)
    nodes = members.select("label", "id")
    at = written(nodes.join(held, "id", "left").withColumn("node", F.coalesce("core", "id")), "nodes")
    left = written(left.join(at.select("label", F.col("id").alias("x")), "x"), "left-links")
    counts = left.groupBy("label").agg(F.count("*").alias("n"))
    large = written(counts.where(F.col("n") > most).select("label"), "large-clusters")
    small = written(counts.where(F.col("n") <= most).select("label"), "small-clusters")

    def run(key: tuple, m: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        first = dict(zip(m["node"].tolist(), m["first"].tolist(), strict=True))
        weight = dict(zip(m["node"].tolist(), m["size"].tolist(), strict=True))
        parts = solve(list(first), list(e[["x", "y", "sim", "x_end", "y_end"]].itertuples(index=False, name=None)), weight)
        return pd.DataFrame([(x, key[0], min(first[y] for y in p)) for p in parts for x in p], columns=["node", "label", "part"])

    heavy = at.join(small, "label", "left_semi").groupBy("label", "node").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    solved = heavy.groupBy("label").cogroup(left.join(small, "label", "left_semi").groupBy("label")).applyInPandas(
        run, "node long, label long, part long")
    whole = nodes.groupBy("label").agg(F.min("id").alias("first"))
    out = at.join(solved, ["label", "node"], "left").join(whole, "label").select("id", "label", F.coalesce("part", "first").alias("part"))
    if large.isEmpty():
        return out
    many = nodes.join(large, "label", "left_semi")
    start = many.join(whole, "label").select(F.col("first").alias("part"), "id")
    # parts are named after their smallest id, also those that are never split
    found = split_large(start, inside.select("a", "b", "sim")).groupBy("id").agg(F.min("part").alias("part"))
    return out.join(large, "label", "left_anti").unionByName(many.join(found, "id").select("id", "label", "part"))
