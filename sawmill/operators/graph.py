"""Graphs as tables of edges: components, strong components and longest paths, by joins and aggregates in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.plans.stored import dropped, stored


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("lo", "hi")).alias("x")).first()
    return r.n, r.x


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (u, v): the least node of each connected component, by alternating large and
    small stars, in rounds of the logarithm of the longest path."""
    e = edges.where("u <> v").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct()
    e = stored(e, "edges")
    mark = _mark(e)
    while True:
        both = e.select(F.col("lo").alias("x"), F.col("hi").alias("y")).unionByName(e.select(F.col("hi").alias("x"), F.col("lo").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("m").alias("lo"), F.col("y").alias("hi")).where("lo <> hi").distinct()
        head = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(head, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo <> hi")
        later = stored(small.unionByName(head.select(F.col("m").alias("lo"), "hi")).distinct(), "edges")
        dropped(e)
        e, before, mark = later, mark, _mark(later)
        if mark == before:
            break
    heads = e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(heads)


def _spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, color): the least color that reaches each node along edges (u, v)."""
    colors = stored(start, "colors")
    while True:
        sent = edges.join(colors.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("color").alias("sent"))
        merged = colors.join(sent, "node", "left").withColumn("moved", F.coalesce(F.col("sent") < F.col("color"), F.lit(False)))
        later = stored(merged.select("node", F.least("color", F.coalesce("sent", "color")).alias("color"), "moved"), "colors")
        dropped(colors)
        colors = later
        if later.where("moved").isEmpty():
            return later.drop("moved")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of directed edges (u, v): the least node of each strongly connected component.

    Nodes without a way in or out are components of their own and are trimmed first.  Then each node takes the least node
    that reaches it as its color; the nodes of a color from which its namesake can be reached are a component, and the rest
    goes on.
    """
    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    out, left = None, stored(edges.where("u <> v").select("u", "v").distinct(), "left")
    size = left.count()
    while size:
        while True:
            inner = left.select(F.col("u").alias("node")).intersect(left.select(F.col("v").alias("node")))
            inner = stored(inner, "inner")
            kept = stored(left.join(inner.withColumnRenamed("node", "u"), "u", "left_semi").join(inner.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v"), "left")
            now = kept.count()
            dropped(left, inner)
            left, before, size = kept, size, now
            if now == before or not now:
                break
        if not size:
            break
        own = left.select(F.col("u").alias("node")).distinct().withColumn("color", F.col("node"))
        colors = _spread(own, left)
        of = lambda c, to: colors.select(F.col("node").alias(c), F.col("color").alias(to))
        within = stored(left.join(of("u", "cu"), "u").join(of("v", "cv"), "v").where("cu = cv").select("u", "v", F.col("cu").alias("color")), "within")
        reached = stored(colors.where("node = color"), "reached")
        every = reached
        while True:
            more = within.join(reached.select(F.col("node").alias("v")), "v", "left_semi").select(F.col("u").alias("node"), "color").distinct()
            more = stored(more.join(every.select("node"), "node", "left_anti"), "reached")
            if more.isEmpty():
                break
            reached, every = more, every.unionByName(more)
        found = stored(every.select("node", F.col("color").alias("component")), "found")
        done = found.select("node")
        rest = stored(left.join(done.withColumnRenamed("node", "u"), "u", "left_anti").join(done.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v"), "left")
        dropped(left, within)
        out, left = found if out is None else out.unionByName(found), rest
        size = left.count()
    alone = nodes.withColumn("component", F.col("node"))
    return alone if out is None else out.unionByName(alone.join(out.select("node"), "node", "left_anti"))


def heaviest_paths(edges: DataFrame) -> DataFrame:
    """(node, path, weights, total) of an acyclic graph (u, v, w) with positive weights: the heaviest path that ends in each
    node, of equal ones that over the least node before it.  A round settles all nodes whose predecessors are settled."""
    heads = edges.select(F.col("u").alias("node")).distinct().join(edges.select(F.col("v").alias("node")).distinct(), "node", "left_anti")
    layer = heads.select("node", F.array("node").alias("path"), F.array().cast("array<double>").alias("weights"), F.lit(0.0).alias("total"))
    layer = stored(layer, "layer")
    settled, left = layer, stored(edges.select("u", "v", "w"), "left")
    known = None  # the ways into nodes that are not settled yet
    while not left.isEmpty():
        step = left.join(layer.withColumnRenamed("node", "u"), "u").select("u", "v", "w", "path", "weights", "total")
        ways = step if known is None else known.unionByName(step)
        rest = stored(left.join(layer.select(F.col("node").alias("u")), "u", "left_anti"), "left")
        waiting = rest.select("v").distinct()
        ready = ways.join(waiting, "v", "left_anti")
        best = ready.groupBy("v").agg(F.min_by(F.struct("u", "w", "path", "weights", "total"), F.struct(-(F.col("total") + F.col("w")), "u")).alias("m"))
        layer = stored(best.select(F.col("v").alias("node"), F.concat("m.path", F.array("v")).alias("path"), F.concat("m.weights", F.array("m.w")).alias("weights"), (F.col("m.total") + F.col("m.w")).alias("total")), "layer")
        known = stored(ways.join(waiting, "v", "left_semi").select("u", "v", "w", "path", "weights", "total"), "known")
        settled, left = settled.unionByName(layer), rest
    return settled
