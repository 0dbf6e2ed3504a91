"""Strongly connected components of graphs of any size, and what follows from them: cycles, and layers with the edges that break them.

All is joins over written edge tables; the driver sees counts. Components are found by trimming and colouring: vertices that nothing leads
into, or that lead nowhere, are components of their own and go, round by round; each that is left takes the smallest name that leads
to it as its colour; what leads back to a colour's own vertex within the colour is that vertex's component. What is found goes, and
the rest starts again. A first pass over many edges may colour from a sample of the vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators.resolve import module_edges
from codeloom.plans.graph import CodeGraph, expand, side
from codeloom.plans.scratch import Scratch

_LINK = "source string, target string, kind string, edge_ord long"


#: Edges from which on a first pass colours from a sample of the vertices, one in OF.
MANY = 1_000_000
OF = 64


def ends_of(edges: DataFrame) -> DataFrame:
    """id, leads, entered and loop for each end of edges (source, target): whether it has edges out to others, in from others, and to itself."""
    others, no = F.col("source") != F.col("target"), F.lit(False)
    both = edges.select(F.col("source").alias("id"), others.alias("leads"), no.alias("entered"), (~others).alias("loop")).unionByName(edges.select(F.col("target").alias("id"), no.alias("leads"), others.alias("entered"), no.alias("loop")))
    return both.groupBy("id").agg(F.max("leads").alias("leads"), F.max("entered").alias("entered"), F.max("loop").alias("loop"))


def _trimmed(edges: DataFrame, scratch: Scratch, name: str, ends: DataFrame | None = None) -> tuple[DataFrame, int]:
    """The edges between vertices that have edges both in and out, and their number. With ends, the first pass, it stops where a round takes less than a twentieth."""
    first, n, k = ends is not None, edges.count(), 0
    while n:
        ends = (scratch.save(ends_of(edges), f"{name}-ends-{k}") if ends is None else ends).where("leads and entered").select("id")
        v = ends.count()
        inside = lambda end: side(ends.withColumnRenamed("id", end), v)  # noqa: B023, E731
        less = edges.join(inside("source"), "source", "left_semi").join(inside("target"), "target", "left_semi").select("source", "target")
        less = scratch.save(less.where("source <> target").distinct() if first and not k else less, f"{name}-{k}")
        if k:
            scratch.drop(f"{name}-{k - 1}", f"{name}-ends-{k}")
        before, n, edges, ends, k = n, less.count(), less, None, k + 1
        if before - n < (before / 20 if first else 1):
            break
    return edges, n


def _coloured(edges: DataFrame, scratch: Scratch, name: str, of: int = 1) -> tuple[DataFrame, int]:
    """id and colour, the smallest vertex that leads to it, and the number of vertices: only vertices whose colour has just changed tell their neighbours.

    A round is one table: what was told and the colours so far are united and grouped, not joined. With of, one vertex in so many is a
    colour, and a vertex that none of them leads to has null.
    """
    every = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    begins = F.pmod(F.xxhash64("id"), F.lit(of)) == 0
    colour = scratch.save(every.select("id", F.when(begins, F.col("id")).alias("colour"), begins.alias("changed")), f"{name}-0")
    vertices, n = colour.count(), colour.where("changed").count()
    none, k = F.lit(None).cast("string"), 0
    while n:
        front = colour.where("changed").select(F.col("id").alias("source"), "colour")
        told = edges.join(side(front, n), "source").select(F.col("target").alias("id"), none.alias("old"), F.col("colour").alias("new"))
        met = told.unionByName(colour.select("id", F.col("colour").alias("old"), none.alias("new"))).groupBy("id").agg(F.max("old").alias("old"), F.min("new").alias("new"))
        colour = scratch.save(met.select("id", F.least("old", "new").alias("colour"), F.coalesce(F.col("new") < F.col("old"), F.col("new").isNotNull()).alias("changed")), f"{name}-{k + 1}")
        scratch.drop(f"{name}-{k}")
        n, k = colour.where("changed").count(), k + 1
    return colour.where("colour is not null").select("id", "colour"), vertices


def components(edges: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """id and component for the vertices of edges (source, target) that lie on a cycle: component is the smallest id of those that lead to each other.

    A written table. Edges of a vertex to itself make no cycle here; null ends, and repeated edges, count for nothing. With ends,
    edges is a written table, and these are what ends_of says of it.

    The first pass over many edges trims no further than pays, and colours from a sample, which many vertices change their colour less
    often for: what leads to each other has one colour there too, and what the sample misses is left for the next pass.
    """
    scratch = Scratch(edges.sparkSession, "components")
    left = edges
    if ends is None:
        left = scratch.save(edges.select("source", "target").where("source <> target"), "edges")
        ends = scratch.save(ends_of(left), "ends")
    found, k = None, 0
    while True:
        left, n = _trimmed(left, scratch, f"trimmed-{k}", ends if not k else None)
        if not n:
            break
        colour, v = _coloured(left, scratch, f"colours-{k}", OF if not k and n >= MANY else 1)
        at = lambda end, name: side(colour.select(F.col("id").alias(end), F.col("colour").alias(name)), v)  # noqa: B023, E731
        own = left.join(at("source", "a"), "source").join(at("target", "b"), "target").where("a = b")
        own = scratch.save(own.select("source", "target", F.lit(None).cast("string").alias("kind"), F.lit(0).cast("long").alias("edge_ord")), f"own-{k}")
        back = expand(own, colour.where("id = colour").select("id"), None, "in").select("id")
        some = scratch.save(colour.join(side(back, v), "id", "left_semi"), f"found-{k}")
        gone, g = some.select("id"), some.count()
        left = scratch.save(left.join(side(gone.withColumnRenamed("id", "source"), g), "source", "left_anti").join(side(gone.withColumnRenamed("id", "target"), g), "target", "left_anti"), f"left-{k}")
        scratch.drop(f"own-{k}")
        found, k = some if found is None else found.unionByName(some), k + 1
    if found is None:
        return edges.sparkSession.createDataFrame([], "id string, component string")
    # A colour's own vertex that nothing leads back to is found alone.
    several = scratch.save(found.groupBy("colour").agg(F.count("*").alias("n"), F.min("id").alias("component")).where("n > 1").select("colour", "component"), "several")
    return scratch.save(found.join(side(several, several.count()), "colour").select("id", "component"), "components")


def _inside(edges: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """The edges within a component, with it, as links; and in tree, each vertex's distance from its component's first one."""
    both = edges.select("source", "target").distinct().join(parts.withColumnsRenamed({"id": "source", "component": "root"}), "source").join(parts.withColumnsRenamed({"id": "target", "component": "b"}), "target")
    links = both.where("root = b and source <> target").select("source", "target", F.lit(None).cast("string").alias("kind"), F.lit(0).cast("long").alias("edge_ord"), "root")
    return scratch.save(links, "inside")


def _levels(links: DataFrame, parts: DataFrame) -> DataFrame:
    """root (the component), id, depth, parent: distances from each component's first vertex; of several parents the smallest id."""
    first = parts.where("id = component").select(F.col("component").alias("root"), "id")
    return expand(links.drop("root"), first, None, "out", keys=("root",), via=True)


def cycles_of(edges: DataFrame) -> DataFrame:
    """component, size, id, hop: the members of each cyclic component, and the place that those on its ring have there, else null.

    A component's ring is a shortest cycle through its first member; of several, the last edge comes from the smallest id, and so
    does each edge before it.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    parts = components(edges)
    links = _inside(edges, parts, scratch)
    tree = scratch.save(_levels(links, parts).select("root", "id", "depth", "parent"), "tree")
    closing = links.where("target = root").select("root", F.col("source").alias("id")).join(tree, ["root", "id"])
    ends = closing.groupBy("root").agg(F.min(F.struct("depth", "id", "parent")).alias("m")).select("root", "m.id", F.col("m.depth").alias("hop"), "m.parent")
    front = ring = scratch.save(ends, "ring-0")
    k = 0
    while not (front := front.where("parent is not null")).isEmpty():
        step = front.select("root", F.col("parent").alias("id")).join(tree, ["root", "id"]).select("root", "id", F.col("depth").alias("hop"), "parent")
        front, k = scratch.save(step, f"ring-{k + 1}"), k + 1
        ring = ring.unionByName(front)
    size = parts.groupBy("component").agg(F.count("*").alias("size"))
    return parts.join(size, "component").join(ring.select(F.col("root").alias("component"), "id", "hop"), ["component", "id"], "left").select("component", "size", "id", "hop")


def layered(edges: DataFrame, vertices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, layer) of all vertices, those of edges (source, target) and of vertices (id), and the edges (source, target) that don't count.

    An edge within a component doesn't count if its target isn't farther than its source from the component's first vertex: every
    cycle has such an edge, and what is left has no cycle. A layer is the length of the longest path that begins there: each
    round takes the vertices whose targets all have layers, and the edges into them go.
    """
    scratch = Scratch(edges.sparkSession, "layers")
    plain = scratch.save(edges.select("source", "target").where("source <> target").distinct(), "edges")
    parts = components(plain)
    links = _inside(plain, parts, scratch)
    place = scratch.save(_levels(links, parts).select("id", "depth"), "places")
    at = lambda side, name: place.select(F.col("id").alias(side), F.col("depth").alias(name))
    broken = links.join(at("source", "a"), "source").join(at("target", "b"), "target").where("b <= a").select("source", "target")
    broken = scratch.save(broken, "broken")
    left = scratch.save(plain.join(broken, ["source", "target"], "left_anti"), "left-0")
    every = plain.select(F.col("source").alias("id")).unionByName(plain.select(F.col("target").alias("id")))
    every = (every if vertices is None else every.unionByName(vertices.select("id"))).distinct()
    front = scratch.save(every.join(left.select(F.col("source").alias("id")), "id", "left_anti").withColumn("layer", F.lit(0)), "layer-0")
    out, k = front, 0
    while not front.isEmpty():
        told = F.broadcast(front) if front.count() < 10_000 else front
        met = told.select(F.col("id").alias("target"), F.lit(True).alias("_m"))
        both = scratch.save(left.join(met, "target", "left"), f"met-{k}")
        rest = both.where("_m is null").select("source", "target")
        front = both.where("_m").select(F.col("source").alias("id")).distinct().join(rest.select(F.col("source").alias("id")), "id", "left_anti").withColumn("layer", F.lit(k + 1))
        front, left, k = scratch.save(front, f"layer-{k + 1}"), rest, k + 1
        if k > 1:
            scratch.drop(f"met-{k - 2}")
        out = out.unionByName(front)
    return out, broken


def _links(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("module").alias("source"), F.col("dep").alias("target"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """module: those that lie on a cycle of edges (module, dep)."""
    return components(_links(edges)).select(F.col("id").alias("module"))


def cycles(g: CodeGraph) -> DataFrame:
    """component, size, module, hop: modules of the project whose imports, extends and implements lead in circles; see cycles_of."""
    return cycles_of(_links(module_edges(g, "imports", "extends", "implements"))).withColumnRenamed("id", "module")


def layers(g: CodeGraph) -> tuple[DataFrame, DataFrame]:
    """(module, layer) of the project's modules by their longest chain of imports and extends, and (module, dep), what closes a cycle and doesn't count."""
    own = g.nodes.where("kind in ('package', 'class') and not coalesce(metadata.cpan, false)").select(C.shown_name().alias("id")).distinct()
    found, broken = layered(_links(module_edges(g, "imports", "extends")), own)
    return found.withColumnRenamed("id", "module"), broken.withColumnsRenamed({"source": "module", "target": "dep"})
