"""Bounded traversals: one job a level, which moves the frontier and not the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.operators.saved import Saved

#: Depth limits of the public calls.
MAX_DEPTH = 20


class Graph:
    """Edges (src, dst) held once: distinct and bucketed by either end, each when first walked in that direction."""

    def __init__(self, edges: DataFrame):
        self.edges = edges
        self.saved = Saved(edges.sparkSession)
        self._steps: dict[bool, DataFrame] = {}

    def step(self, backward: bool = False) -> DataFrame:
        """(id, next): from each node to its callees, or callers."""
        if backward not in self._steps:
            near, far = ("dst", "src") if backward else ("src", "dst")
            self._steps[backward] = self.saved.bucketed(self.edges.select(F.col(near).alias("id"), F.col(far).alias("next")).distinct(), "id")
        return self._steps[backward]


def one_level(frontier: DataFrame, step: DataFrame, visited: DataFrame) -> DataFrame:
    """(root, id) first reached from the frontier (root, id). The bucketed edges stay where they are."""
    found = frontier.select("root", "id").join(step, "id").select("root", F.col("next").alias("id")).distinct()
    return found.join(visited.select("root", "id"), ["root", "id"], "left_anti")


def levels(edges: DataFrame | Graph, seeds: DataFrame, depth: int, backward: bool = False, avoid: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """(root, id, depth of the first visit) reached from seeds (root, id), the seeds themselves at 0.

    Nodes of `avoid` (id) are neither returned nor passed. With a budget the walk ends after the level at which so
    many rows were found: a level is never cut.
    """
    graph = edges if isinstance(edges, Graph) else Graph(edges)
    saved = Saved(graph.edges.sparkSession)
    step = graph.step(backward)
    visited = frontier = saved.save(seeds.select("root", "id").distinct().withColumn("depth", F.lit(0)))
    seen = 0
    for at in range(1, depth + 1):
        found = one_level(frontier, step, visited)
        if avoid is not None:
            found = found.join(avoid.select("id"), "id", "left_anti").select("root", "id")
        frontier = saved.save(found.withColumn("depth", F.lit(at)))
        if frontier.isEmpty():
            break
        visited = saved.all(frontier)
        if budget is not None and (seen := seen + frontier.count()) >= budget:
            break
    return visited


def reach(edges: DataFrame | Graph, seeds: DataFrame, depth: int = MAX_DEPTH, backward: bool = False, avoid: DataFrame | None = None) -> DataFrame:
    """(id, depth) reached from any of the seeds (id), without them."""
    found = levels(edges, seeds.select(F.lit(0).alias("root"), "id"), depth, backward, avoid)
    return found.where("depth > 0").select("id", "depth")


def radius(edges: DataFrame | Graph, roots: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(id, blast_radius): how many other nodes each root (id) reaches."""
    found = levels(edges, roots.select(F.col("id").alias("root"), "id"), depth)
    return found.groupBy(F.col("root").alias("id")).agg((F.count("*") - 1).alias("blast_radius"))


def unreachable(nodes: DataFrame, edges: DataFrame | Graph, entrypoints: DataFrame, depth: int = 50) -> DataFrame:
    """Nodes that no entrypoint reaches; all of them without entrypoints."""
    seeds = entrypoints.select(F.col("node_id").alias("id"))
    return nodes.join(reach(edges, seeds, depth).select("id").unionByName(seeds), "id", "left_anti")


def paths(edges: DataFrame | Graph, sources: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(path array): simple paths of at most `depth` edges from any source (id) to any target (id).

    Only nodes near enough to a target are expanded: backward levels bound the forward search.
    """
    graph = edges if isinstance(edges, Graph) else Graph(edges)
    saved = Saved(graph.edges.sparkSession)
    away = levels(graph, targets.select(F.lit(0).alias("root"), "id"), depth, backward=True).select("id", F.col("depth").alias("away"))
    step = graph.step().select(F.col("id").alias("src"), F.col("next").alias("dst")).join(away.withColumnRenamed("id", "dst"), "dst")
    step = saved.bucketed(step.select("src", "dst", "away"), "src")
    ends = targets.select("id").distinct()
    open_ = saved.save(sources.select("id").distinct().join(away, "id").select("id", F.array("id").alias("path")))
    done = [open_.join(ends, "id", "left_semi").select("path")]
    for at in range(1, depth + 1):
        grown = open_.join(step, F.col("id") == F.col("src")).where((F.col("away") <= depth - at) & ~F.array_contains("path", F.col("dst")))
        open_ = saved.save(grown.select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path")))
        if open_.isEmpty():
            break
        done.append(open_.join(ends, "id", "left_semi").select("path"))
    saved.close()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def shortest_first(found: DataFrame, limit: int) -> DataFrame:
    """The first `limit` paths by length, then ids, as (path, hops)."""
    found = found.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"))
    return found.orderBy("hops", "path").limit(limit)
