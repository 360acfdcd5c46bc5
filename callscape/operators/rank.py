"""Annotations, scores of findings and targets, and version differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.operators import graph, traverse
from callscape.operators.traverse import MAX_DEPTH


# Kinds of annotations.
KINDS = ("finding", "audit_note", "blast_radius", "privilege_boundary", "taint", "entrypoint", "sarif_finding", "weaudit_finding")


def downstream(text, leading: bool = False):
    """The number in texts such as '12 downstream, 3 upstream'; 0 without one."""
    pattern = r"^\s*(\d+)(?:\s|$)" if leading else r"(\d+)\s+downstream"
    return F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("bigint"), F.lit(0))


def with_annotation(nodes: DataFrame, annotations: DataFrame, *kinds: str) -> DataFrame:
    if unknown := [k for k in kinds if k not in KINDS]:
        raise ValueError(f"unknown kind {', '.join(unknown)}; known: {', '.join(KINDS)}")
    return nodes.join(annotations.where(F.col("kind").isin(*kinds)).select(F.col("node_id").alias("id")), "id", "left_semi")


def annotations_of(nodes: DataFrame, annotations: DataFrame, name: str) -> DataFrame:
    return annotations.join(graph.resolve(nodes, name), F.col("node_id") == F.col("id"), "left_semi")


def annotate(nodes: DataFrame, annotations: DataFrame, name: str, kind: str, description: str) -> DataFrame:
    """The annotations with one more on each node of the name."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}; known: {', '.join(KINDS)}")
    if graph.resolve(nodes, name).isEmpty():
        raise LookupError(f"no node {name}")
    new = graph.resolve(nodes, name).select(F.col("id").alias("node_id"), F.lit(kind).alias("kind"), F.lit(description).alias("description"), F.lit(0).cast("long").alias("seq"))
    return annotations.unionByName(new)


def clear(nodes: DataFrame, annotations: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """The annotations without those of the name's nodes, or without their ones of a kind."""
    ids = graph.resolve(nodes, name)
    hit = F.col("node_id") == F.col("id")
    return annotations.join(ids, hit if kind is None else hit & (F.col("kind") == kind), "left_anti")


def _facts(annotations: DataFrame, leading: bool) -> DataFrame:
    blast = F.when(F.col("kind") == "blast_radius", downstream(F.col("description"), leading))
    return annotations.groupBy(F.col("node_id").alias("id")).agg(F.bool_or(F.col("kind") == "taint").alias("tainted"), F.max(blast).alias("down"))


def fuzzing_targets(nodes: DataFrame, annotations: DataFrame, entrypoints: DataFrame, least: int = 10, limit: int = 20, candidates: int = 2000) -> DataFrame:
    """Complex functions by taint, entrypoint, complexity and what lies downstream."""
    top = graph.hotspots(nodes, least).orderBy(F.desc("complexity"), "id").limit(candidates)
    entry = entrypoints.select(F.col("node_id").alias("id"), F.lit(True).alias("entry")).distinct()
    rows = top.join(_facts(annotations, False), "id", "left").join(entry, "id", "left")
    cc, down = F.col("complexity"), F.coalesce("down", F.lit(0))
    score = F.when(F.col("tainted"), 40).otherwise(0) + F.when(F.col("entry"), 30).otherwise(0)
    score += F.when(cc >= 20, 20).when(cc >= 10, 10).otherwise(0) + F.when(down >= 50, 15).when(down >= 10, 5).otherwise(0)
    return rows.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "id").limit(limit).select("id", "complexity", "score")


def correlate(nodes: DataFrame, edges: DataFrame, annotations: DataFrame, entrypoints: DataFrame, hops: int = 10) -> DataFrame:
    """Nodes with findings (imported ones only where there are no others) by taint, reachability and what lies downstream."""
    kinds = annotations.where("kind IN ('finding', 'sarif_finding')").groupBy(F.col("node_id").alias("id")).agg(F.bool_or(F.col("kind") == "finding").alias("own"))
    own = annotations.select(F.coalesce(F.bool_or(F.col("kind") == "finding"), F.lit(False)).alias("any_own"))
    marked = kinds.crossJoin(F.broadcast(own)).where("own = any_own").select("id")  # one row: an aggregate
    seeds = entrypoints.select(F.col("node_id").alias("id"))
    near = traverse.reach(edges, seeds, hops).select("id").unionByName(seeds).distinct().withColumn("reachable", F.lit(True))
    rows = nodes.join(marked, "id", "left_semi").join(_facts(annotations, True), "id", "left").join(near, "id", "left")
    down = F.coalesce("down", F.lit(0))
    tainted, reachable = F.coalesce("tainted", F.lit(False)), F.coalesce("reachable", F.lit(False))
    score = F.when(tainted, 40).otherwise(0) + F.when(reachable, 40).otherwise(0) + F.when(down >= 50, 20).when(down >= 10, 10).otherwise(0)
    return rows.select("id", tainted.alias("tainted"), reachable.alias("reachable"), score.alias("score"))


def correlate_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if("tainted").alias("tainted"), F.count_if("reachable").alias("reachable"), F.count_if(F.col("score") >= 60).alias("critical"))


def scanner_dedup(findings: DataFrame, key: str) -> DataFrame:
    """One row a key: the first by seq, the scanners that report it, how often, and the greatest risk."""
    return findings.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_set("scanner")), ",").alias("scanners"), F.count("*").alias("duplicate_count"), F.max("risk_score").alias("risk_score"), F.min("seq").alias("seq")
    )


def diff(before: DataFrame, after: DataFrame, key: str, *payload: str) -> DataFrame:
    """(key, change): added, removed or changed rows between two versions."""
    a = before.select(F.col(key), F.struct(*payload).alias("a"))
    b = after.select(F.col(key), F.struct(*payload).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def locate(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """Places (file, line_no) with the innermost node around each: the smallest span, then id."""
    inside = (F.col("file") == F.col("file_path")) & F.col("line_no").between(F.col("start_line"), F.col("end_line"))
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "id"))
    return places.distinct().join(nodes, inside).groupBy("file", "line_no").agg(best.alias("best")).select("file", "line_no", "best.id")


def cross_scanner(a: DataFrame, b: DataFrame) -> DataFrame:
    """Findings (file, name, line, scanner, risk_score, seq) of two scanners, one row a place: file and name, or file and line without a name.

    The row is the first one's, of a before b and by seq; scanners, duplicate_count and the greatest risk_score are the group's.
    """
    rows = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    place = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.coalesce(F.col("line"), F.lit(0)).cast("string"))
    first = F.min(F.struct("side", "seq", "file", "name", "line")).alias("first")
    merged = rows.groupBy(F.concat_ws(":", F.coalesce("file", F.lit("")), place).alias("key")).agg(
        first, F.array_join(F.sort_array(F.collect_set("scanner")), ",").alias("scanners"), F.count("*").alias("duplicate_count"), F.max("risk_score").alias("risk_score")
    )
    return merged.select("key", "first.file", "first.name", "first.line", "scanners", "duplicate_count", "risk_score")


def cross_scanner_stats(merged: DataFrame) -> DataFrame:
    total, unique = F.sum("duplicate_count"), F.count("*")
    return merged.agg(F.coalesce(total, F.lit(0)).alias("total_input"), unique.alias("unique_count"), F.coalesce(total - unique, F.lit(0)).alias("duplicates_merged"), graph.share(F.coalesce(total - unique, F.lit(0)), F.coalesce(total, F.lit(0))).alias("reduction_percentage"))


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, dst, change): distinct edges added or removed."""
    a, b = (e.select("src", "dst").distinct() for e in (before, after))
    new = b.join(a, ["src", "dst"], "left_anti").withColumn("change", F.lit("added"))
    return new.unionByName(a.join(b, ["src", "dst"], "left_anti").withColumn("change", F.lit("removed")))


def surface_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of counts of two versions of entrypoints (node_id)."""
    a, b = (e.select("node_id").distinct() for e in (before, after))
    sides = a.select("node_id", F.lit(1).alias("was")).join(b.select("node_id", F.lit(1).alias("now")), "node_id", "full")
    n, m = F.count("was"), F.count("now")
    return sides.agg(n.alias("before"), m.alias("after"), (m - n).alias("delta"), F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("now").isNull()).alias("removed"))


def taint_paths(nodes: DataFrame, edges, annotations: DataFrame, entrypoints: DataFrame, sink: str, depth: int = MAX_DEPTH) -> DataFrame:
    """One row on a sink (an id): whether it is tainted, how many simple paths lead to it from entrypoints and how many direct callers it has."""
    spark = nodes.sparkSession
    target = spark.createDataFrame([(sink,)], "id string")
    n_paths = traverse.paths(edges, entrypoints.select(F.col("node_id").alias("id")), target, depth).agg(F.count("*").alias("path_count"))
    calls = edges.edges if isinstance(edges, traverse.Graph) else edges
    n_callers = graph.callers(nodes, calls, sink).agg(F.count("*").alias("caller_count"))
    tainted = annotations_of(nodes, annotations, sink).agg(F.coalesce(F.bool_or(F.col("kind") == "taint"), F.lit(False)).alias("is_tainted"))
    row = n_paths.crossJoin(n_callers).crossJoin(tainted)  # one row each
    return row.select(F.lit(sink).alias("sink"), "is_tainted", "path_count", "caller_count", (F.col("is_tainted") & (F.col("path_count") > 0)).alias("exploitable"))


def top_radius(nodes: DataFrame, edges, n: int = 50, depth: int = MAX_DEPTH) -> DataFrame:
    """(id, name, blast_radius, complexity): of the 3n most complex functions the n that reach most."""
    top = graph.functions(nodes).select("id", "name", F.coalesce("complexity", F.lit(0)).alias("complexity")).orderBy(F.desc("complexity"), "id").limit(3 * n)
    found = traverse.radius(edges, top.select("id"), depth).join(top, "id")
    return found.orderBy(F.desc("blast_radius"), "id").limit(n).select("id", "name", "blast_radius", "complexity")


def preanalysis(nodes: DataFrame, edges, entrypoints: DataFrame, n: int = 50) -> DataFrame:
    """(part, id, value): the entrypoints, and the functions of the widest reach."""
    points = entrypoints.join(nodes, F.col("node_id") == F.col("id")).select(F.lit("entrypoint").alias("part"), "id", F.lit(0).cast("long").alias("value"))
    wide = top_radius(nodes, edges, n).select(F.lit("blast_radius").alias("part"), "id", F.col("blast_radius").alias("value"))
    return points.unionByName(wide)


def outcomes(cases: DataFrame) -> DataFrame:
    """(bucket, n) of generated test cases (crashed, timed_out, errors, console)."""
    odd_error = F.col("errors").contains("UNEXPECTED") | F.col("errors").contains("!!!")
    bucket = F.when(F.col("crashed"), "crashed").when(F.col("timed_out"), "timed_out").when((F.col("errors") != "") & ~odd_error, "errors")
    bucket = bucket.when((F.col("errors") != "") | F.col("console").contains("[!!!]"), "interesting").otherwise("passed")
    return cases.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
