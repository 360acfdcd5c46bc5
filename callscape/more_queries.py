"""Queries on traversals, annotations, scores, source lines and files, each with its DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from callscape.fixtures import VIEWS, Fixtures, oracle
from callscape.operators import graph, lines, paging, rank, retrieve, traverse
from callscape.sources import files

ROOT, SINK, CONST = "p:7", "s:3", "kMax"
MORE, MORE_ORACLES = {}, {}


def _views(sql: str) -> list[str]:
    """The views that a statement needs, each behind those it needs itself."""
    out: list[str] = []

    def visit(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in out:
                visit(re.sub(rf"\b{v}\b", "", oracle(v)))
                out.append(v)

    visit(sql)
    return out


def _query(sql: str | None = None):
    def add(f):
        MORE[f.__name__] = lambda spark, d: f(Fixtures(spark, d))
        if sql:
            body = sql.removeprefix("WITH RECURSIVE ")
            views = ", ".join(f"{v} AS ({oracle(v)})" for v in _views(body))
            MORE_ORACLES[f.__name__] = "WITH RECURSIVE " + views + (", " if body is not sql else " ") + body if views else sql
        return f

    return add


def _ids(f, sql):
    return f.spark.createDataFrame([(sql,)], "id string")


def _walk(seeds: str, depth: int, near: str = "src", far: str = "dst") -> str:
    """Recursive SQL: v(root, id, depth of the first visit)."""
    return (
        f"WITH RECURSIVE w(root, id, depth) AS (SELECT root, id, 0 FROM ({seeds}) UNION SELECT root, {far}, depth + 1 FROM w JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.{near} = w.id WHERE depth < {depth}), "
        "v AS (SELECT root, id, min(depth) AS depth FROM w GROUP BY ALL) "
    )


FUNCTIONS = "kind IN ('function', 'method')"
ENTRY = "SELECT 0 AS root, node_id AS id FROM entrypoints"
ONE = f"SELECT 0 AS root, '{ROOT}' AS id"


@_query(f"SELECT DISTINCT dst AS id FROM edges WHERE src = '{ROOT}' AND dst <> '{ROOT}'")
def callees_of(f):
    return traverse.reach(f.graph, _ids(f, ROOT), 1).select("id")


@_query(_walk(f"SELECT 0 AS root, '{SINK}' AS id", 5, "dst", "src") + "SELECT id, depth FROM v WHERE depth > 0")
def ancestors_of(f):
    return traverse.reach(f.graph, _ids(f, SINK), 5, backward=True)


@_query(_walk(ONE, 5) + "SELECT id FROM v WHERE depth > 0")
def reachable_from(f):
    return traverse.reach(f.graph, _ids(f, ROOT), 5).select("id")


@_query(_walk(ONE, 20) + "SELECT id, depth FROM v")
def bfs_levels(f):
    return traverse.levels(f.graph, _ids(f, ROOT).withColumn("root", F.lit(0)), 20).select("id", "depth")


@_query(_walk("SELECT node_id AS root, node_id AS id FROM entrypoints", 5) + "SELECT root, id, depth FROM v")
def batched_bfs(f):
    return traverse.levels(f.graph, f.entrypoints.select(F.col("node_id").alias("root"), F.col("node_id").alias("id")), 5)


@_query(_walk(ONE, 20) + "SELECT count(*) - 1 AS blast_radius FROM v")
def blast_radius(f):
    return traverse.radius(f.graph, _ids(f, ROOT)).select("blast_radius")


@_query(_walk("SELECT node_id AS root, node_id AS id FROM entrypoints", 20) + "SELECT root AS id, count(*) - 1 AS blast_radius FROM v GROUP BY root")
def blast_radius_batch(f):
    return traverse.radius(f.graph, f.entrypoints.select(F.col("node_id").alias("id")))


TOP = f"SELECT id FROM nodes WHERE {FUNCTIONS} ORDER BY coalesce(complexity, 0) DESC, id LIMIT 150"


@_query(_walk(f"SELECT id AS root, id FROM ({TOP})", 20) + "SELECT root AS id, count(*) - 1 AS blast_radius FROM v GROUP BY root ORDER BY 2 DESC, 1 LIMIT 50")
def blast_radius_top_n(f):
    top = graph.functions(f.nodes).orderBy(F.desc(F.coalesce("complexity", F.lit(0))), "id").limit(150)
    return traverse.radius(f.graph, top.select("id")).orderBy(F.desc("blast_radius"), "id").limit(50)


@_query(_walk(ENTRY, 50) + f"SELECT id FROM nodes WHERE {FUNCTIONS} AND id NOT IN (SELECT id FROM v)")
def unreachable_from_entrypoints(f):
    return traverse.unreachable(graph.functions(f.nodes), f.graph, f.entrypoints).select("id")


@_query(_walk(ENTRY, 50) + f"SELECT count(*) AS total, count(*) FILTER (WHERE id NOT IN (SELECT id FROM v)) AS unreachable FROM nodes WHERE {FUNCTIONS}")
def unreachable_stats(f):
    functions = graph.functions(f.nodes)
    n = traverse.unreachable(functions, f.graph, f.entrypoints).select("id", F.lit(1).alias("no"))
    return functions.join(n, "id", "left").agg(F.count("*").alias("total"), F.count("no").alias("unreachable"))


@_query(_walk(ENTRY, 20) + "SELECT id FROM v")
def reachable_from_entrypoints(f):
    return traverse.levels(f.graph, f.entrypoints.select(F.lit(0).alias("root"), F.col("node_id").alias("id")), 20).select("id")


@_query(f"SELECT count(*) AS total, count(*) FILTER (WHERE id NOT IN (SELECT dst FROM edges) AND id NOT IN (SELECT node_id FROM entrypoints)) AS dead FROM nodes WHERE {FUNCTIONS}")
def dead_code_stats(f):
    functions = graph.functions(f.nodes)
    dead = graph.dead_code(f.nodes, f.edges, f.entrypoints).select("id", F.lit(1).alias("no"))
    return functions.join(dead, "id", "left").agg(F.count("*").alias("total"), F.count("no").alias("dead"))


def _paths(sources: str, depth: int, limit: int, sink: str = SINK) -> str:
    return (
        f"WITH RECURSIVE w(path, id) AS (SELECT [id], id FROM ({sources}) UNION ALL SELECT list_append(path, dst), dst FROM w JOIN (SELECT DISTINCT src, dst FROM edges) ON src = id "
        f"WHERE len(path) <= {depth} AND NOT list_contains(path, dst)) SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INT) AS hops FROM w WHERE id = '{sink}' ORDER BY 2, 1 LIMIT {limit}"
    )


FROM, TO = "p:115", "s:16"  # linked by several paths at sf0.01


@_query(_paths(f"SELECT '{FROM}' AS id", 5, 20, TO))
def paths_between(f):
    return traverse.shortest_first(traverse.paths(f.graph, _ids(f, FROM), _ids(f, TO), 5), 20)


@_query(_paths("SELECT DISTINCT node_id AS id FROM entrypoints", 4, 10))
def entrypoint_paths_to(f):
    return traverse.shortest_first(traverse.paths(f.graph, f.entrypoints.select(F.col("node_id").alias("id")), _ids(f, SINK), 4), 10)


@_query("WITH RECURSIVE w(id) AS (SELECT 'r:1' UNION SELECT child FROM w JOIN inherits ON parent = id) SELECT id FROM w WHERE id <> 'r:1'")
def children_of(f):
    return traverse.reach(f.inherits.select(F.col("parent").alias("src"), F.col("child").alias("dst")), _ids(f, "r:1"), 1000).select("id")


FILE = "Brand#5/ECONOMY"


def _includes(f, depth, backward=False):
    return traverse.reach(f.includes.select(F.col("file").alias("src"), F.col("includes").alias("dst")), _ids(f, FILE), depth, backward).select("id")


def _include_sql(near, far, depth):
    return f"WITH RECURSIVE w(id, depth) AS (SELECT '{FILE}', 0 UNION SELECT {far}, depth + 1 FROM w JOIN includes i ON i.{near} = id WHERE depth < {depth}) SELECT DISTINCT id FROM w WHERE id <> '{FILE}'"


@_query(_include_sql("file", "includes", 1))
def includes_of(f):
    return _includes(f, 1)


@_query(_include_sql("file", "includes", 10))
def transitive_includes(f):
    return _includes(f, 10)


@_query(_include_sql("includes", "file", 10))
def includers_of(f):
    return _includes(f, 10, True)


@_query("SELECT src, dst, s.name AS src_name, d.name AS dst_name FROM edges LEFT JOIN nodes s ON s.id = src LEFT JOIN nodes d ON d.id = dst")
def edge_endpoints(f):
    ends = [f.nodes.select(F.col("id").alias(x), F.col("name").alias(x + "_name")) for x in ("src", "dst")]
    return f.edges.join(ends[0], "src", "left").join(ends[1], "dst", "left").select("src", "dst", "src_name", "dst_name")


@_query(f"SELECT id FROM nodes WHERE name = '{ROOT[2:]}' OR id = '{ROOT[2:]}' OR id LIKE '%:{ROOT[2:]}'")
def resolve_name(f):
    return graph.resolve(f.nodes, ROOT[2:])


@_query(f"SELECT id, name, kind FROM nodes WHERE id = '{ROOT}'")
def node_by_id(f):
    return f.nodes.where(F.col("id") == ROOT).select("id", "name", "kind")


@_query("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE kind IN ('function', 'method')) AS functions, (SELECT count(*) FROM nodes WHERE kind = 'class') AS classes, (SELECT count(*) FROM edges) AS call_edges, (SELECT count(*) FROM entrypoints) AS entrypoints")
def graph_summary(f):
    n = f.nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind").isin("function", "method")).alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"))
    return n.crossJoin(f.edges.agg(F.count("*").alias("call_edges"))).crossJoin(f.entrypoints.agg(F.count("*").alias("entrypoints")))  # one row each


@_query("SELECT id FROM nodes WHERE id IN (SELECT node_id FROM raises WHERE exception = '1-URGENT')")
def functions_that_raise(f):
    hit = f.raises.where(F.col("exception") == "1-URGENT").select(F.col("node_id").alias("id"))
    return f.nodes.join(hit, "id", "left_semi").select("id")


@_query("SELECT id, name FROM nodes WHERE id IN (SELECT node_id FROM annotations WHERE kind = 'taint')")
def nodes_with_annotation(f):
    return rank.with_annotation(f.nodes, f.annotations, "taint").select("id", "name")


# `findings` is a view's name too, so the SQL asks for the kind in the annotations.
@_query("SELECT id FROM nodes WHERE id IN (SELECT node_id FROM annotations WHERE kind IN ('finding', 'audit_note'))")
def findings(f):
    return rank.with_annotation(f.nodes, f.annotations, "finding", "audit_note").select("id")


@_query("SELECT kind, description FROM annotations WHERE node_id = 'p:9'")
def annotations_of(f):
    return rank.annotations_of(f.nodes, f.annotations, "p:9").select("kind", "description")


@_query("SELECT node_id, kind FROM annotations UNION ALL SELECT 'p:9', 'audit_note'")
def annotate(f):
    return rank.annotate(f.nodes, f.annotations, "p:9", "audit_note", "look").select("node_id", "kind")


@_query("SELECT node_id, kind FROM annotations WHERE NOT (node_id = 'p:9' AND kind = 'taint')")
def clear_annotations(f):
    return rank.clear(f.nodes, f.annotations, "p:9", "taint").select("node_id", "kind")


FACTS = "facts AS (SELECT node_id AS id, bool_or(kind = 'taint') AS t, max(CASE WHEN kind = 'blast_radius' THEN CAST(split_part(description, ' ', 1) AS INT) END) AS down FROM annotations GROUP BY node_id)"


@_query(
    f"WITH RECURSIVE {FACTS} SELECT id, complexity, CAST(score AS INT) AS score FROM (SELECT id, complexity, CASE WHEN t THEN 40 ELSE 0 END + CASE WHEN id IN (SELECT node_id FROM entrypoints) THEN 30 ELSE 0 END + CASE WHEN complexity >= 20 THEN 20 ELSE 10 END "
    f"+ CASE WHEN down >= 50 THEN 15 WHEN down >= 10 THEN 5 ELSE 0 END AS score FROM (SELECT * FROM nodes WHERE {FUNCTIONS} AND complexity >= 10 ORDER BY complexity DESC, id LIMIT 2000) LEFT JOIN facts USING (id)) ORDER BY score DESC, id LIMIT 20"
)
def fuzzing_targets(f):
    return rank.fuzzing_targets(f.nodes, f.annotations, f.entrypoints)


CORRELATE = (
    _walk(ENTRY, 10) + f", {FACTS}, c AS (SELECT id, coalesce(t, false) AS tainted, id IN (SELECT id FROM v) AS reachable, down FROM nodes LEFT JOIN facts USING (id) WHERE id IN (SELECT node_id FROM annotations WHERE kind = 'finding')), "
    "r AS (SELECT id, tainted, reachable, CAST(CASE WHEN tainted THEN 40 ELSE 0 END + CASE WHEN reachable THEN 40 ELSE 0 END + CASE WHEN down >= 50 THEN 20 WHEN down >= 10 THEN 10 ELSE 0 END AS INT) AS score FROM c) "
)


def _correlated(f):
    return rank.correlate(f.nodes, f.graph, f.annotations, f.entrypoints)


@_query(CORRELATE + "SELECT * FROM r")
def scan_correlate(f):
    return _correlated(f)


@_query(CORRELATE + "SELECT count(*) AS total, count(*) FILTER (WHERE tainted) AS tainted, count(*) FILTER (WHERE reachable) AS reachable, count(*) FILTER (WHERE score >= 60) AS critical FROM r")
def scan_correlate_stats(f):
    return rank.correlate_stats(_correlated(f))


@_query("SELECT node_id, CAST(regexp_extract(description, '([0-9]+) downstream', 1) AS BIGINT) AS down FROM annotations WHERE kind = 'blast_radius'")
def parse_downstream(f):
    return f.annotations.where("kind = 'blast_radius'").select("node_id", rank.downstream(F.col("description")).alias("down"))


@_query("SELECT node_id, string_agg(DISTINCT scanner, ',' ORDER BY scanner) AS scanners, count(*) AS duplicate_count, max(risk_score) AS risk_score, min(seq) AS seq FROM findings GROUP BY node_id")
def cross_scanner_dedup(f):
    return rank.scanner_dedup(f.findings, "node_id")


@_query("SELECT id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM nodes_a a FULL JOIN nodes_b b USING (id) WHERE a.id IS NULL OR b.id IS NULL OR a.complexity IS DISTINCT FROM b.complexity")
def diff_codebases(f):
    return rank.diff(f.nodes_a, f.nodes_b, "id", "name", "kind", "file_path", "start_line", "end_line", "complexity")


def _entry_versions(f):
    return [f.entrypoints.join(n.select(F.col("id").alias("node_id")), "node_id", "left_semi") for n in (f.nodes_a, f.nodes_b)]


@_query("SELECT node_id, CASE WHEN node_id IN (SELECT id FROM nodes_a) THEN 'removed' ELSE 'added' END AS change FROM entrypoints WHERE (node_id IN (SELECT id FROM nodes_a)) <> (node_id IN (SELECT id FROM nodes_b))")
def attack_surface_diff(f):
    return rank.diff(*_entry_versions(f), "node_id", "trust_level")


@_query(f"SELECT DISTINCT src AS id FROM edges WHERE dst = '{SINK}' AND src <> '{SINK}' ORDER BY id LIMIT 5 OFFSET 2")
def paged_callers(f):
    return graph.callers(f.nodes, f.edges, SINK).orderBy("id").offset(2).limit(5)


def _shape(kind: str, pattern: str):
    shape = lines.SHAPES[kind]
    value = f"trim(regexp_extract(text, '{shape.pattern}', {shape.value}))" if shape.value else "''"
    sql = f"SELECT file, line_no, regexp_extract(text, '{shape.pattern}', {shape.name}) AS name, {value} AS value FROM lines WHERE regexp_matches(text, '{shape.pattern}') AND regexp_matches(text, '(?i){pattern}')"

    def query(f):
        return lines.search(f.lines, kind, pattern)

    query.__name__ = "search_" + kind
    _query(sql)(query)


for _kind, _pattern in (("constants", "kmax"), ("types", "t1"), ("assertions", "field"), ("bitfields", "bitfield"), ("macros", "lim_1"), ("narrowing_casts", "buf")):
    _shape(_kind, _pattern)


@_query("SELECT file, line_no, text FROM lines WHERE regexp_matches(text, 'kMax[a-m]')")
def search_source(f):
    return lines.search_source(f.lines, "kMax[a-m]")


@_query("SELECT h.file, h.line_no AS hit, l.line_no, rtrim(l.text) AS text FROM lines h JOIN lines l ON h.file = l.file AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2 WHERE regexp_matches(h.text, 'LIM_1')")
def search_with_context(f):
    return lines.with_context(f.lines, "LIM_1", 2)


EXTS = ", ".join(f"('{e}', '{lang}')" for lang, es in files.EXTENSIONS.items() for e in es)
SKIP = ", ".join(f"'{s}'" for s in files.SKIPPED)
DISCOVER = f"WITH RECURSIVE x(ext, language) AS (VALUES {EXTS}), found AS (SELECT path, language FROM files JOIN x ON lower(regexp_extract(path, '([.][^./]*)$', 1)) = ext WHERE len(list_filter(string_split(path, '/')[:-2], lambda s: s IN ({SKIP}) OR starts_with(s, '.'))) = 0) "


@_query(DISCOVER + "SELECT path, language FROM found")
def scan_files(f):
    return files.discover(f.files).select("path", "language")


@_query(DISCOVER + "SELECT language, count(*) AS n FROM found GROUP BY language")
def detect_languages(f):
    return files.discover(f.files).groupBy("language").agg(F.count("*").alias("n"))


@_query("SELECT path, sha256(content) AS hash FROM files WHERE content IS NOT NULL")
def content_hash(f):
    return files.hashes(f.files.where("content IS NOT NULL"))


@_query(
    "SELECT sha256(string_agg(bucket || ':' || digest, chr(10) ORDER BY bucket || ':' || digest)) AS hash FROM (SELECT bucket, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM "
    "(SELECT left(sha256(path), 3) AS bucket, path || ':' || sha256(content) AS line FROM files WHERE content IS NOT NULL) GROUP BY bucket)"
)
def composite_hash(f):
    return files.composite_hash(f.files.where("content IS NOT NULL"))


@_query("SELECT b.path FROM files_b b WHERE NOT EXISTS (SELECT 1 FROM files a WHERE a.path = b.path AND a.content = b.content)")
def incremental_changed(f):
    return files.changed(f.files, f.files_b)


@_query("SELECT 'root' AS name, false AS is_third_party, count(*) AS estimated_files FROM files")
def plan_partitions(f):
    return files.partitions(f.files)


@_query("SELECT id, kind FROM nodes_a UNION SELECT id, kind FROM nodes_b")
def graph_merge(f):
    return graph.merge(f.nodes_a, f.nodes_b).select("id", "kind")


@_query("SELECT 20 AS depth, 5000 AS max_results, 0 AS start_at, 1 AS hub_threshold")
def clamp_bounds(f):
    return f.spark.createDataFrame([paging.clamp(999, 99999, -5, 0)], "depth int, max_results int, start_at int, hub_threshold int")


@_query(f"SELECT count(*) AS total, count(*) FILTER (WHERE n > 2 AND n <= 7) AS returned, true AS truncated FROM (SELECT row_number() OVER (ORDER BY src) AS n FROM (SELECT DISTINCT src FROM edges WHERE dst = '{SINK}' AND src <> '{SINK}'))")
def bounded_envelope(f):
    return paging.envelope(graph.callers(f.nodes, f.edges, SINK), limit=5, offset=2)


@_query("WITH RECURSIVE hits AS (SELECT file, line_no FROM lines WHERE contains(text, 'static_assert')) SELECT file, line_no, id FROM (SELECT h.file, h.line_no, id, row_number() OVER (PARTITION BY h.file, h.line_no ORDER BY end_line - start_line, id) AS n FROM hits h JOIN nodes ON file_path = h.file AND h.line_no BETWEEN start_line AND end_line) WHERE n = 1")
def augment_sarif(f):
    return rank.locate(f.nodes, f.lines.where(F.col("text").contains("static_assert")).select("file", "line_no")).select("file", "line_no", "id")


@_query("SELECT lang AS language, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def chunk_stats(f):
    return f.table("documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


TERMS = ["license", "copyright"]
_TF = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(TERMS))
_DF = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(TERMS)))
_SCORE = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / al))" for i in range(len(TERMS)))
_ANY = " OR ".join(f"f{i} > 0" for i in range(len(TERMS)))


@_query(
    f"WITH RECURSIVE tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents), tf AS (SELECT doc_id, len(t) AS dl, {_TF} FROM tok), "
    f"st AS (SELECT count(*) AS n, avg(dl) AS al, {_DF} FROM tf) SELECT doc_id, round(CAST({_SCORE} AS DOUBLE), 6) AS score FROM tf, st WHERE {_ANY} ORDER BY round(CAST({_SCORE} AS DOUBLE), 6) DESC, doc_id LIMIT 10"
)
def semantic_search(f):
    return retrieve.bm25(retrieve.Index.build(f.table("documents"), "doc_id"), TERMS, 10).select(F.col("key").alias("doc_id"), "score")


@_query(
    "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 1)), 6) AS score FROM embeddings WHERE vec_id <> 1 AND embedding IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 5"
)
def find_related(f):
    return retrieve.related(f.table("embeddings"), 1, 5)
