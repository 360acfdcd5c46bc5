"""Queries on bounds, types and calls, source bodies, retrieval, scanners and files, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F


from callscape.more_queries import EXTS, FUNCTIONS, ONE, ROOT, SINK, _ids, _paths, _query, _walk
from callscape.operators import consteval, graph, lines, paging, rank, resolver, retrieve, traverse
from callscape.plans import catalog
from callscape.sources import files

R = "WITH RECURSIVE "
HUB_LIMIT = 60
HUBS = f"hubs AS (SELECT dst AS id FROM edges GROUP BY dst HAVING count(*) > {HUB_LIMIT})"


def _page(sql: str, order: str, limit: int, offset: int) -> str:
    """SQL of paging.page() over a query."""
    end = f"least(total, {limit + offset})"
    return (
        f"SELECT * FROM (SELECT *, (total > {limit + offset} OR {offset} > 0) AS truncated, CASE WHEN total > {limit + offset} THEN 'rows {offset} to ' || {end} || ' of ' || total || '; the next page begins at ' || {end} "
        f"WHEN {offset} > 0 THEN 'begins at {offset}, of ' || total || ' rows' ELSE '' END AS hint FROM (SELECT *, count(*) OVER () AS total FROM ({sql}) q) q) q ORDER BY {order} LIMIT {limit} OFFSET {offset}"
    )


def _hubs(f):
    return graph.hubs(f.edges, HUB_LIMIT)


@_query(R + HUBS + " " + _page(f"SELECT DISTINCT src AS id FROM edges WHERE dst = '{SINK}' AND src <> '{SINK}' AND src NOT IN (SELECT id FROM hubs)", "id", 5, 2))
def callers_page(f):
    return paging.page(paging.without_hubs(graph.callers(f.nodes, f.edges, SINK), _hubs(f)), 5, 2, "id")


@_query(R + _page(f"SELECT DISTINCT dst AS id FROM edges WHERE src = '{ROOT}' AND dst <> '{ROOT}'", "id", 100, 0))
def callees_page(f):
    return paging.page(graph.callees(f.nodes, f.edges, ROOT), 100, 0, "id")


@_query(_walk(f"SELECT 0 AS root, '{SINK}' AS id", 5, "dst", "src") + ", " + HUBS + " " + _page("SELECT id, depth FROM v WHERE depth > 0 AND id NOT IN (SELECT id FROM hubs)", "depth, id", 100, 0))
def ancestors_page(f):
    return paging.page(paging.without_hubs(traverse.reach(f.graph, _ids(f, SINK), 5, backward=True), _hubs(f)), 100, 0, "depth", "id")


BLOCKED = f"{HUBS}, w(id, depth) AS (SELECT '{ROOT}', 0 UNION SELECT dst, depth + 1 FROM w JOIN (SELECT DISTINCT src, dst FROM edges WHERE dst NOT IN (SELECT id FROM hubs)) e ON src = id WHERE depth < 5)"


@_query(R + BLOCKED + " " + _page("SELECT id, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY id HAVING min(depth) > 0", "depth, id", 20, 1).replace("FROM w WHERE depth > 0 GROUP", f"FROM w WHERE id <> '{ROOT}' GROUP"))
def reachable_page_blocked(f):
    return paging.page(traverse.reach(f.graph, _ids(f, ROOT), 5, avoid=_hubs(f)), 20, 1, "depth", "id")


@_query(_walk(ONE, 5) + ", " + HUBS + " SELECT id, depth FROM v WHERE depth > 0 AND id NOT IN (SELECT id FROM hubs)")
def reachable_without_hubs(f):
    return paging.without_hubs(traverse.reach(f.graph, _ids(f, ROOT), 5), _hubs(f))


@_query(_walk("SELECT 0 AS root, node_id AS id FROM entrypoints", 20) + "SELECT id, id IN (SELECT id FROM v) AS reachable FROM (VALUES ('s:3'), ('p:7'), ('p:11'), ('none')) q(id)")
def is_reachable(f):
    seeds = f.entrypoints.select(F.col("node_id").alias("id"))
    found = traverse.reach(f.graph, seeds, 20).select("id").unionByName(seeds).distinct().withColumn("hit", F.lit(True))
    asked = f.spark.createDataFrame([("s:3",), ("p:7",), ("p:11",), ("none",)], "id string")
    return asked.join(found, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("reachable"))


def _share(part: str, whole: str) -> str:
    return f"round(CAST(100 AS DOUBLE) * {part} / greatest({whole}, 1), 1)"


@_query(R + _page(f"SELECT id, name, complexity FROM nodes WHERE {FUNCTIONS} AND id NOT IN (SELECT dst FROM edges) AND id NOT IN (SELECT node_id FROM entrypoints)", "coalesce(complexity, 0) DESC, id", 50, 0))
def dead_code_page(f):
    return paging.page(graph.dead_code(f.nodes, f.edges, f.entrypoints).select("id", "name", "complexity"), 50, 0, F.desc(F.coalesce("complexity", F.lit(0))), "id")


@_query(R + f"d AS (SELECT count(*) AS total, count(*) FILTER (WHERE id NOT IN (SELECT dst FROM edges) AND id NOT IN (SELECT node_id FROM entrypoints)) AS dead FROM nodes WHERE {FUNCTIONS}) SELECT total, dead, {_share('dead', 'total')} AS percentage FROM d")
def dead_code_percentage(f):
    rows = graph.functions(f.nodes).select("id").join(graph.dead_code(f.nodes, f.edges, f.entrypoints).select("id", F.lit(1).alias("no")), "id", "left")
    return rows.agg(F.count("*").alias("total"), F.count("no").alias("dead")).withColumn("percentage", graph.share(F.col("dead"), F.col("total")))


@_query(_walk("SELECT 0 AS root, node_id AS id FROM entrypoints", 50) + f", u AS (SELECT count(*) AS total, count(*) FILTER (WHERE id NOT IN (SELECT id FROM v)) AS unreachable FROM nodes WHERE {FUNCTIONS} AND file_path <> '') SELECT total, unreachable, {_share('unreachable', 'total')} AS percentage FROM u")
def unreachable_percentage(f):
    functions = graph.functions(f.nodes).where("file_path <> ''")
    rows = functions.select("id").join(traverse.unreachable(functions, f.graph, f.entrypoints).select("id", F.lit(1).alias("no")), "id", "left")
    return rows.agg(F.count("*").alias("total"), F.count("no").alias("unreachable")).withColumn("percentage", graph.share(F.col("unreachable"), F.col("total")))


DEEP = 4


@_query(
    _paths("SELECT DISTINCT node_id AS id FROM entrypoints", DEEP, 1_000_000).replace("SELECT array_to_string", f", p AS (SELECT array_to_string") + f"), c AS (SELECT count(DISTINCT src) AS caller_count FROM edges WHERE dst = '{SINK}' AND src <> '{SINK}'), "
    f"t AS (SELECT coalesce(bool_or(kind = 'taint'), false) AS is_tainted FROM annotations WHERE node_id = '{SINK}'), n AS (SELECT count(*) AS path_count FROM p) SELECT '{SINK}' AS sink, is_tainted, path_count, caller_count, is_tainted AND path_count > 0 AS exploitable FROM n, c, t"
)
def taint_paths_to(f):
    return rank.taint_paths(f.nodes, f.graph, f.annotations, f.entrypoints, SINK, DEEP)


N_TOP = 10
RADIUS = _walk(f"SELECT id AS root, id FROM (SELECT id FROM nodes WHERE {FUNCTIONS} ORDER BY coalesce(complexity, 0) DESC, id LIMIT {3 * N_TOP})", 20)
TOP = f"SELECT n.id, name, c AS blast_radius, coalesce(complexity, 0) AS complexity FROM (SELECT root, count(*) - 1 AS c FROM v GROUP BY root) r JOIN nodes n ON n.id = root ORDER BY c DESC, n.id LIMIT {N_TOP}"


@_query(RADIUS + TOP)
def blast_radius_named(f):
    return rank.top_radius(f.nodes, f.graph, N_TOP)


@_query(RADIUS + f"SELECT 'entrypoint' AS part, node_id AS id, CAST(0 AS BIGINT) AS value FROM entrypoints JOIN nodes n ON n.id = node_id UNION ALL SELECT 'blast_radius', id, blast_radius FROM ({TOP})")
def preanalysis(f):
    return rank.preanalysis(f.nodes, f.graph, f.entrypoints, N_TOP)


@_query("SELECT src, dst FROM typed_edges WHERE kind = 'calls'")
def call_edges(f):
    return f.typed_edges.where("kind = 'calls'").select("src", "dst")


@_query(
    "SELECT id, name, qualified_name, kind, file_path, coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line, coalesce(complexity, 0) AS complexity, false AS is_phantom FROM nodes UNION ALL "
    "SELECT id, split_part(id, ':', -1), split_part(id, ':', -1), 'function', '', 0, 0, 0, true FROM (SELECT DISTINCT id FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) WHERE id NOT IN (SELECT id FROM nodes))"
)
def node_records(f):
    return graph.records(f.nodes, f.edges)


MATCH = f"SELECT id, name, qualified_name, kind, file_path, start_line, end_line, complexity FROM nodes WHERE {FUNCTIONS} AND (regexp_matches(name, '(?i)WIDGET') OR regexp_matches(qualified_name, '(?i)WIDGET'))"


@_query(R + _page(MATCH, "id", 20, 5))
def search_functions_page(f):
    columns = ("id", "name", "qualified_name", "kind", "file_path", "start_line", "end_line", "complexity")
    return paging.page(graph.search_functions(f.nodes, "WIDGET").select(*columns), 20, 5, "id")


@_query(R + _page(f"SELECT id, name, complexity FROM nodes WHERE {FUNCTIONS} AND complexity >= 10", "complexity DESC, id", 30, 10).replace("OR 10 > 0", "OR false").replace("WHEN 10 > 0", "WHEN true"))
def complexity_hotspots_page(f):
    rows = paging.page(graph.hotspots(f.nodes).select("id", "name", "complexity"), 30, 10, F.desc("complexity"), "id")
    return rows.withColumn("truncated", F.col("total") > 40)  # on the last page nothing is left out


@_query("SELECT id AS node_id, name, CASE WHEN regexp_matches(name, '_1$') THEN 'one' ELSE 'early' END AS trust_level FROM nodes WHERE kind IN ('function', 'method') AND (regexp_matches(name, '_1$') OR regexp_matches(name, '(?i)^[a-d]'))")
def detect_entrypoints(f):
    return graph.detect_entrypoints(f.nodes, {"one": "_1$", "early": "(?i)^[a-d]"})


MERGED = "n AS (SELECT *, 0 AS nth FROM nodes_a UNION ALL SELECT *, 1 FROM nodes_b)"


@_query(R + MERGED + " SELECT id, name, kind, complexity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nth) AS k FROM n) WHERE k = 1")
def graph_merge_rows(f):
    return graph.merge(f.nodes_a, f.nodes_b).select("id", "name", "kind", "complexity")


E_A, E_B = "src NOT LIKE '%0'", "dst NOT LIKE '%1'"


@_query(f"SELECT DISTINCT src, dst, CASE WHEN {E_B} THEN 'added' ELSE 'removed' END AS change FROM edges WHERE ({E_A}) <> ({E_B})")
def diff_edges(f):
    return rank.edge_diff(f.edges.where(E_A), f.edges.where(E_B))


@_query("SELECT count(*) FILTER (WHERE a) AS before, count(*) FILTER (WHERE b) AS after, count(*) FILTER (WHERE b) - count(*) FILTER (WHERE a) AS delta, count(*) FILTER (WHERE b AND NOT a) AS added, count(*) FILTER (WHERE a AND NOT b) AS removed FROM (SELECT DISTINCT node_id, node_id IN (SELECT id FROM nodes_a) AS a, node_id IN (SELECT id FROM nodes_b) AS b FROM entrypoints)")
def attack_surface_delta(f):
    return rank.surface_delta(*(f.entrypoints.join(n.select(F.col("id").alias("node_id")), "node_id", "left_semi") for n in (f.nodes_a, f.nodes_b)))


PLACED = "CAST('f' || seq % 50 AS STRING) AS file, CASE WHEN seq % 3 <> 0 THEN node_id END AS name, seq % 20 AS line, scanner, risk_score, seq"
SQL_PLACED = PLACED.replace("AS STRING", "AS VARCHAR")
BOTH = f"p AS (SELECT *, file || ':' || coalesce(name, CAST(line AS VARCHAR)) AS key, CASE scanner WHEN 'a' THEN 0 ELSE 1 END AS side FROM (SELECT {SQL_PLACED} FROM findings))"
DEDUPED = "SELECT key, first(file ORDER BY side, seq) AS file, first(name ORDER BY side, seq) AS name, first(line ORDER BY side, seq) AS line, string_agg(DISTINCT scanner, ',' ORDER BY scanner) AS scanners, count(*) AS duplicate_count, max(risk_score) AS risk_score FROM p GROUP BY key"


def _two(f):
    rows = f.findings.selectExpr(*(x.strip() for x in PLACED.split(", ")))
    return rank.cross_scanner(rows.where("scanner = 'a'"), rows.where("scanner = 'b'"))


@_query(R + BOTH + " " + DEDUPED)
def cross_scanner_findings(f):
    return _two(f)


@_query(R + BOTH + f" SELECT CAST(sum(duplicate_count) AS BIGINT) AS total_input, count(*) AS unique_count, CAST(sum(duplicate_count) - count(*) AS BIGINT) AS duplicates_merged, {_share('(sum(duplicate_count) - count(*))', 'sum(duplicate_count)')} AS reduction_percentage FROM ({DEDUPED})")
def cross_scanner_dedup_stats(f):
    return rank.cross_scanner_stats(_two(f))


@_query("SELECT file, line_no, name, value, TRY_CAST(value AS BIGINT) AS numeric_value FROM (SELECT file, line_no, regexp_extract(text, '{0}', 1) AS name, trim(regexp_extract(text, '{0}', 2)) AS value FROM lines WHERE regexp_matches(text, '{0}'))".replace("{0}", lines.SHAPES["constants"].pattern))
def constants_with_numbers(f):
    return lines.constants(f.lines)


@_query("SELECT file, line_no, name, bits || ' bits (max ' || format('{{:,}}', CAST(1 AS BIGINT) << bits) || ')' AS value FROM (SELECT file, line_no, regexp_extract(text, '{0}', 1) AS name, CAST(regexp_extract(text, '{0}', 2) AS INT) AS bits FROM lines WHERE regexp_matches(text, '{0}'))".replace("{{", "{").replace("}}", "}").replace("{0}", lines.SHAPES["bitfields"].pattern))
def bitfield_widths(f):
    return lines.widths(f.lines)


@_query(R + "m AS (SELECT file, line_no, text FROM lines WHERE regexp_matches(text, 'kMax[a-m]')) SELECT * FROM m ORDER BY file, line_no LIMIT 25")
def search_source_first(f):
    return lines.first_matches(lines.search_source(f.lines, "kMax[a-m]"), 25)


EXPRESSION = """CASE p_partkey % 8 WHEN 0 THEN '(' || p_size || ' + 2) * 1024' WHEN 1 THEN '1u << ' || p_size % 20 WHEN 2 THEN '0xFF' WHEN 3 THEN '1''''000UL' WHEN 4 THEN 'sizeof(int) * 2' WHEN 5 THEN p_size || ' / 4 - ' || p_size || ' % 4' WHEN 6 THEN '-' || p_size || '.75f' ELSE CAST(p_size AS STRING) END"""
VALUE = "CASE p_partkey % 8 WHEN 0 THEN (p_size + 2) * 1024 WHEN 1 THEN 1 << (p_size % 20) WHEN 2 THEN 255 WHEN 3 THEN 1000 WHEN 4 THEN NULL WHEN 5 THEN p_size // 4 - p_size % 4 WHEN 6 THEN -p_size ELSE p_size END"


@_query(f"SELECT p_partkey, CAST({VALUE} AS BIGINT) AS value FROM part")
def eval_constant(f):
    return f.table("part").select("p_partkey", consteval.evaluate(F.expr(EXPRESSION.replace("''''", "\\'"))).alias("value"))


def _code(pattern: str, *groups: tuple[int, str]) -> str:
    return "SELECT file, line_no, " + ", ".join(f"regexp_extract(text, '{pattern}', {g}) AS {n}" for g, n in groups) + f" FROM code WHERE regexp_matches(text, '{pattern}')"


WORDS = ", ".join(f"'{w}'" for w in resolver.KEYWORDS)
INCLUDES = "inc AS (SELECT file, line_no, name, CASE WHEN regexp_replace(file, '[^/]*$', '') || name IN (SELECT file FROM code) THEN regexp_replace(file, '[^/]*$', '') || name WHEN name IN (SELECT file FROM code) THEN name END AS target FROM (" + _code(resolver.INCLUDE, (1, "name")) + "))"
CLASSES = "cls AS (SELECT file, line_no, class, nullif(parent, '') AS parent FROM (" + _code(resolver.CLASS, (1, "class"), (2, "parent")) + "))"
DEFS = "def AS (SELECT *, CASE class WHEN '' THEN name ELSE class || '::' || name END AS qualified FROM (" + _code(resolver.DEFINITION, (1, "class"), (2, "name")) + f") WHERE name NOT IN ({WORDS}))"
METHODS = "meth AS (SELECT m.file, m.line_no, c.class, method, virt <> '' AS is_virtual, ovr <> '' AS is_override FROM (" + _code(resolver.METHOD, (1, "virt"), (2, "method"), (3, "ovr")) + ") m ASOF JOIN cls c ON m.file = c.file AND m.line_no > c.line_no)"
VARS = "vars AS (SELECT file, variable, last(type ORDER BY line_no) AS type FROM (" + _code(resolver.VARIABLE, (1, "type"), (2, "variable")) + ") GROUP BY file, variable)"
INSIDE = "ins AS (SELECT c.file, c.line_no, c.text, d.qualified AS caller FROM code c ASOF JOIN def d ON c.file = d.file AND c.line_no >= d.line_no WHERE c.line_no <> d.line_no)"


def _named(pattern: str, kind: str, sure: float) -> str:
    return (
        f"SELECT DISTINCT i.file, line_no, caller, d.file AS callee_file, qualified AS callee, '{kind}' AS kind, CAST({sure} AS DOUBLE) AS confidence FROM (SELECT file, line_no, caller, unnest(regexp_extract_all(text, '{pattern}', 1)) AS n FROM ins) i "
        f"JOIN (SELECT DISTINCT file, name, qualified FROM def) d ON n = d.name AND i.file <> d.file WHERE n NOT IN ({WORDS})"
    )


CALLS = (
    f"WITH RECURSIVE {CLASSES}, {DEFS}, {METHODS}, {VARS}, {INSIDE}, mc AS (SELECT i.file, line_no, caller, type AS class, m AS method FROM (SELECT file, line_no, caller, unnest(regexp_extract_all(text, '{resolver.MEMBER_CALL}', 1)) AS v, unnest(regexp_extract_all(text, '{resolver.MEMBER_CALL}', 2)) AS m FROM ins) i JOIN vars ON vars.file = i.file AND variable = v), "
    "km AS (SELECT class, method, bool_or(is_virtual) AS is_virtual FROM meth GROUP BY class, method), "
    "hit AS (SELECT file, line_no, caller, class AS owner, method, is_virtual FROM mc JOIN km USING (class, method) UNION ALL SELECT mc.file, mc.line_no, caller, parent, mc.method, km.is_virtual FROM mc JOIN (SELECT DISTINCT class, parent FROM cls WHERE parent IS NOT NULL) u USING (class) JOIN km ON km.class = parent AND km.method = mc.method WHERE NOT EXISTS (SELECT 1 FROM km k WHERE k.class = mc.class AND k.method = mc.method)), "
    "calls AS (SELECT DISTINCT h.file, h.line_no, caller, coalesce(d.file, '') AS callee_file, owner || '::' || h.method AS callee, CASE WHEN is_virtual THEN 'virtual' ELSE 'direct' END AS kind, CAST(CASE WHEN is_virtual THEN 0.7 ELSE 0.9 END AS DOUBLE) AS confidence FROM hit h LEFT JOIN (SELECT DISTINCT class, name, file FROM def) d ON d.class = owner AND d.name = h.method "
    f"UNION {_named(resolver.FREE_CALL, 'direct', 0.6)} UNION {_named(resolver.ADDRESS, 'address_taken', 0.8)}) "
)
FILES_OF = "file"


@_query(f"WITH RECURSIVE {INCLUDES} SELECT file, line_no, name, target FROM inc")
def resolved_includes(f):
    return resolver.includes(f.code, f.code)


@_query(f"WITH RECURSIVE {CLASSES}, {DEFS}, {METHODS} SELECT 'class' AS kind, file, line_no, coalesce(parent, '') AS owner, class AS name FROM cls UNION ALL SELECT 'method', file, line_no, class, method FROM meth UNION ALL SELECT 'function', file, line_no, class, name FROM def")
def type_table(f):
    return resolver.type_table(f.code)


@_query(f"WITH RECURSIVE {CLASSES}, {DEFS}, {METHODS}, {VARS}, {INCLUDES} SELECT (SELECT count(*) FROM cls) AS classes, (SELECT count(*) FROM meth) AS methods, (SELECT count(*) FROM def) AS functions, (SELECT count(*) FROM vars) AS variables, (SELECT count(*) FROM inc WHERE target IS NOT NULL) AS includes")
def type_summary(f):
    return resolver.summary(f.code, f.code)


@_query(CALLS + "SELECT * FROM calls")
def resolve_calls(f):
    return resolver.resolve_calls(f.code)


@_query(CALLS + "SELECT * FROM calls WHERE callee = 'run1' OR ends_with(callee, '::run1')")
def resolved_callers(f):
    return resolver.callers(resolver.resolve_calls(f.code), "run1")


@_query(CALLS + "SELECT * FROM calls WHERE caller = 'helper10' OR ends_with(caller, '::helper10')")
def resolved_callees(f):
    return resolver.callees(resolver.resolve_calls(f.code), "helper10")


@_query(CALLS + ", e AS (SELECT DISTINCT caller AS src, callee AS dst FROM calls), w(id, depth) AS (SELECT DISTINCT dst, 0 FROM e WHERE dst = 'helper60' OR ends_with(dst, '::helper60') UNION SELECT src, depth + 1 FROM w JOIN e ON dst = id WHERE depth < 10) SELECT id AS caller, min(depth) AS hops FROM w GROUP BY id HAVING min(depth) > 0 ORDER BY 2, 1 LIMIT 50")
def trace_to(f):
    return resolver.trace_to(resolver.resolve_calls(f.code), "helper60")


@_query(f"WITH RECURSIVE {CLASSES}, {DEFS}, w(id) AS (SELECT 'C5' UNION SELECT class FROM w JOIN cls ON parent = id) SELECT class, file, line_no FROM def WHERE name = 'run1' AND class IN (SELECT id FROM w)")
def all_overrides(f):
    return resolver.all_overrides(f.code, "C5", "run1")


@_query(f"WITH RECURSIVE {CLASSES}, {METHODS}, near AS (SELECT 'C25' AS class, 0 AS up UNION SELECT parent, 1 FROM cls WHERE class = 'C25' AND parent IS NOT NULL), found AS (SELECT DISTINCT class, method, is_virtual, up FROM meth JOIN near USING (class) WHERE method IN ('run0', 'run1', 'run2')) SELECT class, method, is_virtual FROM (SELECT *, min(up) OVER (PARTITION BY method) AS least FROM found) WHERE up = least")
def resolve_method(f):
    out = [resolver.resolve_method(f.code, "C25", f"run{i}") for i in range(3)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _body(pattern: str) -> str:
    return (
        f"WITH RECURSIVE b AS (SELECT c.file, first_line, line_no, text, sum(length(text) - length(replace(text, '{{', ''))) OVER w AS o, sum(length(text) - length(replace(text, '{{', '')) - length(text) + length(replace(text, '}}', ''))) OVER w AS d FROM code c JOIN (SELECT file, min(line_no) AS first_line FROM code WHERE regexp_matches(text, '{pattern}') GROUP BY file) s ON c.file = s.file AND line_no >= first_line "
        "WINDOW w AS (PARTITION BY c.file ORDER BY line_no)) SELECT file, first_line, line_no, text FROM b WHERE NOT EXISTS (SELECT 1 FROM b p WHERE p.file = b.file AND p.line_no < b.line_no AND p.o > 0 AND p.d <= 0)"
    )


@_query(_body(r"^(?:[\w:<>&*]+\s+)+?[&*]*(?:[A-Za-z0-9_]+::)?helper10\s*\([^;]*$"))
def read_function(f):
    return resolver.read_function(f.code, "helper10")


@_query(_body(r"^\s*(?:class|struct)\s+C15\b[^;]*$"))
def extract_class(f):
    return resolver.extract_class(f.code, "C15")


@_query(f"WITH RECURSIVE {CLASSES}, {DEFS} SELECT qualified AS id, min(file) AS file_path, CASE WHEN first(class ORDER BY file, line_no) = '' THEN 'function' ELSE 'method' END AS kind FROM def GROUP BY qualified")
def parsed_nodes(f):
    return resolver.parse_graph(f.code)[0].select("id", "file_path", "kind")


RECORDS = "SELECT json_object('id', id, 'name', name, 'kind', kind)::VARCHAR AS json FROM nodes"


@_query(RECORDS)
def export_graph(f):
    return catalog.export(f.nodes.select("id", "name", "kind"), None)


AT = "$.runs[0].results[0]"
IMPORTED = f"SELECT json_extract_string(body, '$.runs[0].tool.driver.name') AS scanner, json_extract_string(body, '{AT}.ruleId') AS rule, json_extract_string(body, '{AT}.level') AS level, json_extract_string(body, '{AT}.message.text') AS message, json_extract_string(body, '{AT}.locations[0].physicalLocation.artifactLocation.uri') AS file, CAST(json_extract_string(body, '{AT}.locations[0].physicalLocation.region.startLine') AS BIGINT) AS line FROM sarif"


@_query(IMPORTED)
def import_sarif(f):
    return files.sarif(f.sarif)


@_query(f"WITH RECURSIVE {DEFS}, r AS ({IMPORTED}), n AS (SELECT file, line_no, qualified, coalesce(lead(line_no) OVER (PARTITION BY file ORDER BY line_no) - 1, (SELECT max(line_no) FROM code c WHERE c.file = def.file)) AS last_line FROM def) SELECT DISTINCT r.file, r.line AS line_no, qualified AS id FROM r JOIN n ON n.file = r.file AND r.line BETWEEN n.line_no AND last_line")
def locate_sarif(f):
    nodes = resolver.definitions(f.code).select(F.col("qualified").alias("id"), F.col("file").alias("file_path"), F.col("line_no").alias("start_line"), F.col("last_line").alias("end_line"))
    return rank.locate(nodes, files.sarif(f.sarif).select("file", F.col("line").alias("line_no")))


@_query("SELECT unnest(['bandit', 'bearer', 'gosec', 'phpstan', 'semgrep', 'trivy']) AS name, unnest([1, 6, 1, 1, 13, 10])::BIGINT AS languages")
def list_scanners(f):
    return files.scanners(f.spark).groupBy("name").agg(F.count("*").alias("languages"))


@_query("SELECT CASE WHEN crashed THEN 'crashed' WHEN timed_out THEN 'timed_out' WHEN errors <> '' AND NOT contains(errors, 'UNEXPECTED') AND NOT contains(errors, '!!!') THEN 'errors' WHEN errors <> '' OR contains(console, '[!!!]') THEN 'interesting' ELSE 'passed' END AS bucket, count(*) AS n FROM outcomes GROUP BY 1")
def fuzz_outcomes(f):
    return rank.outcomes(f.outcomes)


@_query(f"SELECT ext, language FROM (VALUES {EXTS}) x(ext, language)")
def language_of_ext(f):
    return files.languages(f.spark)


C_EXT, C_SKIP = (", ".join(f"'{x}'" for x in xs) for xs in (files.C_EXTENSIONS, files.C_SKIPPED))


@_query(f"SELECT path FROM files WHERE lower(regexp_extract(path, '([.][^./]*)$', 1)) IN ({C_EXT}) AND len(list_filter(string_split(path, '/')[:-2], lambda s: s IN ({C_SKIP}))) = 0")
def c_family_files(f):
    return files.c_family(f.files).select("path")


@_query("SELECT path FROM files WHERE path LIKE '%/f8.cpp' OR path LIKE '%/f8.%' AND split_part(path, '/', -1) = 'f8.cpp' ORDER BY path LIMIT 1")
def resolve_path(f):
    return files.resolve_path(f.files, "any\\where/f8.cpp")


LEVELS = "x AS (SELECT string_split(path, '/') AS p FROM files), c AS (SELECT CASE WHEN len(p) > 1 THEN p[1] ELSE '__root_files__' END AS top, CASE WHEN len(p) > 2 THEN p[1] || '/' || p[2] ELSE p[1] || '/__root_files__' END AS child, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY top) AS of_top FROM c)"


@_query(R + LEVELS + ", q AS (SELECT CASE WHEN of_top > 30 AND top <> '__root_files__' THEN child ELSE top END AS name, CAST(sum(n) AS BIGINT) AS estimated_files FROM t GROUP BY 1) SELECT name, len(list_filter(string_split(lower(name), '/'), lambda s: s IN ('third_party', 'third-party', 'thirdparty', 'external', 'vendor', 'vendored', 'deps'))) > 0 AS is_third_party, estimated_files FROM q")
def split_partitions(f):
    return files.partitions(f.files, most=30, least=100, every=True)


HASHES = "SELECT split_part(path, '/', 1) AS index_id, sha256(string_agg(path || ':' || content, chr(10) ORDER BY path)) AS hash FROM {0} WHERE content IS NOT NULL AND path LIKE '%/%' GROUP BY 1"


@_query("SELECT index_id, CASE WHEN a.hash IS NULL THEN 'new' WHEN b.hash IS NULL THEN 'gone' WHEN a.hash = b.hash THEN 'current' ELSE 'refreshing' END AS status FROM (" + HASHES.format("files") + ") a FULL JOIN (" + HASHES.format("files_b") + ") b USING (index_id)")
def index_freshness(f):
    def hashed(rows):
        rows = rows.where("content IS NOT NULL AND path LIKE '%/%'").select(F.substring_index("path", "/", 1).alias("index_id"), F.struct("path", F.concat_ws(":", "path", "content").alias("line")).alias("x"))
        return rows.groupBy("index_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n"), 256).alias("hash"))

    return files.freshness(hashed(f.files), hashed(f.files_b))


@_query(r"SELECT doc_id, pos AS line_no, part AS text FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1)::INT AS pos, len(parts) AS n FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS parts FROM documents WHERE text IS NOT NULL)) WHERE NOT (pos = n AND part = '')")
def source_lines(f):
    return files.lines(f.table("documents").where("text IS NOT NULL").select("doc_id", "text"), "doc_id")


TERMS = ["license", "the", "copyright"]
TOKENS = "tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents)"
_LIST = ", ".join(f"'{w}'" for w in TERMS)
LEXICAL = (
    f"{TOKENS}, post AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(t) AS term FROM tok) WHERE term IN ({_LIST}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), st AS (SELECT count(*) AS chunks, avg(len(t)) AS mean FROM tok), "
    "lex AS (SELECT doc_id AS key, round(sum(ln(1 + (chunks - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * n * 2.2::DOUBLE / (n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / mean))), 6) AS score FROM post JOIN df USING (term) JOIN tok USING (doc_id), st GROUP BY doc_id)"
)
NEAR = "vec AS (SELECT vec_id AS key, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 2)), 6) AS score FROM embeddings WHERE embedding IS NOT NULL)"


def _lexical(f, top=None):
    return retrieve.bm25(retrieve.Index.build(f.table("documents"), "doc_id"), TERMS, top)


def _near(f, top=None):
    vectors = f.table("embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return retrieve.by_vector(vectors, vectors.where("key = 2"), top)


@_query(R + LEXICAL + " SELECT key, score FROM lex ORDER BY score DESC, key LIMIT 20")
def bm25_search(f):
    return _lexical(f, 20)


@_query(R + NEAR + " SELECT key, score FROM vec ORDER BY score DESC, key LIMIT 20")
def vector_search(f):
    return _near(f, 20)


FUSED = "SELECT key, round(sum(part), 9) AS score FROM (SELECT key, 0.5::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, key)) AS part FROM (SELECT * FROM lex ORDER BY score DESC, key LIMIT 200) UNION ALL SELECT key, 0.5::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, key)) FROM (SELECT * FROM vec ORDER BY score DESC, key LIMIT 200)) GROUP BY key ORDER BY 2 DESC, 1 LIMIT 20"


@_query(R + LEXICAL + ", " + NEAR + " " + FUSED)
def hybrid_search(f):
    return retrieve.fuse(_lexical(f), _near(f), retrieve.weight(" ".join(TERMS), None), 20, depth=200)


@_query(R + TOKENS + " SELECT term, count(DISTINCT doc_id) AS chunks, count(*) AS n FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY term")
def retrieval_index(f):
    index = retrieve.Index.build(f.table("documents"), "doc_id")
    return index.postings.groupBy("term").agg(F.count("*").alias("chunks"), F.sum("n").alias("n"))


CHUNKS = "SELECT doc_id AS key, 'src/' || lang || '/f' || doc_id % 40 || '.cc' AS file, doc_id * 10 AS start_line, doc_id * 10 + 9 AS end_line FROM documents"


@_query(R + f"ch AS ({CHUNKS}), seed AS (SELECT key FROM ch WHERE ends_with(file, '/f5.cc') ORDER BY CASE WHEN 457 BETWEEN start_line AND end_line THEN 0 ELSE 1 END, length(file), start_line, key LIMIT 1), s AS (SELECT CAST(embedding AS DOUBLE[]) AS e, vec_id AS k FROM embeddings WHERE vec_id = (SELECT key FROM seed)) SELECT vec_id AS key, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), e), 6) AS score FROM embeddings, s WHERE vec_id <> k AND embedding IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 5")
def find_related_at(f):
    chunks = f.table("documents").selectExpr("doc_id AS key", "'src/' || lang || '/f' || doc_id % 40 || '.cc' AS file", "doc_id * 10 AS start_line", "doc_id * 10 + 9 AS end_line")
    seed = retrieve.chunk_at(chunks, "f5.cc", 457)
    vectors = f.table("embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return retrieve.by_vector(vectors.join(F.broadcast(seed), "key", "left_anti"), vectors.join(F.broadcast(seed), "key", "left_semi"), 5)  # one row


@_query("SELECT event_id, left(sha256(event_type || ':' || user_id), 12) AS short_id, regexp_replace(lower(event_type || ' #' || user_id), '[^a-z0-9]+', '-', 'g') AS slug, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, round(CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS DOUBLE) / 1000000, 3) AS elapsed, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS code, user_id % 7 >= 3 AS late FROM events")
def scalar_functions(f):
    e = f.table("events")
    codes = F.create_map(F.lit("view"), F.lit(1), F.lit("click"), F.lit(2))
    return e.select(
        "event_id", F.left(F.sha2(F.concat_ws(":", "event_type", "user_id"), 256), F.lit(12)).alias("short_id"),
        F.regexp_replace(F.lower(F.concat("event_type", F.lit(" #"), "user_id")), "[^a-z0-9]+", "-").alias("slug"),
        F.from_json("props", "k bigint")["k"].alias("k"),
        F.round((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1000000, 3).alias("elapsed"),
        F.coalesce(F.try_element_at(codes, "event_type"), F.lit(0)).alias("code"),
        F.array_contains(F.array(*(F.lit(i) for i in (3, 4, 5, 6))), (F.col("user_id") % 7).cast("int")).alias("late"),
    )


RISKY = (
    "b AS (SELECT file, line_no, regexp_extract(text, '{b}', 1) AS name, CAST(regexp_extract(text, '{b}', 2) AS INT) AS bits FROM lines WHERE regexp_matches(text, '{b}')), "
    "k AS (SELECT file, line_no, regexp_matches(text, '(?i){m}') AS peak, regexp_extract(text, '{c}', 1) AS cname, TRY_CAST(trim(regexp_extract(text, '{c}', 2)) AS BIGINT) AS v FROM lines WHERE regexp_matches(text, '{c}')), "
    "a AS (SELECT DISTINCT lower(regexp_extract(text, '{a}', 2)) AS t FROM lines WHERE regexp_matches(text, '{a}') AND contains(regexp_extract(text, '{a}', 2), '<<')), "
    "f AS (SELECT *, lower(name) AS low, replace(replace(lower(name), 'field', ''), 'bits', '') AS stem FROM b WHERE bits >= 10), "
    "hit AS (SELECT name, first(cname ORDER BY peak DESC, file, line_no, cname, v) AS constant_name, first(v ORDER BY peak DESC, file, line_no, cname, v) AS c FROM (SELECT DISTINCT name, low, stem FROM f WHERE length(name) > 3) n JOIN k ON (peak OR v IS NOT NULL) AND (contains(lower(cname), low) OR (length(stem) > 3 AND contains(lower(cname), stem))) GROUP BY name), "
    "p AS (SELECT DISTINCT name FROM (SELECT DISTINCT name, low FROM f WHERE length(name) > 3) n JOIN a ON contains(t, low)) "
).replace("{a}", lines.SHAPES["assertions"].pattern).replace("{b}", lines.SHAPES["bitfields"].pattern).replace("{c}", lines.SHAPES["constants"].pattern).replace("{m}", lines.MAXIMA)


@_query(
    R + RISKY + "SELECT file, line_no, name, bits, capacity, constant_name, constant, margin, margin_pct, protected, CASE WHEN margin <= 0 THEN 'overflow' WHEN margin_pct < 5 THEN 'tight' WHEN NOT protected AND bits >= 14 THEN 'unprotected' ELSE 'safe' END AS risk FROM "
    "(SELECT file, line_no, name, bits, CAST(1 AS BIGINT) << bits AS capacity, constant_name, c AS constant, (CAST(1 AS BIGINT) << bits) - c AS margin, round(CAST(100 AS DOUBLE) * ((CAST(1 AS BIGINT) << bits) - c) / (CAST(1 AS BIGINT) << bits), 1) AS margin_pct, name IN (SELECT name FROM p) AS protected FROM f LEFT JOIN hit USING (name))"
)
def cross_reference_bitfields(f):
    return lines.bitfield_risks(f.lines)


