"""Graph queries over the fixture views, each with its DuckDB SQL."""

from __future__ import annotations

from callscape import audit_queries  # registers its queries
from callscape.fixtures import Fixtures, oracle
from callscape.more_queries import MORE, MORE_ORACLES
from callscape.operators import graph

HUBS, THRESHOLD, NAME, PATTERN = 100, 10, "s:3", "widget_1"


def dead_code(spark, d):
    f = Fixtures(spark, d)
    return graph.dead_code(f.nodes, f.edges, f.entrypoints).select("id", "name", "complexity")


def in_degree(spark, d):
    f = Fixtures(spark, d)
    return graph.in_degree(f.nodes, f.edges)


def hub_set(spark, d):
    return graph.hubs(Fixtures(spark, d).edges, HUBS)


def phantom_nodes(spark, d):
    f = Fixtures(spark, d)
    return graph.phantoms(f.nodes, f.edges).select("id", "name")


def callers_of(spark, d):
    f = Fixtures(spark, d)
    return graph.callers(f.nodes, f.edges, NAME).select("id")


def function_nodes(spark, d):
    return graph.functions(Fixtures(spark, d).nodes).select("id", "kind")


def complexity_hotspots(spark, d):
    return graph.hotspots(Fixtures(spark, d).nodes, THRESHOLD).select("id", "complexity")


def attack_surface(spark, d):
    f = Fixtures(spark, d)
    return graph.attack_surface(f.nodes, f.entrypoints)


def search_functions(spark, d):
    return graph.search_functions(Fixtures(spark, d).nodes, PATTERN).select("id", "name")


QUERIES = {q.__name__: q for q in (dead_code, in_degree, hub_set, phantom_nodes, callers_of, function_nodes, complexity_hotspots, attack_surface, search_functions)} | MORE

WITH = "WITH " + ", ".join(f"{v} AS ({oracle(v)})" for v in ("edges", "nodes", "entrypoints")) + " "
FUNCTIONS = "kind IN ('function', 'method')"
ORACLES = {
    k: WITH + v
    for k, v in {
        "dead_code": f"SELECT id, name, complexity FROM nodes WHERE {FUNCTIONS} AND id NOT IN (SELECT dst FROM edges) AND id NOT IN (SELECT node_id FROM entrypoints)",
        "in_degree": "SELECT id, count(dst) AS in_degree FROM nodes LEFT JOIN edges ON dst = id GROUP BY id",
        "hub_set": f"SELECT dst AS id, count(*) AS in_degree FROM edges GROUP BY dst HAVING count(*) > {HUBS}",
        "phantom_nodes": "SELECT DISTINCT id, split_part(id, ':', -1) AS name FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) WHERE id NOT IN (SELECT id FROM nodes)",
        "callers_of": f"SELECT DISTINCT src AS id FROM edges WHERE dst = '{NAME}' AND src <> '{NAME}'",
        "function_nodes": f"SELECT id, kind FROM nodes WHERE {FUNCTIONS}",
        "complexity_hotspots": f"SELECT id, complexity FROM nodes WHERE {FUNCTIONS} AND complexity >= {THRESHOLD}",
        "attack_surface": "SELECT node_id, name, kind, trust_level FROM entrypoints JOIN nodes ON node_id = id",
        "search_functions": f"SELECT id, name FROM nodes WHERE {FUNCTIONS} AND (regexp_matches(name, '(?i){PATTERN}') OR regexp_matches(qualified_name, '(?i){PATTERN}'))",
    }.items()
} | MORE_ORACLES
