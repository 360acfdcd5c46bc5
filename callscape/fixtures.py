"""Views over the test tables that both Spark and the SQL oracle build alike."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from callscape.operators.saved import Saved
from callscape.operators.traverse import Graph

EDGES = """
SELECT 'p:' || a.l_partkey AS src, 'p:' || b.l_partkey AS dst
FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE (a.l_partkey < b.l_partkey AND a.l_returnflag = 'R' AND b.l_quantity <= 25)
   OR (a.l_partkey > b.l_partkey AND a.l_returnflag = 'A' AND b.l_quantity <= 3)
UNION ALL
SELECT 'p:' || l_partkey, 's:' || l_suppkey FROM {lineitem} WHERE l_linenumber <= 1 + l_suppkey % 7 AND l_linestatus = 'F'
"""
NODES = """
SELECT 'p:' || p_partkey AS id, replace(p_name, ' ', '_') || '_' || p_partkey AS name, p_brand || '::' || p_name AS qualified_name,
 CASE WHEN p_partkey % 10 = 3 THEN 'method' WHEN p_partkey % 10 = 7 THEN 'class' ELSE 'function' END AS kind,
 p_brand || '/' || p_type AS file_path, CAST(p_partkey * 10 AS BIGINT) AS start_line, CAST(p_partkey * 10 + p_size AS BIGINT) AS end_line,
 CAST(CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size END AS BIGINT) AS complexity FROM {part}
UNION ALL SELECT 's:' || s_suppkey, s_name, s_name, 'function', 'lib', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM {supplier} WHERE s_acctbal >= 0
"""
ENTRYPOINTS = "SELECT 'p:' || p_partkey AS node_id, p_type AS trust_level FROM {part} WHERE p_size >= 48 AND p_type IN ('ECONOMY', 'PROMO')"
FINDINGS = """
SELECT 'p:' || (event_id % (SELECT count(*) FROM {part})) AS node_id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS scanner, value AS risk_score, event_id AS seq
FROM {events} WHERE event_type = 'error'
"""
INHERITS = """
SELECT 'n:' || n_nationkey AS child, 'r:' || n_regionkey AS parent FROM {nation}
UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM {customer}
UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM {supplier}
"""
LINES = """
SELECT p_brand || '/' || p_type AS file, CAST(p_partkey * 10 AS BIGINT) AS line_no, 'static const int kMax' || replace(p_name, ' ', '') || p_partkey || ' = ' || (p_size * 1024) || ';' AS text FROM {part}
UNION ALL SELECT p_brand || '/' || p_type, CAST(p_partkey * 10 + 1 AS BIGINT), 'using ' || replace(p_name, ' ', '') || p_partkey || 'Field = BitField<uint32_t, 0, ' || (1 + p_size % 24) || '>;' FROM {part}
UNION ALL SELECT p_brand || '/' || p_type, CAST(p_partkey * 10 + 2 AS BIGINT), '#define LIM_' || p_partkey || ' (' || p_size || ')' FROM {part}
UNION ALL SELECT p_brand || '/' || p_type, CAST(p_partkey * 10 + 3 AS BIGINT), 'static_assert(' || replace(p_name, ' ', '') || p_partkey || 'Field < (1 << ' || (1 + p_size % 24) || '));' FROM {part} WHERE p_partkey % 3 = 0
UNION ALL SELECT p_brand || '/' || p_type, CAST(p_partkey * 10 + 4 AS BIGINT), 'x = static_cast<uint8_t>(buf.size() + ' || p_size || ');' FROM {part}
UNION ALL SELECT p_brand || '/' || p_type, CAST(p_partkey * 10 + 5 AS BIGINT), 'struct T' || p_partkey || ' {};' FROM {part}
"""
ANNOTATIONS = """
SELECT 'p:' || p_partkey AS node_id, 'taint' AS kind, 'reachable from input' AS description, CAST(p_partkey AS BIGINT) AS seq FROM {part} WHERE p_partkey % 9 = 0
UNION ALL SELECT node_id, 'finding', 'reported', min(seq) FROM {findings} GROUP BY node_id
UNION ALL SELECT id, 'blast_radius', coalesce(o.n, 0) || ' downstream, ' || coalesce(i.n, 0) || ' upstream', CAST(0 AS BIGINT) FROM {nodes} LEFT JOIN (SELECT src, count(*) AS n FROM {edges} GROUP BY src) o ON src = id LEFT JOIN (SELECT dst, count(*) AS n FROM {edges} GROUP BY dst) i ON dst = id WHERE id LIKE 'p:%'
"""
INCLUDES = """
SELECT DISTINCT a.file_path AS file, b.file_path AS includes FROM {edges} e JOIN {nodes} a ON e.src = a.id JOIN {nodes} b ON e.dst = b.id WHERE e.dst LIKE 'p:%' AND a.file_path <> b.file_path
"""
RAISES = "SELECT DISTINCT 'p:' || l_partkey AS node_id, o_orderpriority AS exception FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
NODES_A = "SELECT * FROM {nodes} WHERE NOT (id LIKE 'p:%' AND id LIKE '%0')"
NODES_B = "SELECT id, name, qualified_name, kind, file_path, start_line, end_line, CASE WHEN id LIKE 'p:%7' THEN complexity + 1 ELSE complexity END AS complexity FROM {nodes} WHERE NOT (id LIKE 'p:%' AND id LIKE '%1')"
FILES = """
SELECT CASE WHEN doc_id % 17 = 0 THEN 'node_modules/' WHEN doc_id % 19 = 0 THEN 'third_party/' ELSE '' END || source || '/' || lang || '/' || CASE WHEN doc_id % 23 = 0 THEN '.cache/' ELSE '' END || 'f' || doc_id ||
 CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.cpp' WHEN 2 THEN '.h' WHEN 3 THEN '.jsx' WHEN 4 THEN '.RS' WHEN 5 THEN '.txt' ELSE '.go' END AS path, text AS content FROM {documents}
UNION ALL SELECT 'README.md', 'readme' UNION ALL SELECT 'setup.py', 'setup'
"""
CODE = """
SELECT 'inc/c' || p_partkey || '.h' AS file, CAST(n AS BIGINT) AS line_no, CASE n
 WHEN 1 THEN '#include "c' || (p_partkey - p_partkey % 10) || '.h"' WHEN 2 THEN 'class C' || p_partkey || CASE WHEN p_partkey > 15 THEN ' : public C' || (CAST(floor(p_partkey / 3) AS BIGINT) - CAST(floor(p_partkey / 3) AS BIGINT) % 5) ELSE '' END || ' {{'
 WHEN 3 THEN '  virtual void run' || p_size % 3 || '();' WHEN 4 THEN '  void stop' || p_size % 2 || '(int x) const override;' ELSE '}};' END AS text FROM {part}, (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) WHERE p_partkey % 5 = 0
UNION ALL SELECT 'src/c' || p_partkey || '.cc', CAST(n AS BIGINT), CASE n
 WHEN 1 THEN '#include "inc/c' || p_partkey || '.h"' WHEN 2 THEN 'void C' || p_partkey || '::run' || p_size % 3 || '() {{' WHEN 3 THEN '  C' || (p_partkey - p_partkey % 10) || ' obj;'
 WHEN 4 THEN '  if (x) {{ obj.run' || p_size % 3 || '(); obj.stop1(2); }}' WHEN 5 THEN '  helper' || (p_partkey + 5) || '(1);' WHEN 6 THEN '}}' WHEN 7 THEN 'static int helper' || p_partkey || '(int x) {{'
 WHEN 8 THEN '  register_cb(&helper' || (p_partkey + 10) || ');' WHEN 9 THEN '  while (x) {{ x--; }}' ELSE '}}' END FROM {part}, (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10) WHERE p_partkey % 5 = 0
"""
TYPED_EDGES = "SELECT src, dst, 'calls' AS kind FROM {edges} UNION ALL SELECT child, parent, 'inherits' FROM {inherits} UNION ALL SELECT file, includes, 'includes' FROM {includes}"
SARIF = """
SELECT event_id AS run_id, '{{"runs":[{{"tool":{{"driver":{{"name":"' || CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END || '"}}}},"results":[{{"ruleId":"R' || event_id % 7 || '","level":"error","message":{{"text":"found"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"src/c' || (event_id % 40) * 5 || '.cc"}},"region":{{"startLine":' || (1 + event_id % 9) || '}}}}}}]}}]}}]}}' AS body
FROM {events} WHERE event_type = 'error'
"""
OUTCOMES = """
SELECT event_id AS case_id, event_type = 'error' AND value > 80 AS crashed, event_type = 'click' AND value > 90 AS timed_out,
 CASE WHEN event_type = 'signup' AND value > 90 THEN 'UNEXPECTED token' WHEN event_type = 'signup' AND value > 60 THEN 'SyntaxError' ELSE '' END AS errors, CASE WHEN event_type = 'view' AND value > 95 THEN 'x [!!!] y' ELSE 'ok' END AS console FROM {events}
"""
FILES_B = "SELECT path, CASE WHEN path LIKE '%5.cpp' THEN content || ' changed' ELSE content END AS content FROM {files} WHERE path NOT LIKE '%3.h'"

VIEWS = {
    "edges": EDGES, "nodes": NODES, "entrypoints": ENTRYPOINTS, "findings": FINDINGS, "inherits": INHERITS, "lines": LINES,
    "annotations": ANNOTATIONS, "includes": INCLUDES, "raises": RAISES, "nodes_a": NODES_A, "nodes_b": NODES_B, "files": FILES, "files_b": FILES_B,
    "code": CODE, "typed_edges": TYPED_EDGES, "sarif": SARIF, "outcomes": OUTCOMES,
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_graphs: dict[tuple[str, str], Graph] = {}


@dataclass
class Fixtures:
    """Lazy DataFrames of the tables and views of a data folder."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        needed = {n: self.table(n) for n in TABLES if f"{{{n}}}" in sql} | {n: getattr(self, n) for n in VIEWS if f"{{{n}}}" in sql}
        return self.spark.sql(sql.replace(" {}", " {{}}"), **needed)

    @property
    def graph(self) -> Graph:
        """The call edges, built once for a session and a data folder and then held as bucketed tables."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _graphs:
            edges = self.view("edges")
            _graphs[key] = Graph(Saved(self.spark).save(edges))
        return _graphs[key]

    edges = cached_property(lambda self: self.graph.edges)
    code = cached_property(lambda self: self.view("code"))
    typed_edges = cached_property(lambda self: self.view("typed_edges"))
    sarif = cached_property(lambda self: self.view("sarif"))
    outcomes = cached_property(lambda self: self.view("outcomes"))
    nodes = cached_property(lambda self: self.view("nodes"))
    entrypoints = cached_property(lambda self: self.view("entrypoints"))
    findings = cached_property(lambda self: self.view("findings"))
    inherits = cached_property(lambda self: self.view("inherits"))
    lines = cached_property(lambda self: self.view("lines"))
    annotations = cached_property(lambda self: self.view("annotations"))
    includes = cached_property(lambda self: self.view("includes"))
    raises = cached_property(lambda self: self.view("raises"))
    nodes_a = cached_property(lambda self: self.view("nodes_a"))
    nodes_b = cached_property(lambda self: self.view("nodes_b"))
    files = cached_property(lambda self: self.view("files"))
    files_b = cached_property(lambda self: self.view("files_b"))


def oracle(name: str) -> str:
    """A view's SQL over plain names."""
    sql = VIEWS[name]
    for n in (*TABLES, *VIEWS):
        sql = sql.replace(f"{{{n}}}", n)
    return sql.replace("{{", "{").replace("}}", "}")
