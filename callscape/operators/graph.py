"""The graph as tables (nodes, call edges, entrypoints), and what needs no traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Node kinds that are functions.
FUNCTION_KINDS = ("function", "method")


def functions(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind").isin(*FUNCTION_KINDS))


def phantoms(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Call endpoints without a node, named after the text behind the last colon."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").select("id", F.substring_index("id", ":", -1).alias("name"))


def resolve(nodes: DataFrame, name: str) -> DataFrame:
    """Ids of nodes of the name, or whose id is it or ends with :name."""
    return nodes.where((F.col("name") == name) | (F.col("id") == name) | F.col("id").endswith(":" + name)).select("id")


def callers(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Distinct direct callers (id) of all nodes of a name, phantoms too, without those nodes."""
    return _neighbours(nodes, edges, name, "dst", "src")


def callees(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Distinct direct callees (id) of all nodes of a name, without those nodes."""
    return _neighbours(nodes, edges, name, "src", "dst")


def _neighbours(nodes: DataFrame, edges: DataFrame, name: str, near: str, far: str) -> DataFrame:
    # An end without a node is named after its id, so its id alone tells: no search for phantoms, and no shuffle of the edges.
    ids = resolve(nodes, name).unionByName(edges.where((F.col(near) == name) | F.col(near).endswith(":" + name)).select(F.col(near).alias("id"))).distinct()
    return edges.join(ids, F.col(near) == F.col("id"), "left_semi").select(F.col(far).alias("id")).distinct().join(ids, "id", "left_anti")


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Call sites that lead to each node, 0 included; repeated sites count."""
    n = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("in_degree"))


def hubs(edges: DataFrame, threshold: int) -> DataFrame:
    """Nodes with more than `threshold` call sites leading to them."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree")).where(F.col("in_degree") > threshold)


def dead_code(nodes: DataFrame, edges: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """Functions that nothing calls and that are no entrypoints."""
    called, entry = edges.select(F.col("dst").alias("id")), entrypoints.select(F.col("node_id").alias("id"))
    return functions(nodes).join(called, "id", "left_anti").join(entry, "id", "left_anti")


def hotspots(nodes: DataFrame, threshold: int = 10) -> DataFrame:
    return functions(nodes).where(F.col("complexity") >= threshold)


def attack_surface(nodes: DataFrame, entrypoints: DataFrame) -> DataFrame:
    return entrypoints.join(nodes, F.col("node_id") == F.col("id")).select("node_id", "name", "kind", "trust_level")


def search_functions(nodes: DataFrame, pattern: str) -> DataFrame:
    """Functions whose name or qualified name matches, whatever the case."""
    p = "(?i)" + pattern
    return functions(nodes).where(F.col("name").rlike(p) | F.col("qualified_name").rlike(p))


def merge(*parts: DataFrame) -> DataFrame:
    """The union of node tables, one row an id: that of the first table that has it."""
    rows = None
    for i, part in enumerate(parts):
        part = part.select("id", F.struct(F.lit(i).alias("nth"), *part.columns).alias("row"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("id").agg(F.min("row").alias("row")).select(*(f"row.{c}" for c in parts[0].columns))


def records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes, phantoms too, with defaults where something is missing: complexity 0, lines 0, no file."""
    missing = phantoms(nodes, edges).select("id", "name", F.col("name").alias("qualified_name"), F.lit("function").alias("kind"), F.lit("").alias("file_path"), F.lit(True).alias("is_phantom"))
    rows = nodes.withColumn("is_phantom", F.lit(False)).unionByName(missing, allowMissingColumns=True)
    return rows.select(
        "id", "name", F.coalesce("qualified_name", "name").alias("qualified_name"), F.coalesce("kind", F.lit("function")).alias("kind"), F.coalesce("file_path", F.lit("")).alias("file_path"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("start_line", "end_line", "complexity")), "is_phantom",
    )


# Names that are entrypoints, by what they trust.
ENTRYPOINT_RULES = {"main": r"^(?:main|wmain|WinMain)$", "handler": r"(?i)^(?:handle|on)_", "fuzzer": r"^LLVMFuzzerTestOneInput$"}


def detect_entrypoints(nodes: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(node_id, name, trust_level) of functions whose name matches a rule; the first rule that does holds."""
    level = F.coalesce(*(F.when(F.col("name").rlike(pattern), F.lit(kind)) for kind, pattern in (ENTRYPOINT_RULES if rules is None else rules).items()))
    return functions(nodes).select(F.col("id").alias("node_id"), "name", level.alias("trust_level")).where("trust_level IS NOT NULL")


def share(part, whole):
    """A percentage of one decimal, over 1 at least."""
    return F.round(F.lit(100.0) * part / F.greatest(whole, F.lit(1)), 1)
