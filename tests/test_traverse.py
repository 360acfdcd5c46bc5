import pytest

from callscape.operators import lines, paging, rank, retrieve, traverse
from callscape.sources import files


@pytest.fixture(scope="module")
def edges(spark):
    pairs = ["ab", "ab", "bc", "ca", "bd", "de", "xx"]
    return spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_reach_in_a_cycle(spark, edges):
    assert {r.id: r.depth for r in traverse.reach(edges, ids(spark, "a"), 20).collect()} == {"b": 1, "c": 2, "d": 2, "e": 3}
    assert {r.id for r in traverse.reach(edges, ids(spark, "e"), 2, backward=True).collect()} == {"d", "b"}
    assert traverse.reach(edges, ids(spark, "nowhere"), 5).count() == 0
    assert {r.id for r in traverse.reach(edges, ids(spark, "a"), 20, avoid=ids(spark, "d")).collect()} == {"b", "c"}


def test_radius_and_unreachable(spark, edges):
    assert {r.id: r.blast_radius for r in traverse.radius(edges, ids(spark, "a", "x", "d")).collect()} == {"a": 4, "x": 0, "d": 1}
    nodes = ids(spark, "a", "b", "x")
    none = spark.createDataFrame([], "node_id string")
    assert traverse.unreachable(nodes, edges, none).count() == 3
    assert [r.id for r in traverse.unreachable(nodes, edges, spark.createDataFrame([("a",)], "node_id string")).collect()] == ["x"]


def test_paths_are_simple(spark, edges):
    found = traverse.shortest_first(traverse.paths(edges, ids(spark, "a", "c"), ids(spark, "e"), 10), 10).collect()
    assert [(r.path, r.hops) for r in found] == [("a>b>d>e", 3), ("c>a>b>d>e", 4)]
    assert traverse.paths(edges, ids(spark, "a"), ids(spark, "e"), 2).count() == 0


def test_clamp():
    assert paging.clamp(999, 99999, -5, 0) == (20, 5000, 0, 1)


def test_diff_with_nulls(spark):
    a = spark.createDataFrame([("k", None), ("l", 1), ("m", 1)], "id string, v int")
    b = spark.createDataFrame([("k", None), ("l", 2), ("n", 1)], "id string, v int")
    assert {r.id: r.change for r in rank.diff(a, b, "id", "v").collect()} == {"l": "changed", "m": "removed", "n": "added"}


def test_shapes(spark):
    rows = spark.createDataFrame([("f", 1, "static const int kMax = 12;"), ("f", 2, "#define A(x) x"), ("f", 3, None)], "file string, line_no long, text string")
    assert [(r.name, r.value) for r in lines.search(rows, "constants", "KMAX").collect()] == [("kMax", "12")]
    assert [(r.name, r.value) for r in lines.search(rows, "macros").collect()] == [("A", "x")]


def test_discovery(spark):
    rows = spark.createDataFrame([("a/b.py", ""), (".git/c.py", ""), ("a/out/d.PY", ""), ("e.JSX", ""), ("f.txt", "")], "path string, content string")
    assert {r.path: r.language for r in files.discover(rows).collect()} == {"a/b.py": "python", "e.JSX": "javascript"}


def test_bm25_prefers_rare_and_dense(spark):
    rows = spark.createDataFrame([(1, "cat cat"), (2, "cat dog dog dog"), (3, None), (4, "dog")], "id long, text string")
    assert [r.id for r in retrieve.bm25(retrieve.Index.build(rows, "id"), ["cat"], 5).withColumnRenamed("key", "id").collect()] == [1, 2]
