from callscape.operators import graph


def tables(spark):
    nodes = spark.createDataFrame([("f:a", "a", "a", "function", 12), ("f:b", "b", "b", "method", None), ("f:c", "c", "c", "class", 3)], "id string, name string, qualified_name string, kind string, complexity long")
    edges = spark.createDataFrame([("f:a", "f:b"), ("f:a", "f:b"), ("f:b", "f:b"), ("f:z", "f:b")], "src string, dst string")
    return nodes, edges


def test_degrees_count_repeated_sites(spark):
    nodes, edges = tables(spark)
    assert {r.id: r.in_degree for r in graph.in_degree(nodes, edges).collect()} == {"f:a": 0, "f:b": 4, "f:c": 0}
    assert [r.id for r in graph.hubs(edges, 3).collect()] == ["f:b"]
    assert graph.hubs(edges, 4).count() == 0


def test_callers_leave_out_the_node_itself(spark):
    nodes, edges = tables(spark)
    assert sorted(r.id for r in graph.callers(nodes, edges, "b").collect()) == ["f:a", "f:z"]
    assert [r.name for r in graph.phantoms(nodes, edges).collect()] == ["z"]


def test_dead_code(spark):
    nodes, edges = tables(spark)
    none = spark.createDataFrame([], "node_id string, trust_level string")
    assert [r.id for r in graph.dead_code(nodes, edges, none).collect()] == ["f:a"]
    assert graph.dead_code(nodes, edges, spark.createDataFrame([("f:a", "x")], none.schema)).count() == 0
