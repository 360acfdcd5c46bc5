"""Bounds, plans, constants, bodies, retrieval, scanners, catalog and ingest."""

import datetime
import json
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from callscape import audit_queries  # noqa: F401  registers its queries
from callscape.more_queries import MORE
from callscape.operators import consteval, graph, lines, paging, rank, resolver, retrieve, traverse
from callscape.plans import catalog
from callscape.sources import files
from callscape.streaming import ingest

CALLS = [("main", "parse"), ("main", "check"), ("parse", "read"), ("parse", "log"), ("check", "log"), ("read", "log"), ("log", "write"), ("write", "flush"), ("main", "parse")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(CALLS, "src string, dst string")


def _ids(rows):
    return {r.id for r in rows.collect()}


def test_a_level_does_not_move_the_edges(spark, edges):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        walk = traverse.Graph(edges)
        step = walk.step()
        seeds = spark.createDataFrame([(0, "main")], "root int, id string")
        plan = traverse.one_level(seeds, step, seeds)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    at = plan.splitlines()
    scan = next(i for i, x in enumerate(at) if "callscape_" in x and "FileScan" in x)
    assert "Bucketed: true" in at[scan]
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, now = [], depth(at[scan])
    for x in reversed(at[:scan]):
        if depth(x) < now:
            above.append(x)
            now = depth(x)
    join = next(i for i, x in enumerate(above) if "Join" in x)
    assert not any("Exchange" in x for x in above[:join])


def test_hubs_hidden_or_blocked(spark, edges):
    nodes = spark.createDataFrame([(x, x) for x in ("main", "parse", "check", "read", "log", "write", "flush")], "id string, name string")
    hubs = graph.hubs(edges, 2)
    assert _ids(hubs) == {"log"}
    sink, root = (spark.createDataFrame([(x,)], "id string") for x in ("flush", "main"))
    ways = traverse.Graph(edges)
    assert [_ids(traverse.reach(ways, sink, d, backward=True)) for d in (1, 2)] == [{"write"}, {"write", "log"}]
    assert _ids(paging.without_hubs(traverse.reach(ways, root, 20), hubs)) == {"parse", "check", "read", "write", "flush"}
    assert _ids(traverse.reach(ways, root, 20, avoid=hubs)) == {"parse", "check", "read"}
    assert _ids(traverse.levels(ways, root.withColumn("root", F.lit(0)), 20, budget=1)) == {"main", "parse", "check"}
    assert _ids(graph.callers(nodes, edges, "log")) == {"parse", "check", "read"}
    assert _ids(graph.callees(nodes, edges, "main")) == {"parse", "check"}


def test_pages_do_not_overlap(spark):
    rows = spark.createDataFrame([(i,) for i in range(10)], "id int")
    first, second, last = (paging.page(rows, 4, o, "id").collect() for o in (0, 4, 8))
    assert [r.id for r in first + second + last] == list(range(10))
    assert {(r.total, r.truncated, r.hint) for r in first} == {(10, True, "rows 0 to 4 of 10; the next page begins at 4")}
    assert {(r.truncated, r.hint) for r in last} == {(True, "begins at 8, of 10 rows")}
    assert {(r.truncated, r.hint) for r in paging.page(rows, 20, 0, "id").collect()} == {(False, "")}


def test_budgets_of_the_bounds():
    assert paging.clamp(999, 99999, -5, 0) == (20, 5000, 0, 1)


@pytest.mark.parametrize(
    ("text", "expected"),
    [("0xFF", 255), ("1'000UL", 1000), ("(1 << 10) - 1", 1023), ("-7 / 2", -3), ("-7 % 3", -1), ("2.9f * 2", 5), ("010", 8), ("~0", -1), ("1 / 0", None), ("sizeof(x)", None), ("", None), (None, None), ("1 << 300", None), ("((((3))))", 3), ("1 | 2 ^ 3 & 4", 3), ("(" * 5000, None), ("3 4", None), ("1e3", 1000)],
)
def test_constants(text, expected):
    assert consteval.value(text) == expected


LINES = [
    ("constants", "static\tconst int kA = 5;", "kA"), ("constants", "constexpr size_t kB = 1 << 4;", "kB"), ("constants", "int x = 5;", None),
    ("macros", "#define MAX 10", "MAX"), ("macros", "#define LIM_1 (5)", "LIM_1"), ("macros", "#  define F(x) ((x) + 1)", "F"), ("macros", "// define X", None),
    ("assertions", "CHECK_EQ(a,", "CHECK_EQ"), ("assertions", "static_assert(x < (1 << 3));", "static_assert"), ("assertions", "check(x)", None),
    ("bitfields", "class A : BitField<uint32_t, 0, 12> {};", "A"), ("bitfields", "using B = base::BitField<uint32_t, 3, 4>;", "B"), ("bitfields", "using C = Pair<int, 4>;", None),
    ("narrowing_casts", "static_cast<uint8_t> (x.size())", "uint8_t"), ("narrowing_casts", "static_cast<int8_t>(x) + y.size();", None), ("narrowing_casts", "static_cast<int64_t>(x.size())", None),
    ("types", "enum class E { A };", "E"), ("types", "return x;", None),
]


def test_line_shapes(spark):
    for kind in lines.SHAPES:
        own = [(t, n) for k, t, n in LINES if k == kind]
        rows = spark.createDataFrame([("f", i, t) for i, (t, _) in enumerate(own)], "file string, line_no long, text string")
        assert {r.line_no: r.name for r in lines.search(rows, kind).collect()} == {i: n for i, (_, n) in enumerate(own) if n}
    rows = spark.createDataFrame([("f", 1, "static_assert(x < (1 << 3));")], "file string, line_no long, text string")
    assert lines.search(rows, "assertions").first().value == "x < (1 << 3)"
    assert not lines.valid("(") and lines.valid("a+")


def test_bit_fields_meet_constants_by_substring(spark):
    text = ["const auto A = 1;", "static const int kSmallRingLimit = 5000;", "using SmallRing = BitField<uint32_t, 0, 12>;", "using Wide = BitField<uint32_t, 0, 20>;", "static_assert(sizeof(Wide) < (1 << 20));", "using Lonely = BitField<int, 0, 14>;", "using Tiny = BitField<int, 0, 3>;"]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line_no long, text string")
    found = [(r.name, r.constant, r.protected, r.risk) for r in lines.bitfield_risks(rows).collect()]
    assert found == [("SmallRing", 5000, False, "overflow"), ("Lonely", None, False, "unprotected"), ("Wide", None, True, "safe")]


def test_no_bit_field_is_left_out_and_maxima_come_first(spark):
    text = [
        "using Tag = BitField<int, 0, 12>;", "using Whole = BitField<uint64_t, 0, 64>;", "using Sign = BitField<uint64_t, 0, 63>;", "using RingFieldBits = BitField<int, 0, 12>;",
        "using Page = BitField<int, 0, 14>;", "using Page = BitField<int, 0, 14>;", "using Slot = BitField<int, 0, 14>;", "static_assert(sizeof(Tag) < (1 << 12));", "static const char* kPageName = 7;",
        "constexpr int kMaxTag = 9000;", "constexpr int kMaxRing = 5000;", "constexpr int kMaxPage = 16000;", "constexpr int kMaxSlot = other();", "constexpr int kMaxSlot2 = 5;", "constexpr long kMaxSign = 9223372036854775807;",
    ]
    rows = spark.createDataFrame([("f", i // 2 if 4 <= i < 6 else i, t) for i, t in enumerate(text)], "file string, line_no long, text string")
    found = [(r.name, r.bits, r.capacity, r.constant_name, r.constant, r.margin, r.margin_pct, r.protected, r.risk) for r in lines.bitfield_risks(rows).collect()]
    page = ("Page", 14, 16384, "kMaxPage", 16000, 384, 2.3, False, "tight")
    assert found == [
        ("RingFieldBits", 12, 4096, "kMaxRing", 5000, -904, -22.1, False, "overflow"),
        ("Sign", 63, None, "kMaxSign", 2**63 - 1, None, 0.0, False, "tight"), page, page,
        ("Whole", 64, None, None, None, None, None, False, "unprotected"), ("Slot", 14, 16384, "kMaxSlot", None, None, None, False, "unprotected"),
        ("Tag", 12, 4096, None, None, None, None, False, "safe"),
    ]


def _most_joined(df):
    """The most rows that one join of df's last run gave."""

    def walk(plan):
        name = plan.nodeName()
        if "Adaptive" in name:
            yield from walk(plan.executedPlan())
        elif "QueryStage" in name:
            yield from walk(plan.plan())
        else:
            if "Join" in name and plan.metrics().contains("numOutputRows"):
                yield plan.metrics().apply("numOutputRows").value()
            children = plan.children()
            for i in range(children.size()):
                yield from walk(children.apply(i))

    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_bit_fields_with_equal_first_letters_are_not_compared_in_pairs(spark):
    n = 400
    text = [x for i in range(n) for x in (f"static const int kMaxRing{i} = {i * 40};", f"using Ring{i}Field = BitField<uint32_t, 0, {10 + i % 8}>;", f"static_assert(sizeof(Ring{i}Field) < (1 << 9));" if i % 3 == 0 else "")]
    text += ["using RING7field = BitField<uint32_t, 0, 14>;", "using Bits = BitField<uint32_t, 0, 14>;", "using a_Ring1Bits = BitField<uint32_t, 0, 14>;", "constexpr int A_RING1 = 3;", "constexpr int kBitsBits = 9;", "CHECK(xBITSx, 1 << 2, é_a_ring1bits_ring12field);"]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line_no long, text string")
    out = lines.bitfield_risks(rows)
    got = {(r.line_no, r.name, r.constant_name, r.constant, r.protected) for r in out.collect()}
    fields = [(r.line_no, r.name) for r in lines.search(rows, "bitfields").collect()]
    known = sorted((r.line_no, r.name, r.numeric_value) for r in lines.constants(rows).collect())
    asserted = [r.value.lower() for r in lines.search(rows, "assertions").collect() if "<<" in r.value]
    expected = set()
    for line_no, name in fields:
        low, stem = name.lower(), re.sub("(?i)(?:field|bits)$", "", name).lower()
        of = next(((c, v) for _, c, v in known if low in c.lower() or (len(stem) > 3 and stem in c.lower())), (None, None))
        expected.add((line_no, name, *of, any(low in t for t in asserted)))
    assert got == expected and len(got) == n + 3
    # Joins are on equal keys alone, without pairs that a condition then drops, and give few rows.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "Contains(" in x]
    assert _most_joined(out) <= 10 * n


CODE = '#include "b.h"\nint helper(int x) {\n  if (x) {\n    return other(x);\n  }\n  return 0;\n}\nvoid A::go() {\n  B b;\n  b.run();\n  helper(1);\n}\n'
HEAD = "class A {\n  void go();\n};\nclass B : public A {\n  virtual void run();\n};\n"


def _code(spark):
    texts = spark.createDataFrame([("src/a.cc", CODE), ("src/b.h", HEAD), ("src/o.cc", "int other(int y) {\n  return helper(y);\n}")], "file string, text string")
    return files.lines(texts, "file")


def test_bodies_and_calls(spark):
    code = _code(spark)
    assert [r.line_no for r in resolver.read_function(code, "helper").orderBy("line_no").collect()] == list(range(2, 8))
    assert [r.line_no for r in resolver.read_function(code, "A::go").orderBy("line_no").collect()] == list(range(8, 13))
    assert [r.line_no for r in resolver.extract_class(code, "B").orderBy("line_no").collect()] == [4, 5, 6]
    calls = {(r.caller, r.callee, r.kind) for r in resolver.resolve_calls(code).collect()}
    assert calls == {("helper", "other", "direct"), ("other", "helper", "direct"), ("A::go", "B::run", "virtual")}
    assert resolver.includes(code, code).first().target == "src/b.h"
    assert [(r["class"], r.method) for r in resolver.resolve_method(code, "B", "go").collect()] == [("A", "go")]
    assert {r["class"] for r in resolver.all_overrides(code, "A", "go").collect()} == {"A"}
    nodes, found = resolver.parse_graph(code)
    assert _ids(nodes) == {"helper", "A::go", "other"} and found.count() == 3


def test_retrieval(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha alpha"), (3, None), (4, "gamma")], "id long, text string")
    index = retrieve.Index.build(chunks, "id")
    lexical = retrieve.bm25(index, ["alpha", "gamma"])
    assert {r.key for r in lexical.collect()} == {1, 2, 4}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1]), (4, None)], "key long, vector array<double>")
    near = retrieve.by_vector(vectors, vectors.where("key = 1"))
    assert retrieve.fuse(lexical, near, 0.0, 2).first().key == 1 and retrieve.fuse(lexical, near, 1.0, 1).first().key == 4
    assert (retrieve.weight("fooBar", None), retrieve.weight("foo bar", None), retrieve.weight("x", 3)) == (0.8, 0.5, 1.0)


def test_unknown_kinds_and_nodes_are_errors(spark):
    nodes = spark.createDataFrame([("a", "a")], "id string, name string")
    notes = spark.createDataFrame([], "node_id string, kind string, description string, seq long")
    with pytest.raises(ValueError, match="unknown kind"):
        rank.with_annotation(nodes, notes, "nonsense")
    with pytest.raises(LookupError):
        rank.annotate(nodes, notes, "nobody", "taint", "x")
    assert rank.annotate(nodes, notes, "a", "taint", "x").count() == 1


def test_files_are_read_and_sarif_is_parsed(spark, tmp_path):
    for path, text in (("a/x.py", "pass"), ("a/y.txt", "no"), ("node_modules/z.js", "no"), ("b.GO", "package b")):
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text(text)
    assert {(r.path, r.language, r.content) for r in files.read(spark, f"file:{tmp_path}/tree").collect()} == {("a/x.py", "python", "pass"), ("b.GO", "go", "package b")}
    found = {"runs": [{"tool": {"driver": {"name": "t"}}, "results": [{"ruleId": "R", "level": "error", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "f.c"}, "region": {"startLine": 3}}}]}, {"ruleId": "S"}]}]}
    (tmp_path / "s.sarif").write_text(json.dumps(found, indent=1))
    rows = files.read_sarif(spark, f"{tmp_path}/s.sarif").collect()
    assert [(r.scanner, r.rule, r.file, r.line) for r in rows] == [("t", "R", "f.c", 3), ("t", "S", None, None)]
    listed = spark.createDataFrame([(f"d/{i % 3}/f{i}.c",) for i in range(9)] + [("top.c",), ("vendor/x.c",)], "path string")
    parts = {r.name: (r.is_third_party, r.estimated_files) for r in files.partitions(listed, most=5, least=5).collect()}
    assert parts == {"d/0": (False, 3), "d/1": (False, 3), "d/2": (False, 3), "__root_files__": (False, 1), "vendor": (True, 1)}


def test_only_source_files_make_a_plan_split(spark):
    paths = ["a/x.py", "a/b/y.GO", "c/z.rs", "README.md", "a/notes.txt", "node_modules/m.js", "c/.cache/f.py", "c/Tests/t.py", ".hidden"]
    listed = spark.createDataFrame([(p,) for p in paths], "path string")

    def plan(**limits):
        return {r.name: r.estimated_files for r in files.partitions(listed, **limits).collect()}

    assert plan(least=5) == {"root": 9}  # four count: three sources and the README
    assert plan(least=4) == {"a": 3, "c": 3, "node_modules": 1, "__root_files__": 2}
    assert plan(least=4, most=2) == {"a": 3, "c": 3, "node_modules": 1, "__root_files__": 2}  # two sources in a, one in c
    assert plan(least=4, most=1) == {"a/__root_files__": 2, "a/b": 1, "c": 3, "node_modules": 1, "__root_files__": 2}


def test_split_partitions_counts_every_file(spark, tmp_path):
    # 40 files in src, all .txt, and 70 .go files in node_modules: no source file at all
    doc = "CAST({0} AS BIGINT) AS doc_id, 'src' AS source, 'en' AS lang, 't' AS text"
    ids = [i for i in range(5, 3000, 7) if all(i % p for p in (17, 19, 23))][:40], [i for i in range(6, 90_000, 7) if i % 17 == 0 and i % 23][:70]
    spark.createDataFrame([(i,) for i in ids[0] + ids[1]], "i long").selectExpr(*doc.format("i").split(", ")).write.parquet(f"{tmp_path}/documents.parquet")
    parts = {r.name: r.estimated_files for r in MORE["split_partitions"](spark, str(tmp_path)).collect()}
    assert parts == {"src/en": 40, "node_modules/src": 70, "__root_files__": 2}


def test_the_whole_graph_is_exported_whatever_its_size(spark, tmp_path):
    n = 1_000_001
    part = "id AS p_partkey, 'a b' AS p_name, 'B' AS p_brand, 'T' AS p_type, 1 AS p_size"
    spark.range(n).selectExpr(*part.split(", ")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(2).selectExpr("id AS s_suppkey", "'s' AS s_name", "id - 0.5 AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = MORE["export_graph"](spark, str(tmp_path))
    assert rows.distinct().count() == n + 1
    assert rows.where("json LIKE '%\"p:1000000\"%'").first().json == '{"id":"p:1000000","name":"a_b_1000000","kind":"function"}'


def test_catalog_tasks_and_held_tables(spark, tmp_path):
    def wait(poll, key):
        while poll(key)["status"] in ("indexing", "pending", "running"):
            time.sleep(0.01)
        return poll(key)

    rows = catalog.Catalog(str(tmp_path / "c"))
    key = rows.register("/src", "c", lambda: {"functions": 3})
    assert wait(rows.poll, key)["summary"] == {"functions": 3} and rows.register("/src", "c", lambda: 1 / 0) == key
    bad = rows.register("/bad", "c", lambda: 1 / 0)
    assert wait(rows.poll, bad)["status"] == "error" and len(rows.list()) == 2
    (tmp_path / "c" / "x.json").write_text(json.dumps({"index_id": "x", "status": "indexing", "started_at": 0, "finished_at": 1}))
    again = catalog.Catalog(str(tmp_path / "c"))
    assert again.poll("x")["status"] == "error" and again.poll(key)["status"] == "ready" and again.drop(key) and again.poll(key)["error"]
    tasks = catalog.Tasks(spark)
    done = tasks.submit("count", lambda: spark.range(5).count(), key)
    assert wait(tasks.poll, done)["result"] == 5 and wait(tasks.poll, tasks.submit("x", lambda: 1 / 0))["status"] == "error"
    assert wait(tasks.poll, tasks.submit("x", lambda: {"status": "error", "error": "no"}))["status"] == "error" and tasks.poll("none")["error"]
    assert len(tasks.list()) == 3 and len(tasks.list(key)) == 1
    gate, calls = threading.Event(), []

    def slow(n):
        calls.append(n)
        gate.wait(5)
        return n

    got = []
    both = [threading.Thread(target=lambda: got.append(tasks.call("slow", {"n": 1}, slow))) for _ in range(2)]
    [t.start() for t in both]
    while tasks.shared == 0:
        time.sleep(0.01)
    gate.set()
    [t.join() for t in both]
    assert calls == [1] and got == [1, 1]
    assert tasks.call("sleep", {}, lambda: time.sleep(0.5), timeout=0.01)["status"] == "error"
    held = catalog.Held(2)
    for name in ("a", "b", "a", "c", "b"):
        held.get(name, lambda: spark.range(1))
    assert held.stats() == {"held": 2, "budget": 2, "hits": 1, "misses": 4, "evicted": 2, "keys": ["c", "b"]} and held.clear() == 2
    assert catalog.export(spark.range(2)).count() == 2
    with pytest.raises(ValueError, match="at most"):
        catalog.export(spark.range(3), 2)
    built = []
    for _ in range(2):
        assert catalog.cached(spark, f"{tmp_path}/g", "k", lambda: built.append(1) or spark.range(3)).count() == 3
    assert built == [1]


def test_ingest_follows_a_folder(spark, tmp_path):
    at = lambda n: datetime.datetime(2024, 1, n)
    put = lambda rows: spark.createDataFrame(rows, ingest.KIND).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: ingest.follow(spark, f"{tmp_path}/in", f"{tmp_path}/t", f"{tmp_path}/ck").awaitTermination()
    put([("a", "1", at(1)), ("b", "1", at(1))])
    run()
    put([("a", "2", at(2)), ("b", "1", at(3)), ("c", "1", at(2))])
    run()
    assert {(r.path, r.content) for r in ingest.current(spark, f"{tmp_path}/t").collect()} == {("a", "2"), ("b", "1"), ("c", "1")}
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
