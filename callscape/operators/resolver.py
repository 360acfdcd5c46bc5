"""Types and calls of C++ text by patterns: includes, classes, methods, functions, variables and what calls what.

Input is lines (file, line_no, text). A call belongs to the function whose definition it follows in its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscape.operators import traverse

# Words that look like calls but aren't.
KEYWORDS = ("if", "for", "while", "switch", "return", "sizeof", "catch", "new", "delete", "throw", "static_cast", "dynamic_cast", "reinterpret_cast", "const_cast", "defined", "decltype", "alignof", "assert")
INCLUDE = r'^\s*#\s*include\s*"([^"]+)"'
CLASS = r"^\s*(?:class|struct)\s+(\w+)(?:\s+final)?\s*(?::\s*(?:(?:public|protected|private|virtual)\s+)*(?:\w+::)*(\w+)[^{;]*)?\{?\s*$"
METHOD = r"^\s+(?:(virtual)\s+)?[\w:<>&*]+(?:\s+[\w:<>&*]+)*?\s+[&*]*(\w+)\s*\([^;{}]*\)\s*(?:const\s*)?(override)?[^;{}]*;"
DEFINITION = r"^(?:[\w:<>&*]+\s+)+?[&*]*(?:(\w+)::)?(~?\w+)\s*\([^;]*\)[^;]*\{\s*$"
VARIABLE = r"^\s+(?:const\s+)?(?:\w+::)*([A-Z]\w*)\s*[&*]?\s+(\w+)\s*(?:;|=|\{)"
MEMBER_CALL = r"(\w+)(?:\.|->)(\w+)\s*\("
FREE_CALL = r"(?:^|[^\w.>:&~])(\w+)\s*\("
ADDRESS = r"&(\w+)"
#: How sure a resolved call is.
DIRECT, VIRTUAL, ADDRESSED, FREE = 0.9, 0.7, 0.8, 0.6


def _found(lines: DataFrame, pattern: str, **groups: int) -> DataFrame:
    text = F.col("text")
    return lines.where(text.rlike(pattern)).select("file", "line_no", *(F.regexp_extract(text, pattern, g).alias(n) for n, g in groups.items()))


def includes(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file, line_no, name, target): quoted includes, looked for beside the including file, then from the root; null if in neither place."""
    rows = _found(lines, INCLUDE, name=1)
    folder = F.when(F.col("file").contains("/"), F.regexp_replace("file", "[^/]*$", "")).otherwise("")
    near = files.select(F.col("file").alias("near")).distinct()
    far = files.select(F.col("file").alias("far")).distinct()
    rows = rows.withColumn("beside", F.concat(folder, "name")).join(near, F.col("beside") == F.col("near"), "left").join(far, F.col("name") == F.col("far"), "left")
    return rows.select("file", "line_no", "name", F.coalesce("near", "far").alias("target"))


def classes(lines: DataFrame) -> DataFrame:
    """(file, line_no, class, parent): parent is null without one."""
    return _found(lines, CLASS, **{"class": 1, "parent": 2}).withColumn("parent", F.nullif("parent", F.lit("")))


def methods(lines: DataFrame) -> DataFrame:
    """(file, line_no, class, method, is_virtual, is_override): declarations behind a class head."""
    head, text = F.regexp_extract("text", CLASS, 1), F.col("text")
    marked = lines.withColumn("class", F.last(F.when(text.rlike(CLASS), head), True).over(W.partitionBy("file").orderBy("line_no")))
    marked = marked.where(F.col("class").isNotNull() & text.rlike(METHOD))
    flags = ((F.regexp_extract(text, METHOD, g) != "").alias(n) for n, g in (("is_virtual", 1), ("is_override", 3)))
    return marked.select("file", "line_no", "class", F.regexp_extract(text, METHOD, 2).alias("method"), *flags)


def definitions(lines: DataFrame) -> DataFrame:
    """(file, line_no, class, name, qualified, last_line): function bodies; class is empty for free functions."""
    rows = _found(lines, DEFINITION, **{"class": 1, "name": 2}).where(~F.col("name").isin(*KEYWORDS))
    ends = lines.groupBy("file").agg(F.max("line_no").alias("end"))
    following = F.lead("line_no").over(W.partitionBy("file").orderBy("line_no"))
    rows = rows.withColumn("following", following).join(ends, "file")
    qualified = F.when(F.col("class") == "", F.col("name")).otherwise(F.concat_ws("::", "class", "name"))
    return rows.select("file", "line_no", "class", "name", qualified.alias("qualified"), F.coalesce(F.col("following") - 1, F.col("end")).alias("last_line"))


def variables(lines: DataFrame) -> DataFrame:
    """(file, variable, type): the last declaration of a name in a file, of types with a capital."""
    rows = _found(lines, VARIABLE, type=1, variable=2)
    return rows.groupBy("file", "variable").agg(F.max_by("type", "line_no").alias("type"))


def type_table(lines: DataFrame) -> DataFrame:
    """(kind, file, line_no, owner, name): classes, methods and functions in one table."""
    c = classes(lines).select(F.lit("class").alias("kind"), "file", "line_no", F.coalesce("parent", F.lit("")).alias("owner"), F.col("class").alias("name"))
    m = methods(lines).select(F.lit("method").alias("kind"), "file", "line_no", F.col("class").alias("owner"), F.col("method").alias("name"))
    d = definitions(lines).select(F.lit("function").alias("kind"), "file", "line_no", F.col("class").alias("owner"), "name")
    return c.unionByName(m).unionByName(d)


def summary(lines: DataFrame, files: DataFrame) -> DataFrame:
    """One row of counts."""
    kinds = type_table(lines).select("kind").unionByName(variables(lines).select(F.lit("variable").alias("kind")))
    kinds = kinds.unionByName(includes(lines, files).where("target IS NOT NULL").select(F.lit("include").alias("kind")))
    names = ("class", "method", "function", "variable", "include")
    return kinds.agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in zip(names, ("classes", "methods", "functions", "variables", "includes"))))


def resolve_method(lines: DataFrame, cls: str, method: str) -> DataFrame:
    """(class, method, is_virtual) in the class itself, else in its direct parents."""
    own = classes(lines).where(F.col("class") == cls)
    near = own.select("class", F.lit(0).alias("up")).unionByName(own.where("parent IS NOT NULL").select(F.col("parent").alias("class"), F.lit(1).alias("up"))).distinct()
    found = methods(lines).where(F.col("method") == method).select("class", "method", "is_virtual").distinct().join(near, "class")
    least = found.agg(F.min("up").alias("least"))
    return found.join(F.broadcast(least), F.col("up") == F.col("least")).select("class", "method", "is_virtual")  # one row


def all_overrides(lines: DataFrame, cls: str, method: str) -> DataFrame:
    """(class, file, line_no) of the method's definitions in the class and all that descend from it."""
    tree = classes(lines).where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("class").alias("dst"))
    root = lines.sparkSession.createDataFrame([(cls,)], "id string")
    family = traverse.reach(tree, root, 1000).select("id").unionByName(root).distinct()
    return definitions(lines).where(F.col("name") == method).join(family, F.col("class") == F.col("id"), "left_semi").select("class", "file", "line_no")


def _within(lines: DataFrame) -> DataFrame:
    """lines with the function around them: caller; lines outside of functions go."""
    text = F.col("text")
    is_def = text.rlike(DEFINITION) & ~F.regexp_extract(text, DEFINITION, 2).isin(*KEYWORDS)
    cls, name = F.regexp_extract(text, DEFINITION, 1), F.regexp_extract(text, DEFINITION, 2)
    qualified = F.when(is_def, F.when(cls == "", name).otherwise(F.concat_ws("::", cls, name)))
    marked = lines.withColumn("caller", F.last(qualified, True).over(W.partitionBy("file").orderBy("line_no"))).withColumn("is_def", is_def)
    return marked.where("caller IS NOT NULL AND NOT is_def")


def resolve_calls(lines: DataFrame) -> DataFrame:
    """(file, line_no, caller, callee_file, callee, kind, confidence).

    Calls on a variable go by its type to the method of that class, or of its direct parent where it has none;
    other calls and addresses go to functions of that name in other files.
    """
    inside, defined = _within(lines), definitions(lines)
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(MEMBER_CALL), F.lit(1)).alias("v"), F.regexp_extract_all("text", F.lit(MEMBER_CALL), F.lit(2)).alias("m"))
    called = inside.where(F.col("text").rlike(MEMBER_CALL)).withColumn("c", F.explode(pairs)).select("file", "line_no", "caller", F.col("c.v").alias("variable"), F.col("c.m").alias("method"))
    typed = called.join(variables(lines), ["file", "variable"]).select("file", "line_no", "caller", F.col("type").alias("class"), "method")
    known = methods(lines).groupBy("class", "method").agg(F.bool_or("is_virtual").alias("is_virtual"))
    up = classes(lines).where("parent IS NOT NULL").select("class", "parent").distinct()
    own = typed.join(known, ["class", "method"], "left")
    direct = own.where("is_virtual IS NOT NULL").select("file", "line_no", "caller", F.col("class").alias("owner"), "method", "is_virtual")
    above = own.where("is_virtual IS NULL").drop("is_virtual").join(up, "class").join(known.withColumnRenamed("class", "parent"), ["parent", "method"])
    members = direct.unionByName(above.select("file", "line_no", "caller", F.col("parent").alias("owner"), "method", "is_virtual"))
    places = defined.select(F.col("class").alias("owner"), F.col("name").alias("method"), F.col("file").alias("callee_file")).distinct()
    members = members.join(places, ["owner", "method"], "left").select(
        "file", "line_no", "caller", F.coalesce("callee_file", F.lit("")).alias("callee_file"), F.concat_ws("::", "owner", "method").alias("callee"),
        F.when(F.col("is_virtual"), "virtual").otherwise("direct").alias("kind"), F.when(F.col("is_virtual"), VIRTUAL).otherwise(DIRECT).alias("confidence"),
    )
    target = defined.select("name", F.col("file").alias("callee_file"), F.col("qualified").alias("callee")).distinct()

    def by_name(pattern: str, kind: str, sure: float) -> DataFrame:
        rows = inside.where(F.col("text").rlike(pattern)).withColumn("name", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))))
        rows = rows.where(~F.col("name").isin(*KEYWORDS)).join(target, "name").where("file <> callee_file")
        return rows.select("file", "line_no", "caller", "callee_file", "callee", F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))

    return members.unionByName(by_name(FREE_CALL, "direct", FREE)).unionByName(by_name(ADDRESS, "address_taken", ADDRESSED)).distinct()


def callers(calls: DataFrame, name: str) -> DataFrame:
    return calls.where((F.col("callee") == name) | F.col("callee").endswith("::" + name))


def callees(calls: DataFrame, name: str) -> DataFrame:
    return calls.where((F.col("caller") == name) | F.col("caller").endswith("::" + name))


def trace_to(calls: DataFrame, sink: str, depth: int = 10, limit: int = 50) -> DataFrame:
    """(caller, hops): functions from which a call leads to the sink, by the fewest hops; the first `limit` by hops, then name."""
    edges = calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()
    ids = edges.select(F.col("dst").alias("id")).where((F.col("id") == sink) | F.col("id").endswith("::" + sink)).distinct()
    found = traverse.reach(edges, ids, depth, backward=True)
    return found.orderBy("depth", "id").limit(limit).select(F.col("id").alias("caller"), F.col("depth").alias("hops"))


def body(lines: DataFrame, pattern: str, most: int = 5000) -> DataFrame:
    """(file, first_line, line_no, text): the first matching declaration of each file, to the line where its braces close again, `most` lines at most."""
    first = lines.where(F.col("text").rlike(pattern)).groupBy("file").agg(F.min("line_no").alias("first_line"))
    rows = lines.join(first, "file").where((F.col("line_no") >= F.col("first_line")) & (F.col("line_no") < F.col("first_line") + most))
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    so_far = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("open", F.sum(count("{")).over(so_far)).withColumn("deep", F.sum(count("{") - count("}")).over(so_far))
    rows = rows.withColumn("closed", ((F.col("open") > 0) & (F.col("deep") <= 0)).cast("int"))
    return rows.withColumn("past", F.coalesce(F.max("closed").over(before), F.lit(0))).where("past = 0").select("file", "first_line", "line_no", "text")


def read_function(lines: DataFrame, name: str) -> DataFrame:
    """The body of a function's definition (name, or Class::name) in each file that has one. Call sites are indented, definitions aren't."""
    last = name.split("::")[-1]
    owner = "::".join(name.split("::")[:-1])
    return body(lines, rf"^(?:[\w:<>&*]+\s+)+?[&*]*{owner + '::' if owner else '(?:[A-Za-z0-9_]+::)?'}{last}\s*\([^;]*$")


def extract_class(lines: DataFrame, name: str) -> DataFrame:
    return body(lines, rf"^\s*(?:class|struct)\s+{name}\b[^;]*$", 2000)


def parse_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, name, kind, file_path, start_line, end_line) and edges (src, dst, kind) of source lines."""
    defs = definitions(lines)
    nodes = defs.groupBy("qualified").agg(F.min(F.struct("file", "line_no", "last_line", "name", "class")).alias("d"))
    nodes = nodes.select(F.col("qualified").alias("id"), "d.name", F.when(F.col("d.class") == "", "function").otherwise("method").alias("kind"), F.col("d.file").alias("file_path"), F.col("d.line_no").alias("start_line"), F.col("d.last_line").alias("end_line"))
    return nodes, resolve_calls(lines).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("calls").alias("kind"))
