"""File tables (path, content): discovery, languages, hashes and change detection."""

from __future__ import annotations

import re
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of each language, and folders that are never entered.
EXTENSIONS = {
    "python": [".py"],
    "java": [".java"],
    "javascript": [".js", ".mjs", ".cjs", ".jsx"],
    "typescript": [".ts", ".tsx"],
    "go": [".go"],
    "rust": [".rs"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".hpp", ".cc", ".hh", ".cxx"],
    "c_sharp": [".cs"],
    "php": [".php"],
    "ruby": [".rb"],
    "kotlin": [".kt", ".kts"],
    "swift": [".swift"],
    "objc": [".m", ".mm"],
    "dart": [".dart"],
    "solidity": [".sol"],
    "haskell": [".hs"],
    "erlang": [".erl"],
}
SKIPPED = [".git", ".svn", "node_modules", "vendor", "venv", ".venv", "__pycache__", "build", "out", "dist", "target", ".tox", ".mypy_cache"]


# What searches in source text read, and the folders that they leave out.
C_EXTENSIONS = [".c", ".cc", ".cpp", ".h", ".hpp", ".cxx", ".mm"]
C_SKIPPED = [".git", "test", "tests", "testing", "testdata", "node_modules", "build", "out", "third_party"]
RESOLVED = [".c", ".cc", ".cpp", ".h", ".hpp"]


def read(spark: SparkSession, root: str) -> DataFrame:
    """(path below root, content) of a tree's files in a known language outside skipped folders. Only those are opened: paths come from a listing without content."""
    root = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    listed = raw.load(root).select("path", F.substring_index("path", root, -1).alias("below"))
    wanted = discover(listed.select(F.col("below").alias("path"), F.col("path").alias("whole"))).select("path", "whole", "language")
    content = raw.load(root).select(F.col("path").alias("whole"), F.decode("content", "UTF-8").alias("content"))
    endings = "(?i)(?:" + "|".join(re.escape(e) for es in EXTENSIONS.values() for e in es) + ")$"
    return content.where(F.col("whole").rlike(endings)).join(wanted, "whole").select("path", "language", "content")


def languages(spark: SparkSession) -> DataFrame:
    """(ext, language)"""
    return spark.createDataFrame([(e, lang) for lang, es in EXTENSIONS.items() for e in es], "ext string, language string")


def c_family(files: DataFrame, extensions: list[str] = C_EXTENSIONS) -> DataFrame:
    """Files that searches in source text read."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    kept = ~F.exists(folders, lambda f: f.isin(*C_SKIPPED))
    return files.where(kept & F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*extensions))


def resolve_path(files: DataFrame, wanted: str) -> DataFrame:
    """The one file that a path given by a user means: of those that end with it, else of those of its name, the first."""
    wanted = wanted.replace("\\", "/").lstrip("/")
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    name = F.substring_index(path, "/", -1)
    rank = F.when((path == wanted) | path.endswith("/" + wanted), 0).when(name == wanted.split("/")[-1], 1)
    return files.select("path", rank.alias("rank")).where("rank IS NOT NULL").orderBy("rank", "path").limit(1).select("path")


def narrowed(places: DataFrame, part: str) -> DataFrame:
    """Of places (file, line_no) the first whose file holds `part`, else the first."""
    return places.orderBy(F.when(F.contains("file", F.lit(part)), 0).otherwise(1), "file", "line_no").limit(1)


SARIF = "runs array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>>>>>>"


def sarif(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(scanner, rule, level, message, file, line) of SARIF documents in a text column, a row a location."""
    runs = bodies.select(F.explode(F.from_json(body, SARIF)["runs"]).alias("run"))
    results = runs.select(F.col("run.tool.driver.name").alias("scanner"), F.explode("run.results").alias("r"))
    places = results.select("scanner", F.col("r.ruleId").alias("rule"), F.col("r.level").alias("level"), F.col("r.message.text").alias("message"), F.explode_outer("r.locations").alias("at"))
    return places.select("scanner", "rule", "level", "message", F.col("at.physicalLocation.artifactLocation.uri").alias("file"), F.col("at.physicalLocation.region.startLine").alias("line"))


def read_sarif(spark: SparkSession, *paths: str) -> DataFrame:
    """As sarif(), of files."""
    return sarif(spark.read.text(list(paths), wholetext=True).withColumnRenamed("value", "body"))


# Scanners that SARIF is taken from.
SCANNERS = {
    "semgrep": ("python", "java", "javascript", "typescript", "go", "rust", "c", "cpp", "c_sharp", "ruby", "php", "kotlin", "swift"),
    "bandit": ("python",),
    "trivy": ("python", "java", "javascript", "typescript", "go", "rust", "c", "cpp", "ruby", "php"),
    "bearer": ("ruby", "javascript", "typescript", "java", "go", "php"),
    "gosec": ("go",),
    "phpstan": ("php",),
}


def scanners(spark: SparkSession) -> DataFrame:
    """(name, language, installed), a row a language."""
    rows = [(n, lang, shutil.which(n) is not None) for n, langs in SCANNERS.items() for lang in langs]
    return spark.createDataFrame(rows, "name string, language string, installed boolean")


def language(path):
    """The language of a path's extension, null if there is none."""
    pairs = [F.lit(x) for lang, exts in EXTENSIONS.items() for e in exts for x in (e, lang)]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def discover(files: DataFrame) -> DataFrame:
    """Files in a known language outside skipped and dot folders, with it."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    skipped = F.exists(folders, lambda f: f.isin(*SKIPPED) | f.startswith("."))
    return files.where(~skipped).withColumn("language", language(F.col("path"))).where("language IS NOT NULL")


def hashes(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("hash"))


def composite_hash(files: DataFrame) -> DataFrame:
    """One digest of all files: of the digests of 4,096 buckets of paths, so that no task sorts all files."""
    bucket = F.substring(F.sha2("path", 256), 1, 3)
    inner = hashes(files).groupBy(bucket.alias("bucket")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "path", "hash"))), "\n"), 256).alias("digest"))
    return inner.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "bucket", "digest"))), "\n"), 256).alias("hash"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files of `after` to parse again: new, or with other content."""
    return hashes(after).join(hashes(before), ["path", "hash"], "left_anti").select("path")


# Source files that a partition holds at most before it is split, and below which there is only one; folders and endings that count for that.
MOST_FILES, LEAST_FILES = 5000, 10_000
THIRD_PARTY = ("third_party", "third-party", "thirdparty", "external", "vendor", "vendored", "deps")
PLAN_SKIPPED = (
    ".git", ".svn", ".hg", "node_modules", "vendor", "venv", ".venv", "__pycache__", "build", "out", "dist", "target", ".tox", ".mypy_cache", ".ruff_cache", ".pytest_cache",
    "docs", "doc", "documentation", "test", "tests", "testing", "test_data", "testdata", "examples", "samples", "demo", "demos", "benchmarks", "perf",
)
PLAN_ENDINGS = (*(e for es in EXTENSIONS.values() for e in es), ".cairo", ".circom")


def partitions(files: DataFrame, most: int = MOST_FILES, least: int = LEAST_FILES, every: bool = False) -> DataFrame:
    """(name, is_third_party, estimated_files): one partition, root, below `least` source files; else by top folder, those above `most` by their children.

    Source files have a known ending and lie in no skipped or dot folder; all files beside the top folders count too. With `every`, the limits are for
    all files. estimated_files counts every file.
    """
    parts = F.split("path", "/")
    deep = F.size(parts)
    passed = F.when(deep > 1, F.slice(parts, 1, deep - 1)).otherwise(parts)
    skipped = F.exists(passed, lambda p: F.lower(p).isin(*PLAN_SKIPPED) | p.startswith("."))
    source = F.lit(every) | ~skipped & ((deep == 1) | F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*PLAN_ENDINGS))
    top = F.when(deep > 1, parts[0]).otherwise("__root_files__")
    child = F.when(deep > 2, F.concat_ws("/", parts[0], parts[1])).otherwise(F.concat(parts[0], F.lit("/__root_files__")))
    rows = files.select(top.alias("top"), child.alias("child"), source.alias("source"))
    counted = rows.groupBy("top", "child").agg(F.count("*").alias("n"), F.count_if("source").alias("sources"))  # from here on a row a folder
    tops = counted.groupBy("top").agg(F.sum("sources").alias("of_top"))
    total = counted.agg(F.sum("sources").alias("total"))
    counted = counted.join(tops, "top").crossJoin(F.broadcast(total))  # one row
    split = (F.col("of_top") > most) & (F.col("top") != "__root_files__")
    name = F.when(F.col("total") < least, "root").when(split, F.col("child")).otherwise(F.col("top"))
    own = F.exists(F.split("name", "/"), lambda p: F.lower(p).isin(*THIRD_PARTY))
    return counted.groupBy(name.alias("name")).agg(F.sum("n").alias("estimated_files")).select("name", own.alias("is_third_party"), "estimated_files")


def freshness(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(index_id, status) of indexes (index_id, hash): current, refreshing if the source changed, new, or gone."""
    both = stored.select("index_id", F.col("hash").alias("was")).join(now.select("index_id", F.col("hash").alias("is")), "index_id", "full")
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.col("was") == F.col("is"), "current").otherwise("refreshing")
    return both.select("index_id", status.alias("status"))


#: Where a line ends, as text files have it.
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def lines(texts: DataFrame, key: str) -> DataFrame:
    """(key, line_no from 1, text) of each line of texts (key, text)."""
    parts = F.split("text", BREAK, -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)  # no line behind the last break
    split = texts.select(key, F.posexplode(parts).alias("pos", "line"))
    return split.select(key, (F.col("pos") + 1).alias("line_no"), F.col("line").alias("text"))
