"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Candidate strings are found in every text. The hash of each candidate's value is counted
over the whole corpus by distinct owners and repositories: a value that several owners hold
is a copied example, one that few owners hold looks like a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscape.llm.store import Store

# The base patterns. The group whose length counts, and its least length.
# (hex and access runs are greedy, so a least length inside the pattern drops the same matches;
# a failing assign match still consumes its text, so its length is tested afterwards.)
BASE = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
# What the method looks at besides. Kept only where few owners hold the value.
ADDED = {
    "provider": (r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 0, 20),
    "mixed": (r"[A-Za-z0-9+/_-]{24,}", 0, 24),
}
KINDS = {**BASE, **ADDED}
ORDER = {kind: i for i, kind in enumerate(KINDS)}
#: A value looks live if one owner holds it, in however many repositories, or a few owners do in a few repositories.
LIVE_OWNERS, LIVE_REPOS = 2, 3


def looks_live(n_owners: Column, n_repos: Column) -> Column:
    return (n_owners == 1) | ((n_owners <= LIVE_OWNERS) & (n_repos <= LIVE_REPOS))


def _matches(text: Column, kind: str) -> Column:
    """Array of (gap, len, value hash, passes) for each match, in order; null where there is none.

    A gap is the number of code points between the end of the last match and the start of this one.
    """
    pattern, group, least = KINDS[kind]
    lit = F.lit(pattern)
    value = F.regexp_extract_all(text, lit, F.lit(group))
    whole = F.regexp_extract_all(text, lit, F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))

    def describe(x: Column) -> Column:
        passes = F.char_length(x["value"]) >= least
        if kind == "mixed":
            for needed in ("[0-9]", "[A-Z]", "[a-z]"):
                passes = passes & x["value"].rlike(needed)
        return F.struct(
            F.char_length(x["gap"]).cast("long").alias("gap"),
            F.char_length(x["whole"]).cast("long").alias("len"),
            F.sha2(x["value"], 256).alias("value"),
            passes.alias("passes"),
        )

    found = F.slice(F.transform(zipped, describe), F.lit(1), F.size(whole))
    return F.when(text.rlike(pattern), found)


def _tagger(kind: str):
    def tag(x: Column, i: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("nth"), *(x[f].alias(f) for f in ("gap", "len", "value", "passes")))

    return tag


def find(docs: DataFrame, store: Store, text: str = "text", owner: Column | None = None, repo: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, doc_id) for all documents, and spans (rid, kind, start, end, value, n_owners, n_repos, n_docs, base, live).

    Starts and ends count code points, ends exclusive. A null text counts as empty. owner and
    repo (default: source; source and lang) may be null: nulls together are one owner. Repeated
    rows are separate documents. Other columns are not read.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit(""))) if repo is None else repo
    body = F.coalesce(F.col(text), F.lit(""))
    per_doc = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        repo.alias("repo"),
        *(_matches(body, kind).alias(kind) for kind in KINDS),
    )
    per_doc = store.save(per_doc, "matches")
    # One row per match; a running sum of gaps and lengths gives the place.
    tagged = F.concat(
        *(
            F.transform(F.coalesce(F.col(kind), F.array().cast(per_doc.schema[kind].dataType)), _tagger(kind))
            for kind in KINDS
        )
    )
    rows = per_doc.select("rid", "owner", "repo", F.explode(tagged).alias("m")).select("rid", "owner", "repo", "m.*")
    so_far = W.partitionBy("rid", "kind").orderBy("nth")
    placed = (
        rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far))
        .where("passes")
        .select("rid", "owner", "repo", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "value")
    )
    placed = store.save(placed, "placed")
    # Pre-aggregated by (value, owner, repository), so a value in a third of all rows stays small.
    stats = (
        placed.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
        .groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
        .groupBy("value").agg(F.sum("n").alias("n_found"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))
    )
    stats = store.save(stats, "stats")
    base = F.col("kind").isin(*BASE)
    spans = (
        placed.join(stats, "value")
        .select("rid", "kind", "start", "end", "value", "n_owners", "n_repos", "n_found", base.alias("base"), looks_live(F.col("n_owners"), F.col("n_repos")).alias("live"))
        .where("base OR live")
    )
    return per_doc.select("rid", "doc_id"), spans


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, most_owners, most_repos.

    The last two are the most owners and repositories that hold any of the document's values. A document without
    secrets (or with null or empty text) has zero counts, the digest of the empty string and empty spans. Repeated rows
    are documents of their own. An empty table gives an empty result. Matching holds a text and its matches at once.
    """
    store = Store(docs.sparkSession, "secrets")
    per_doc, spans = find(docs, store)
    order = F.element_at(F.create_map(*(F.lit(x) for kv in ORDER.items() for x in kv)), F.col("kind"))
    listed = F.sort_array(F.collect_list(F.struct("start", order.alias("nth"), "end", "kind", "base")))
    per_spans = spans.groupBy("rid").agg(
        listed.alias("s"),
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repos").alias("most_repos"),
    )
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in (*(f"n_{k}" for k in BASE), "n_live", "n_copied", "most_owners", "most_repos")]
    return per_doc.join(per_spans, "rid", "left").select(
        "doc_id",
        *counts[:3],
        F.sha2(F.coalesce(_joined(F.filter("s", lambda x: x["base"])), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("s")), F.lit("")).alias("spans"),
        *counts[3:],
    )


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """The documents with every span found (base, and added ones that look live) replaced by a mark.

    Overlapping spans become one mark; null and empty texts stay as they are; all rows and columns stay, repeated
    ones too (which fare alike), and a column named n_chars is set to the new length where the text changed. An empty table stays empty.
    """
    store = Store(docs.sparkSession, "redact")
    # (document, text) identifies a row; rows alike in both fare alike.
    ident = [F.col("doc_id").cast("string").alias("key"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(3), "text").alias("g")]
    body = docs.select("text", F.struct(*ident).alias("doc_id"), *(F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")))
    per_doc, spans = find(body, store)
    # Merge overlaps: a span starts a new island where it begins after all earlier ends.
    before = W.partitionBy("rid").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    islands = (
        spans.withColumn("reach", F.max("end").over(before))
        .withColumn("island", F.sum((F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int")).over(W.partitionBy("rid").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("rid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    last = F.coalesce(F.lag("end").over(W.partitionBy("rid").orderBy("start")), F.lit(0))
    cuts = islands.withColumn("from", last).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "from"))).alias("cuts"))
    cuts = per_doc.join(cuts, "rid").groupBy(*(F.col(f"doc_id.{c}").alias(f"cut_{c}") for c in ("key", "h", "g"))).agg(F.min("cuts").alias("cuts"))
    cuts = store.save(cuts, "cuts")
    store.only("cuts")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *ident)
    text = F.col("row.text")
    parts = F.transform("cuts", lambda c: F.concat(F.substring(text, (c["from"] + 1).cast("int"), (c["start"] - c["from"]).cast("int")), F.lit(mark)))
    tail = F.expr("substring(row.text, cast(element_at(cuts, -1).`end` + 1 as int))")
    new = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.array_join(parts, ""), tail))
    same = F.col("key").eqNullSafe(F.col("cut_key")) & (F.col("h") == F.col("cut_h")) & (F.col("g") == F.col("cut_g"))
    out = rows.join(cuts, same, "left").withColumn("new", new)
    columns = []
    for c in docs.columns:
        old = F.col(f"row.`{c}`")
        if c == "text":
            columns.append(F.col("new").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("cuts").isNull(), old).otherwise(F.char_length("new")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(old.alias(c))
    return out.select(*columns)
