"""Exact Jaccard self-join of shingle sets by universe-partition pigeonhole.

Two sets of at most `hi` elements that reach the threshold differ in at most H elements. Hash
the universe into m > H segments: they agree in at least m - H segments, so equal segments
are an index. Sets are banded by size; each band has its own m, and a set that may have a larger
partner in the next band is indexed there too. An empty segment indexes nothing. A set with so
many empty segments that pigeonhole may fail also indexes its segments' one-deletion neighbourhoods
(a segment then tolerates one difference and counts twice), and, should that not do
either, every element. How many segments a band has beyond H + 1 is allocated by cost: more
segments for all sets against more neighbourhoods for few.

Linked sets agree in m - H segments, not in one only. In a total order of all entries by how
many sets hold them, each set may thus leave out its m - H - 1 commonest (empty segments
count as such): the rarest entry that a pair agrees on is then left out by neither. So passages that
many texts share don't tie these texts together. SPARE keeps m - H a fixed part of m.

Sets that share a remaining entry form clusters, in which all pairs are compared block by block
inside tasks, exactly, so that no pair is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscape.llm.components import components
from callscape.llm.shingles import U, mix, shingles, slices
from callscape.llm.store import Store, scratch

#: Ratio of the sizes at a band's ends.
BAND = 1.3
#: Segments beyond H + 1 for each of H, at the least.
SPARE = 0.5
#: Low bits of an entry that name its band's scheme.
SCHEMES = 64
#: The entries are counted and joined in so many rounds, by the bits above those, so that only a round's share of them is ever shuffled at once.
ROUNDS = 4
#: Sets and elements that a comparison block holds at most (a single set may be larger).
BLOCK_SETS, BLOCK_ELEMENTS = 128, 1_000_000


@dataclass(frozen=True)
class Band:
    lo: int  # least size of a set at home here
    hi: int  # largest
    least: int  # least size of any partner of a set at home here
    differ: int  # H
    segments: int  # m


def _allocate(lo: int, hi: int, differ: int) -> int:
    """m >= H + 1 of least expected cost in index entries for a set in the middle of the band."""
    size = math.sqrt(lo * hi)

    def cost(m: int) -> float:
        mean = m * math.exp(-size / m)  # empty segments, about Poisson
        spare, p, below = m - differ - 1, math.exp(-mean), 0.0
        for i in range(spare + 1):
            below += p
            p *= mean / (i + 1)
        return m + max(0.0, 1 - below) * size

    first = differ + 1 + math.ceil(SPARE * differ)
    return min(range(first, first + max(4, first // 3)), key=cost)


@lru_cache
def bands(num: int, den: int, largest: int) -> tuple[Band, ...]:
    """Bands up to the size `largest`; smaller sets than the first band's link only if equal."""
    found: list[Band] = []
    # The least size at which two different sets can link: they differ in one element at least.
    lo = next(n for n in range(1, 10 * den) if (den - num) * 2 * n >= den + num)
    while not found or found[-1].hi < largest:
        hi = max(lo + 1, int(lo * BAND))
        differ = (den - num) * 2 * hi // (den + num)
        found.append(Band(lo, hi, -(-num * lo // den), differ, _allocate(lo, hi, differ)))
        lo = hi + 1
    return tuple(found)


def _entries(h: np.ndarray, begin: np.ndarray, which: np.ndarray, band: Band, nth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, index entry) of the texts `which` in one band's scheme, and how many entries each of `which` may leave out; h is sorted by text and hash."""
    sizes = begin[which + 1] - begin[which]
    owner = np.repeat(np.arange(len(which)), sizes)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[which][owner]
    element = h[at]
    m = band.segments
    segment = ((element >> U(24)) * U(m)) >> U(32)  # of 56 bits, so segments are runs
    cell = owner * m + segment.astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    value = mix(element + U(0xA0761D6478BD642F))
    sums = np.add.reduceat(value, starts)
    cells = cell[starts]
    lengths = np.diff(np.concatenate([starts, [len(cell)]]))
    tag = mix((cells % m).astype(np.uint64) + U(nth << 40))
    entry = mix(sums + tag)
    text = cells // m
    out_text, out_entry = [which[text]], [entry]
    full = np.bincount(text, minlength=len(which))
    spare = (m - band.differ - 1) - (m - full)
    poor = spare < 0  # too many empty segments
    if poor.any():
        of_cell = np.repeat(np.arange(len(starts)), lengths)
        pick = poor[owner] & (lengths[of_cell] > 1)
        out_text.append(which[owner[pick]])
        out_entry.append(mix(sums[of_cell[pick]] - value[pick] + tag[of_cell[pick]]))
        double = np.bincount(text, weights=lengths > 1, minlength=len(which))
        last = poor & (full + double < band.differ + 1)
        pick = last[owner]
        out_text.append(which[owner[pick]])
        out_entry.append(mix(element[pick] + U((nth << 40) + 0xE7037ED1A0B428DB)))
    scheme = U(nth % SCHEMES)
    return np.concatenate(out_text), np.concatenate(out_entry) & ~U(SCHEMES - 1) | scheme, np.maximum(spare, 0)


def index_entries(h: np.ndarray, begin: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, entry) for all texts, ordered by text; and (text, entries it may leave out * SCHEMES + scheme), likewise."""
    sizes = np.diff(begin)
    texts, entries, owners, spares = [], [], [], []
    for nth, band in enumerate(bands(num, den, int(sizes.max(initial=1)))):
        which = np.flatnonzero((sizes >= band.least) & (sizes <= band.hi) & (sizes > 0))
        if len(which):
            t, e, spare = _entries(h, begin, which, band, nth)
            texts.append(t)
            entries.append(e)
            owners.append(which)
            spares.append((spare * SCHEMES + nth % SCHEMES).astype(np.uint64))
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text, entry, owner, spare = map(np.concatenate, (texts, entries, owners, spares))
    order, by_owner = np.argsort(text, kind="stable"), np.argsort(owner, kind="stable")
    return text[order], entry[order], owner[by_owner], spare[by_owner]


def _lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.view(np.int64)))


ENTRIES = [f"entries{r}" for r in range(ROUNDS)]
#: Set digests that a task remembers, to index each of many equal sets once.
REMEMBER = 200_000


def _digests(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each set."""
    a = np.concatenate([[U(0)], np.cumsum(mix(h))])
    b = np.concatenate([[U(0)], np.cumsum(mix(h + U(0x8EBC6AF09C88C6E3)))])
    return (a[begin[1:]] - a[begin[:-1]]).view(np.int64), (b[begin[1:]] - b[begin[:-1]]).view(np.int64)


def _index(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            ids, keys = batch.column(0), batch.column(2)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            for first, last, data, offsets in slices(batch.column(1)):
                h, begin = shingles(data, offsets, k)
                n = np.diff(begin)
                d1, d2 = _digests(h, begin)
                text, entry, owner, spare = index_entries(h, begin, num, den)
                fresh = np.zeros(last - first, bool)
                for i, digest in enumerate(zip(d1.tolist(), d2.tolist())):
                    if known[first + i] and digest not in seen:
                        fresh[i] = True
                        seen.add(digest)
                if len(seen) > REMEMBER:
                    seen.clear()
                keep = fresh[text]
                text, entry = text[keep], entry[keep]
                keep = fresh[owner]
                owner, spare = owner[keep], spare[keep]
                every = np.arange(last - first + 1)
                turn = entry // U(SCHEMES) % U(ROUNDS)
                lists = [_lists(spare, np.searchsorted(owner, every))]
                for r in range(ROUNDS):
                    own = turn == r
                    lists.append(_lists(entry[own], np.searchsorted(text[own], every)))
                yield pa.RecordBatch.from_arrays([keys.slice(first, last - first), ids.slice(first, last - first), pa.array(n), pa.array(d1), pa.array(d2), *lists], names=["key", "id", "n_shingles", "d1", "d2", "spare", *ENTRIES])

    return run


def _meets(indexed: DataFrame, store: Store) -> DataFrame:
    """(u, v): keys with the least key that keeps one of the same entries. A hot entry is a skewed join key only, its counts are aggregated beforehand."""
    shared = None
    for name in ENTRIES:  # a column is read for its round only
        entries = indexed.select(F.explode(name).alias("entry"), "key")
        held = entries.groupBy("entry").agg(F.count("*").alias("held")).where("held > 1")
        part = store.save(entries.join(held, "entry"), f"shared-{name}")
        shared = part if shared is None else shared.unionByName(part)
    shared = shared.withColumn("scheme", F.pmod("entry", F.lit(SCHEMES)))
    spare = indexed.select("key", F.explode("spare").alias("s")).groupBy("key", F.pmod("s", F.lit(SCHEMES)).alias("scheme")).agg(F.min(F.floor(F.col("s") / SCHEMES)).alias("spare"))
    commonest = W.partitionBy("key", "scheme").orderBy(F.desc("held"), "entry")
    kept = shared.join(spare, ["key", "scheme"]).withColumn("nth", F.row_number().over(commonest)).where("nth > spare").select("entry", "key")
    kept = store.save(kept, "kept")
    store.drop(*(f"shared-{name}" for name in ENTRIES))
    hub = kept.groupBy("entry").agg(F.min("key").alias("v"), F.max("key").alias("top")).where("v < top").drop("top")
    return store.save(kept.join(hub, "entry").where("key <> v").select(F.col("key").alias("u"), "v").distinct(), "meets")


def _sets(k: int):
    """The texts whose set has the digests given; other texts of the same id go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(2)):
                h, begin = shingles(data, offsets, k)
                kept = (batch.column(i).slice(first, last - first) for i in (0, 1))
                same = np.ones(last - first, bool)
                for i, found in enumerate((np.diff(begin), *_digests(h, begin))):
                    same &= batch.column(3 + i).slice(first, last - first).to_numpy() == found
                sets = pa.RecordBatch.from_arrays([*kept, _lists(h, begin)], names=["key", "component", "elements"])
                yield sets if same.all() else sets.filter(pa.array(same))

    return run


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of a with all of b, from dense columns a portion at a time."""
    out = np.zeros((len(a), len(b)), np.float32)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    values, at = np.unique(np.concatenate(a + b), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), np.concatenate([na, nb]))
    in_a = row < len(a)
    both = (np.bincount(at[in_a], minlength=len(values)) > 0) & (np.bincount(at[~in_a], minlength=len(values)) > 0)
    column = np.cumsum(both) - 1
    keep = both[at]
    row, at = row[keep], column[at[keep]]
    width = 8192
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    n = int(both.sum())
    cuts = np.searchsorted(at, np.arange(0, n + width, width))
    for i in range(len(cuts) - 1):
        r, c = row[cuts[i] : cuts[i + 1]], at[cuts[i] : cuts[i + 1]] - i * width
        if len(r):
            dense = np.zeros((len(a) + len(b), min(width, n - i * width)), np.float32)
            dense[r, c] = 1
            out += dense[: len(a)] @ dense[len(a) :].T
    return out


def links(a: list[np.ndarray], b: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which sets of a link with which of b: den * intersection >= num * union."""
    both = _overlaps(a, b).astype(np.int64)
    sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None]
    return (den * both >= num * (sizes - both)) & (both > 0)


def _compare(num: int, den: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("key").to_numpy()
        block = table.column("block").to_numpy()
        lists = table.column("elements").combine_chunks()
        flat, where = lists.values.to_numpy(), lists.offsets.to_numpy()
        sets = [flat[where[i] : where[i + 1]] for i in range(len(ids))]
        i, j = key[1].as_py(), key[2].as_py()
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        us, vs = [], []
        if len(left) and len(right):
            hit = links([sets[x] for x in left], [sets[x] for x in right], num, den)
            # A node for each row and column; label propagation joins them without listing pairs.
            la, lb = ids[left], ids[right]
            label_a, label_b = la.copy(), lb.copy()
            top = np.iinfo(np.int64).max
            while True:
                new_a = np.minimum(label_a, np.where(hit, label_b[None], top).min(1))
                new_b = np.minimum(label_b, np.where(hit, new_a[:, None], top).min(0))
                if np.array_equal(new_a, label_a) and np.array_equal(new_b, label_b):
                    break
                label_a, label_b = new_a, new_b
            for nodes, label in ((la, label_a), (lb, label_b)):
                moved = nodes != label
                us.append(nodes[moved])
                vs.append(label[moved])
        u = np.concatenate(us) if us else np.zeros(0, np.int64)
        v = np.concatenate(vs) if vs else np.zeros(0, np.int64)
        return pa.table({"u": u, "v": v})

    return run


def groups(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs (id long, text) -> (id, n_shingles, component) with one row per row of docs.

    Links pairs whose sets of distinct k-word shingles have a Jaccard similarity >= num / den;
    component is the smallest id reachable. A text of 1 to k - 1 words is one shingle; null
    and empty texts, and those of white space, have none and link with nothing. Repeated rows
    are equal sets and link; rows of one id and different texts are one node. Rows whose id is null have a null component and link with nothing.
    """
    spark = docs.sparkSession
    store = Store(spark, "jaccard")
    source = docs.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows have keys, as one id may have several texts; the keys hold in the written table only.
    keyed = source.select("id", "text", F.monotonically_increasing_id().alias("key"))
    indexed = store.save(keyed.mapInArrow(_index(k, num, den), "key long, id long, n_shingles long, d1 long, d2 long, spare array<long>, " + ", ".join(f"{e} array<long>" for e in ENTRIES)), "indexed")
    # Equal sets are one set, of the smallest key.
    sets = indexed.where("n_shingles > 0 AND id IS NOT NULL").groupBy("n_shingles", "d1", "d2").agg(F.min("key").alias("rep"), F.min("id").alias("low"))
    sets = store.save(sets, "sets")
    reps = indexed.select("key", "id", "n_shingles", "d1", "d2").join(sets, ["n_shingles", "d1", "d2"], "left").select("key", "id", "n_shingles", "rep", "low")
    known = F.col("id").isNotNull()
    reps = store.save(reps.withColumn("rep", F.when(known, F.coalesce("rep", "key"))).withColumn("low", F.when(known, F.coalesce("low", "id"))), "reps")
    meets = _meets(indexed.where("id IS NOT NULL"), store)
    store.drop("indexed", "kept")
    to = store.save(reps.where("key <> rep").select("key", "rep"), "equal")
    for side in ("u", "v"):
        meets = meets.join(to.withColumnRenamed("key", side), side, "left").withColumn(side, F.coalesce("rep", side)).drop("rep")
    clusters = components(meets.where("u <> v"), store, "clusters")
    # The sets of clusters' members, from their texts.
    wanted = clusters.join(sets, F.col("node") == F.col("rep")).select("node", "component", F.col("low").alias("id"), "n_shingles", "d1", "d2")
    members = source.join(wanted, "id").select(F.col("node").alias("key"), "component", "text", "n_shingles", "d1", "d2")
    members = store.save(members.mapInArrow(_sets(k), "key long, component long, elements array<long>"), "members")
    totals = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_SETS)), F.ceil(F.sum(F.size("elements")) / F.lit(BLOCK_ELEMENTS))).alias("n"))
    totals = store.save(totals, "totals")
    blocked = members.join(totals, "component").withColumn("block", F.pmod(F.xxhash64("key"), F.col("n")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    dealt = blocked.withColumn("with", other).select("component", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "key", "block", "elements")
    linked = dealt.groupBy("component", "i", "j").applyInArrow(_compare(num, den), "u long, v long")
    # Sets of one id are one node.
    nodes = reps.where(known).groupBy("id").agg(F.min("rep").alias("v"), F.max("rep").alias("top")).where("v < top").select("id", "v")
    of_id = reps.join(nodes, "id").where("rep <> v").select(F.col("rep").alias("u"), "v")
    found = components(linked.unionByName(of_id), store, "links")
    store.drop("members")
    lows = found.join(reps.select(F.col("rep").alias("node"), "low").distinct(), "node")
    least = lows.groupBy("component").agg(F.min("low").alias("least"))
    least = store.save(found.join(least, "component").select("node", "least"), "least")
    store.only("reps", "least")
    return reps.join(least, F.col("rep") == F.col("node"), "left").select("id", "n_shingles", F.coalesce("least", "low").alias("component"))


def join(docs: DataFrame, k: int = 4, num: int = 17, den: int = 20) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, at the similarity num / den."""
    found = groups(docs.select(F.col("doc_id").alias("id"), "text"), k, num, den)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents without those in whose group another has a smaller doc_id, with all columns.

    Of rows that share a doc_id one stays. Documents without shingles, and those whose doc_id
    is null, stay. Columns may have any names.
    """
    store = Store(docs.sparkSession, "keep-one")
    with scratch():
        found = groups(docs.select(F.col("doc_id").alias("id"), "text"), k, num, den)
        marks = found.where("id IS NOT NULL AND n_shingles > 0").groupBy("id").agg(F.bool_or(F.col("component") < F.col("id")).alias("drop"), (F.count("*") > 1).alias("repeated"))
        marks = store.save(marks.where("drop OR repeated"), "marks")
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    nth = F.row_number().over(W.partitionBy("key").orderBy("id"))
    kept = rows.join(marks, F.col("key") == F.col("id"), "left").withColumn("nth", nth)
    kept = kept.where("id IS NULL OR (NOT drop AND nth = 1)")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
