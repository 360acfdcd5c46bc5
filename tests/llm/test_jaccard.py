"""The n-gram Jaccard join against brute force on near copies that share passages."""

import random

from callscape.llm import jaccard


def brute(rows, k, num, den):
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and den * both >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_copies_and_shared_passages(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    passage = rng.choices(words, k=60)
    rows = [(0, None), (1, ""), (2, "one two")]
    for size in (4, 8, 12, 20, 40, 100, 300):
        for _ in range(4):
            base = rng.choices(words, k=size) + passage * rng.randrange(2)
            for changes in (0, 0, 1, len(base) // 40, len(base) // 20):
                text = list(base)
                for _ in range(changes):
                    text[rng.randrange(len(text))] = rng.choice(words)
                rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "id long, text string")
    found = {r.id: (r.n_shingles, r.component) for r in jaccard.groups(docs, 4, 17, 20).collect()}
    assert found == brute(rows, 4, 17, 20)


def test_empty_table(spark):
    assert jaccard.groups(spark.createDataFrame([], "id long, text string")).count() == 0


def test_null_and_repeated_ids(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(4))
    # Null ids before their equal; id 7 has a text of id 1's and another one, near id 9's; id 12 an empty text and one near id 3's.
    rows = [(None, a), (5, a), (6, a + " x"), (1, b), (7, b), (7, c), (9, c + " y"), (None, d), (3, d), (12, ""), (12, d + " z"), (4, "")]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    found = {(r.id, r.n_shingles, r.component) for r in jaccard.groups(docs, 4, 17, 20).collect()}
    assert found == {(None, 57, None), (5, 57, 5), (6, 58, 5), (1, 57, 1), (7, 57, 1), (9, 58, 1), (3, 57, 3), (12, 0, 3), (12, 58, 3), (4, 0, 4)}


def test_keep_one_keeps_the_smallest_of_each_group(spark):
    rng = random.Random(13)
    a, b = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(2))
    rows = [(3, a), (2, a + " x"), (9, a), (4, b), (4, b), (5, ""), (6, None), (None, a)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(2, a + " x"), (4, b), (5, ""), (6, None), (None, a)], key=repr)
