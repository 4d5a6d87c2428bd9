"""Op 1 against brute force."""

import random
import re

import pytest

from webdistill.llm import jaccard
from webdistill.llm.components import components

UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n):
    w = re.findall("[^ \t\n\x0b\x0c\r]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    s = {}
    for i, t in rows:
        s.setdefault(i, []).append(shingles(t, n))
    parent = {i: i for i in s}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(s)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if any(a and b and den * len(a & b) >= num * len(a | b) for a in s[i] for b in s[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(shingles(t, n)), root(i)) for i, t in rows)


def corpus(seed, size=260):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["A", "a", "É"]
    passage = r.choices(vocabulary, k=60)
    rows = []
    for i in range(size):
        kind = r.random()
        if kind < 0.45 and rows:
            words = list(re.split(r"[ \n]", r.choice(rows)[1]))
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                k = r.randrange(len(words) + 1)
                words[k : k + r.randint(0, 1)] = r.choices(vocabulary, k=r.randint(0, 2))
        else:
            words = r.choices(vocabulary, k=r.choice([1, 2, 3, 5, 9, 12, 20, 40, 80, 200]))
            if r.random() < 0.4:
                words = passage + words
        rows.append((i * 3, r.choice([" ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("seed,n,num,den,long", [(1, 3, 90, 100, 64), (2, 3, 90, 100, 5), (3, 5, 80, 100, 4), (4, 1, 60, 100, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, n, num, den, long):
    monkeypatch.setattr(jaccard, "LONG", long)
    rows = [*corpus(seed), (5000, None), (5001, ""), (5002, " \n"), (5003, "x"), (5004, "X")]
    rows.append(rows[3])
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, n, num, den).collect())
    assert got == brute(rows, n, num, den)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG", 10)
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in r.sample(range(150), r.randint(0, 4)):
            words[k] = f"v{r.randrange(50)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.join(docs, 3, 90, 100).collect())
    assert got == brute(rows, 3, 90, 100)


def test_nothing_and_string_ids(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([("b", "one two three"), ("a", "One two three"), (None, "one two three"), ("c", "other")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.join(docs).collect()} == {("b", "a"), ("a", "a"), (None, None), ("c", "c")}
    assert sorted(r.doc_id or "" for r in jaccard.drop_near_copies(docs).collect()) == ["", "a", "c"]


def test_boundary_is_by_cost():
    sizes = [(10, 100), (50, 100), (500, 100)]
    assert jaccard.boundary(sizes, 90, 100, 0.0) < 500
    assert jaccard.boundary(sizes, 90, 100, 1e9) >= 50
    assert jaccard.boundary(sizes, 90, 100, 0.0) <= jaccard.boundary(sizes, 90, 100, 5.0)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.id: r.component for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_common_elements_joined_or_sent(spark, monkeypatch, most):
    """Elements that many sets share go last in the order, whether their list is sent to the tasks or joined."""
    monkeypatch.setattr(jaccard, "LONG", 4)
    monkeypatch.setattr(jaccard, "MOST_COMMON", most)
    rows = corpus(11, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, 3, 90, 100).collect())
    assert got == brute(rows, 3, 90, 100)


def test_hot_key_without_links(spark, monkeypatch):
    """Many sets of like size share half their elements and link with nothing: no link is made up or lost."""
    monkeypatch.setattr(jaccard, "LONG", 1000)  # what they share stays at the front
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, *(f"v{r.randrange(10**6)}" for _ in range(50))])) for i in range(200)]
    rows.append((900, rows[7][1].replace("w30", "changed")))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.join(docs, 3, 90, 100).collect())
    assert got == brute(rows, 3, 90, 100) and got[-1][2] == 7


def test_sketches_bound_the_difference():
    r = random.Random(2)
    import numpy as np

    for size in (3, 300, 3000):
        a = np.array([r.getrandbits(63) for _ in range(size)], dtype=np.int64)
        b = np.concatenate([a[size // 4 :], np.array([r.getrandbits(63) for _ in range(size // 3)], dtype=np.int64)])
        for bits in (jaccard.SKETCH, jaccard.WIDE):
            x, y = jaccard.sketch(a, bits), jaccard.sketch(b, bits)
            assert sum(int(v).bit_count() for v in (x ^ y).view("<u8").tolist()) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", 1, 2, 3), (1, "a b c d e f", 1, 2, 3)], "doc_id long, text string, gone int, __gone int, Gone_ int")
    assert [r.doc_id for r in jaccard.drop_near_copies(docs).collect()] == [1]
