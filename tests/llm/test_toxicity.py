"""Op 5: the index against brute force, held-out accuracy and corner cases."""

import pickle
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from webdistill.llm import toxicity, worker


def test_index_is_exact():
    r = np.random.default_rng(1)
    make = lambda: toxicity.unit({int(t): float(x) for t, x in zip(r.choice(30, r.integers(1, 5), replace=False), r.random(5), strict=False)})
    vectors = [make() for _ in range(2000)]
    vectors += vectors[:50]
    index = toxicity.BlockMaxIndex(vectors, 30)
    for i in range(200):
        q, skip = (vectors[i], i) if i % 2 else (make(), -1)
        all_scores = [(round(-sum(x * float(np.float32(v.get(t, 0))) for t, x in q.items()), 6), j) for j, v in enumerate(vectors) if j != skip]
        want = [j for s, j in sorted(all_scores)[:15] if s < 0]
        assert index.search(q, 15, skip)[0].tolist() == want


def test_isotonic():
    xs, ys = toxicity.isotonic(np.array([0.0, 0.2, 0.2, 0.5, 1.0]), np.array([0, 1, 0, 0, 1.0]), np.ones(5))
    assert list(xs) == sorted(xs) and list(ys) == sorted(ys)


def test_held_out(spark):
    rows = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_accuracy_and_corner_cases(spark):
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("aeioutnsr"), r.integers(2, 9)))
    rows, labels = [], []
    for i in range(900):
        words, bad = [word() for _ in range(r.integers(5, 60))], i % 6 == 0
        if bad:
            words[:: max(1, len(words) // 3)] = [str(r.choice(["Grumble", "blasted", "zoggen" + word()])) for _ in words[:: max(1, len(words) // 3)]]
        rows.append((i, " ".join(words), 1))
        labels.append((i, int(bad), 1))
    rows += [(5000, None, 1), (5001, "", 1), (None, "grumble blasted grumble", 1), rows[3]]
    labels += [(7777, 1, 1), (None, 1, 1), (3, None, 1), labels[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.rate(docs, known).collect()
    assert len(got) == len(rows)
    test = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 900]
    assert np.mean([x.predicted == (x.doc_id % 6 == 0) for x in test]) > 0.97
    by = {x.doc_id: x for x in got}
    assert by[5000].predicted == by[5001].predicted == 0 and 0 <= by[5000].score < 0.5
    assert by[None].predicted == 1 and len(by[None].evidence) > 0 and not by[None].held_out


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert toxicity.rate(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()[0].predicted == 0
    assert toxicity.rate(docs.where("false"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_index_is_exact_with_common_and_rare_terms():
    r = np.random.default_rng(6)
    share = 1 / np.arange(1, 401) ** 1.1
    make = lambda: toxicity.unit({int(t): float(x) for t, x in zip(r.choice(400, 12, replace=False, p=share / share.sum()), r.random(12), strict=True)})
    vectors = [make() for _ in range(1500)]
    index = toxicity.BlockMaxIndex(vectors, 400)
    assert 0 < len(index.dense) < 400
    for i in range(100):
        q, skip = (vectors[i], i) if i % 2 else (make(), -1)
        all_scores = [(round(-sum(x * float(np.float32(v.get(t, 0))) for t, x in q.items()), 6), j) for j, v in enumerate(vectors) if j != skip]
        want = [j for s, j in sorted(all_scores)[:15] if s < 0]
        assert index.search(q, 15, skip)[0].tolist() == want


def test_stem_that_clean_texts_have_too(spark):
    """A stem of one language that clean texts also hold now and then still tells labels apart; clean texts have neighbours."""
    r = np.random.default_rng(8)
    rows, labels, mention = [], [], set()
    for i in range(2000):
        lang, bad = i % 4, i // 4 % 6 == 0
        word = lambda: "".join(r.choice(list(("aeiouns", "bcdfghk", "lmpqrtv", "wxyzäöü")[lang]), r.integers(2, 5)))  # noqa: B023, E731
        words = [word() for _ in range(r.integers(150, 300))]
        for at in range(0, 150, 30) if bad else [3] * (lang == 0 and i // 4 % 9 == 1):
            words[at] = ("boment", "zoggen", "grumbl", "blaste")[lang] + word()
            mention |= set() if bad else {i}
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    test = [x for x in toxicity.rate(docs, known).collect() if x.held_out]
    for lang in range(4):
        own = [x for x in test if x.doc_id % 4 == lang]
        assert np.mean([x.predicted for x in own if x.doc_id // 4 % 6 == 0]) > 0.9, lang
        assert np.mean([x.predicted for x in own if x.doc_id // 4 % 6 and x.doc_id not in mention]) < 0.05, lang
    assert all(len(x.evidence) == 15 for x in test)


def test_vectors_hold_every_term_of_whole_texts():
    """Vectors made from whole arrays against terms counted one by one; null, empty, odd and very long texts."""
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("aeioutnsßéñ日"), r.integers(1, 9)))
    texts = [" ".join(word() for _ in range(r.integers(0, 80))) for _ in range(300)]
    texts += [None, "", "İstanbul Ñandú 123abc_def ²x", "a" * 5000 + " aei", " ".join(word() for _ in range(120_000))]
    df = Counter(t for x in texts for w in set(toxicity.tokens(x)) for t in toxicity.terms_of(w))
    terms = sorted(t for t, n in df.items() if n >= 3)
    number = {t: i for i, t in enumerate(terms)}
    model = toxicity.Model(toxicity.Vocabulary(terms), np.arange(1.0, len(terms) + 1), [], [], [], None, 5, 0.0, (np.zeros(0), np.zeros(0)))
    for text, (got, x) in zip(texts, model.vectors(texts), strict=True):
        tf = Counter(number[t] for w in toxicity.tokens(text) for t in toxicity.terms_of(w) if t in number)
        want = toxicity.unit({t: (1 + np.log(n)) * (t + 1.0) for t, n in sorted(tf.items())})
        assert got.tolist() == list(want) and np.allclose(x, list(want.values()))


def test_scores_against_brute_force(spark):
    """Scores, votes and evidence from the model's vectors by plain loops; a document's own label has no say in its score."""
    r = np.random.default_rng(9)
    word = lambda: "".join(r.choice(list("aeioutn"), r.integers(2, 6)))
    rows = [(i, " ".join([word() for _ in range(r.integers(8, 40))] + ["grumble"] * (i % 5 == 0))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, ~toxicity.held_out(F.col("doc_id")), least_df=2)
    texts = dict(rows)
    vectors = [dict(zip(*(a.tolist() for a in model.vector(texts[i])), strict=True)) for i in model.example_ids]
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    for i, text in rows[::3]:
        q = dict(zip(*(a.tolist() for a in model.vector(text)), strict=True))
        cosines = [(-round(sum(w * v.get(t, 0.0) for t, w in q.items()), 6), j) for j, v in enumerate(vectors) if texts[model.example_ids[j]] != text]
        near = [(-c, j) for c, j in sorted(cosines)[: model.k] if c < -1e-6]
        weight = [1 / (np.sqrt(max(0, 2 - 2 * c)) + 0.1) for c, _ in near]
        vote = sum(w * model.labels[j] for w, (_, j) in zip(weight, near, strict=True)) / sum(weight)
        assert abs(got[i].score - np.clip(np.interp(vote, *model.knots), 0, 1)) < 1e-3
        assert np.allclose(sorted(e.cosine for e in got[i].evidence), sorted(c for c, _ in near), atol=1e-5)
        assert i not in [e.example for e in got[i].evidence]


def test_index_is_exact_where_bounds_are_used(monkeypatch):
    """The same with block maxima made and used however few postings a block has."""
    monkeypatch.setattr(toxicity.BlockMaxIndex, "WORTH", 0)
    test_index_is_exact()
    test_index_is_exact_with_common_and_rare_terms()


def test_ids_have_no_say(spark):
    """Equal texts have equal scores under any id, those of examples too; so do all texts when ids change places."""
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("aeioutn"), r.integers(2, 6)))
    rows = [(i, " ".join([word() for _ in range(r.integers(8, 40))] + ["grumble"] * (i % 5 == 0))) for i in range(300)]
    rows += [(1000 + i, t.upper() if i % 2 else t) for i, t in rows[:60]]  # copies that aren't labelled
    schema = "doc_id long, text string"
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, schema), labels, ~toxicity.held_out(F.col("doc_id")), least_df=2)
    assert model.example_keys == sorted(model.example_keys) and len(model.example_ids) > 150
    own = {x.doc_id: x.score for x in toxicity.score(spark.createDataFrame(rows, schema), model).collect()}
    assert all(own[1000 + i] == own[i] for i in range(60))
    moved = {x.doc_id: x.score for x in toxicity.score(spark.createDataFrame([(5000 - i, t) for i, t in rows], schema), model).collect()}
    assert moved == {5000 - i: x for i, x in own.items()}


def test_index_of_files_takes_little_memory(tmp_path):
    draw = np.random.default_rng(7)
    found = [np.unique((20_000 * draw.random(700) ** 3).astype(np.int32)) for _ in range(4_000)]
    sizes = np.array([len(t) for t in found])
    weights = draw.random(sizes.sum()).astype(np.float32)
    np.concatenate(found).tofile(tmp_path / "terms")
    weights.tofile(tmp_path / "weights")
    terms, xs = (np.asarray(np.memmap(tmp_path / name, kind, "r")) for name, kind in (("terms", np.int32), ("weights", np.float32)))
    tracemalloc.start()
    index = toxicity.BlockMaxIndex.of(np.cumsum(sizes) - sizes, sizes, terms, xs, 20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(terms)  # whole arrays of terms, ids, weights and postings took over 40 bytes each
    ends = np.cumsum(sizes)[:-1]
    whole = toxicity.BlockMaxIndex([*zip(found, np.split(weights, ends), strict=True)], 20_000)
    index, whole = pickle.loads(pickle.dumps(index)).prepare(), whole.prepare()
    assert np.array_equal(index.posts, whole.posts) and np.array_equal(index.ends, whole.ends)
    assert all(np.array_equal(a, b) for a, b in zip(index.tables, whole.tables, strict=True))
    for at in (0, 1_234, 3_999):
        query = found[at], np.split(weights, ends)[at].astype(float)
        scores = {i: float(weights_of[np.isin(t, query[0])].astype(float) @ query[1][np.isin(query[0], t)]) for i, (t, weights_of) in enumerate(zip(found, np.split(weights, ends), strict=True))}
        best = sorted(scores.values(), reverse=True)[:5]
        assert np.allclose(np.sort(index.search(query, 5)[1])[::-1], best, atol=1e-3)


def test_task_gives_memory_back_at_its_end(monkeypatch):
    seen = []
    monkeypatch.setattr(worker, "give_back", lambda: seen.append("back"))
    assert [*worker.trimmed(seen.append(i) or i for i in range(2))] == [0, 1] and seen == [0, 1, "back"]
