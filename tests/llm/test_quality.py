"""Op 4 against brute force."""

import re
from collections import Counter

import numpy as np

import corpus_pipeline
from webdistill.llm import quality, queries


def brute(text):
    words = re.findall("[^ \t\n\x0b\x0c\r]+", text or "")
    n = len(words)
    seen = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    hit = set()
    for i in range(n - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_counts():
    r = np.random.default_rng(1)
    for _ in range(300):
        text = "".join(r.choice(["a", "b", "cé", " ", " ", " ", "\n", "#", "|", "\xa0", "\t", "\x1f"]) for _ in range(r.integers(0, 200)))
        assert quality.counts(text)[:5] == brute(text)
    assert quality.counts(None)[:5] == brute(None)


def test_chi_square():
    assert abs(quality.chi_square(0.95) - 9.4877) < 1e-3 and abs(quality.chi_square(0.75) - 5.3853) < 1e-3


def test_outliers_of_each_group_go(spark):
    r = np.random.default_rng(2)
    word = lambda k: "".join(r.choice(list("abcdefgh"), k))
    rows = []
    for i in range(900):
        lang, source = ("en", "de", None)[i % 3], ("s", "t", None)[i // 3 % 3]
        words = [word(r.integers(3, 9) + (4 if lang == "de" else 0)) for _ in range(r.integers(25, 300))]
        junk = i % 15 == 0
        rows.append((i, " ".join(w + "$$$" if junk else w for w in words), lang, source, "x"))
    rows += [(1000, None, "en", "s", "x"), (1001, "", None, None, "x"), (1002, "too few words", "en", "s", "x"), (1003, "a b c d e f g h " * 9, "en", "s", "x"), rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string").repartition(3)
    got = [r for r in quality.judge(docs).collect()]
    assert len(got) == len(rows) and sum(r.doc_id == 7 for r in got) == 2
    for r in got:
        want = r.doc_id < 900 and r.doc_id % 15 != 0
        assert r.kept == want, r
        assert r.base_failed == (r.doc_id >= 1000)
    texts = {x[0]: x[1] for x in rows}
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]) for r in got)


def test_nothing(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_estimate_equals_brute_force(spark):
    """Steps of concentration on one group against numpy."""
    r = np.random.default_rng(5)
    rows = [(i, " ".join("x" * int(k) + ("#" if r.random() < 0.02 else "") for k in r.integers(2, 9, 60)), "en", "s") for i in range(400)]
    got = {x.doc_id: x.distance for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), starts=1, steps=4).collect()}
    c = np.array([quality.counts(t) for _, t, _, _ in rows], dtype=float)
    mean = c[:, 1] / c[:, 0]
    mid = np.sort(mean)[199]
    z = np.stack([(mean - mid) / np.sqrt(0.0625 + 9 / c[:, 0]), np.sqrt(c[:, 2] / c[:, 0]) / 0.15, np.sqrt(c[:, 3] / np.maximum(c[:, 5], 1)) / 0.25, np.sqrt(c[:, 4] / c[:, 0]) / 0.25], axis=1)
    m, w = np.sort(z, axis=0)[199], np.eye(4)
    half = quality.chi_square(0.75)
    factor = 0.75 / quality._gamma_share(3, half)
    for _ in range(4):
        d = np.einsum("ni,ij,nj->n", z - m, w, z - m)
        near = z[d <= np.sort(d)[299]]
        m, w = near.mean(0), np.linalg.inv(np.cov(near.T, bias=True) * factor + np.eye(4))
    d = np.einsum("ni,ij,nj->n", z - m, w, z - m)
    assert np.allclose(d, [got[i] for i in range(400)], rtol=1e-6, atol=1e-6)


def test_menus_and_repeated_lines_go(spark, tmp_path):
    """Menus with a bar after every second word, and texts of which most lines are repeated short ones, in op4 and the pipeline."""
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("abcdefgh"), r.integers(3, 9)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(r.integers(60, 200))]
        if i % 30 == 1:
            words = [w + " |" * (k % 2) for k, w in enumerate(words)]
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        if i % 30 == 2:
            lines = [x for k, line in enumerate(lines) for x in (line, *["read more"] * 2)]
        rows.append((i, "\n".join(lines), "en", "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_robust_outliers(spark, str(tmp_path)).collect()
    want = {i for i in range(600) if i % 30 not in (1, 2)}
    assert not any(x.base_failed for x in got)
    assert {x.doc_id for x in got if x.kept} == want
    assert {x.doc_id for x in corpus_pipeline.outliers(spark, docs, str(tmp_path)).collect()} == want


def test_scatter_decides_and_smallest_determinant_wins(spark):
    """Two statistics that go together: the same distance from the centre along them is common, across them an outlier,
    which an estimate without scatter wouldn't tell apart. Of all starts the estimate of least determinant is used."""
    r = np.random.default_rng(7)
    rows = []
    for i in range(600):
        k = int(r.integers(0, 25))  # symbols and repeated lines rise together
        lines = ["".join("x" * int(n) + " " for n in r.integers(2, 9, 8)) + f"u{j}" for j in range(40)]
        lines[: k // 2] = ["same line | here"] * (k // 2)
        rows.append((i, "\n".join(lines) + " |" * k, "en", "s"))
    plain = ["".join("x" * int(n) + " " for n in r.integers(2, 9, 8)) + f"u{j}" for j in range(40)]
    rows.append((1000, "\n".join(["another same line"] * 20 + plain[20:]), "en", "s"))  # repeated lines alone
    rows += [(1001, None, "en", "s"), (1002, "", None, None), (1003, "word " * 200_000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    z = quality.judge(docs, floor=0.1)
    got = {x.doc_id: x for x in z.collect()}
    assert len(got) == len(rows) and not any(got[i].kept for i in (1001, 1002, 1003)) and got[1003].base_failed
    assert not got[1000].kept and got[1000].distance > max(got[i].distance for i in range(600))
    assert np.mean([got[i].kept for i in range(600)]) > 0.85


def test_more_starts_never_raise_the_determinant(spark):
    r = np.random.default_rng(2)
    z = spark.createDataFrame([(i, "g", *(float(x) for x in r.normal(size=4) * (3 if i % 3 else 0.5))) for i in range(900)], ["doc_id", "grp", *quality.DIMS])
    dets = []
    for starts in (1, 4):
        e = quality._starts(z, 0.1, starts)
        for _ in range(3):
            e = quality._concentrated(z, e, 0.75, 0.1, 1.0)
        dets.append(quality._least(e).collect()[0].logdet)
    assert dets[1] <= dets[0] + 1e-9


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
