"""Op 8 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from webdistill.llm import topk


def brute(vectors, k, is_query, scale):
    q = {i: np.floor(scale * np.array(v, dtype=np.float64)).astype(np.int64) for i, v in vectors}
    width = max(map(len, q.values()))
    q = {i: np.pad(v, (0, width - len(v))) for i, v in q.items()}
    out = []
    for i in sorted(x for x in q if is_query(x)):
        best = sorted((-int(q[i] @ v), j) for j, v in q.items() if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in vectors], "vec_id long, embedding array<float>, score int").repartition(3)


@pytest.mark.parametrize("scale", [64, 10_000_000])
def test_equals_brute_force(spark, scale):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 16))
    vectors = [(i, (centres[i % 6] + 0.3 * r.normal(size=16)).astype(np.float32)) for i in range(700)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(60)] + [(2000, np.zeros(16)), (2001, [1.0, -1.0])]
    docs = frame(spark, vectors).unionByName(frame(spark, vectors[:3]))
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(docs, F.col("vec_id") % 20 == 0, 7, scale).collect())
    assert got == brute([(i, np.float32(v)) for i, v in vectors], 7, lambda x: x % 20 == 0, scale)


def test_rows_without_a_vector_take_no_part(spark):
    rows = [(0, [1.0]), (20, None), (1, []), (2, [None]), (3, [float("nan")]), (4, [float("inf")]), (None, [1.0]), (5, [2.0]), (40, [0.5])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(docs, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 5, 8192), (0, 2, 40, 2048), (40, 1, 5, 4096), (40, 2, 0, 2048)]
    assert topk.top_k(docs.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_search_stops_early_and_stays_exact():
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 32)) + 4 * r.normal(size=(20, 32))[r.integers(0, 20, 4000)]
    v = np.floor(16 * x).astype(np.int64)
    index = topk.Index(np.arange(4000), v)
    for q, ids, scores in index.search(np.arange(0, 4000, 200), v[::200], 10):
        exact = v @ v[q]
        want = sorted((-int(s), i) for i, s in enumerate(exact) if i != q)[:10]
        assert [(-int(s), int(i)) for i, s in zip(ids, scores, strict=True)] == want
