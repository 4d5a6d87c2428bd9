"""Exact top-k search by inner product over an impact-ordered score-at-a-time index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webdistill.llm import common

#: Pairs of query and vector that are scored at a time.
TILE = (512, 4096)


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v ARRAY<BIGINT>``: each component is floor(scale * x).

    Rows with a null id, a null or empty vector, or a null or non-finite component take no part. Repeated rows count once.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x")).where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & ~F.exists("x", bad))
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v")).distinct()


class Index:
    """Posting segments of a block of vectors, by descending quantised impact.

    A component's impact is quantised to its number of bits; a segment holds the postings (vector, dimension, component)
    of one impact. Segments are scored for all queries of a tile at a time, highest impact first. What later segments can
    add to a score is at most the product of the query's norm and that of the vector's components yet to come. A query is
    done once no vector outside its possible members can reach its k-th certain score; these are rescored exactly.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        size = np.abs(self.vectors)
        bits = np.ceil(np.log2(size + 1.0)).astype(np.int64)
        self.levels = [int(b) for b in sorted(np.unique(bits), reverse=True) if b]
        self.segments, self.rest = [], []
        for b in self.levels:
            self.segments.append(np.where(bits == b, self.vectors, 0))
            self.rest.append(np.sqrt(np.where(bits < b, self.vectors, 0).astype(np.float64) ** 2 @ np.ones(vectors.shape[1])))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per query its id and the k best vectors' ids and scores (all, if fewer), its own id left out; ties to smaller ids."""
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * queries.shape[1]
        kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        own_from, own_to = np.searchsorted(self.ids, query_ids, "left"), np.searchsorted(self.ids, query_ids, "right")
        members: list[np.ndarray | None] = [None] * len(query_ids)
        scores = np.zeros((len(query_ids), len(self.ids)), dtype=kind)
        left = np.arange(len(query_ids))
        for segment, rest in zip(self.segments, self.rest, strict=True):
            scores[left] += queries[left].astype(kind) @ segment.T.astype(kind)
            if len(self.ids) <= 4 * k:
                continue
            slack = norms[left, None].astype(np.float32) * np.nextafter(rest.astype(np.float32), np.float32(np.inf))[None, :] * np.float32(1.00001)
            now = scores[left].astype(np.float32 if kind == np.float32 else np.float64)
            low = now - slack
            for i, q in enumerate(left):
                low[i, own_from[q] : own_to[q]] = -np.inf
            certain = np.partition(low, len(self.ids) - k, axis=1)[:, len(self.ids) - k]
            # one unit of room for what rounding can take away
            possible = now + slack >= (certain - 1 - np.abs(certain) * 1e-6)[:, None]
            few = possible.sum(axis=1) <= max(8 * k, len(self.ids) // 50)
            for i in np.flatnonzero(few):
                members[left[i]] = np.flatnonzero(possible[i])
            left = left[~few]
            if not len(left):
                break
        for q, found in enumerate(members):
            if found is None:  # every segment was scored: the scores are exact
                found = np.arange(len(self.ids))
                exact = scores[q]
                if len(found) > 4 * k:
                    line = exact.copy().astype(np.float64)
                    line[own_from[q] : own_to[q]] = -np.inf
                    found = np.flatnonzero(exact >= np.partition(line, len(line) - k)[len(line) - k])
            found = found[(found < own_from[q]) | (found >= own_to[q])]
            exact = self.vectors[found] @ queries[q]
            best = np.lexsort((self.ids[found], -exact))[:k]
            yield int(query_ids[q]), self.ids[found][best], exact[best]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    if len(ends) > 1 and (np.diff(ends) == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(ends) - 1, width), dtype=np.int64)
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each query with all other rows.

    ``is_query`` is a condition on ``vec_id``. A query's candidates are all rows but those of its own id; vectors of
    different lengths are compared as if the shorter had zeros at its end. Ties go to the smaller id.

    The stated queries meet all rows in blocks: queries and vectors are each dealt into blocks of equal size, and each
    task searches one block of the index for one block of queries; the blocks' best are then ranked per query.
    """
    rows = quantised(vectors, scale, id_col, vector_col)
    rows = common.save(rows, "quantised")
    n, m = rows.count(), rows.where(is_query).count()
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    n_blocks = max(1, math.ceil(n / min(32_768, max(1024, n // 16))) if n else 1)
    q_blocks = max(1, math.ceil(m / 4096))
    block = lambda count, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.where(is_query).select("vec_id", "v", block(q_blocks, 1).alias("q"), every(n_blocks).alias("b"))
    right = rows.select("vec_id", "v", block(n_blocks, 2).alias("b"), every(q_blocks).alias("q"))

    def search(queries: pa.Table, block_rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(block_rows):
            ids, found = block_rows["vec_id"].to_numpy(), _matrix(block_rows["v"], width)
            qids, wanted = queries["vec_id"].to_numpy(), _matrix(queries["v"], width)
            for a in range(0, len(ids), TILE[1]):
                index = Index(ids[a : a + TILE[1]], found[a : a + TILE[1]])
                for c in range(0, len(qids), TILE[0]):
                    out += [(np.full(len(i), q), i, s) for q, i, s in index.search(qids[c : c + TILE[0]], wanted[c : c + TILE[0]], k)]
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        q, i, s = columns
        order = np.lexsort((i, -s, q))  # of the tiles' best only the block's best go on
        q, i, s = q[order], i[order], s[order]
        begins = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(q)]]))) if len(q) else begins
        return pa.table({"query_id": q[place < k].astype(np.int64), "vec_id": i[place < k].astype(np.int64), "score": s[place < k].astype(np.int64)})

    best = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL of the same over ``embeddings``.
SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}
"""
