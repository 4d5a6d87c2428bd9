"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes."""

from __future__ import annotations

import hashlib
import math
import re
import tempfile
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webdistill.llm import common, worker

_TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are terms beside whole words.
STARTS = (4, 5, 6)
BLOCK = 64


def terms_of(word: str) -> tuple[str, ...]:
    """A word's terms: itself, and its beginnings (marked ``^``)."""
    return (word, *(f"^{word[:n]}" for n in STARTS if len(word) >= n))


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def unit(weights: dict[int, float]) -> dict[int, float]:
    norm = math.sqrt(sum(x * x for x in weights.values()))
    return {t: x / norm for t, x in weights.items()} if norm else {}


#: Terms in ascending order and their weights.
Vector = tuple[np.ndarray, np.ndarray]


def arrays(vector: dict[int, float] | Vector) -> Vector:
    if isinstance(vector, tuple):
        return vector
    terms = np.array(sorted(vector), dtype=np.int64)
    return terms, np.array([vector[t] for t in terms.tolist()], dtype=np.float64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + size - 1`` of each range, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _pieces(sizes: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """From which to before which vector, so that a piece has one vector or at most ``most`` postings."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b
        a = b


def _room(n: int, kind: type) -> np.ndarray:
    """An array in a temporary file of its own, for what is passed on but shouldn't stay in memory."""
    with tempfile.TemporaryFile() as file:
        return np.asarray(np.memmap(file, kind, "w+", shape=n)) if n else np.zeros(0, dtype=kind)


class BlockMaxIndex:
    """Postings of unit vectors by term in blocks of examples, with each block's largest weight of each term.

    Examples alike in their most frequent terms (those of one language) stand together. Within such a group, terms of more
    than one in ``COMMON`` of its examples have a weight for each of them (``heads`` gives the scores by these), all
    others a list of the examples that have them. ``search`` first scores the blocks that promise most. No member of
    another block can exceed its largest score by common terms plus the sum of the query's other weights times the
    block's largest ones, so only blocks whose bound reaches the k-th score found are scored after them: the result is
    exact. Ties go to the earlier example.

    A posting is one 64-bit number, the example's place above its weight's 32 bits. Pickled, the index is its postings
    alone: what search adds (``prepare``) is made where it is used.
    """

    FIRST = 8
    COMMON = 16
    GROUPS = 4
    FREQUENT = 256
    WORTH = 4

    def __init__(self, vectors: list[dict[int, float] | Vector], n_terms: int):
        found = [arrays(v) for v in vectors]
        terms = np.concatenate([t for t, _ in found] or [np.zeros(0)]).astype(np.int32, copy=False)
        xs = np.concatenate([x for _, x in found] or [np.zeros(0)]).astype(np.float32, copy=False)
        sizes = np.array([len(t) for t, _ in found], dtype=np.int64)
        self._build(np.cumsum(sizes) - sizes, sizes, terms, xs, n_terms)

    @classmethod
    def of(cls, starts: np.ndarray, sizes: np.ndarray, terms: np.ndarray, xs: np.ndarray, n_terms: int) -> BlockMaxIndex:
        """From all terms and weights, and where each vector's start and how many they are. Terms and weights may lie in
        files: they are read a piece at a time."""
        self = cls.__new__(cls)
        self._build(starts, sizes, terms, xs, n_terms)
        return self

    def _build(self, starts: np.ndarray, sizes: np.ndarray, terms: np.ndarray, xs: np.ndarray, n_terms: int) -> None:
        self.n, self.blocks = len(sizes), max(1, -(-len(sizes) // BLOCK))
        group = self._grouped(starts, sizes, terms, xs, n_terms)
        self.order = np.argsort(group, kind="stable")  # the example in each place
        self.place = np.empty(self.n, dtype=np.int64)
        self.place[self.order] = np.arange(self.n)
        members = np.bincount(group, minlength=len(self.centres))
        self.bounds = np.concatenate([[0], np.cumsum(members)])
        df = np.zeros((len(members), n_terms), dtype=np.int64)
        for a, b in _pieces(sizes):
            of, piece = np.repeat(group[a:b], sizes[a:b]), terms[_ranges(starts[a:b], sizes[a:b])]
            for g in np.unique(of).tolist():
                df[g] += np.bincount(piece[of == g], minlength=n_terms)
        self.row = np.full((len(members), n_terms), -1, dtype=np.int32)
        for g, n in enumerate(members):
            common = np.flatnonzero((df[g] * self.COMMON > n) & (df[g] >= 8))
            self.row[g, common] = np.arange(len(common))
        self.ends = np.concatenate([[0], np.cumsum(np.where(self.row < 0, df, 0).sum(axis=0))])
        n_common = int(df.sum() - self.ends[-1])
        del df
        self.posts = _room(int(self.ends[-1]), np.int64)
        self.common = _room(n_common, np.int32), _room(n_common, np.int64)
        free, taken = self.ends[:-1].copy(), 0
        for a, b in _pieces(sizes[self.order]):  # in order of places, so they ascend within a term
            own = self.order[a:b]
            at = _ranges(starts[own], sizes[own])
            piece, posts = terms[at], np.repeat(np.arange(a, b), sizes[own]) << 32
            posts |= xs[at].view(np.uint32)
            rows = self.row[np.repeat(group[own], sizes[own]), piece]
            dense = rows >= 0
            more = taken + np.count_nonzero(dense)
            self.common[0][taken:more], self.common[1][taken:more], taken = rows[dense], posts[dense], more
            piece, posts = piece[~dense], posts[~dense]
            order = np.argsort(piece, kind="stable")
            seen, n = np.unique(piece, return_counts=True)
            self.posts[_ranges(free[seen], n)] = posts[order]
            free[seen] += n
        self.tables = None

    def _grouped(self, starts: np.ndarray, sizes: np.ndarray, terms: np.ndarray, xs: np.ndarray, n_terms: int) -> np.ndarray:
        """A group for each example by its weights of the ``FREQUENT`` most frequent terms: spherical k-means from seeds far apart."""
        df = np.zeros(n_terms, dtype=np.int64)
        for a, b in _pieces(sizes):
            df += np.bincount(terms[_ranges(starts[a:b], sizes[a:b])], minlength=n_terms)
        top = np.argsort(-df, kind="stable")[: self.FREQUENT]
        self.column = np.full(n_terms, -1, dtype=np.int32)
        self.column[top] = np.arange(len(top))
        x = np.zeros((self.n, len(top)), dtype=np.float32)
        for a, b in _pieces(sizes):
            own = _ranges(starts[a:b], sizes[a:b])
            at = self.column[terms[own]]
            x[np.repeat(np.arange(a, b), sizes[a:b])[at >= 0], at[at >= 0]] = xs[own[at >= 0]]
        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
        full, draw = np.flatnonzero(x.any(axis=1)), np.random.default_rng(0)
        centres = x[full[:1]] if len(full) else np.zeros((1, len(top)), dtype=np.float32)
        while len(centres) < min(self.GROUPS, len(full)):
            far = np.maximum(1 - (x[full] @ centres.T).max(axis=1), 1e-9).astype(np.float64) ** 2
            centres = np.concatenate([centres, x[full[draw.choice(len(full), 1, p=far / far.sum())]]])
        for _ in range(8):
            group = np.argmax(x @ centres.T, axis=1) if self.n else np.zeros(0, dtype=np.int64)
            for g in range(len(centres)):
                if (group == g).any():
                    centres[g] = x[group == g].mean(axis=0)
            centres /= np.maximum(np.sqrt((centres * centres).sum(axis=1, keepdims=True)), 1e-9)
        self.centres = centres
        return np.argmax(x @ centres.T, axis=1) if self.n else np.zeros(0, dtype=np.int64)

    def group_of(self, query: Vector) -> int:
        """The group most like a query: queries of one group are cheaper to score together."""
        at = self.column[query[0]]
        return int(np.argmax(self.centres[:, at[at >= 0]] @ query[1][at >= 0]))

    def __getstate__(self):
        if self.tables is not None:
            raise ValueError("an index is sent before it is prepared")
        return self.__dict__

    def prepare(self) -> BlockMaxIndex:
        """Weights of common terms by group, and each block's largest weights."""
        if self.tables is None:
            row, posts = self.common
            self.tables = []
            for g, (a, b) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)):
                table = np.zeros((int(self.row[g].max(initial=-1)) + 1, b - a), dtype=np.float32)
                own = (posts >= a << 32) & (posts < b << 32)
                table[row[own], (posts[own] >> 32) - a] = _weights(posts[own])
                self.tables.append(table)
            self.common = None
            self.sizes = np.diff(self.ends)
            self.runs = None
            if self._n_runs() * self.WORTH <= len(self.posts):
                self._bounds()
        return self

    def _n_runs(self) -> int:
        """Runs of a term's postings within a block, counted a piece at a time."""
        total = len(np.unique(self.ends[:-1][self.sizes > 0]))
        for a in range(0, len(self.posts) - 1, 1 << 18):
            block = self.posts[a : a + (1 << 18) + 1] // (BLOCK << 32)
            inner = np.flatnonzero(block[1:] != block[:-1]) + a + 1
            total += len(inner) - np.count_nonzero(np.isin(inner, self.ends))
        return total

    def _bounds(self) -> None:
        """Each block's largest weight of each term; not made where blocks hold too few postings of a term for bounds to pay."""
        block = (self.posts // (BLOCK << 32)).astype(np.int32)
        starts = np.zeros(len(block) + 1, dtype=bool)  # where each run of a term within a block begins
        starts[self.ends] = True
        starts[1:-1] |= block[1:] != block[:-1]
        first = np.flatnonzero(starts[:-1])
        self.block = block[first]
        self.most = np.maximum.reduceat(_weights(self.posts), first) if len(first) else np.zeros(0, dtype=np.float32)
        self.first = np.append(first, len(block)).astype(np.int32)
        self.runs = np.searchsorted(first, self.ends)  # where each term's runs begin

    @property
    def dense(self) -> np.ndarray:
        """Terms that some group has a weight of for each of its examples."""
        return np.flatnonzero((self.row >= 0).any(axis=0))

    def heads(self, queries: list[Vector]) -> np.ndarray:
        """Each query's scores by common terms of all places."""
        self.prepare()
        out = np.zeros((len(queries), self.blocks * BLOCK), dtype=np.float32)
        terms, weights = (np.concatenate([q[i] for q in queries]) for i in (0, 1))
        of = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        for g, table in enumerate(self.tables):
            rows = self.row[g][terms]
            some = np.flatnonzero(rows >= 0)
            rows = rows[some]
            used = np.zeros(len(table), dtype=bool)
            used[rows] = True
            n = np.count_nonzero(used)
            if n * 2 < len(table):  # mostly another group's queries
                rows, table = (np.cumsum(used) - 1)[rows], table[used]
            if n:
                x = np.zeros((len(queries), len(table)), dtype=np.float32)
                x[of[some], rows] = weights[some]
                np.matmul(x, table, out=out[:, self.bounds[g] : self.bounds[g + 1]])
        return out

    def search(self, query: dict[int, float] | Vector, k: int, skip: int | tuple[int, int] = -1, head: np.ndarray | None = None, prune: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above zero, and the cosines; an example, or those from one to before another, are left out."""
        terms, x = arrays(query)
        skip = (skip, skip + 1) if isinstance(skip, int) else skip
        skipped = self.place[skip[0] : skip[1]] if skip[1] > skip[0] >= 0 else []
        head = self.heads([(terms, x)])[0] if head is None else head
        rare = self.sizes[terms] > 0
        terms, weights = terms[rare], x[rare]
        at, scores = self._pruned(head.reshape(self.blocks, BLOCK), terms, weights, k, skipped) if prune else (None, None)
        self.helped = at is not None
        if at is None:  # most blocks are left: all in one go
            scores = head.astype(np.float64)
            if len(terms):
                posts = self.posts[_ranges(self.ends[terms], self.sizes[terms])]
                scores += np.bincount(posts >> 32, np.repeat(weights, self.sizes[terms]) * _weights(posts), len(head))
            scores[skipped] = 0
            most = scores.reshape(self.blocks, BLOCK).max(axis=1)  # k blocks' largest scores are k scores
            least = np.partition(most, self.blocks - k)[self.blocks - k] if self.blocks > k else 0.0
            at = np.flatnonzero(scores >= least - 1e-5)
            scores = scores[at]
        if len(scores) > k:
            near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-5)
            at, scores = at[near], scores[near]
        at, scores = at[scores > 1e-6], scores[scores > 1e-6]
        ids = self.order[at]
        best = np.lexsort((ids, -np.round(scores, 6)))[:k]
        return ids[best], scores[best]

    def _pruned(self, head: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Places and scores of the blocks that can hold the k best; None if that is over half of the blocks, or bounds would cost more than scores."""
        if self.runs is None:
            return None, None
        sizes = self.runs[terms + 1] - self.runs[terms]
        if sizes.sum() * self.WORTH > self.sizes[terms].sum():  # too few postings a block: bounds cost more than scores
            return None, None
        runs, x = _ranges(self.runs[terms], sizes), np.repeat(weights, sizes)
        block = self.block[runs]
        bound = head.max(axis=1) + np.bincount(block, x * self.most[runs], self.blocks)
        order = np.argsort(-bound, kind="stable")
        ids, scores = self._score(head, runs, x, block, order[: self.FIRST], skip)
        least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else 0.0
        more = order[self.FIRST :]
        more = more[(bound[more] >= least - 1e-5) & (bound[more] > 0)]
        if len(more) * 2 > self.blocks:
            return None, None
        if len(more):
            more_ids, more_scores = self._score(head, runs, x, block, more, skip)
            ids, scores = np.concatenate([ids, more_ids]), np.concatenate([scores, more_scores])
        return ids, scores

    def _score(self, head: np.ndarray, runs: np.ndarray, x: np.ndarray, block: np.ndarray, blocks: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = np.zeros(self.blocks, dtype=bool)
        wanted[blocks] = True
        keep = wanted[block]
        runs, x = runs[keep], x[keep]
        sizes = self.first[runs + 1] - self.first[runs]
        posts = self.posts[_ranges(self.first[runs], sizes)]
        scores = (head + np.bincount(posts >> 32, np.repeat(x, sizes) * _weights(posts), head.size).reshape(head.shape))[blocks].ravel()
        ids = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        scores[np.isin(ids, skip)] = 0
        return ids, scores


def _weights(posts: np.ndarray) -> np.ndarray:
    return posts.astype("<i8", copy=False).view("<f4")[::2]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is one of a word."""
    out = np.zeros(0x110000, dtype=bool)
    for m in _TOKEN.finditer("".join(map(chr, range(0x110000)))):
        out[m.start() : m.end()] = True
    return out


def word_keys(texts: list[str], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """64-bit keys of the words of lower-cased texts, and the numbers of their texts: ``(n, of, keys)`` for the first n
    letters of the words that long, n in ``STARTS``, and at the end ``(0, of, keys)`` of whole words of up to ``longest`` letters."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.concatenate([[False], _letters()[codes], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, length = edges[::2], np.diff(edges)[::2]
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, "right")
    keys = np.zeros(len(begin), dtype=np.uint64)
    long, begin_of, h = np.arange(len(begin)), begin, keys
    for j in range(min(int(length.max(initial=0)), max(longest, *STARTS))):
        if j:
            keys[long] = h
            more = length[long] > j
            long, begin_of, h = long[more], begin_of[more], h[more]
        h = (h ^ codes[begin_of + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if j + 1 in STARTS:
            yield j + 1, of[long], (h ^ np.uint64(j + 1)) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
    keys[long] = h
    whole = length <= longest
    yield 0, of[whole], keys[whole] * np.uint64(0x94D049BB133111EB) | np.uint64(1)


class Vocabulary:
    """Numbers of terms by 64-bit keys, in an open table in which whole arrays are looked up at once."""

    def __init__(self, terms: list[str]):
        keys = np.zeros(len(terms), dtype=np.uint64)
        whole = [i for i, t in enumerate(terms) if t[0] != "^"]
        self.longest = max((len(terms[i]) for i in whole), default=0)
        for n in (0, *STARTS):
            some = [i for i, t in enumerate(terms) if len(t) == n + 1 and t[0] == "^"] if n else whole
            for m, of, found in word_keys([terms[i].lstrip("^") for i in some], self.longest):
                if m == n:
                    keys[np.array(some, dtype=np.int64)[of]] = found
        bits = max(4, (2 * len(terms)).bit_length())
        self.shift, self.mask, self.probes = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys, self.numbers = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int32)
        slot, left = (keys >> self.shift).astype(np.int64), np.arange(len(terms))
        while len(left):
            at = (slot[left] + self.probes) & self.mask
            free = np.flatnonzero(self.keys[at] == 0)
            at, first = np.unique(at[free], return_index=True)
            taken = free[first]
            self.keys[at], self.numbers[at] = keys[left[taken]], left[taken]
            left = np.delete(left, taken)
            self.probes += 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of the term of each key, or -1."""
        at = (keys >> self.shift).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == keys, self.numbers[at], -1)
        left = np.flatnonzero((found != keys) & (found != 0))
        for p in range(1, self.probes):
            if not len(left):
                break
            next_at = (at[left] + p) & self.mask
            found, wanted = self.keys[next_at], keys[left]
            hit = found == wanted
            out[left[hit]] = self.numbers[next_at[hit]]
            left = left[~hit & (found != 0)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted monotone fit of y on x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, weighted sum, first x, last x
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        pools.append([c, b * c, a, a])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0] or pools[-2][3] == pools[-1][2]):
            c, s, _, last = pools.pop()
            pools[-1][0] += c
            pools[-1][1] += s
            pools[-1][3] = last
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    ys = np.array([v for p in pools for v in ((p[1] + 0.5) / (p[0] + 1),) * 2])
    return xs, np.maximum.accumulate(ys) if len(ys) else ys


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that few texts lie in a worker as Python's own objects at a time."""
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def text_key(text: str | None) -> int:
    """The same for texts that differ in case at most: 64 bits of a digest."""
    return int.from_bytes(hashlib.blake2b((text or "").lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), signed=True)


@dataclass
class Model:
    """What ``fit`` learns: an index of at most ``limit`` examples and the vocabulary of their texts, whatever the corpus."""

    terms: Vocabulary
    weights: np.ndarray
    example_ids: list
    example_keys: list[int]  # of equal texts equal, in order
    labels: list[int]
    sent: Broadcast | None
    k: int
    none_rate: float
    knots: tuple[np.ndarray, np.ndarray]

    @property
    def index(self) -> BlockMaxIndex | None:
        """Sent to each worker once, for fitting and scoring alike; a task's function names it beside the model."""
        return self.sent.value if self.sent else None

    def __getstate__(self):
        return self.__dict__ | {"sent": None}

    def vectors(self, texts: list[str | None]) -> list[Vector]:
        """Unit TF-IDF vectors over the model's terms: (1 + log tf) * weight. Texts are taken some at a time, each whole."""
        out: list[Vector] = []
        while len(out) < len(texts):
            part, size = [], 0
            for text in texts[len(out) : len(out) + 512]:
                part.append((text or "").lower())
                size += len(part[-1])
                if size > 1 << 19:
                    break
            of, found = [], []
            for _, texts_of, keys in word_keys(part, self.terms.longest):
                number = self.terms.find(keys)
                known = number >= 0
                of.append(texts_of[known])
                found.append(number[known])
            pairs = np.sort(np.concatenate(of) << 32 | np.concatenate(found))
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, dtype=np.int64)
            tf = np.diff(np.append(first, len(pairs)))
            text, terms = pairs[first] >> 32, pairs[first] & 0xFFFFFFFF
            x = (1 + np.log(tf)) * self.weights[terms]
            x /= np.sqrt(np.bincount(text, x * x, len(part)))[text]
            ends = np.searchsorted(text, np.arange(len(part) + 1)).tolist()
            out += [(terms[a:b], x[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return out

    def vector(self, text: str | None) -> Vector:
        return self.vectors([text])[0]

    def examples_of(self, text: str | None) -> tuple[int, int]:
        """From which to before which example those of an equal text are."""
        key = text_key(text)
        return bisect_left(self.example_keys, key), bisect_right(self.example_keys, key)

    def votes(self, vectors: list[Vector], texts: list[str | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Of each vector the share of label 1 among the nearest examples, each weighing the inverse of its distance; the
        examples and cosines. Examples of an equal text are left out: a document's own label has no say in its vote, and equal
        texts have equal votes whatever their ids."""
        classes, none = np.array(self.labels), (self.none_rate, np.zeros(0, dtype=np.int64), np.zeros(0))
        for start in range(0, len(vectors), 1024):
            part, out, index = vectors[start : start + 1024], {}, self.index
            by_group = sorted(range(len(part)), key=[index.group_of(v) for v in part].__getitem__) if index else []
            for at in range(0, len(by_group), 256):
                batch = by_group[at : at + 256]
                for j, (i, head) in enumerate(zip(batch, index.heads([part[i] for i in batch]), strict=True)):
                    skip = self.examples_of(texts[start + i])
                    prune = j % 16 == 0 or index.helped  # not where the last bounds left most blocks
                    found, cosines = index.search(part[i], self.k, skip, head, prune)
                    if len(found):
                        w = 1 / (np.sqrt(np.maximum(0, 2 - 2 * cosines)) + 0.1)
                        out[i] = float((w * classes[found]).sum() / w.sum()), found, cosines
            yield from (out.get(i, none) for i in range(len(part)))

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list, list[float]]]:
        """Of each text the score, and the nearest examples' ids and cosines."""
        xs, ys = self.knots
        votes = (v for a in range(0, len(texts), 1024) for v in self.votes(self.vectors(texts[a : a + 1024]), texts[a : a + 1024]))
        for vote, found, cosines in votes:
            score = float(np.clip(np.interp(vote, xs, ys) if len(xs) else vote, 0, 1)) if len(found) else self.none_rate
            yield score, [self.example_ids[i] for i in found.tolist()], cosines.tolist()

    def score(self, text: str | None) -> tuple[float, list, list[float]]:
        """Of one text."""
        return next(self.scores([text]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = 12_000, least_df: int = 5, k: int = 15, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from labelled documents.

    ``learn`` is a condition on ``doc_id`` of the rows that may be learned from. Of each label at most ``limit`` / 2
    examples are used, those of the smallest hash of the id: this bounds the model and is no limit on what is scored.
    All terms of ``least_df`` or more examples are in the vectors, those of either label and of none. Beside its idf a
    term weighs the square root of one plus its log-likelihood ratio to the label (about one by chance), so that what
    tells the labels apart counts more than the subject of a text, and how much of a text it makes up counts too.
    Null ids, labels other than 0 and 1 and labels of unknown documents are left out; of repeated labels one counts.
    """
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).where(learn)
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit // 2) for y in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")  # at most `limit` ids
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.held("toxicity")
        kinds = (0, *STARTS)
        df = {(y, n): Counter() for y in (0, 1) for n in kinds}
        for batch in batches:
            for text, y in ((a.as_py(), b.as_py()) for a, b in zip(batch.column(0), batch.column(1), strict=True)):
                words = set(tokens(text))
                for n in kinds:
                    df[y, n].update({w[:n] for w in words if len(w) >= n} if n else words)
        for n in kinds:
            found = [*df[0, n].keys() | df[1, n].keys()]
            for i in range(0, len(found), 50_000):
                part = found[i : i + 50_000]
                names = pa.array([f"^{t}" for t in part] if n else part, pa.string())
                yield pa.RecordBatch.from_arrays([names, *(pa.array([df[y, n][t] for t in part], pa.int64()) for y in (0, 1))], ["term", "n0", "n1"])

    texts = saved = common.save(texts.select("doc_id", "text", "y"), "toxicity-examples")  # read once
    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model(Vocabulary([]), np.zeros(0), [], [], [], None, k, (n1 + 0.5) / (n0 + n1 + 1) if n0 + n1 else 0.5, (np.zeros(0), np.zeros(0)))
    texts = texts.repartition(max(1, min(48, (n0 + n1) // 250)), "doc_id")
    counted = texts.select("text", "y").mapInArrow(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= least_df)
    plus = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(F.lit(0.0))
    all_n, df = F.lit(n0 + n1), F.col("n0") + F.col("n1")
    cells = [plus(F.col("n0"), df * n0 / all_n), plus(F.col("n1"), df * n1 / all_n), plus(n0 - F.col("n0"), (all_n - df) * n0 / all_n), plus(n1 - F.col("n1"), (all_n - df) * n1 / all_n)]
    ratio = F.lit(2.0) * (cells[0] + cells[1] + cells[2] + cells[3])
    found = counted.select("term", "n0", "n1", ratio.alias("r")).orderBy("term").toArrow()
    rate0, rate1 = total.get(0, n0) / n0, total.get(1, n1) / n1  # documents that an example stands for
    every = rate0 * n0 + rate1 * n1
    have0, have1, ratios = (found[c].to_numpy() for c in ("n0", "n1", "r"))
    weights = np.log(1 + every / (rate0 * have0 + rate1 * have1)) * np.sqrt(1 + np.maximum(0, ratios))
    model = Model(Vocabulary(found["term"].to_pylist()), weights, [], [], [], None, k, 0.0, (np.zeros(0), np.zeros(0)))
    del found
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the texts of `limit` examples

    def vectors(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker.held("toxicity")
        for f in frames:
            made = shared.value.vectors(f["text"].tolist())
            yield pd.DataFrame({"doc_id": f["doc_id"], "key": [text_key(t) for t in f["text"]], "y": f["y"], "t": [t.astype(np.int32).tobytes() for t, _ in made], "x": [x.astype(np.float32).tobytes() for _, x in made]})

    examples = common.save(texts.mapInPandas(vectors, f"doc_id {kind}, key long, y int, t binary, x binary"), "toxicity-vectors")
    sizes, rows_of, none = [], [], Counter()
    with tempfile.TemporaryFile() as ts, tempfile.TemporaryFile() as xs:  # at most `limit` vectors, a part at a time
        for row in examples.toLocalIterator():
            if not len(row["t"]):
                none[row["y"]] += 1
                continue
            ts.write(row["t"])
            xs.write(row["x"])
            rows_of.append((row["key"], row["doc_id"], row["y"]))
            sizes.append(len(row["t"]) // 4)
        common.drop(spark, examples)
        model.none_rate = (rate1 * none[1] + rate1 * n1 / every) / (rate0 * none[0] + rate1 * none[1] + 1)
        if sizes:
            ts.flush()
            xs.flush()
            order = sorted(range(len(sizes)), key=rows_of.__getitem__)
            model.example_keys, model.example_ids, model.labels = ([rows_of[i][k] for i in order] for k in range(3))
            made = (np.asarray(np.memmap(f, kind_of, "r")) for f, kind_of in ((ts, np.int32), (xs, np.float32)))
            index = BlockMaxIndex.of((np.cumsum(sizes) - sizes)[order], np.array(sizes)[order], *made, len(weights))
    if sizes:
        model.sent = spark.sparkContext.broadcast(index)
        del index
        worker.give_back()
        learned, sent = spark.sparkContext.broadcast(model), model.sent

        def without_itself(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker.held("toxicity")
            known = learned.value
            known.sent = sent
            for batch in sliced(batches):
                texts_of = batch.column(0).to_pylist()
                made = known.vectors(texts_of)
                some = [i for i, (t, _) in enumerate(made) if len(t)]
                own = [vote for vote, _, _ in known.votes([made[i] for i in some], [texts_of[i] for i in some])]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(some, pa.int64())), pa.array(own, pa.float64())], ["y", "vote"])

        votes = texts.select("text", "y").mapInArrow(lambda batches: worker.trimmed(without_itself(batches)), "y int, vote double").toArrow()
        learned.destroy()
        y = votes["y"].to_numpy().astype(float)
        model.knots = isotonic(votes["vote"].to_numpy(), y, np.where(y == 1, rate1, rate0))
    shared.destroy()
    common.drop(spark, saved)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, evidence`` of every whole text: the nearest examples' ids and cosines are the evidence.

    Examples whose text equals a document's, case aside, are left out of its neighbours, so that its label has no part in
    its score; ids have none either.
    Texts without any of the model's terms (null and empty ones too) have the rate of label 1 among such examples, or
    among all where there are none.
    Repeated rows are scored each.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared, sent = docs.sparkSession.sparkContext.broadcast(model), model.sent  # bounded by the texts of `limit` examples

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.held("toxicity")
        known = shared.value
        known.sent = sent
        for batch in sliced(batches):
            found, ids, cosines = list(known.scores(batch.column(1).to_pylist())), [], []
            ends = [0]
            for _, e, c in found:
                ids += e
                cosines += c
                ends.append(len(ids))
            evidence = pa.StructArray.from_arrays([pa.array(ids, batch.column(0).type), pa.array(cosines, pa.float64())], ["example", "cosine"])
            evidence = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), evidence)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _, _ in found], pa.float64()), evidence], ["doc_id", "score", "evidence"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: worker.trimmed(run(batches)), f"doc_id {kind}, score double, evidence array<struct<example {kind}, cosine double>>")


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3. A null id is empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def rate(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **more) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` of every document."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")), **more)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
