"""Byte-level BPE with forced-boundary splitting, and its decoder."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdistill.llm import worker
from webdistill.llm.encoding import SPACE, Encoder, byte_chars, packed

FLUSH = 8 << 20
#: The published pre-tokenization of byte-level vocabularies of this family.
_PRE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class ForcedBoundaryBPE:
    """Encode and decode by vocabulary and merges alone.

    ``inside`` holds every pair of bytes that occurs next to each other inside any token. A token is never made over
    any other pair, so between such bytes a cut is certain: merges on its two sides can't meet. Pre-tokens are cut
    there, the fragments are merged independently, and the ids are joined.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_chars())}
        raw = lambda token: bytes(back[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(spec["model"]["merges"])}
        self.inside = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.tokens = [b""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for t, i in [*self.ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.tokens[i] = t
        self.encoder = Encoder(path, word=lambda w: packed(self.pre_token(w.encode())), piece=self.piece)
        if not self.encoder.keeps_space:
            raise ValueError("a byte-level vocabulary whose pre-tokenizer keeps white space is needed")

    def fragments(self, data: bytes) -> list[bytes]:
        out, begin = [], 0
        for i in range(1, len(data)):
            if data[i - 1 : i + 1] not in self.inside:
                out.append(data[begin:i])
                begin = i
        out.append(data[begin:])
        return out

    def merge(self, fragment: bytes) -> list[int]:
        whole = self.ids.get(fragment) if len(fragment) == 1 else None
        if whole is not None:
            return [whole]
        parts, rank = [fragment[i : i + 1] for i in range(len(fragment))], self.ranks.get
        if len(parts) > 64:
            return self.merge_long(parts)
        ranks = [rank(p, 1 << 60) for p in zip(parts, parts[1:])]
        while ranks:
            k = min(ranks)
            if k == 1 << 60:
                break
            i = ranks.index(k)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), 1 << 60)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), 1 << 60)
        return [self.ids[p] for p in parts]

    def merge_long(self, parts: list[bytes]) -> list[int]:
        """The same with a heap, for fragments whose length makes repeated scans slow."""
        import heapq

        n, rank = len(parts), self.ranks.get
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []
        for i in range(n - 1):
            if (k := rank((parts[i], parts[i + 1]))) is not None:
                heap.append((k, i, parts[i], parts[i + 1]))
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j], after[i] = a + b, True, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (k := rank((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (k, x, parts[x], parts[y]))
        return [self.ids[p] for p, g in zip(parts, gone, strict=True) if not g]

    def pre_token(self, data: bytes) -> list[int]:
        out: list[int] = []
        for f in self.fragments(data):
            out += self.merge(f)
        return out

    def plain(self, text: str) -> list[int]:
        out: list[int] = []
        for t in _PRE.findall(text):
            out += self.pre_token(t.encode())
        return out

    def piece(self, text: str) -> bytes:
        out, at = [], 0
        for m in self._special.finditer(text) if self._special else ():
            out += self.plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return packed(out + self.plain(text[at:]))

    def encode(self, text: str | None) -> bytes:
        return self.encoder.encode(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def codec(path: str) -> ForcedBoundaryBPE:
    return worker.held("codec", path, lambda: ForcedBoundaryBPE(path))


def _mapped(df: DataFrame, schema: str, source: str, target: str, make) -> DataFrame:
    """Append a column made from another, row by row, in batches of bounded bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            at, held, size = 0, [], 0
            for k, value in enumerate(batch.column(source)):
                held.append(f(value.as_py()))
                size += len(held[-1] or b"")
                if size >= FLUSH or k == batch.num_rows - 1:
                    part = batch.slice(at, len(held))
                    kept = [c for c in part.schema.names if c != source or target != source]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(held)], [*kept, target])
                    at, held, size = k + 1, [], 0

    return df.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids BINARY`` (little-endian unsigned 32-bit) of every whole text; null and empty texts have none.

    Repeated rows stay; other columns are not carried.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("ids"))
    return _mapped(rows, f"doc_id {kind}, ids binary", "ids", "ids", lambda: codec(vocabulary).encode)


def decode_documents(rows: DataFrame, vocabulary: str) -> DataFrame:
    """Add ``decoded STRING`` to ``doc_id, ids``: bytes that aren't UTF-8 become U+FFFD; null ids stay null."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _mapped(rows.select("doc_id", "ids"), f"doc_id {kind}, ids binary, decoded string", "ids", "decoded", lambda: lambda x: None if x is None else codec(vocabulary).decode(x))
