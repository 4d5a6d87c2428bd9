"""Cost-balanced packing of token sequences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdistill.llm.tokens import encoder

#: Tokens that a task gathers before it packs them.
BUFFER = 4 << 20


def assign(lengths: list[int], room: int, sizes: list[int], linear: float = 1.0, quadratic: float = 1.0) -> list[list[tuple[int, int]]]:
    """Deal pieces out to sequences of the given sizes; per piece its parts as (sequence, length).

    Pieces are taken in descending length; each goes to the sequence of lowest cost (``linear`` a token and
    ``quadratic`` over ``room`` a pair of tokens that attend to each other) that has room for all of it. Where none
    has, the lowest-cost sequence with any room takes what fits and the rest is dealt out in turn, so every sequence
    is filled: the sizes must sum to the lengths at least. Ties go to the earlier piece and the earlier sequence.
    """
    cost, free = np.zeros(len(sizes)), np.array(sizes, dtype=np.int64)
    out: list[list[tuple[int, int]]] = [[] for _ in lengths]
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        left = lengths[k]
        while left:
            fits = free >= left
            if not fits.any():
                fits = free > 0
            s = int(np.argmin(np.where(fits, cost, np.inf)))
            n = min(left, int(free[s]))
            out[k].append((s, n))
            free[s] -= n
            cost[s] += linear * n + quadratic * n * n / room
            left -= n
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, room: int = 4096, id_col: str = "doc_id", text_col: str = "text", linear: float = 1.0, quadratic: float = 1.0, buffer: int = BUFFER) -> DataFrame:
    """Pack whole documents into sequences of at most ``room`` tokens.

    Returns one row per piece: ``doc_id, start, length, ids BINARY (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset``. A null or empty text is the end id alone; repeated rows are packed each; other columns are
    not carried. No shuffle: each task packs the documents it reads, ``buffer`` tokens at a time. Documents longer than
    a sequence first fill whole ones. Tokens over a multiple of ``room`` wait for the next buffer; a task's last ones
    go to sequences whose lengths are powers of two, which need no padding.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    tail = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, 40 << 20).encode
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 40
        held: list[tuple] = []  # doc_id, start, ids, doc_tokens
        total = 0
        id_type = None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (id_type, *(pa.int64(),) * 2, pa.binary(), *(pa.int64(),) * 3), strict=True)], names
            )

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, total, next_id
            sizes, rest = [room] * (total // room), total % room
            if last:
                sizes += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
                rest = 0
            kept: list[tuple] = []
            while rest:  # the latest pieces wait
                d, start, ids, n = held.pop()
                have = len(ids) // 4
                if have > rest:
                    held.append((d, start, ids[: 4 * (have - rest)], n))
                    start, ids, have = start + have - rest, ids[4 * (have - rest) :], rest
                kept.append((d, start, ids, n))
                rest -= have
            found, filled = [], [0] * len(sizes)
            for (d, start, ids, n), parts in zip(held, assign([len(x[2]) // 4 for x in held], room, sizes, linear, quadratic), strict=True):
                at = 0
                for s, k in parts:
                    found.append((d, start + at, k, ids[4 * at : 4 * (at + k)], n, next_id + s, filled[s]))
                    filled[s] += k
                    at += k
            next_id += len(sizes)
            held, total = kept[::-1], sum(len(x[2]) // 4 for x in kept)
            for i in range(0, len(found), 4096):
                yield rows(found[i : i + 4096])

        for batch in batches:
            id_type = batch.column(0).type
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc(text.as_py()) + tail
                n = len(ids) // 4
                whole = n // room if n > room else 0
                if whole:
                    for i in range(0, whole, 256):
                        yield rows([(d, j * room, room, ids[4 * j * room : 4 * (j + 1) * room], n, next_id + j, 0) for j in range(i, min(whole, i + 256))])
                    next_id += whole
                if n > whole * room:
                    held.append((d, whole * room, ids[4 * whole * room :], n))
                    total += n - whole * room
                if total >= buffer:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
