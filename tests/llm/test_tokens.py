"""Ops 2, 3 and 10 against brute force by the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from webdistill.llm import bpe, common, packing, tokens
from webdistill.llm.encoding import Encoder, packed

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PARTS = ["a", "The", "é", "'s", "'", "  ", " ", "\n", "\t", "<|endoftext|>", "<|startoftext|>", "1", "23", "Σ", "İ", "é", " ", "\x1c", "　", "漢字", "🙂", ".", ",", "\r\n", "ß", "thinwhtion", "\xa0", "!!", "'re", "²"]


def texts(n=400, seed=3):
    r = random.Random(seed)
    out = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return [*out, "", " ", "a ", " a", "\n", "x" * 3000, "a  b", "a \n b", " ".join(r.choice(PARTS) for _ in range(20_000)), out[5], out[5]]


def frame(spark, found, extra=False):
    rows = [(i, t, 7) for i, t in enumerate(found)] + [(10_000, None, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(path):
    t, e, small = Tokenizer.from_file(path), Encoder(path), Encoder(path, cache=8)
    for x in texts(4000):
        want = packed(t.encode(x, add_special_tokens=False).ids)
        assert e.encode(x) == want and small.encode(x) == want, repr(x)


def test_forced_boundary_bpe(spark):
    t, found = Tokenizer.from_file(BYTE), texts()
    rows = {r.doc_id: r for r in bpe.decode_documents(bpe.encode_documents(frame(spark, found), BYTE), BYTE).collect()}
    assert len(rows) == len(found) + 1 and rows[10_000].ids == b""
    for i, x in enumerate(found):
        ids = t.encode(x, add_special_tokens=False).ids
        assert bytes(rows[i].ids) == packed(ids), repr(x)
        assert rows[i].decoded == t.decode(ids, skip_special_tokens=False)


def test_long_fragments_merge_alike():
    c = bpe.ForcedBoundaryBPE(BYTE)
    r = random.Random(1)
    for _ in range(50):
        f = bytes(r.choice(b"abth eion") for _ in range(200))
        t = [f[i : i + 1] for i in range(len(f))]
        assert sum(map(len, (c.tokens[i] for i in c.merge_long(t)))) == 200
    w = "thetionther" * 30
    assert c.encode(w) == packed(Tokenizer.from_file(BYTE).encode(w, add_special_tokens=False).ids)


def test_orc_round_trip(spark):
    t, found = Tokenizer.from_file(BYTE), texts(100)
    path = common.new_path(spark, "t")
    tokens.write_orc(frame(spark, found), path, BYTE, end_id=0)
    rows = {r.doc_id: r for r in tokens.starts(tokens.checksums(tokens.read_orc(spark, path))).collect()}
    at = 0
    for i in [*range(len(found)), 10_000]:
        ids = (t.encode(found[i], add_special_tokens=False).ids if i < len(found) else []) + [0]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), zlib.crc32(packed(ids)))
        at += len(ids)
    one = tokens.read_orc(spark, path).where("doc_id = 3")
    assert "EqualTo(doc_id,3)" in one._jdf.queryExecution().toString() and one.count() == 1


def test_orc_of_nothing(spark):
    path = common.new_path(spark, "t")
    tokens.write_orc(frame(spark, []).where("false"), path, BYTE, end_id=0)
    assert tokens.starts(tokens.checksums(tokens.read_orc(spark, path))).count() == 0


def test_packing(spark):
    t, found = Tokenizer.from_file(WORD), texts()
    rows = packing.pack(frame(spark, found), WORD, end_id=2, room=512, buffer=4000).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert len(by) == len(found) + 1
    for i in [*range(len(found)), 10_000]:
        ids = (t.encode(found[i], add_special_tokens=False).ids if i < len(found) else []) + [2]
        own = sorted(by[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == packed(ids)
        assert [r.start for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
        assert {r.doc_tokens for r in own} == {len(ids)}
    for own in seq.values():
        own.sort(key=lambda r: r.offset)
        n = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
        assert n == 512 or (n < 512 and n & (n - 1) == 0)


def test_assignment_is_by_cost():
    parts = packing.assign([5, 4, 3, 3], 10, [10, 10])
    assert parts == [[(0, 5)], [(1, 4)], [(1, 3)], [(0, 3)]]


def test_queries_are_registered():
    import __spark_entry__

    assert {"op2_cost_balanced_packing", "op3_orc_token_ids", "op10_forced_boundary_bpe"} <= set(__spark_entry__.queries())


def test_hashes_of_query(spark):
    import __spark_entry__

    t = Tokenizer.from_file(BYTE)
    d = "/root/testdata/sf0.001"
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in __spark_entry__.queries()["op10_forced_boundary_bpe"](spark, d).collect():
        assert r.ids_sha256 == hashlib.sha256(packed(want[r.doc_id])).hexdigest() and r.n_tokens == len(want[r.doc_id])


def test_files_follow_each_other_by_smallest_id(spark):
    """``part-100000`` sorts before ``part-99999`` by name: starts go by the files' smallest ids; null ids come first."""
    rows = [("part-99999", 1, 5, 0), ("part-100000", 7, 3, 0), ("part-100000", 9, 2, 0), ("part-0", None, 4, 0)]
    found = spark.createDataFrame(rows, "file string, doc_id long, n_tokens long, ids_crc32 long")
    assert {r.doc_id: r.start for r in tokens.starts(found).collect()} == {None: 0, 1: 4, 7: 9, 9: 12}


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cuts_at_stops_commas_and_line_ends(path):
    parts = [" ", "\n", ".", ",", "..", "...", "Word", "é", "İ", "क़", "_", "'s", "x,y", "3.14", "***", "\0", " .", "\r", "’t", "a" * 400]
    r, t, e = random.Random(8), Tokenizer.from_file(path), Encoder(path)
    for _ in range(4000):
        x = "".join(r.choices(parts, k=r.randint(1, 10)))
        assert e.encode(x) == packed(t.encode(x, add_special_tokens=False).ids), repr(x)


def test_cache_is_bounded_by_bytes():
    e = Encoder(BYTE, cache=240 * 50)
    for i in range(2000):
        e.encode(f"w{i} " + "x" * (i % 300))
        assert len(e.cache) + len(e.cache.old) <= 100 and max(map(len, e.cache), default=0) <= e.cache.LONG


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, WORD, 2).count() == 0
    assert bpe.decode_documents(bpe.encode_documents(none, BYTE), BYTE).count() == 0


def test_assignment_against_brute_force():
    """Each piece in descending order to the cheapest sequence with room for it, by plain loops."""
    r = random.Random(5)
    for _ in range(50):
        sizes = [64] * r.randint(1, 6)
        lengths, left = [], sum(sizes)
        while left:
            lengths.append(min(left, r.randint(1, 64)))
            left -= lengths[-1]
        free, cost, want = list(sizes), [0.0] * len(sizes), {k: [] for k in range(len(lengths))}
        for k in sorted(want, key=lambda k: (-lengths[k], k)):
            todo = lengths[k]
            while todo:
                some = [s for s in range(len(sizes)) if free[s] >= todo] or [s for s in range(len(sizes)) if free[s]]
                s = min(some, key=lambda s: (cost[s], s))
                n = min(todo, free[s])
                want[k].append((s, n))
                free[s], cost[s], todo = free[s] - n, cost[s] + n + n * n / 64, todo - n
        assert packing.assign(lengths, 64, sizes) == [want[k] for k in range(len(lengths))]
