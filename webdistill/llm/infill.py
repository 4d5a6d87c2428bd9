"""Fill-in-middle transformation: a text cut in three, reordered so that a model learns to write the middle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks prefix, suffix and middle. None begins within another, so a part that ends like the start of a mark is no danger.
MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "struct<n bigint, prefix string, middle string, suffix string>"


def tokens(codes: np.ndarray) -> np.ndarray:
    """Where the tokens ``[A-Za-z]+|[^A-Za-z]`` of an array of code points begin."""
    letter = (codes | 32) - 97 < 26  # unsigned: what is below a wraps round
    starts = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.append(0, starts) if len(codes) else starts


def three(text: bytes, first: int, second: int) -> tuple[int, bytes, bytes, bytes]:
    """Number of tokens, and the text's parts up to, between and after the ranks ``first`` and ``second`` modulo number + 1."""
    codes = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    starts = tokens(codes)
    n = len(starts)
    a, b = (len(codes) if r == n else int(starts[r]) for r in sorted((first % (n + 1), second % (n + 1))))
    return n, *(x.tobytes().decode("utf-32-le").encode() for x in (codes[:a], codes[a:b], codes[b:]))


def cut(text: Column, first: Column, second: Column) -> Column:
    """Column of a text's number of tokens and its prefix, middle and suffix, cut at two drawn token boundaries.

    ``first`` and ``second`` are non-negative draws, taken modulo the number of tokens + 1; null draws count as 0. Null
    and empty texts have no tokens and three empty parts. Each row is cut by itself: repeated rows with the same draws
    are cut alike. Whole texts are read.
    """

    def run(texts: pa.Array, firsts: pa.Array, seconds: pa.Array) -> pa.Array:
        rows = [three(t.as_py() or b"", i or 0, j or 0) for t, i, j in zip(texts, firsts.to_pylist(), seconds.to_pylist(), strict=True)]
        n, *parts = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), *(pa.array(x, pa.binary()).cast(pa.string()) for x in parts)], ["n", "prefix", "middle", "suffix"])

    return F.arrow_udf(run, SCHEMA).asNondeterministic()(text.cast("binary"), first.cast("long"), second.cast("long"))


def draws(key: Column, seed: int, count: int = 4) -> list[Column]:
    """``count`` (8 at most) unsigned 32-bit numbers from the sha256 of ``seed:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(count)]


def form(text: Column, whether: Column, which: Column, rate: int = 90, spm: int = 20) -> Column:
    """``plain``, ``psm`` or ``spm``: of a hundred draws ``rate`` transform, of a hundred of those ``spm`` put the suffix first.

    Null and empty texts and texts with a mark of their own stay plain.
    """
    odd = (F.coalesce(F.length(text), F.lit(0)) == 0) | F.contains(text, F.lit(MARKS[0])) | F.contains(text, F.lit(MARKS[1])) | F.contains(text, F.lit(MARKS[2]))
    return F.when(odd | (whether % 100 >= rate), "plain").when(which % 100 < spm, "spm").otherwise("psm")


def arrange(kind: Column, text: Column, parts: Column) -> Column:
    """The text of a document in its form; a null text is empty."""
    p, s, m = (F.lit(x) for x in MARKS)
    psm = F.concat(p, parts["prefix"], s, parts["suffix"], m, parts["middle"])
    spm = F.concat(s, parts["suffix"], p, parts["prefix"], m, parts["middle"])
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(F.coalesce(text, F.lit("")))


def restore(kind: Column, output: Column) -> Column:
    """The text that ``arrange`` was given, from its output and form alone."""
    body = F.substr(output, F.lit(4))
    prefix, rest = _parted(body, MARKS[1])
    suffix, middle = _parted(rest, MARKS[2])
    suffix2, rest2 = _parted(body, MARKS[0])
    prefix2, middle2 = _parted(rest2, MARKS[2])
    return F.when(kind == "psm", F.concat(prefix, middle, suffix)).when(kind == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def _parted(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before the first mark, and after it."""
    before = F.substring_index(text, mark, 1)
    return before, F.substr(text, F.length(before) + F.lit(1 + len(mark)))


#: DuckDB SQL of the same over ``documents`` with the query's parameters; the restored text is the text itself.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS k,
  CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, len(k) AS n, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS a, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, array_to_string(k[1:a], '') AS p, array_to_string(k[a + 1:b], '') AS m, array_to_string(k[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
