"""Quality rules: base counts, and robust multivariate outliers per language and source."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webdistill.llm import common, worker

_WORDS = re.compile(r"[^ \t-\r]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8
#: Transformed statistics that the outlier rule sees.
DIMS = ("z_chars", "z_symbols", "z_dup", "z_repeat")
#: Least standard deviation that op4 and the pipeline allow a statistic, in units of a clean document's spread.
FLOOR = 0.5
D = len(DIMS)
_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes: dict[str, int] = {}
    x = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.uint64, count=len(words))
    if len(codes) == len(words):
        return 0
    with np.errstate(over="ignore"):  # spread the codes over 64 bits, then a polynomial over the window
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(window):
            h = h * np.uint64(0xD6E8FEB86659FD93) + x[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, np.flatnonzero(twice), 1)
    np.add.at(marks, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) of a text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = _WORDS.findall(text)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat_words(words), len(lines)


def statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """One row per document with its base counts; ``lang`` and ``source`` are empty for null. Texts are read once."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.held("quality")
        for batch in batches:
            found = np.array([counts(t.as_py()) for t in batch.column(3)], dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(found[:, k]) for k in range(len(names)))], ["doc_id", "lang", "source", *names])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text(lang_col).alias("lang"), text(source_col).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{n} long" for n in names))


def _gamma_share(k: int, x: float) -> float:
    """P(chi-square with 2k degrees of freedom <= x)."""
    term, total = 1.0, 0.0
    for i in range(k):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * total


def chi_square(p: float, dims: int = D) -> float:
    """The quantile of chi-square with an even number of degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_share(dims // 2, mid) < p else (low, mid)
    return low


def _distance() -> Column:
    """Squared Mahalanobis distance by the columns ``m{i}`` (centre) and ``w{i}{j}`` (inverse scatter)."""
    out = F.lit(0.0)
    for i, j in _PAIRS:
        out = out + F.lit(1.0 if i == j else 2.0) * F.col(f"w{i}{j}") * (F.col(DIMS[i]) - F.col(f"m{i}")) * (F.col(DIMS[j]) - F.col(f"m{j}"))
    return out


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(DIMS)), *(F.avg(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"s{i}{j}") for i, j in _PAIRS)]


def _inverted(moments: DataFrame, floor: float, factor: float) -> DataFrame:
    """Centre, inverse scatter and the scatter's log-determinant ``logdet`` of each group and start; ``floor`` squared is added to each variance."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = f[[f"m{i}" for i in range(D)]].to_numpy()
            s = np.zeros((len(f), D, D))
            for i, j in _PAIRS:
                s[:, i, j] = s[:, j, i] = f[f"s{i}{j}"].to_numpy() - m[:, i] * m[:, j]
            s = s * factor + np.eye(D) * floor**2
            inverse, logdet = np.linalg.inv(s), np.linalg.slogdet(s)[1]
            yield pd.DataFrame({"grp": f["grp"], "start": f["start"], "logdet": logdet, **{f"m{i}": m[:, i] for i in range(D)}, **{f"w{i}{j}": inverse[:, i, j] for i, j in _PAIRS}})

    return moments.mapInPandas(run, "grp string, start int, logdet double, " + ", ".join([*(f"m{i} double" for i in range(D)), *(f"w{i}{j} double" for i, j in _PAIRS)]))


def _small(rows: DataFrame) -> DataFrame:
    """A table of a row a group, to be broadcast if its measured size allows."""
    return F.broadcast(rows) if common.fits(rows) else rows


def _concentrated(z: DataFrame, estimate: DataFrame, share: float, floor: float, factor: float) -> DataFrame:
    """One concentration step of every group and start: the estimate from the ``share`` of documents nearest to the last one."""
    own = [c for c in estimate.columns if c not in ("grp", "start", "logdet")]
    near = z.select("grp", *DIMS).join(_small(estimate.drop("logdet")), "grp").withColumn("distance", _distance()).drop(*own)
    limits = common.save(near.groupBy("grp", "start").agg(F.percentile_approx("distance", share, 10_000).alias("limit")), "quality-limits")
    moments = near.join(_small(limits), ["grp", "start"]).where("distance <= limit").groupBy("grp", "start").agg(*_moments())
    return common.save(_inverted(moments, floor, factor), "quality-estimate")


def _least(estimate: DataFrame) -> DataFrame:
    """Of each group's starts that of the smallest determinant; ties go to the first."""
    kept = [c for c in estimate.columns if c != "grp"]
    return estimate.groupBy("grp").agg(F.min(F.struct("logdet", "start", *(c for c in kept if c not in ("logdet", "start")))).alias("x")).select("grp", *(F.col(f"x.{c}").alias(c) for c in kept))


def _starts(z: DataFrame, floor: float, starts: int) -> DataFrame:
    """First estimates: the group's medians with unit scatter, and moments of disjoint tenths of its documents by hash of their statistics."""
    medians = z.groupBy("grp").agg(*(F.percentile_approx(x, 0.5, 10_000).alias(f"m{i}") for i, x in enumerate(DIMS)))
    first = medians.select("grp", F.lit(0).alias("start"), F.lit(0.0).alias("logdet"), *(f"m{i}" for i in range(D)), *(F.lit(1.0 if i == j else 0.0).alias(f"w{i}{j}") for i, j in _PAIRS))
    if starts < 2:
        return first
    tenth = z.withColumn("start", F.pmod(F.xxhash64("doc_id", *DIMS), F.lit(10)).cast("int") + 1).where(F.col("start") < starts)
    return first.unionByName(_inverted(tenth.groupBy("grp", "start").agg(*_moments()), floor, 1.0))


def judge(docs: DataFrame, cutoff: float = 1e-4, share: float = 0.75, floor: float = 1.0, least: int = 100, steps: int = 10, starts: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``distance`` and ``kept`` of every document.

    Documents that fail the base rules (fewer than 20 words, or over 30 % of them in repeated windows) are not kept. The
    others of a language and source form a group; groups of fewer than ``least`` are pooled within the language, and
    those still smaller over all. A group's centre and scatter are minimum-covariance-determinant estimates: from each of
    ``starts`` first estimates (the medians with unit scatter, and the moments of disjoint tenths of the group) two
    concentration steps each take the ``share`` of all the group's documents nearest to the last estimate; the start
    of the smallest determinant goes on until no group's determinant falls any more, ``steps`` steps at most. A document
    is kept if its squared distance is at most the chi-square quantile of 1 - ``cutoff``. Medians and the shares' limits
    are of ``percentile_approx``, with an error of a ten-thousandth of the rows in rank.

    The statistics are transformed so that a clean document's spread is about one at any length: the mean word length
    against the group's median, over its sampling error; square roots of the ratios of symbols, repeated lines and
    repeated words. ``floor`` squared is added to each variance, so that statistics which most documents lack (a scatter
    of zero) don't make every other document an outlier. It bounds the distance: where most documents
    have neither, 37 % of repeated lines or 13 symbols to 100 words are outliers by themselves with ``FLOOR``; with a
    floor of 1 repeated lines never are. Groups meet nowhere in one task: estimates, of a row a group, are broadcast to
    the documents as long as their measured size allows, and each step sums up per task.
    A null text has no words; null languages and sources count as empty; repeated rows are judged each.
    """
    rows = common.save(statistics(docs, id_col, text_col, lang_col, source_col), "quality-statistics")
    n = F.col("n_words")
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    fit = rows.where(~failed)
    sizes = fit.groupBy("lang", "source").agg(F.count("*").alias("c"))
    per_lang = sizes.where(F.col("c") < least).groupBy("lang").agg(F.sum("c").alias("pool"))
    name = F.when(F.col("c") >= least, F.concat_ws("\x1f", F.lit("s"), "lang", "source")).when(F.col("pool") >= least, F.concat_ws("\x1f", F.lit("l"), "lang")).otherwise("all")
    names = common.save(sizes.join(per_lang, "lang", "left").select("lang", "source", name.alias("grp")), "quality-groups")
    mean = F.col("word_chars") / n
    named = fit.join(_small(names), ["lang", "source"]).withColumn("mean", mean)
    medians = common.save(named.groupBy("grp").agg(F.percentile_approx("mean", 0.5, 10_000).alias("mid")), "quality-medians")
    z = named.join(_small(medians), "grp").select(
        "*",
        ((F.col("mean") - F.col("mid")) / F.sqrt(F.lit(0.25**2) + 9 / n)).alias(DIMS[0]),
        (F.sqrt(F.col("n_symbols") / n) / 0.15).alias(DIMS[1]),
        (F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))) / 0.25).alias(DIMS[2]),
        (F.sqrt(F.col("n_repeat_words") / n) / 0.25).alias(DIMS[3]),
    )
    z = common.save(z.drop("mid", "mean"), "quality-vectors")
    half = chi_square(share)
    factor = share / _gamma_share(D // 2 + 1, half)  # makes the scatter of the nearest share that of all, for normal data
    estimate = common.save(_starts(z, floor, starts), "quality-estimate")
    for k in range(steps):
        new = _concentrated(z, estimate, share, floor, factor)
        if k < 2:
            estimate = common.save(_least(new), "quality-estimate") if k == 1 else new
            continue
        was = estimate.select("grp", F.col("logdet").alias("was"))
        falls = new.join(_small(was), "grp").where("logdet < was - 1e-9").limit(1).count()
        estimate = new if falls else estimate
        if not falls:
            break
    judged = z.join(_small(estimate.drop("start", "logdet")), "grp").withColumn("distance", _distance())
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    good = judged.select(*columns, F.lit(False).alias("base_failed"), "distance", (F.col("distance") <= chi_square(1 - cutoff)).alias("kept"))
    bad = rows.where(failed).select(*columns, F.lit(True).alias("base_failed"), F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return good.unionByName(bad)
