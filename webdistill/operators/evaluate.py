"""Evaluation of extracted texts against references, as joins and aggregates over tokens."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webdistill.functions.text import words


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), 0)


def reference_scores(pairs: DataFrame, id_col: str = "page_id", result_col: str = "result", reference_col: str = "reference") -> DataFrame:
    """Precision, recall and F1 of each row's result against its reference, over multisets of tokens; 1 where both are empty."""
    # both sides' tokens in one pass: a row without any keeps its place by a token of neither
    side = lambda c, n: F.transform(tokens(F.col(c)), lambda t: F.struct(t.alias("token"), F.lit(n).alias("side")))
    every = F.concat(side(result_col, 1), side(reference_col, 2), F.array(F.struct(F.lit("").alias("token"), F.lit(0).alias("side"))))
    counts = pairs.select(id_col, F.inline(every)).groupBy(id_col, "token").agg(F.count_if(F.col("side") == 1).alias("a"), F.count_if(F.col("side") == 2).alias("b"))
    out = counts.groupBy(id_col).agg(F.sum(F.least("a", "b")).alias("shared"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    safe = lambda x, y: F.when(F.coalesce(y, F.lit(0)) == 0, F.when(F.coalesce(x, F.lit(0)) == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce("shared", F.lit(0)) / y)
    out = out.select(id_col, safe(F.col("b"), F.col("a")).alias("precision"), safe(F.col("a"), F.col("b")).alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1)


def report(scores: DataFrame, category_col: str, dimensions: list[str]) -> DataFrame:
    """Means of each dimension by category and over all (category null), missing values left out."""
    return scores.rollup(category_col).agg(F.count("*").alias("n"), *(F.avg(d).alias(d) for d in dimensions))


def gate(now: DataFrame, baseline: DataFrame, id_col: str, dimensions: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows and dimensions that fell below the baseline, or that one of the two lacks."""
    long = lambda df, name: df.select(id_col, F.explode(F.create_map(*[x for d in dimensions for x in (F.lit(d), F.col(d).cast("double"))])).alias("dimension", name))
    both = long(now, "value").join(long(baseline, "expected"), [id_col, "dimension"], "full")
    return both.where(~F.col("value").eqNullSafe(F.col("expected")) & (F.col("value").isNull() | F.col("expected").isNull() | (F.col("value") < F.col("expected") - tolerance)))


def structure_retention(nodes: DataFrame, metrics: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Share of the source's paragraphs, headings, lists, tables and code that the result has; null where there are none."""
    n = lambda *tags: F.count_if(F.col("tag").isin(*tags))
    source = nodes.where("kind = 'element'").groupBy(id_col).agg(n("p").alias("p"), n("h1", "h2", "h3", "h4", "h5", "h6").alias("h"), n("ul", "ol").alias("l"), n("table").alias("t"), n("pre").alias("c"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    joined = metrics.join(source, id_col, "left")
    return joined.select(id_col, share("paragraph_count", "p").alias("paragraphs"), share("heading_count", "h").alias("headings"), share("list_count", "l").alias("lists"), share("table_count", "t").alias("tables"), share("code_block_count", "c").alias("code"))


def visible_text(markdown: Column) -> Column:
    """Markdown without its marks, destinations and fences."""
    out = F.regexp_replace(markdown, "(?m)^(```+|~~~+).*$", "")
    out = F.regexp_replace(out, "!?\\[((?:[^\\]\\\\]|\\\\.)*)\\]\\([^)]*\\)", "$1")
    out = F.regexp_replace(out, "(?m)^\\s*(?:#{1,6}|>|[-+*]|\\d+[.)])\\s+", "")
    out = F.regexp_replace(out, "(?m)^\\|?(?:\\s*:?-{3,}:?\\s*\\|)+\\s*$", "")
    out = F.regexp_replace(out, "\\*\\*|~~|(?<!\\\\)[*`|]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "\\\\(.)", "$1"), "\\s+", " "))


def order_kept(result: str | None, reference: str | None) -> float:
    """Share of the result's words found in the reference that stand in its order (longest increasing subsequence)."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words(reference or "")):
        places.setdefault(w, []).append(i)
    for found in places.values():
        found.reverse()
    at = [places[w].pop() for w in words(result or "") if places.get(w)]
    tails: list[int] = []
    for x in at:
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails) / len(at) if at else 1.0


def retained_order(pairs: DataFrame, id_col: str = "page_id", result_col: str = "result", reference_col: str = "reference") -> DataFrame:
    """``order_kept`` of each row."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([order_kept(x, y) for x, y in zip(a, b, strict=True)])

    return pairs.select(id_col, F.pandas_udf(run, "double")(result_col, reference_col).alias("order_kept"))
