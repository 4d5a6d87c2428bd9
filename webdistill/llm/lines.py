"""Line deduplication by site-relative frequency. Native DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdistill.llm import common


#: Bytes of boilerplate hashes that may be broadcast.
MOST_BROADCAST = 32 << 20


def boilerplate(docs: DataFrame, ratio: float, least: int, host_col: str, text_col: str) -> DataFrame:
    """``host, drops``: per host the hashes of lines that more than ``ratio`` of its pages, and ``least`` or more, contain.

    A page counts once for a line it repeats. Lines without a visible character are no boilerplate. A host has fewer
    than its mean number of distinct lines divided by ``ratio`` such lines, so ``drops`` stays small whatever its pages.
    """
    rows = docs.select(F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.xxhash64(x)))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    counts = rows.select("host", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    common = counts.join(totals, counts["host"].eqNullSafe(totals["host"])).where(F.col("n") > ratio * F.col("pages"))
    return common.groupBy(counts["host"].alias("host")).agg(F.collect_set("line").alias("drops"))


def drop_boilerplate(docs: DataFrame, ratio: float = 0.1, least: int = 5, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """All of ``docs`` with boilerplate lines taken out of the text, and ``n_lines``, ``n_dropped`` added.

    Lines are parted by line feeds. Null texts stay null and have no lines; a null host is a host of its own. Rows that
    repeat are pages each. Input columns named like an added one are replaced. Hosts of fewer than ``least`` pages lose
    no line. Texts aren't shuffled: hosts with boilerplate and its hashes go to them, which their measured size allows;
    where it doesn't, texts are joined by host, and Spark splits large hosts.
    """
    host, drops, kept = (common.unused(docs, x) for x in ("host", "drops", "kept"))
    found = common.save(boilerplate(docs, ratio, least, host_col, text_col).select(F.col("host").alias(host), F.col("drops").alias(drops)), "boilerplate")
    size = found.agg(F.sum(F.octet_length(F.coalesce(F.col(host).cast("string"), F.lit(""))) + 8 * F.size(drops) + 64)).first()[0] or 0
    keep = F.filter(F.split(text_col, "\n"), lambda x: ~F.coalesce(F.array_contains(F.col(drops), F.xxhash64(x)), F.lit(False)))
    out = docs.drop("n_lines", "n_dropped").join(F.broadcast(found) if size <= MOST_BROADCAST else found, F.col(host_col).eqNullSafe(F.col(host)), "left")
    out = out.withColumn(kept, keep)
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n")))
    out = out.withColumn("n_lines", n.cast("long")).withColumn("n_dropped", F.when(F.col(text_col).isNull(), 0).otherwise(F.col("n_lines") - F.size(kept)).cast("long"))
    return out.withColumn(text_col, F.array_join(kept, "\n")).drop(host, drops, kept)


#: DuckDB SQL of the same over ``documents``, with the lines themselves in place of their hashes.
SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, text FROM documents),
l AS (SELECT source, unnest(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS line FROM d),
c AS (SELECT source, line, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= {least}),
h AS (SELECT source, count(*) AS pages FROM d GROUP BY ALL),
b AS (SELECT c.source, list(line) AS drops FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE n > {ratio} * pages GROUP BY ALL),
k AS (SELECT doc_id, text, string_split(text, chr(10)) AS all_lines,
  list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(drops, []), x)) AS kept
  FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(all_lines) END AS n_lines,
  CASE WHEN text IS NULL THEN 0 ELSE len(all_lines) - len(kept) END AS n_dropped,
  md5(array_to_string(kept, chr(10))) AS text_md5
FROM k
"""
