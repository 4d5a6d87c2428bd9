"""Queries over ``pages`` that the driver runs, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webdistill.functions.extract import Options
from webdistill.functions.parser import Budget
from webdistill.operators import evaluate, kernels
from webdistill.operators import pages as P
from webdistill.streaming import pages as streaming


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> P.PageFrame:
    """Pages for the kernels, over all cores."""
    return P.PageFrame(_table(spark, sf_dir)).balanced()


def _shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the master is local and none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return (found or "file://" + tempfile.mkdtemp(prefix="webdistill-")).rstrip("/")


def extract_pages(spark, sf_dir):
    flat = _pages(spark, sf_dir).extract()
    m = "page.metadata."
    return flat.select("page_id", m + "title", m + "site_name", m + "language", m + "description", "page.metrics.word_count", "page.markdown", F.col("page.error.kind").alias("error_kind"))


def extract_flat(spark, sf_dir):
    return _pages(spark, sf_dir).flat()


def extract_plain_options(spark, sf_dir):
    """No links, no images, lines of 80 characters."""
    return _pages(spark, sf_dir).extract(Options(links=False, images=False, max_line_width=80)).select("page_id", "page.markdown")


def extract_content_root(spark, sf_dir):
    return _pages(spark, sf_dir).extract(Options(content_root=("tag", "article"))).select("page_id", "page.text", F.col("page.error.kind").alias("error_kind"))


def extract_diagnostics(spark, sf_dir):
    page = _pages(spark, sf_dir).extract(Options(diagnostics=True))
    return page.select("page_id", F.explode("page.diagnostics").alias("a")).groupBy("a.strategy", "a.accepted").agg(F.count("*").alias("n"))


def raw_titles(spark, sf_dir):
    return _pages(spark, sf_dir).texts_in("title").select("page_id", F.col("text").alias("title"))


def headings(spark, sf_dir):
    return _pages(spark, sf_dir).texts_in("h1").select("page_id", F.col("text").alias("heading"))


def element_counts(spark, sf_dir):
    c = lambda t: F.count_if(F.col("tag") == t).alias(f"n_{t}")
    return _pages(spark, sf_dir).nodes().groupBy("page_id").agg(c("p"), c("li"), c("nav"), c("article"), c("footer"), c("div"))


def languages(spark, sf_dir):
    return _pages(spark, sf_dir).extract().select("page_id", F.col("page.metadata.language").alias("language"))


def site_names(spark, sf_dir):
    return _pages(spark, sf_dir).extract().select("page_id", F.col("page.metadata.site_name").alias("site_name"), F.col("page.metadata.canonical_url").alias("canonical_url"))


def metadata_native(spark, sf_dir):
    return _pages(spark, sf_dir).metadata().select("page_id", "language", "site_name", "canonical_url")


def metadata_candidates(spark, sf_dir):
    return P.agreement(_pages(spark, sf_dir).meta_candidates())


def link_texts(spark, sf_dir):
    return _pages(spark, sf_dir).links().select("page_id", "ord", "text")


def link_hosts(spark, sf_dir):
    links = _pages(spark, sf_dir).links().withColumn("host", F.regexp_extract("href", "^https?://([^/?#]*)", 1))
    return links.groupBy("host").agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages"))


def internal_links(spark, sf_dir):
    """Links within the table; each page is given one to the page of the next id."""
    pages = _table(spark, sf_dir)
    following = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("to"))
    linked = pages.join(following, "page_id", "left")
    html = F.replace(F.col("html"), F.lit("<body>"), F.concat(F.lit('<body><a href="'), F.coalesce("to", F.lit("/")), F.lit('">next</a>')))
    return P.internal_links(P.PageFrame(linked.withColumn("html", html)).balanced().links(), pages)


def page_blocks(spark, sf_dir):
    return _pages(spark, sf_dir).blocks()


def block_counts(spark, sf_dir):
    return _pages(spark, sf_dir).blocks().where("NOT close").groupBy("op").agg(F.count("*").alias("n"))


def rank_top(spark, sf_dir):
    return P.top_candidates(_pages(spark, sf_dir).rank_features(), 1).select("page_id", "tag", F.round("rank_score", 6).alias("rank_score"))


def subtree_text(spark, sf_dir):
    return P.subtree_text(_pages(spark, sf_dir).nodes())


def over_budget(spark, sf_dir):
    return _pages(spark, sf_dir).errors(Options(budget=Budget(input_bytes=4096))).select("page_id", "kind", "resource", "limit")


def within_budget(spark, sf_dir):
    return P.PageFrame(_table(spark, sf_dir)).within(4096).pages.select("page_id", F.octet_length("html").cast("long").alias("bytes"))


def decoded_bytes(spark, sf_dir):
    pages = _table(spark, sf_dir).select("page_id", "url", F.encode("html", "UTF-8").alias("body"), F.lit("text/html; charset=utf-8").alias("content_type"))
    return P.PageFrame.from_bytes(pages).pages.select("page_id", F.length("html").cast("long").alias("n_chars"), F.md5("html").alias("html_md5"))


def url_parts(spark, sf_dir):
    u = F.col("url")
    pages = _table(spark, sf_dir)
    return pages.select("page_id", F.regexp_extract(u, "^([a-z]+):", 1).alias("scheme"), F.regexp_extract(u, "://([^/?#]*)", 1).alias("host"), (F.instr(u, "?") > 0).alias("has_query"), (F.instr(u, "#") > 0).alias("has_fragment"))


def language_report(spark, sf_dir):
    pages = _table(spark, sf_dir).withColumn("language", F.regexp_extract("html", '<html lang="([a-z]+)"', 1)).withColumn("bytes", F.octet_length("html").cast("double"))
    return evaluate.report(pages, "language", ["bytes"])


def longest_titles(spark, sf_dir):
    pages = _table(spark, sf_dir)
    t = pages.select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "page_id"))
    return t.withColumn("rank", rank).where("rank <= 3").select("host", "rank", "page_id", F.col("n").cast("long").alias("title_chars"))


def duplicate_texts(spark, sf_dir):
    path = f"{_shared_dir(spark)}/hashes-{uuid.uuid4().hex}"
    P.text_hashes(_pages(spark, sf_dir).extract(Options(repeats=True))).write.parquet(path)  # texts that differ by what one says again aren't equal
    return P.canonical_duplicates(spark.read.schema("page_id bigint, h string").parquet(path))


def reference_scores(spark, sf_dir):
    """Extracted texts against all text below the article, as reference."""
    pages = _pages(spark, sf_dir).pages
    both = pages.select("page_id", kernels.extract_page("html", "url").alias("a"), kernels.extract_page("html", "url", Options(content_root=("tag", "article"))).alias("b"))
    scores = evaluate.reference_scores(both.select("page_id", F.col("a.text").alias("result"), F.col("b.text").alias("reference")))
    return scores.select("page_id", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def structure_retention(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return evaluate.structure_retention(pages.nodes(), pages.extract().select("page_id", "page.metrics.*"))


def streamed_pages(spark, sf_dir):
    """The pages read as a stream give the same rows as a batch."""
    where = f"{_shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(streaming.SCHEMA).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/pages.parquet*")
    found = streaming.extract_stream(source).select("page_id", "page.metadata.language")
    streaming.write_stream(found, f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return spark.read.schema("page_id bigint, language string").parquet(f"{where}/out")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        extract_pages, extract_flat, extract_plain_options, extract_content_root, extract_diagnostics, raw_titles, headings, element_counts, languages, site_names, metadata_native,
        metadata_candidates, link_texts, link_hosts, internal_links, page_blocks, block_counts, rank_top, subtree_text, over_budget, within_budget, decoded_bytes, url_parts, language_report,
        longest_titles, duplicate_texts, reference_scores, structure_retention, streamed_pages,
    )
    return {f.__name__: f for f in found}


_TEXT = "replace(replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&amp;', '&')"
_COUNT = "CAST((length(html) - length(replace(html, '<{0}>', ''))) / (length('{0}') + 2) AS BIGINT)"


def oracle_sql() -> dict[str, str]:
    host = "regexp_extract(url, '://([^/?#]*)', 1)"
    language = "regexp_extract(html, '<html lang=\"([a-z]+)\"', 1)"
    # blocks of the article's text as lines, their white space run together
    said = "list_transform(regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>'), lambda x: {})".format(
        "trim(regexp_replace({}, '\\s+', ' ', 'g'))".format(_TEXT.format("regexp_replace(x, '<[^>]*>', ' ', 'g')"))
    )
    lines = f"array_to_string(list_filter({said}, lambda x: x <> ''), chr(10))"
    counts = ", ".join(f"{_COUNT.format(t)} AS n_{t}" for t in ("p", "li", "nav", "article", "footer"))
    return {
        "raw_titles": f"SELECT page_id, {_TEXT.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title FROM pages",
        "headings": f"SELECT page_id, {_TEXT.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS heading FROM pages",
        "element_counts": f"SELECT page_id, {counts}, CAST((length(html) - length(replace(html, '<div', ''))) / 4 AS BIGINT) AS n_div FROM pages",
        "languages": f"SELECT page_id, {language} AS language FROM pages",
        "site_names": f"SELECT page_id, regexp_replace({host}, '^www\\.', '') AS site_name, url AS canonical_url FROM pages",
        "metadata_native": f"SELECT page_id, {language} AS language, regexp_replace({host}, '^www\\.', '') AS site_name, url AS canonical_url FROM pages",
        "link_texts": f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages)
            SELECT page_id, CAST(unnest(range(len(t))) AS INTEGER) AS ord, {_TEXT.format('unnest(t)')} AS text FROM l""",
        "link_hosts": f"""WITH l AS (SELECT page_id, {host} AS host, len(regexp_extract_all(html, '<a href="/')) AS n FROM pages)
            SELECT host, CAST(sum(n) AS BIGINT) AS n_links, count(DISTINCT page_id) AS n_pages FROM l WHERE n > 0 GROUP BY host""",
        "extract_content_root": f"SELECT page_id, {lines} AS text, CASE WHEN {lines} = '' THEN 'NoContent' END AS error_kind FROM pages",
        "internal_links": """WITH p AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages)
            SELECT a.page_id, CAST(0 AS INTEGER) AS ord, c.page_id AS target_id FROM p a JOIN p b ON b.page_id = a.page_id + 1 JOIN p c ON c.bare = b.bare""",
        "duplicate_texts": f"""WITH t AS (SELECT page_id, {lines} AS t FROM pages), f AS (SELECT page_id, min(page_id) OVER (PARTITION BY t) AS first_id FROM t WHERE t <> '')
            SELECT page_id, first_id FROM f WHERE page_id > first_id""",
        "over_budget": "SELECT page_id, 'ResourceLimit' AS kind, 'input_bytes' AS resource, CAST(4096 AS BIGINT) AS \"limit\" FROM pages WHERE octet_length(encode(html)) > 4096",
        "within_budget": "SELECT page_id, octet_length(encode(html)) AS bytes FROM pages WHERE octet_length(encode(html)) <= 4096",
        "decoded_bytes": "SELECT page_id, length(html) AS n_chars, md5(html) AS html_md5 FROM pages",
        "url_parts": f"SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, {host} AS host, contains(url, '?') AS has_query, contains(url, '#') AS has_fragment FROM pages",
        "language_report": f"""WITH p AS (SELECT {language} AS language, octet_length(encode(html)) AS b FROM pages)
            SELECT language, count(*) AS n, CAST(avg(b) AS DOUBLE) AS bytes FROM p GROUP BY ROLLUP(language)""",
        "longest_titles": f"""WITH t AS (SELECT page_id, {host} AS host, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS n FROM pages)
            SELECT host, CAST(row_number() OVER (PARTITION BY host ORDER BY n DESC, page_id) AS INTEGER) AS rank, page_id, n AS title_chars FROM t
            QUALIFY row_number() OVER (PARTITION BY host ORDER BY n DESC, page_id) <= 3""",
        "streamed_pages": f"SELECT page_id, {language} AS language FROM pages",
    }
