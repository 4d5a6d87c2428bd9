"""Operators over tables of pages. The page kernels run in Arrow batches; everything set-shaped is left to Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webdistill.functions.extract import Options
from webdistill.functions.metadata import MANY, SINGLE
from webdistill.operators import kernels as K


class PageFrame:
    """Pages with ``id_col``, ``url`` and ``html``; columns of the same names as added ones are replaced."""

    def __init__(self, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"):
        self.pages, self.id, self.url, self.html = pages, id_col, url_col, html_col

    @classmethod
    def from_bytes(cls, pages: DataFrame, body_col: str = "body", content_type_col: str = "content_type", **more) -> PageFrame:
        """Pages given as bytes: decoded by mark, header, being UTF-8, declaration, or as windows-1252."""
        return cls(pages.withColumn("html", K.decode(body_col, content_type_col)), **more)

    def where(self, condition: Column | str) -> PageFrame:
        """Filter before any page is parsed; the condition reaches the scan."""
        return PageFrame(self.pages.where(condition), self.id, self.url, self.html)

    def within(self, max_bytes: int) -> PageFrame:
        """Pages of at most so many bytes, tested natively."""
        return self.where(F.octet_length(self.html) <= max_bytes)

    def spread(self, partitions: int) -> PageFrame:
        """Deal pages out anew, for inputs whose files differ much in size."""
        return PageFrame(self.pages.repartition(partitions), self.id, self.url, self.html)

    def balanced(self) -> PageFrame:
        """Pages of fewer files than cores are dealt out over all cores, since a page costs milliseconds and a file is often
        one piece to a scan; tables of more files stay as they are and no page is shuffled."""
        cores = self.pages.sparkSession.sparkContext.defaultParallelism
        return self.spread(4 * cores) if len(self.pages._jdf.inputFiles()) < cores else self

    def texts_in(self, tag: str) -> DataFrame:
        """A row for each text right below an element of the tag: from the nodes within the row, so pages are parsed once and nothing is joined."""
        nodes = self.pages.select(self.id, K.page_nodes(F.col(self.html)).alias("nodes"))
        owners = F.transform(F.filter("nodes", lambda x: x["tag"] == tag), lambda x: x["node_id"])
        texts = F.filter("nodes", lambda x: (x["kind"] == "text") & F.array_contains("owners", x["parent_id"]))
        return nodes.withColumn("owners", owners).select(self.id, F.inline(texts))

    def extract(self, options: Options | None = None, keep: list[str] | None = None) -> DataFrame:
        """The columns kept (the id and the address by default) and ``page``; each page is parsed once."""
        keep = [self.id, self.url] if keep is None else keep
        return self.pages.select(*keep, K.extract_page(F.col(self.html), F.col(self.url), options).alias("page"))

    def flat(self, options: Options | None = None) -> DataFrame:
        """``extract`` with one column for each field."""
        page = self.extract(options)
        return page.select(self.id, self.url, "page.metadata.*", "page.markdown", "page.html", "page.text", "page.metrics.*", "page.kind", F.col("page.error.kind").alias("error_kind"))

    def ok(self, options: Options | None = None) -> DataFrame:
        return self.extract(options).where("page.error IS NULL")

    def errors(self, options: Options | None = None) -> DataFrame:
        return self.extract(options).where("page.error IS NOT NULL").select(self.id, self.url, "page.error.*")

    def nodes(self) -> DataFrame:
        """A row for each node of each document."""
        return self.pages.select(self.id, F.inline(K.page_nodes(F.col(self.html))))

    def blocks(self, options: Options | None = None) -> DataFrame:
        """A row for each operation of each page's content."""
        return self.pages.select(self.id, F.posexplode(K.page_blocks(F.col(self.html), F.col(self.url), options)).alias("ord", "block")).select(self.id, "ord", "block.*")

    def links(self) -> DataFrame:
        return self.pages.select(self.id, F.inline(K.page_links(F.col(self.html), F.col(self.url))))

    def meta_candidates(self) -> DataFrame:
        return self.pages.select(self.id, F.inline(K.meta_candidates(F.col(self.html), F.col(self.url))))

    def metadata(self) -> DataFrame:
        """A row a page with its metadata, resolved natively from the candidates in the row: nothing is shuffled."""
        return resolved(self.pages.select(self.id, K.meta_candidates(F.col(self.html), F.col(self.url)).alias("found")), self.id)

    def rank_features(self) -> DataFrame:
        return self.pages.select(self.id, F.inline(K.rank_features(F.col(self.html))))


def agreement(candidates: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Add ``score``: the confidence and 5 for each candidate of another source with the same value, three at most."""
    key = [id_col, "field", "key"]
    same = F.count("*").over(Window.partitionBy(*key)) - F.count("*").over(Window.partitionBy(*key, "source"))
    return candidates.withColumn("score", (F.col("confidence") + 5 * F.least(same, F.lit(3))).cast("int"))


def resolved(rows: DataFrame, id_col: str = "page_id", found_col: str = "found") -> DataFrame:
    """``rows`` with arrays of candidates in order, as metadata: what the kernel resolves, by expressions on the row.

    Of each field the value of the highest score (confidence and 5 for each candidate of another source with an equal
    value, three at most), the earliest of equal ones. Authors within 8 of the surest one, ten at most, and tags but for
    the site's name, each once. A title loses the site's name at its ends.
    """
    of = lambda f: F.filter(found_col, lambda c: c["field"] == f)

    def best(own: Column) -> Column:
        score = lambda c: c["confidence"] + 5 * F.least(F.size(F.filter(own, lambda o: (o["key"] == c["key"]) & (o["source"] != c["source"]))), F.lit(3))
        return F.array_max(F.transform(own, lambda c: F.struct(score(c).alias("score"), (-c["ord"]).alias("first"), c["value"].alias("value"), c["key"].alias("key"))))

    once = lambda own, keys: F.transform(F.filter(own, lambda c, i: F.array_position(keys, c["key"]) == i + 1), lambda c: c["value"])
    keys = lambda own: F.transform(own, lambda c: c["key"])
    compact = lambda key: F.regexp_replace(key, "[^\\p{L}\\p{N}]", "")
    parts = rows.select(id_col, *(of(f).alias(f) for f in (*SINGLE, *MANY)))
    sure = F.array_max(F.transform("authors", lambda a: a["confidence"])) - 8
    parts = parts.select(id_col, *(best(F.col(f)).alias(f) for f in SINGLE), "authors", sure.alias("sure"), "tags")
    site = F.col("site_name")
    authors = F.filter("authors", lambda c: c["confidence"] >= F.col("sure"))
    tags = F.filter("tags", lambda c: F.col("site").isNull() | (compact(c["key"]) != F.col("site")))
    parts = parts.withColumn("site", compact(site["key"])).select(id_col, *SINGLE, authors.alias("authors"), tags.alias("tags"))
    quoted = F.concat(F.lit("\\Q"), F.replace(site["value"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    affix = F.concat(F.lit("(?iu)\\s+[|\\-–—·»]\\s+"), quoted, F.lit("$|^"), quoted, F.lit("\\s+[|\\-–—·»]\\s+"))
    bare = F.regexp_replace(F.col("title")["value"], affix, F.lit(""))
    title = F.when(site["value"].isNotNull() & (bare != ""), bare).otherwise(F.col("title")["value"])
    single = [(title if f == "title" else F.col(f)["value"]).alias(f) for f in SINGLE]
    return parts.select(id_col, *single, F.slice(once(F.col("authors"), keys(F.col("authors"))), 1, 10).alias("authors"), once(F.col("tags"), keys(F.col("tags"))).alias("tags"))


def resolve_metadata(candidates: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row a page with its ``resolved`` candidates, for candidates that lie in rows of their own."""
    found = F.array_sort(F.collect_list(F.struct("ord", "field", "value", "source", "confidence", "key"))).alias("found")
    return resolved(candidates.groupBy(id_col).agg(found), id_col)


def ranking_score() -> Column:
    """The ranking score of ``rank_features`` rows as one expression."""
    c = F.col
    tiny = lambda *xs: sum((F.least(c(x) / 1e5, F.lit(0.001)) for x in xs), F.lit(0.0))
    p = c("paragraph_count")
    structure = F.when((c("list_item_count") >= 3) & (p <= 1) & (c("link_density") >= 0.5), F.least(1.5 * c("list_item_count"), F.lit(12.0))).otherwise(0.0)
    structure += F.when(p <= 2, F.least(4 * c("code_block_count"), F.lit(12.0)) + F.least(4 * c("table_count"), F.lit(12.0))).otherwise(0.0)
    structure += tiny("heading_count", "figure_count", "image_count", "protected_block_count")
    negative = F.when(c("positive_name") > 0, 0.1 * c("negative_name")).otherwise(c("negative_name") * F.least(1 + 0.6 * F.greatest(c("readability"), F.lit(0.0)), F.lit(125.0)))
    listing = (p >= 40) & (c("heading_count") == 0) & (c("table_count") == 0) & (c("code_block_count") == 0) & (c("comma_count") <= 2) & (c("word_count") <= 4 * p) & (c("digit_chars") > 0)
    listing = listing & ((c("digit_chars") >= c("word_count") / 5) | (c("sentence_end_count") >= 1.5 * p))
    penalty = F.when(listing, F.least(2 * p, F.lit(160.0))).otherwise(0.0)
    small = F.least(c("text_chars") / 1e6, F.lit(0.001)) + F.least(c("link_text_chars") / 1e6, F.lit(0.001))
    return (
        c("readability") + c("prior") + tiny("word_count", "paragraph_count", "sentence_end_count", "comma_count") + small + structure + 0.001 * c("positive_name") - negative
        - F.least(0.2 * c("link_density"), F.lit(0.1)) - penalty - 48 * c("utility_name")
    )


def top_candidates(features: DataFrame, k: int = 5, id_col: str = "page_id") -> DataFrame:
    """The k best candidates of each page by the native score; ties in source order."""
    scored = features.withColumn("rank_score", ranking_score())
    w = Window.partitionBy(id_col).orderBy(F.desc("rank_score"), "pre")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def subtree_text(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Characters of text below each element, by the running sums that nodes carry: no join, no shuffle."""
    return nodes.where("kind = 'element'").select(id_col, "node_id", "tag", "pre", "depth", (F.col("text_to") - F.col("text_from")).cast("long").alias("text_chars"))


def internal_links(links: DataFrame, pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Links whose target is a page of the table, as pairs of ids; addresses are compared without fragments."""
    bare = lambda x: F.regexp_replace(x, "#.*$", "")
    to = pages.select(F.col(id_col).alias("target_id"), bare(F.col(url_col)).alias("bare"))
    return links.withColumn("bare", bare(F.col("href"))).join(to, "bare").select(id_col, "ord", "target_id")


def text_hashes(extracted: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``id, h``: the hash of each page's text; pages with errors have none."""
    return extracted.where("page.error IS NULL").select(id_col, F.sha2(F.col("page.text"), 256).alias("h"))


def canonical_duplicates(hashed: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Of ``text_hashes``, saved since it is read twice: pages whose text equals that of a page of a smaller id, and that id.

    Hashes are shuffled, texts aren't; a hash that very many pages share is one row a task in the sum, and Spark splits it in the join.
    """
    first = hashed.groupBy("h").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return hashed.join(first, "h").where(F.col(id_col) > F.col("first_id")).select(id_col, "first_id")
