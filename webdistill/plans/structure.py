"""Queries over structured data, streamed parts, numbered lists and kept structure, on ``pages`` and on pages that Spark rewrites from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webdistill.functions.extract import Options
from webdistill.operators import kernels
from webdistill.operators import pages as P
from webdistill.operators import structure as S

_ARTICLE = "(?s)^(.*)<article>(.*)</article>(.*)$"


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _rewritten(pages: DataFrame, html: Column) -> P.PageFrame:
    return P.PageFrame(pages.withColumn("html", html)).balanced()


def _bare(html: Column) -> Column:
    """A text without tags, as raw HTML has it."""
    return F.regexp_replace(html, "<[^>]*>", " ")


def _plain(html: Column) -> Column:
    """``_bare`` without the entities that these pages have."""
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(char))
    return html


def _article() -> Column:
    return F.regexp_extract("html", _ARTICLE, 2)


def _ld_json(value: Column) -> Column:
    """A script of structured data that begins the head."""
    return F.concat(F.lit('<head><script type="application/ld+json">'), F.replace(value, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))


def structured_agreement(spark, sf_dir):
    """How well the whole page's raw text agrees with its article's."""
    pages = _table(spark, sf_dir).select("page_id", _bare(F.col("html")).alias("text"), _bare(_article()).alias("hint"))
    return S.agreements(pages).select("page_id", *(F.round(c, 9).alias(c) for c in ("coverage", "precision", "agreement")))


def structured_roots(spark, sf_dir):
    """Articles in a container of another name, found by the page's structured data; a text that begins in short paragraphs isn't."""
    pages, html = P.PageFrame(_table(spark, sf_dir)), _with_text()
    return pages.balanced().pages.withColumn("html", html).select("page_id", kernels.structured_root("html", "url").alias("r")).select("page_id", "r.tag", "r.name", F.round("r.agreement", 9).alias("agreement"))


def _with_text() -> Column:
    """Pages whose article lies in a ``div`` of no telling name, and whose structured data has its text."""
    item = F.to_json(F.struct(F.lit("Article").alias("@type"), F.col("url"), _plain(_bare(F.regexp_extract("html", "(?s)<article>.*?<br><p>(.*)</article>", 1))).alias("articleBody")))
    html = F.regexp_replace(F.col("html"), _ARTICLE, '$1<div class="x-7">$2</div>$3')
    return F.replace(html, F.lit("<head>"), _ld_json(item))


def page_items(spark, sf_dir):
    """Items of a page and of four others of its host; each page finds its own."""
    pages = _table(spark, sf_dir).withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1)).select("page_id", "url", "title", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    w = Window.partitionBy("host").orderBy("page_id")
    item = F.to_json(F.struct(F.lit("Article").alias("@type"), F.col("title").alias("headline"), F.col("url")))
    pages = pages.withColumn("item", item)
    near = F.array(*(F.lag("item", k).over(w) for k in (2, 1)), F.col("item"), *(F.lead("item", k).over(w) for k in (1, 2)))
    return S.page_items(pages.withColumn("near", near).select("page_id", "title", "url", F.posexplode("near").alias("ord", "item")).where("item IS NOT NULL")).select(
        "page_id", F.get_json_object("item", "$.url").alias("item_url"), "score"
    )


def page_items_kernel(spark, sf_dir):
    """Authors of pages that carry items of three pages of their host: the page's own item decides."""
    pages = _table(spark, sf_dir).withColumn("host", F.regexp_extract("url", "://([^/?#]*)", 1))
    w = Window.partitionBy("host").orderBy("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    item = F.struct(F.lit("NewsArticle").alias("@type"), title.alias("headline"), F.col("url"), F.struct(F.concat(F.lit("Author "), F.col("page_id")).alias("name")).alias("author"))
    small = pages.select("page_id", "host", item.alias("item")).withColumn("items", F.array_compact(F.array(F.lag("item").over(w), F.col("item"), F.lead("item").over(w)))).select("page_id", "items")
    html = F.replace(F.col("html"), F.lit("<head>"), _ld_json(F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.col("items").alias("@graph")))))
    return _rewritten(pages.join(small, "page_id"), html).extract().select("page_id", F.array_join("page.metadata.authors", "; ").alias("authors"))


def json_duplicates(spark, sf_dir):
    """Items in two orders of their keys are one."""
    pages = _table(spark, sf_dir)
    a, b = (F.to_json(F.struct(*x)) for x in (["page_id", "url"], ["url", "page_id"]))
    return S.distinct_items(pages.select("page_id", F.posexplode(F.array(a, b, F.lit("no json"))).alias("ord", "item"))).select("page_id", F.col("ord").cast("long").alias("ord"))


def streamed_segments(spark, sf_dir):
    """Pages whose article comes as a streamed part: the content is that of the page itself."""
    html = F.regexp_replace(F.col("html"), _ARTICLE, '$1<article><!--$?--><template id="B:0"></template><p>Loading</p><!--/$--></article><div hidden id="S:0">$2</div>$3'.replace("<!--$?", "<!--\\$?").replace("/$--", "/\\$--"))
    return _rewritten(_table(spark, sf_dir), html).extract().select("page_id", F.md5("page.markdown").alias("markdown_md5"))


def streamed_places(spark, sf_dir):
    """Places and parts of such pages, joined by their keys; every third page lacks its part."""
    part = F.when(F.col("page_id") % 3 == 0, "S:1").otherwise("S:0")
    html = F.concat(F.regexp_replace(F.col("html"), _ARTICLE, '$1<article><template id="B:0"></template></article>$3'), F.lit('<div hidden id="'), part, F.lit('"><p>x</p></div>'))
    found = S.streamed_parts(_rewritten(_table(spark, sf_dir), html).nodes())
    return found.select("page_id", "key", "place_kind", F.col("part_id").isNotNull().alias("filled"))


def shell_pages(spark, sf_dir):
    """Pages of a program that have their article in a noscript only."""
    html = F.concat(F.lit("<html><body><div id=root></div><noscript><article>"), _article(), F.lit("</article></noscript></body></html>"))
    return _rewritten(_table(spark, sf_dir), html).extract().select("page_id", F.md5("page.text").alias("text_md5"), F.col("page.error.kind").alias("error_kind"))


def ordered_lists(spark, sf_dir):
    """Lists with numbers written into their items, from 3 on."""
    parts = F.split("html", "<li>")
    html = F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("<li>"), (i + 2).cast("string"), F.lit(". "), x))), "")
    return S.ordered_lists(_rewritten(_table(spark, sf_dir), html).nodes()).select("page_id", "n_items", "start")


def aria_headings(spark, sf_dir):
    """Headings given by role, as scoring sees them."""
    html = F.replace(F.replace(F.col("html"), F.lit("<h1>"), F.lit('<div role="heading" aria-level="1">')), F.lit("</h1>"), F.lit("</div>"))
    nodes = _rewritten(_table(spark, sf_dir), html).nodes().where("kind = 'element'")
    return nodes.groupBy("page_id").agg(F.count_if(S.seen_as(F.col("tag"), F.col("attrs")) == "h1").alias("n_h1"), F.count_if(F.col("tag") == "h1").alias("n_raw_h1"))


_LABELS = (("Published ", "Updated "), ("Veröffentlicht am ", "Aktualisiert am "), ("Publié le ", "Mis à jour le "), ("Publicado el ", "Actualizado el "))
_MONTHS = (
    "January February March April May June July August September October November December".split(), "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(), "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
)


def written_dates(spark, sf_dir):
    """Pages with a line of two dates below their heading, in four languages: when they were published, and changed."""
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % 4 + 1).cast("int"))
    first = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") % 1000).cast("int"))

    def said(day: Column) -> Column:
        month = F.element_at(F.element_at(F.array(*(F.array(*map(F.lit, m)) for m in _MONTHS)), (F.col("page_id") % 4 + 1).cast("int")), F.month(day))
        d, y = F.dayofmonth(day).cast("string"), F.year(day).cast("string")
        forms = F.array(F.concat(month, F.lit(" "), d, F.lit(", "), y), F.concat(d, F.lit(". "), month, F.lit(" "), y), F.concat(d, F.lit(" "), month, F.lit(" "), y), F.concat(d, F.lit(" de "), month, F.lit(" de "), y))
        return F.element_at(forms, (F.col("page_id") % 4 + 1).cast("int"))

    line = F.concat(F.lit("</h1><p>"), of([a for a, _ in _LABELS]), said(first), F.lit(" · "), of([b for _, b in _LABELS]), said(F.date_add(first, 30)), F.lit("</p>"))
    return _rewritten(_table(spark, sf_dir), F.replace(F.col("html"), F.lit("</h1>"), line)).metadata().select("page_id", "published_time", "modified_time")


def semantic_standing(spark, sf_dir):
    return S.semantic_standing(P.PageFrame(_table(spark, sf_dir)).balanced().nodes()).select("page_id", "tag", "under", "within")


def edge_elements(spark, sf_dir):
    """Elements near the start and the end of each page's text, by tag."""
    at = S.positions(P.PageFrame(_table(spark, sf_dir)).balanced().nodes())
    return at.groupBy("page_id", "tag").agg(F.count_if("near_start").alias("n_near_start"), F.count_if("near_end").alias("n_near_end"), F.count("*").alias("n"))


def semantic_coverage(spark, sf_dir):
    """Structure of whole articles that extraction keeps."""
    pages = P.PageFrame(_table(spark, sf_dir)).balanced()
    return S.semantic_coverage(pages.blocks(Options(content_root=("tag", "body"))), pages.blocks())


def tape_faults(spark, sf_dir):
    """Operations of each page, how deep they go, and how many break a rule."""
    marks = S.tape_marks(P.PageFrame(_table(spark, sf_dir)).balanced().blocks())
    counts = {"n_operations": F.count("*"), "n_opening": F.count_if(~F.col("close") & ~F.col("leaf")), "n_closing": F.count_if(F.col("close")), "n_faults": F.sum(F.size("rules")).cast("long")}
    return marks.groupBy("page_id").agg(*(v.alias(k) for k, v in counts.items()))


def _below_heading(html: Column) -> Column:
    return F.replace(F.col("html"), F.lit("</h1>"), F.concat(F.lit("</h1>"), html))


def line_numbers(spark, sf_dir):
    """Code with a column of numbers beside it: the code alone is kept."""
    code = F.concat(F.lit("<table class=highlight><tr><td class=gutter><pre>1\n2\n3</pre></td><td><pre>x = "), F.col("page_id").cast("string"), F.lit("\n  y\nz</pre></td></tr></table>"))
    return _rewritten(_table(spark, sf_dir), _below_heading(code)).blocks().where("op = 'CodeBlock'").select("page_id", "text")


def contents_lists(spark, sf_dir):
    """A list of the page's own parts goes, the parts stay."""
    parts = F.lit("<div class=toc><ul><li><a href='#a'>First part</a><li><a href='#b'>Second part</a></ul></div><h2 id=a>First part</h2><p>Some words of the first part of it.</p><h2 id=b>Second part</h2>")
    ops = _rewritten(_table(spark, sf_dir), _below_heading(parts)).blocks().where("NOT close")
    return ops.groupBy("page_id").agg(F.count_if((F.col("op") == "Link") & F.startswith("href", F.lit("#"))).alias("n_links"), F.count_if(F.col("op") == "Heading").alias("n_headings"))


def screen_views(spark, sf_dir):
    """Of a table and its list for narrow screens the table stays."""
    rows = [("Alpha", "one"), ("Beta", "two"), ("Gamma", "three")]
    table = "".join(f"<tr><td>{a}<td>{b}</tr>" for a, b in rows)
    cards = "".join(f"<li>{a}: {b}</li>" for a, b in rows)
    both = F.lit(f"<div class='md:hidden'><ul>{cards}</ul></div><div class='hidden md:block'><table><tr><th>Name<th>Value</tr>{table}</table></div>")
    ops = _rewritten(_table(spark, sf_dir), _below_heading(both)).blocks().where("NOT close")
    return ops.groupBy("page_id").agg(F.count_if(F.col("op") == "Table").alias("n_tables"), F.count_if(F.col("op") == "List").alias("n_lists"))


def forum_threads(spark, sf_dir):
    """Pages made into a question with replies, one of them twice: their kind and how deep quotes go."""
    reply = lambda i, who, inside="": f"<div class=comment data-shortid={i}><a class=author>{who}</a><div class=comment_text><p>Reply {i} by {who}.</p></div>{inside}</div>"
    replies = reply("a", "ann", reply("b", "bob", reply("c", "cy"))) + reply("d", "di") + reply("d", "di")
    html = F.regexp_replace(F.col("html"), _ARTICLE, f"$1<article class=h-entry><div class=e-content>$2</div></article>{replies}$3")
    html = F.replace(F.replace(html, F.lit("<h1>"), F.lit("</div><h1 class=u-url>")), F.lit("</h1>"), F.lit("</h1><div class=e-content>"))
    pages = _rewritten(_table(spark, sf_dir), html)
    quotes = pages.blocks().where("op = 'BlockQuote'").groupBy("page_id").agg(F.count_if(~F.col("close")).alias("n_quotes"))
    return pages.extract().select("page_id", "page.kind").join(quotes, "page_id").select("page_id", "kind", "n_quotes")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        structured_agreement, structured_roots, page_items, page_items_kernel, json_duplicates, streamed_segments, streamed_places, shell_pages, ordered_lists, aria_headings,
        written_dates, semantic_standing, edge_elements, semantic_coverage, tape_faults,
        line_numbers, contents_lists, screen_views, forum_threads,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    words = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
    bare = "regexp_replace({}, '<[^>]*>', ' ', 'g')"
    article = "regexp_extract(html, '(?s)^(.*)<article>(.*)</article>(.*)$', 2)"
    title = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
    host = "regexp_extract(url, '://([^/?#]*)', 1)"
    return {
        "structured_agreement": f"""WITH p AS (SELECT page_id, {words.format(bare.format('html'))} AS t, {words.format(bare.format(article))} AS h FROM pages),
            t AS (SELECT page_id, w, count(*) AS n FROM (SELECT page_id, unnest(t) AS w FROM p) GROUP BY ALL), h AS (SELECT page_id, w, count(*) AS n FROM (SELECT page_id, unnest(h) AS w FROM p) GROUP BY ALL),
            j AS (SELECT coalesce(t.page_id, h.page_id) AS page_id, coalesce(t.w, h.w) AS w, coalesce(t.n, 0) AS t, coalesce(h.n, 0) AS h FROM t FULL JOIN h ON t.page_id = h.page_id AND t.w = h.w),
            s AS (SELECT page_id, sum(t) AS n, sum(CASE WHEN h > 0 THEN t ELSE 0 END) AS common, sum(CASE WHEN t = 0 THEN h * (length(w) + 1) ELSE 0 END) AS missing, sum(h * (length(w) + 1)) - 1 AS chars FROM j GROUP BY ALL),
            c AS (SELECT page_id, 1 - greatest(missing - 1, 0) / chars AS c, common / n AS p FROM s)
            SELECT page_id, round(c, 9) AS coverage, round(p, 9) AS precision, round(2 * c * p / (c + p), 9) AS agreement FROM c""",
        # pages near by of one title and path are as good as the page itself: none is its own then
        "page_items": f"""WITH p AS (SELECT page_id, url, {host} AS host, {title} AS t, {host} || rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') || chr(10) || {title} AS k FROM pages),
            n AS (SELECT *, [lag(k, 2) OVER w, lag(k) OVER w, lead(k) OVER w, lead(k, 2) OVER w] AS near FROM p WINDOW w AS (PARTITION BY host ORDER BY page_id))
            SELECT page_id, url AS item_url, CAST(150 + CASE WHEN len({words.format('t')}) > 0 THEN 100 ELSE 0 END AS INTEGER) AS score FROM n WHERE NOT coalesce(list_contains(near, k), false)""",
        "page_items_kernel": f"""WITH p AS (SELECT page_id, {host} AS host, {host} || rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') || chr(10) || {title} AS k FROM pages),
            n AS (SELECT *, [lag(k) OVER w, lead(k) OVER w] AS near FROM p WINDOW w AS (PARTITION BY host ORDER BY page_id))
            SELECT page_id, CASE WHEN coalesce(list_contains(near, k), false) THEN '' ELSE 'Author ' || page_id END AS authors FROM n""",
        "json_duplicates": "SELECT page_id, unnest([0, 2])::BIGINT AS ord FROM pages",
        "streamed_places": "SELECT page_id, '0' AS key, 'B' AS place_kind, page_id % 3 <> 0 AS filled FROM pages",
        "written_dates": """WITH d AS (SELECT page_id, DATE '2020-01-01' + CAST(page_id % 1000 AS INTEGER) AS d FROM pages)
            SELECT page_id, strftime(d, '%B %-d, %Y') AS published_time, strftime(d + 30, '%B %-d, %Y') AS modified_time FROM d""",
        "line_numbers": "SELECT page_id, 'x = ' || page_id || chr(10) || '  y' || chr(10) || 'z' AS text FROM pages",
        "contents_lists": "SELECT page_id, CAST(0 AS BIGINT) AS n_links, CAST(2 AS BIGINT) AS n_headings FROM pages",
        "screen_views": "SELECT page_id, CAST(1 AS BIGINT) AS n_tables, CAST(0 AS BIGINT) AS n_lists FROM pages",
        "forum_threads": "SELECT page_id, 'Discussion' AS kind, CAST(4 AS BIGINT) AS n_quotes FROM pages",
        "ordered_lists": "SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n_items, CAST(3 AS BIGINT) AS start FROM pages WHERE contains(html, '<li>')",
        "aria_headings": "SELECT page_id, len(regexp_extract_all(html, '<h1>')) AS n_h1, CAST(0 AS BIGINT) AS n_raw_h1 FROM pages",
        "semantic_standing": f"SELECT page_id, 'article' AS tag, false AS under, CAST(1 AS INTEGER) AS within FROM pages WHERE {host} IS NOT NULL",
    }
