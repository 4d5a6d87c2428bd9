"""Set-shaped decisions over nodes, blocks and items as DataFrame expressions: no kernel, no join of nodes with nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webdistill.functions.coverage import LEAST, SUBSTANTIAL
from webdistill.functions.terminal import NEAR


def words(text: Column) -> Column:
    """The words of a text in lower case: runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}_]+"), lambda w: w != "")


# -- structured text and visible text
def agreements(pairs: DataFrame, id_col: str = "page_id", text_col: str = "text", hint_col: str = "hint") -> DataFrame:
    """``id, coverage, precision, agreement`` of each row's text with its hint, as ``functions.structured.agreement`` has it.

    Words are counted for each row before they are shuffled, and both sides meet in one sum; ids are taken as unique.
    Rows without words on either side have 0.
    """
    side = lambda c, a, b: pairs.select(id_col, F.explode_outer(words(F.col(c))).alias("w")).groupBy(id_col, "w").agg(F.count("w").alias("n")).select(id_col, "w", (a * F.col("n")).alias("t"), (b * F.col("n")).alias("h"))
    met = side(text_col, 1, 0).unionByName(side(hint_col, 0, 1)).groupBy(id_col, "w").agg(F.sum("t").alias("t"), F.sum("h").alias("h"))
    size = F.length("w") + 1
    sums = met.groupBy(id_col).agg(
        F.sum("t").alias("n"), F.sum(F.when(F.col("h") > 0, F.col("t")).otherwise(0)).alias("common"),
        F.coalesce(F.sum(F.when(F.col("t") == 0, F.col("h") * size)), F.lit(0)).alias("missing"), (F.coalesce(F.sum(F.col("h") * size), F.lit(0)) - 1).alias("chars"),
    )
    full = (F.col("n") > 0) & (F.col("chars") > 0)
    coverage = F.when(full, 1 - F.greatest(F.col("missing") - 1, F.lit(0)) / F.col("chars")).otherwise(0.0)
    precision = F.when(full, F.col("common") / F.col("n")).otherwise(0.0)
    both = sums.select(id_col, coverage.alias("coverage"), precision.alias("precision"))
    a, b = F.col("coverage"), F.col("precision")
    return both.withColumn("agreement", F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0))


# -- items of structured data
def json_fingerprint(item: Column) -> Column:
    """Equal for JSON texts that differ in white space and the order of keys at most; null for what is no JSON."""
    return F.sha2(F.to_json(F.try_parse_json(item)), 256)


def distinct_items(items: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``id, ord, item`` without those that equal an earlier one of the page."""
    w = Window.partitionBy(id_col, "print").orderBy("ord")
    return items.withColumn("print", json_fingerprint(F.col("item"))).withColumn("k", F.row_number().over(w)).where((F.col("k") == 1) | F.col("print").isNull()).drop("k", "print")


def similarity(a: Column, b: Column) -> Column:
    """Share of ``b``'s characters in words that ``a`` has too, for titles."""
    theirs = words(b)
    joined = lambda x: F.length(F.array_join(x, " "))
    return F.when(F.size(theirs) > 0, 1 - joined(F.filter(theirs, lambda w: ~F.array_contains(words(a), w))) / joined(theirs)).otherwise(0.0)


def page_items(items: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Of ``id, ord, item, title, url`` (the page's) the item that describes the page, with its score; pages without such an item are left out.

    The score is 100 for a like title (in proportion) and 150 for the same host and path. Of several distinct items the
    best counts if its score is above 0 and no other has it.
    """
    get = lambda *names: F.coalesce(*(F.get_json_object("item", f"$.{n}".replace(".[", "[")) for n in names))
    own = F.coalesce(F.floor(100 * similarity(get("headline", "name", "title"), F.col("title"))), F.lit(0))
    place = lambda u: F.concat_ws("/", F.lower(F.regexp_extract(u, "://([^/?#:]*)", 1)), F.regexp_replace(F.regexp_extract(u, "://[^/?#]*([^?#]*)", 1), "/+$", ""))
    address = get("url.url", "url['@id']", "url", "mainEntityOfPage.url", "mainEntityOfPage['@id']", "mainEntityOfPage", "['@id']")
    same = F.coalesce((place(address) == place(F.col("url"))) & (F.regexp_extract("url", "://([^/?#:]*)", 1) != ""), F.lit(False))
    scored = distinct_items(items, id_col).withColumn("score", (own + F.when(same, 150).otherwise(0)).cast("int"))
    best = scored.groupBy(id_col).agg(F.max_by(F.struct("ord", "item"), F.struct("score", -F.col("ord"))).alias("x"), F.max("score").alias("score"), F.count("*").alias("n"), F.array_sort(F.collect_list("score")).alias("s"))
    unique = (F.col("n") == 1) | (F.col("score") > 0) & (F.get("s", (F.col("n") - 2).cast("int")) < F.col("score"))
    return best.where(unique).select(id_col, "x.ord", "x.item", "score")


# -- how scoring sees nodes
def seen_as(tag: Column, attrs: Column) -> Column:
    """An element's tag with its role: ``h1`` to ``h6`` for headings of a level, ``li`` for items of lists."""
    role = F.split(F.lower(F.coalesce(attrs["role"], F.lit(""))), "\\s+")
    level = F.trim(attrs["aria-level"])
    return F.when(F.array_contains(role, "heading") & level.rlike("^[1-6]$"), F.concat(F.lit("h"), level)).when(F.array_contains(role, "listitem"), "li").otherwise(tag)


def ordered_lists(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``id, list_id, n_items, start`` of lists whose items all begin with a number that counts up by one.

    An item's number is at the start of its first text; items less their rank give one value for such a list.
    """
    after = Window.partitionBy(id_col).orderBy("pre").rowsBetween(1, Window.unboundedFollowing)
    said = F.when((F.col("kind") == "text") & (F.trim(F.regexp_replace("text", "\\s+", " ")) != ""), F.struct("pre", "text"))
    items = nodes.withColumn("first", F.first(said, ignorenulls=True).over(after)).where((F.col("kind") == "element") & (seen_as(F.col("tag"), F.col("attrs")) == "li"))
    number = F.when(F.col("first.pre") < F.col("subtree_end"), F.regexp_extract("first.text", "^\\s*([0-9]{1,18})[.)](?:\\s|$)", 1))
    rank = F.row_number().over(Window.partitionBy(id_col, "parent_id").orderBy("pre"))
    numbered = items.select(id_col, "parent_id", F.when(number != "", number.cast("long")).alias("number"), rank.alias("rank"))
    lists = numbered.groupBy(id_col, F.col("parent_id").alias("list_id")).agg(
        F.count("*").alias("n_items"), F.count("number").alias("n"), F.min("number").alias("start"), F.min(F.col("number") - F.col("rank")).alias("lo"), F.max(F.col("number") - F.col("rank")).alias("hi")
    )
    return lists.where("n_items >= 2 AND n = n_items AND lo = hi").select(id_col, "list_id", "n_items", "start")


def authoritative(tag: Column, attrs: Column) -> Column:
    """Whether an element says itself that it is the content."""
    tokens = lambda name: F.split(F.coalesce(attrs[name], F.lit("")), "\\s+")
    return tag.isin("article", "main") | F.arrays_overlap(tokens("role"), F.array(F.lit("article"), F.lit("main"))) | F.array_contains(tokens("itemprop"), "articleBody")


def semantic_standing(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Authoritative elements: whether one lies around, and how many lie within, each itself included.

    Subtrees are nested intervals, so one that began before and ends later lies around; those within are counted by one
    running sum over starts and ends. No node meets another.
    """
    own = nodes.where(F.col("kind") == "element").where(authoritative(F.col("tag"), F.col("attrs"))).select(id_col, "node_id", "tag", "pre", "subtree_end")
    event = F.explode(F.array(F.struct(F.col("pre").alias("at"), F.lit(1).alias("start")), F.struct(F.col("subtree_end").alias("at"), F.lit(0).alias("start"))))
    w = Window.partitionBy(id_col).orderBy("at", "start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(id_col).orderBy("at", "start").rowsBetween(Window.unboundedPreceding, -1)
    events = own.select("*", event.alias("e")).select(id_col, "node_id", "tag", "pre", "subtree_end", "e.*")
    events = events.withColumn("begun", F.sum("start").over(w)).withColumn("reach", F.max(F.when(F.col("start") == 1, F.col("subtree_end"))).over(before))
    rows = events.groupBy(id_col, "node_id", "tag").agg(
        F.max(F.when(F.col("start") == 1, F.coalesce(F.col("reach"), F.lit(0)) > F.col("pre"))).alias("under"),
        (F.max(F.when(F.col("start") == 0, F.col("begun"))) - F.max(F.when(F.col("start") == 1, F.col("begun"))) + 1).cast("int").alias("within"),
    )
    return rows


# -- where elements stand
def positions(nodes: DataFrame) -> DataFrame:
    """Elements of the body with the characters of text before, in and after them, and whether they are near its start or end.

    Nodes carry running sums of text (``text_from``, ``text_to``) and those of their body, so each row stands for itself.
    """
    inside = nodes.where((F.col("kind") == "element") & (F.col("pre") >= F.col("body_pre")) & (F.col("pre") < F.col("body_end")))
    before, after = F.col("text_from") - F.col("body_from"), F.col("body_to") - F.col("text_to")
    rows = inside.withColumn("chars_before", before).withColumn("text_chars", F.col("text_to") - F.col("text_from")).withColumn("chars_after", after)
    return rows.withColumn("near_start", F.col("chars_before") <= NEAR).withColumn("near_end", F.col("chars_after") <= NEAR)


# -- streamed parts
def streamed_parts(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Places of streamed pages (``template``, id ``B:`` or ``P:``) with the part (hidden, id ``S:``) of their key; null where none came.

    The first part of a key counts. Places and parts are few, and meet by page and key.
    """
    i = F.col("attrs")["id"]
    kind, key = F.regexp_extract(i, "^(?s:.*)([BPS]):[0-9a-fA-F]+$", 1), F.regexp_replace(i, "[BPS]:([0-9a-fA-F]+)$", "$1")
    marked = nodes.where(F.col("kind") == "element").select(id_col, "node_id", "tag", "attrs", kind.alias("k"), key.alias("key"))
    places = marked.where((F.col("tag") == "template") & F.col("k").isin("B", "P")).select(id_col, "key", F.col("node_id").alias("place_id"), F.col("k").alias("place_kind"))
    parts = marked.where((F.col("k") == "S") & F.map_contains_key("attrs", F.lit("hidden"))).groupBy(id_col, "key").agg(F.min("node_id").alias("part_id"))
    return places.join(parts, [id_col, "key"], "left").select(id_col, "key", "place_id", "place_kind", "part_id")


# -- structure that is kept
def _structure(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, category, item, n`` of opening operations: how often each page has each; list items by what they say.

    Blocks are read once: an operation gives a row to each thing that it counts for (its category, its footnote, its list
    item), and these meet in one sum.
    """
    own = blocks.where(~F.col("close"))
    counted = F.when(F.col("op") == "CodeBlock", "CodeBlocks").when(F.col("op") == "Table", "DataTables").when(F.col("op") == "Heading", "Headings")
    counted = counted.when(F.col("op").isin("InlineMath", "DisplayMath"), "MathExpressions").when((F.col("op") == "Figure") | (F.col("op") == "Image") & ~F.col("in_figure"), "Visuals")
    said = F.when(F.col("op") == "Image", F.coalesce(F.when(F.col("alt") != "", F.col("alt")), F.col("src"))).when(F.col("op") == "Media", F.coalesce("title", "src")).otherwise(F.col("text"))
    says = F.when(F.col("op").isin("Text", "InlineCode", "CodeBlock", "InlineMath", "DisplayMath", "Image", "Media"), F.trim(F.regexp_replace(said, "\\s+", " ")))
    note = F.col("op").isin("FootnoteReference", "FootnoteDefinition")
    thing = lambda when, category, label=None, at=None: F.when(when, F.struct(category.alias("category"), (F.lit(None).cast("string") if label is None else label).alias("label"), (F.lit(None).cast("int") if at is None else at).alias("at")))
    things = F.array(
        thing(counted.isNotNull(), counted), thing(note, F.lit("FootnoteDefinitions"), label=F.col("label")), thing(F.col("item_ord").isNotNull(), F.lit("ListItems"), at=F.col("item_ord")),
    )
    rows = own.select(*keys, "op", "ord", "list_ord", says.alias("says"), F.explode(F.array_compact(things)).alias("x")).select(*keys, "op", "ord", "list_ord", "says", "x.*")
    listed = F.col("category") == "ListItems"
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(listed & (F.col("says") != ""), F.struct("ord", "says")))), lambda x: x["says"]), " ")
    met = rows.groupBy(*keys, "category", "label", "at").agg(
        F.count("*").alias("n"), F.min("op").alias("lo"), F.max("op").alias("hi"), texts.alias("says"), F.max(F.when(listed & (F.col("op") == "ListItem"), F.col("list_ord"))).alias("list")
    )
    met = met.where((F.col("category") != "FootnoteDefinitions") | (F.col("lo") != F.col("hi")))
    met = met.withColumn("of", F.count("*").over(Window.partitionBy(*keys, "category", "list")))
    item = F.when(listed, F.col("says")).when(F.col("category") == "FootnoteDefinitions", F.col("label")).otherwise("")
    n = F.when(listed | (F.col("category") == "FootnoteDefinitions"), 1).otherwise(F.col("n"))
    every = F.when(listed & (F.col("of") >= SUBSTANTIAL), F.array(F.lit("ListItems"), F.lit("SubstantialListItems"))).otherwise(F.array("category"))
    return met.select(*keys, F.explode(every).alias("category"), item.alias("item"), n.alias("n")).groupBy(*keys, "category", "item").agg(F.sum("n").alias("n"))


def semantic_coverage(source: DataFrame, result: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``id, category, source_count, result_count, coverage`` of two relations of ``blocks``, as ``functions.coverage`` has it.

    List items and footnotes are met as multisets by what they say, the rest is counted. Each side is read once, both are
    counted and then summed together: nothing is joined.
    """
    needed = [id_col, "ord", "op", "close", "text", "title", "src", "alt", "label", "item_ord", "list_ord", "in_figure"]
    sides = source.select(*needed, F.lit(False).alias("of_result")).unionByName(result.select(*needed, F.lit(True).alias("of_result")))
    side = F.col("of_result")
    # the source's substantial items are met by all of the result's
    category = F.when(~side & (F.col("category") == "ListItems") | side & (F.col("category") == "SubstantialListItems"), None).when(F.col("category") == "ListItems", "SubstantialListItems").otherwise(F.col("category"))
    counts = _structure(sides, [id_col, "of_result"]).withColumn("category", category).where("category IS NOT NULL")
    both = counts.groupBy(id_col, "category", "item").agg(F.sum(F.when(side, 0).otherwise(F.col("n"))).alias("a"), F.sum(F.when(side, F.col("n")).otherwise(0)).alias("b"))
    met = F.when(F.col("category").isin("SubstantialListItems", "FootnoteDefinitions"), F.least("a", "b")).otherwise(F.col("b"))
    sums = both.groupBy(id_col, "category").agg(F.sum("a").alias("source_count"), F.sum(met).alias("result_count"))
    least = F.create_map(*(F.lit(x) for kv in LEAST.items() for x in kv))
    return sums.where(F.col("source_count") >= least[F.col("category")]).withColumn("coverage", F.least(F.col("result_count") / F.col("source_count"), F.lit(1.0)))


#: What may stand right before an operation that needs a place of its own. Fixed values.
_BEFORE = {"TableRow": (("Table", False), ("TableRow", True), ("TableCaption", True)), "TableCell": (("TableRow", False), ("TableCell", True)), "ListItem": (("List", False), ("ListItem", True)), "TableCaption": (("Table", False),)}


def tape_marks(blocks: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``id, ord, op, close, leaf, rules`` of all operations, with the rules that each breaks: all that open close again, in order and by their kind; rows, cells and items stand in theirs; levels and addresses are valid.

    An operation without content stands once and doesn't open. Depth is a running sum; an opening operation and its
    closing one are neighbours among those of one depth.
    """
    by, upto = Window.partitionBy(id_col).orderBy("ord"), Window.partitionBy(id_col).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("close"), -1).when(F.col("leaf"), 0).otherwise(1)
    rows = blocks.withColumn("depth", F.sum(step).over(upto)).withColumn("level_", F.col("depth") + F.when(F.col("close"), 1).otherwise(0))
    rows = rows.withColumn("last_depth", F.last("depth").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    paired = Window.partitionBy(id_col, "level_", ~F.col("close") & F.col("leaf")).orderBy("ord")
    rows = rows.withColumn("opened", F.lag(F.struct("op", "close")).over(paired)).withColumn("prior", F.lag(F.struct("op", "close")).over(by)).withColumn("later", F.lead("ord").over(paired))
    place = F.lit(False)
    for op, allowed in _BEFORE.items():
        good = F.lit(False)
        for name, closed in allowed:
            leaf = F.col("prior.close") == closed if closed is False else F.lit(True)  # what is empty ends where it begins
            good = good | (F.col("prior.op") == name) & leaf
        place = place | (F.col("op") == op) & ~F.col("close") & ~F.coalesce(good, F.lit(False))
    rules = {
        "Negative": F.col("depth") < 0,
        "Unclosed": (F.col("last_depth") > 0) & ~F.col("close") & ~F.col("leaf") & F.col("later").isNull(),
        "Mismatch": F.col("close") & ~F.coalesce((F.col("opened.op") == F.col("op")) & ~F.col("opened.close"), F.lit(False)),
        "Place": place,
        "Level": (F.col("op") == "Heading") & ~F.col("close") & ~F.coalesce(F.col("level").between(1, 6), F.lit(False)),
        "Address": (F.coalesce(F.col("href"), F.col("src"), F.lit("#")).rlike("(?i)^\\s*(?:javascript|vbscript|data):")),
    }
    named = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items())))
    return rows.select(id_col, "ord", "op", "close", "leaf", named.alias("rules"))


def tape_faults(blocks: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``id, ord, op, rule`` of operations that break a rule of ``tape_marks``."""
    return tape_marks(blocks, id_col).select(id_col, "ord", "op", F.explode("rules").alias("rule"))
