"""URL filter: host and path rules, and a character language-model ratio for URLs that no rule fits.

Native: only DataFrame functions. Two smoothed variable-order Markov models over characters are counted from all URLs
that a rule accepts or rejects; the longest context with evidence weighs most (Witten-Bell interpolation of contexts of
two, one and no characters). A URL's score is the mean over its characters of log P(rejected) - log P(accepted), and it
is blocked above a threshold calibrated on the scores of the ruled URLs. The models see host and path only: URLs that differ in scheme,
query or fragment have the same score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webdistill.llm import common

#: Characters the models tell apart; any other is one further symbol, the start of a URL another.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~/:%+@,;=!$&'()*"
SIZE = len(ALPHABET) + 2
START = SIZE - 1
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def match(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Of (verdict, host, path start) rules the longest that fits: its name and verdict, or nulls.

    A rule fits its host and all subdomains. Of rules of equal length the first given wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def grams(text: Column) -> Column:
    """A number for each character with the two before it; each number is below ``SIZE`` cubed."""
    chars = F.filter(F.split(F.translate(text, _UPPER, _UPPER.lower()), ""), lambda c: c != "")
    codes = F.concat(F.array(F.lit(START), F.lit(START)), F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c)))
    shifted = F.arrays_zip(codes.alias("a"), F.slice(codes, 2, F.size(chars) + 1).alias("b"), F.slice(codes, 3, F.size(chars) + 1).alias("c"))
    return F.filter(F.transform(shifted, lambda x: (x["a"] * SIZE + x["b"]) * SIZE + x["c"]), lambda g: g.isNotNull())


def ratio_model(ruled: DataFrame) -> DataFrame:
    """``gram, value``: log P(rejected) - log P(accepted) of a character after two others, from ``verdict, gram`` counts.

    ``ruled`` has ``verdict`` (allow or block), ``gram`` and ``n``. Both classes are smoothed down to even odds over the
    alphabet. At most ``SIZE`` cubed rows, whatever the input.
    """
    spark = ruled.sparkSession
    counts = ruled.select(
        "verdict", "n", (F.col("gram") / (SIZE * SIZE)).cast("int").alias("a"), ((F.col("gram") / SIZE).cast("int") % SIZE).alias("b"), (F.col("gram") % SIZE).alias("c")
    )
    small = F.broadcast  # of any table here: none has more than two rows for each of SIZE cubed grams
    both = spark.range(2).select(F.when(F.col("id") == 0, "allow").otherwise("block").alias("verdict"))
    symbols = spark.range(SIZE).select(F.col("id").cast("int").alias("c"))
    total = counts.groupBy("verdict").agg(F.sum("n").alias("n0"))
    order0 = counts.groupBy("verdict", "c").agg(F.sum("n").alias("n"))
    p0 = both.crossJoin(symbols).join(small(order0), ["verdict", "c"], "left").join(small(total), "verdict", "left")
    p0 = p0.select("verdict", "c", ((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("n0", F.lit(0)) + SIZE)).alias("p0"))
    by1 = counts.groupBy("verdict", "b", "c").agg(F.sum("n").alias("n"))
    all1 = by1.groupBy("verdict", "b").agg(F.sum("n").alias("n1"), F.count("*").alias("t1"))
    prior = symbols.withColumnRenamed("c", "b")
    p1 = p0.crossJoin(prior).join(small(by1), ["verdict", "b", "c"], "left").join(small(all1), ["verdict", "b"], "left")
    mixed = lambda n, m, t, low: F.when(F.col(m) > 0, (F.coalesce(n, F.lit(0)) + F.col(t) * F.col(low)) / (F.col(m) + F.col(t))).otherwise(F.col(low))
    p1 = p1.select("verdict", "b", "c", mixed("n", "n1", "t1", "p0").alias("p1"))
    all2 = counts.groupBy("verdict", "a", "b").agg(F.sum("n").alias("n2"), F.count("*").alias("t2"))
    p2 = p1.crossJoin(symbols.withColumnRenamed("c", "a")).join(small(counts), ["verdict", "a", "b", "c"], "left").join(small(all2), ["verdict", "a", "b"], "left")
    p2 = p2.select("verdict", "a", "b", "c", mixed("n", "n2", "t2", "p1").alias("p"))
    sign = F.when(F.col("verdict") == "block", F.log("p")).otherwise(-F.log("p"))
    return p2.groupBy(((F.col("a") * SIZE + F.col("b")) * SIZE + F.col("c")).cast("int").alias("gram")).agg(F.sum(sign).alias("value"))


def score(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Add ``score`` to rows with a ``grams`` array and a ``row`` number of their own: the mean value of its grams, null without any.

    The model has at most ``SIZE`` cubed rows (about 3 MB), which is why it may be broadcast. The exploded rows are
    summed where they arise, so one row a URL is shuffled, by its number: URLs that very many rows share are no hot key.
    """
    kept = [c for c in rows.columns if c != "grams"]
    each = rows.select(*kept, F.explode_outer("grams").alias("gram")).join(F.broadcast(model), "gram", "left")
    return each.groupBy("row").agg(*(F.first(c).alias(c) for c in kept if c != "row"), F.avg("value").alias("score"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, score, verdict`` of every URL.

    The verdict is the longest fitting rule's, or else the models': block if ``score`` lies above the calibrated
    threshold (between the means of the ruled URLs' scores by class, nearer the class that varies less), allow otherwise. Where the ruled
    URLs lack a class, or a URL has no host and path, the models can't tell and allow. Repeated rows are judged each.
    """
    host, path = host_path(F.col(url_col))
    base = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = match(rules, F.col("host"), F.col("path"))
    base = base.select("row", "page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), grams(F.concat("host", "path")).alias("grams"))
    ruled = base.where(F.col("ruled").isNotNull())
    counted = ruled.select(F.col("ruled").alias("verdict"), F.explode("grams").alias("gram")).groupBy("verdict", "gram").agg(F.count("*").alias("n"))
    model = common.save(ratio_model(common.save(counted, "url-grams")), "url-model")  # two counts and one value a gram at most
    scored = common.save(score(base, model), "url-scores")
    of = lambda v, f: f(F.when(F.col("ruled") == v, F.col("score")))
    ma, mr, sa, sr = (of("allow", F.avg), of("block", F.avg), of("allow", F.stddev_pop), of("block", F.stddev_pop))
    weight = F.when(sa + sr > 0, sr / (sa + sr)).otherwise(F.lit(0.5))
    limit = scored.where(F.col("ruled").isNotNull()).agg((mr - weight * (mr - ma)).alias("limit")).scalar()
    blocked = F.coalesce(F.col("score") > limit, F.lit(False))
    return scored.select("page_id", "host", "path", "rule", "score", F.coalesce("ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict"))


#: DuckDB SQL of the same over ``pages``.
SQL = """
WITH t AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS t FROM pages),
h AS (SELECT page_id, t, regexp_extract(t, '^[^/?#]*') AS h FROM t),
b AS (SELECT row_number() OVER () AS row, page_id, translate(h, '{upper}', lower('{upper}')) AS host, regexp_extract(substr(t, length(h) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM b),
x AS (SELECT row, ruled, list_transform(string_split(translate(host || path, '{upper}', lower('{upper}')), ''), lambda c: instr('{alphabet}', c)) AS k FROM r WHERE host || path <> ''),
g AS (SELECT row, ruled, CASE WHEN i > 2 THEN k[i - 2] ELSE {start} END AS a, CASE WHEN i > 1 THEN k[i - 1] ELSE {start} END AS b, k[i] AS c FROM x, unnest(range(1, len(k) + 1)) AS t(i)),
n AS (SELECT ruled AS v, a, b, c, count(*) AS n FROM g WHERE ruled IS NOT NULL GROUP BY ALL),
n0 AS (SELECT v, sum(n) AS n0 FROM n GROUP BY ALL), o0 AS (SELECT v, c, sum(n) AS o0 FROM n GROUP BY ALL),
o1 AS (SELECT v, b, c, sum(n) AS o1 FROM n GROUP BY ALL), m1 AS (SELECT v, b, sum(o1) AS n1, count(*) AS t1 FROM o1 GROUP BY ALL),
m2 AS (SELECT v, a, b, sum(n) AS n2, count(*) AS t2 FROM n GROUP BY ALL),
d AS (SELECT DISTINCT unnest(['allow', 'block']) AS v, a, b, c FROM g),
p0 AS (SELECT v, a, b, c, (coalesce(o0, 0) + 1) / (coalesce(n0, 0) + {size}) AS p FROM d LEFT JOIN n0 USING (v) LEFT JOIN o0 USING (v, c)),
p1 AS (SELECT v, a, b, c, CASE WHEN n1 > 0 THEN (coalesce(o1, 0) + t1 * p) / (n1 + t1) ELSE p END AS p FROM p0 LEFT JOIN o1 USING (v, b, c) LEFT JOIN m1 USING (v, b)),
p2 AS (SELECT v, a, b, c, CASE WHEN n2 > 0 THEN (coalesce(n, 0) + t2 * p) / (n2 + t2) ELSE p END AS p FROM p1 LEFT JOIN n USING (v, a, b, c) LEFT JOIN m2 USING (v, a, b)),
f AS (SELECT a, b, c, sum(CASE WHEN v = 'block' THEN ln(p) ELSE -ln(p) END) AS value FROM p2 GROUP BY ALL),
s AS (SELECT row, avg(value) AS score FROM g JOIN f USING (a, b, c) GROUP BY ALL),
m AS (SELECT avg(score) FILTER (ruled = 'allow') AS ma, avg(score) FILTER (ruled = 'block') AS mr, stddev_pop(score) FILTER (ruled = 'allow') AS sa, stddev_pop(score) FILTER (ruled = 'block') AS sr
  FROM s JOIN r USING (row)),
l AS (SELECT mr - CASE WHEN sa + sr > 0 THEN sr / (sa + sr) ELSE 0.5 END * (mr - ma) AS lim FROM m)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score > lim THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN s USING (row), l
"""


def sql(rules: list[tuple[str, str, str]]) -> str:
    """``SQL`` for rules; of rules of equal length the first given wins."""
    order = sorted(rules, key=lambda r: -len(r[1]) - len(r[2]))
    fits = "WHEN (host = '{1}' OR ends_with(host, '.{1}')) AND starts_with(path, '{2}') THEN "
    case = lambda value: "CASE " + " ".join(fits.format(*r) + f"'{value(r)}'" for r in order) + " END"
    return SQL.format(upper=_UPPER, alphabet=ALPHABET.replace("'", "''"), start=START, size=SIZE, rule=case(lambda r: r[1] + r[2]), ruled=case(lambda r: r[0]))
