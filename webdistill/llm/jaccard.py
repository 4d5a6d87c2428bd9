"""N-gram Jaccard join: which documents' sets of word shingles overlap by a threshold or more, exactly.

Size-aware heavy-light join over classes of documents with equal sets:

* Every set is put in one order (by hash, common elements last). Two sets that link share most of their elements, so the first few of what
  they share lie near the front of both: a set of n elements of which at least c must be shared has k shared ones
  among its first n - c + k.
* Light sets (small ones) enumerate the fixed-size subsets (k = 2) of those elements as keys; two light sets that link
  have a key in common.
* Heavy sets put their first n - c + 1 elements into inverted lists. Any set probes the lists with its own, so pairs
  with a heavy set share an element there.
* The boundary between them is chosen by cost: keys enumerated against list entries scanned, from the sizes of all sets.
* Elements that many sets share (of a passage that recurs) are moved to the end of the order, for all sets alike, so
  lists of what is common are met only by sets that hold little else.

Keys are not joined with themselves pair by pair either. Each member of a key is compared with the key's first set;
pairs whose sketches (bits that each element turns over) differ too much are ruled out before whole sets are fetched; links found are contracted to components, and only keys whose members still lie in different components are gone
through again, so large groups of near copies cost their size and not its square. No link between components is lost:
the last round compares all members of different components that share a key.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webdistill.llm import common, worker
from webdistill.llm.components import components

_WORDS = re.compile(rb"[^ \t-\r]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: An element that more sets than this share is put last in the order.
LONG = 64
#: Common elements that may go to every task, 8 bytes each; where there are more, they are joined.
MOST_COMMON = 1 << 20
#: Rounds in which a member of a key meets one head of it: what a scan of a list costs a member at most, however long.
ROUNDS = 4
#: Bits of the sketch that every set has, and of the wide one of sets of more than ``WIDE_FROM`` elements.
SKETCH, WIDE = 512, 4096
WIDE_FROM = 700
#: Largest number of shared elements that a light set's keys combine.
SUBSET = 2


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams; words are cached by hash, in a bounded cache."""

    def __init__(self, n: int, most: int = 150_000):
        self.n, self.most, self.cache = n, most, {}

    def word(self, w: bytes) -> int:
        from hashlib import blake2b

        if len(self.cache) >= self.most:
            self.cache.clear()
        found = self.cache[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
        if not words:
            return np.zeros(0, dtype=np.int64)
        cache, word = self.cache, self.word
        h = np.array([cache[w] if w in cache else word(w) for w in words], dtype=np.uint64)
        n = min(self.n, len(h))
        out = np.zeros(len(h) - n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)] + np.uint64(k + 1 + (len(h) < self.n) * 64 * len(h)))
        return np.unique(out.view(np.int64))


def least_shared(n: int, num: int, den: int) -> int:
    """Elements that a set of n shares at least with any set it links to."""
    return -(-n * num // den)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def front_size(n: int, num: int, den: int) -> int:
    """Of a set of n, the elements among which it has ``SUBSET`` in common with any set it links to."""
    return n - least_shared(n, num, den) + SUBSET


def kept_size(n: int, num: int, den: int) -> int:
    """Elements kept of a set of n: its front and half as many, to take the place of common ones."""
    f = front_size(n, num, den)
    return min(n, f + max(8, f // 2))


def sketch(elements: np.ndarray, bits: int) -> np.ndarray:
    """Each bit says whether an odd number of elements has its number for low bits, as 64-bit words.

    Elements of both sets cancel out, so two sets differ in at least as many elements as their sketches do in bits.
    """
    odd = (np.bincount(elements & (bits - 1), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def sets(docs: DataFrame, n: int, num: int, den: int, whole: bool) -> DataFrame:
    """``doc_id, n, d1, d2`` (128-bit digest of the set) and either the whole ``elements`` or ``kept, sketch, wide``.

    Sketches rule most pairs out for good without the sets; ``wide`` is empty for small sets.
    """
    from hashlib import blake2b

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "d1", "d2", *(["elements"] if whole else ["kept", "sketch", "wide"])]
    nothing = np.zeros(0, dtype=np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = _shingler(n)
        for batch in batches:
            at, rows, size = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                s = shingle(text.as_py())
                d = np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), dtype="<i8")
                if whole:
                    rows.append((len(s), d[0], d[1], s))
                else:
                    rows.append((len(s), d[0], d[1], s[: kept_size(len(s), num, den)], sketch(s, SKETCH), sketch(s, WIDE) if len(s) > WIDE_FROM else nothing))
                size += len(rows[-1][3]) + 8
                if size > 1 << 20 or i == batch.num_rows - 1:
                    a, b, c, *lists = zip(*rows, strict=True)
                    numbers = (pa.array(np.array(x, dtype=np.int64)) for x in (a, b, c))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), *numbers, *(_lists(list(x)) for x in lists)], names)
                    at, rows, size = i + 1, [], 0

    last = "elements array<long>" if whole else "kept array<long>, sketch array<long>, wide array<long>"
    return docs.mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long, {last}")


def _shingler(n: int) -> Shingler:
    return worker.held("shingler", n, lambda: Shingler(n))


def boundary(sizes: list[tuple[int, int]], num: int, den: int, entries: float) -> int:
    """Largest size of a light set, by cost.

    ``sizes`` has (size, number of sets) of all sets and ``entries`` the mean number of others that a set meets in a list
    (one a round, at most). A light set pays for each subset of its front; a heavy one pays for each list entry, and for each other set
    it meets there.
    """
    best, best_cost, light, heavy = 0, None, 0.0, 0.0
    front = lambda s: s - least_shared(s, num, den)
    sizes = sorted(sizes)
    heavy = sum(c * (front(s) + 1) * (1 + entries) for s, c in sizes)
    best_cost = heavy
    for s, c in sizes:
        light += c * math.comb(front(s) + SUBSET, SUBSET)
        heavy -= c * (front(s) + 1) * (1 + entries)
        if light + heavy < best_cost:
            best, best_cost = s, light + heavy
        if math.comb(front(s) + SUBSET, SUBSET) > 5000:
            break
    return best


def _subset_keys(front: Column) -> Column:
    """Hashes of all pairs of a front's elements; the sole element of a set of one stands for itself."""
    pairs = F.flatten(F.transform(front, lambda x, i: F.transform(F.slice(front, i + 2, F.size(front)), lambda y: F.xxhash64(x, y))))
    return F.when(F.size(front) < SUBSET, front).otherwise(pairs)


class Join:
    """One join: shingles of ``n`` words; sets link if den * shared >= num * united, with num / den above one half."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str):
        if 2 * num <= den:
            raise ValueError("a similarity above one half is needed")
        self.n, self.num, self.den = n, num, den
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def whole_sets(self, ids: DataFrame) -> DataFrame:
        """``id, n, elements`` of some documents, from their texts again: only these sets are carried whole.

        Ids that fit are broadcast, which their count and width have to show; more are joined by a shuffle.
        """
        ids = ids.select(F.col("id").alias("doc_id"))
        ids = F.broadcast(ids) if common.fits(ids) else ids
        found = sets(self.docs.join(ids, "doc_id", "left_semi"), self.n, self.num, self.den, True)
        return common.save(found.select(F.col("doc_id").alias("id"), "n", "elements"), "jaccard-sets")

    def reordered(self, ids: DataFrame, hot: DataFrame) -> DataFrame:
        """``id, n, front`` of some documents with the ``hot`` elements (``MOST_COMMON`` at most) last, from their texts."""
        spark, n, num, den = ids.sparkSession, self.n, self.num, self.den
        last = spark.sparkContext.broadcast(np.sort(hot.toArrow()["e"].to_numpy()))
        ids = ids.select(F.col("id").alias("doc_id"))
        kind = ids.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingle = _shingler(n)
            for batch in batches:
                sizes, fronts = [], []
                for text in batch.column(1):
                    s = shingle(text.as_py())
                    is_last = np.isin(s, last.value)
                    sizes.append(len(s))
                    fronts.append(np.concatenate([s[~is_last], s[is_last]])[: front_size(len(s), num, den)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), _lists(fronts)], ["id", "n", "front"])

        docs = self.docs.join(F.broadcast(ids) if common.fits(ids) else ids, "doc_id", "left_semi")
        return common.save(docs.mapInArrow(run, f"id {kind}, n long, front array<long>"), "jaccard-again")

    def ordered(self, classes: DataFrame) -> DataFrame:
        """``id, n, front``: fronts in the order that has common elements last.

        Common are elements that more than ``LONG`` sets keep. A set that keeps none has its first elements for a front;
        others move the common ones back. Where too few others were kept, the whole set is ordered again.
        """
        size = F.col("n") - F.ceil(F.col("n") * self.num / self.den) + SUBSET
        each = classes.select("id", F.explode("kept").alias("e"))
        hot = common.save(each.groupBy("e").agg(F.count("*").alias("c")).where(F.col("c") > LONG).select("e"), "jaccard-common")
        if not hot.limit(1).count():
            return classes.select("id", "n", F.slice("kept", 1, size.cast("int")).alias("front"))
        own = each.join(hot, "e").groupBy("id").agg(F.collect_list("e").alias("hot"))  # of a set's own elements
        moved = classes.select("id", "n", "kept").join(own, "id", "left").withColumn("others", F.when(F.col("hot").isNull(), F.col("kept")).otherwise(F.array_except("kept", "hot")))
        done = (F.size("others") >= size) | (F.size("kept") >= F.col("n"))
        front = F.slice(F.concat("others", F.coalesce(F.array_sort("hot"), F.array().cast("array<long>"))), 1, size.cast("int"))
        moved = common.save(moved.select("id", "n", F.when(done, front).alias("front")), "jaccard-fronts")
        if hot.count() <= MOST_COMMON:
            return moved.where("front IS NOT NULL").unionByName(self.reordered(moved.where("front IS NULL").select("id"), hot))
        whole = self.whole_sets(moved.where("front IS NULL").select("id"))
        own = whole.select("id", F.explode("elements").alias("e")).join(hot, "e").groupBy("id").agg(F.collect_list("e").alias("hot"))
        again = whole.join(own, "id").select("id", "n", F.slice(F.concat(F.array_except("elements", "hot"), F.array_sort("hot")), 1, size.cast("int")).alias("front"))
        return moved.where("front IS NOT NULL").unionByName(common.save(again, "jaccard-again"))

    def keys(self, classes: DataFrame) -> DataFrame:
        """``key, id, n``: sets that link have a key in common. Keys of one set alone are left out."""
        fronts = self.ordered(classes)
        sizes = [(r["n"], r["c"]) for r in fronts.groupBy("n").agg(F.count("*").alias("c")).collect()]  # a row a size
        lists = lambda f: f.select(F.explode(F.slice("front", 1, F.greatest(F.size("front") - SUBSET + 1, F.lit(1)))).alias("e"), "id", "n")
        part = lists(fronts).where(F.col("e") % 4 == 0).groupBy("e").agg(F.count("*").cast("double").alias("c"))  # of one quarter of all lists
        met = part.agg(F.sum(F.col("c") * F.least(F.col("c") - 1, F.lit(float(ROUNDS)))) / F.sum("c")).first()[0] or 0.0
        light = boundary(sizes, self.num, self.den, met)
        subsets = fronts.where(F.col("n") <= light).select(F.explode(_subset_keys(F.col("front"))).alias("key"), "id", "n")
        # a light set probes the lists if it is large enough to link to a heavy one
        listed = lists(fronts.where(F.col("n") * self.den >= F.lit(light * self.num))).select(F.xxhash64("e", F.lit("list")).alias("key"), "id", "n")
        every = subsets.unionByName(listed)
        shared = every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
        return common.save(every.join(shared, "key"), "jaccard-keys")

    def alike(self, x: str, y: str, bits: int, na: str, nb: str) -> Column:
        """Whether two sketches allow a link: the sets differ in as many elements as their sketches do in bits, at least."""
        differ = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(bits // 64)), F.lit(0))
        return differ.cast("long") * (self.den + self.num) <= (F.col(na) + F.col(nb)) * (self.den - self.num)

    def possible(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs ``a, b`` whose sketches don't rule a link out; the wide ones where both sets have one."""
        left, right = (sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("wide").alias(f"w{x}")) for x in ("a", "b"))
        wide = (F.size("wa") == 0) | (F.size("wb") == 0) | self.alike("wa", "wb", WIDE, "na", "nb")
        return pairs.join(right, "b").join(left, "a").where(self.alike("sa", "sb", SKETCH, "na", "nb") & wide).select("a", "b")

    def verified(self, pairs: DataFrame, whole: DataFrame) -> DataFrame:
        """Of pairs ``a, b`` those whose sets link. The sets of ``b`` go to that of ``a``; pairs that fit are broadcast to
        the written sets, so each set moves once a pair and none for pairs of other rounds."""
        first = pairs.select("a").distinct()
        small = F.broadcast if common.fits(pairs) else lambda x: x
        left = whole.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("elements").alias("ea")).join(small(first), "a", "left_semi")
        right = whole.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("eb")).join(small(pairs), "b")
        both = right.join(left, "a").select("a", "b", "na", "nb", F.size(F.array_intersect("ea", "eb")).cast("long").alias("shared"))
        return both.where(F.lit(self.den) * F.col("shared") >= F.lit(self.num) * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")

    def pairs(self, keys: DataFrame, label: DataFrame | None, step: str, sketches: DataFrame) -> DataFrame:
        """Pairs of sets in different components that share a key and may link: each set and the head it shares most
        keys with (``first``), each set and the heads of all its keys (``heads``), or all sets (``all``; there the
        sketches are compared within the join, so pairs that they rule out are no rows)."""
        named = keys.withColumn("component", F.col("id")) if label is None else keys.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        heads = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("component", "id", "n")).alias("head")).where("low <> high")
        heads = heads.select("key", F.col("low").alias("ca"), F.col("head.id").alias("a"), F.col("head.n").alias("na"))
        near = F.lit(self.den) * F.least("n", "na") >= F.lit(self.num) * F.greatest("n", "na")
        if step == "all":
            left = named.join(heads.select("key"), "key", "left_semi").join(sketches.select("id", F.col("sketch").alias("sb")), "id")
            other = left.select(F.col("key").alias("k"), F.col("component").alias("ca"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("sb").alias("sa"))
            both = (F.col("key") == F.col("k")) & (F.col("ca") < F.col("component")) & near & self.alike("sa", "sb", SKETCH, "na", "n")
            found = left.join(other, both).select("a", F.col("id").alias("b"))
        else:
            found = named.join(heads, "key").where((F.col("ca") < F.col("component")) & near).select("a", F.col("id").alias("b"))
        if step == "first":
            found = found.groupBy("a", "b").agg(F.count("*").alias("c")).groupBy("b").agg(F.max_by("a", "c").alias("a"))
        return self.possible(found.distinct(), sketches)

    def run(self) -> DataFrame:
        spark = self.docs.sparkSession
        found = common.save(sets(self.docs, self.n, self.num, self.den, False), "jaccard-sets")
        members = common.save(found.select("doc_id", "n", "d1", "d2"), "jaccard-members")
        first = [F.first(c).alias(c) for c in ("n", "kept", "sketch", "wide")]
        classes = found.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), *first)
        classes = common.save(classes, "jaccard-classes")
        common.drop(spark, found)
        keys = self.keys(classes)
        sketches = classes.select("id", "n", "sketch", "wide")
        links, label, whole, ids = None, None, None, None
        for step in ("first", "heads", "heads", "all"):
            pairs = common.save(self.pairs(keys, label, step, sketches), "jaccard-pairs")
            need = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            need = common.save(need if ids is None else need.join(ids, "id", "left_anti"), "jaccard-need")
            more = self.whole_sets(need)
            whole, ids = (more, need) if whole is None else (whole.unionByName(more), ids.unionByName(need))
            linked = common.save(self.verified(pairs, whole), "jaccard-links")
            common.drop(spark, pairs)
            if linked.limit(1).count():
                links = linked if links is None else links.unionByName(linked)
                label = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        for done in (keys, whole, ids):
            common.drop(spark, done)
        named = classes.select("d1", "d2", "id").withColumn("component", F.col("id"))
        if label is not None:
            named = classes.select("d1", "d2", "id").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        out = members.join(named.select("d1", "d2", "component"), ["d1", "d2"], "left")
        alone = (F.col("n") == 0) | F.col("doc_id").isNull()
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a set holds the distinct ``n``-word shingles, or the
    whole sequence where there are fewer words. Documents link if their sets' Jaccard similarity is ``num`` / ``den`` at
    least, and ``component_id`` is the smallest id reachable by links, itself included.

    Null, empty and blank texts have empty sets and link with nothing, rows with a null id neither. Repeated rows are
    returned each; rows that share an id but not a text count as one document. Other columns are not carried.
    """
    return Join(docs, n, num, den, id_col, text_col).run()


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the documents that stay: those of the smallest id of each component, and all that link with nothing."""
    found = join(docs, n, num, den, id_col, text_col)
    return common.without(docs, found.where(F.col("component_id") < F.col("doc_id")).select("doc_id"), id_col)
