"""Linking the spellings of one name (problem 7).

1. Every name of a record is brought to a spelling-neutral key (``names``): Bangla in
   Latin letters, titles and brackets dropped, kinds of bodies unified, parts sorted.
2. Parts become vectors of character 4-grams and the whole part, weighted by rarity (the
   document frequencies live in a table of fixed size), and each two parts of a name the
   product of their vectors.  A distributed sparse cosine join of these products finds
   the names that are similar in two parts (``candidate_pairs``): names that share one
   part only do not meet, so the work follows the variants and not the square of the names.
3. Pairs whose whole names have a cosine under the threshold are dropped, and so are those whose
   parts contradict each other (typos, initials, short forms and missing parts do not).
   The names listed in one row meet too, whatever their cosine.
4. Average-linkage clustering by reciprocal nearest neighbours: each round all pairs of
   clusters that are each other's best merge at once, which gives the same result as
   merging one pair at a time, and no cluster is ever collected.
5. A record belongs to the cluster that holds the most of its names, so a wrong alias
   does not pull it away; records of one cluster are linked.

Joins of two tables that grow with the records ask for a merge join.  Left to itself the optimiser
broadcasts by the size of the stored file, which says nothing of the hundred and more rows that a
name becomes in Python, and little of those that dictionaries compress.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondhan.llm.names import align, parts, same_name
from sondhan.session import checkpoint, materialise, spread

BUCKETS = 1 << 17


def _key(kind: str, toks: tuple[str, ...]) -> str:
    return f"{kind}|{' '.join(sorted(toks))}"


def _open(key: str) -> tuple[str, tuple[str, ...]]:
    kind, _, rest = key.partition("|")
    return kind, tuple(rest.split())


def _features(key: str) -> Counter:
    found: Counter = Counter()
    for token in _open(key)[1]:
        padded = f"^{token}$"
        grams = [padded[: len(token) + 1]] if len(token) <= 2 else [padded, *(padded[i : i + 4] for i in range(len(padded) - 3))]
        found.update(zlib.crc32(g.encode()) % BUCKETS for g in grams)
    return found


def _vector(key: str, idf: np.ndarray) -> dict[int, float]:
    raw = {f: n * float(idf[f]) for f, n in _features(key).items()}
    norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
    return {f: v / norm for f, v in raw.items()}


def record_names(records: DataFrame, key: str = "entity_id", canonical: tuple[str, ...] = ("canonical_en", "canonical_bn"), aliases: str = "aliases") -> DataFrame:
    """(id, name key, weight, first): one row a distinct name key of a record, with the record's first name key.

    Canonical names count double; names that show fewer than two full parts less.
    Null, blank and letterless names are left out, so a record without any name has no row.
    """
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, weights, firsts = [], [], [], []
            lists = batch.column(1 + len(canonical)).to_pylist()
            for i, (*main, others) in enumerate(zip(*[batch.column(j + 1).to_pylist() for j in range(len(canonical))], lists, strict=True)):
                seen: dict[str, float] = {}
                for name, weight in [(n, 2.0) for n in main] + [(n, 1.0) for n in others or []]:
                    form = parts(name) if name else None
                    if form and form[1]:
                        full = sum(len(t) > 2 for t in form[1])
                        k = _key(*form)
                        seen[k] = seen.get(k, 0.0) + weight * (1.0 if full >= 3 else 0.9 if full == 2 else 0.5)
                at += [i] * len(seen)
                keys += seen
                weights += seen.values()
                firsts += [next(iter(seen))] * len(seen) if seen else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(keys, pa.string()), pa.array(weights, pa.float64()), pa.array(firsts, pa.string())], ["id", "name", "weight", "first"])

    return spread(records.filter(F.col(key).isNotNull()).select(key, *canonical, aliases)).mapInArrow(run, f"id {kind}, name string, weight double, first string")


def rarity(names: DataFrame) -> np.ndarray:
    """Inverse document frequencies by feature bucket: a table of BUCKETS values whatever the number of names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for k in batch.column(0).to_pylist():
                n.update(_features(k).keys())
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], ["f", "n"])

    rows = names.select("name").mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS)
    for f, n in rows:
        df[f] = n
    return np.log(1 + max(1, names.count()) / np.maximum(df, 1)).astype(np.float32)


def _grams(token: str) -> list[int]:
    padded = f"^{token}$"
    return [zlib.crc32(g.encode()) % BUCKETS for g in (padded, *(padded[i : i + 4] for i in range(len(padded) - 3)))]


def _unit(token: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of one part, of length 1."""
    f = np.array(sorted(set(_grams(token))), np.int64)
    w = idf[f].astype(np.float64)
    return f, w / (np.sqrt((w * w).sum()) or 1.0)


class _Index:
    """A worker's index keys of names, with the vectors of parts and of pairs of parts it has met."""

    def __init__(self, idf: np.ndarray, threshold: float):
        self.idf, self.threshold = idf, threshold
        self.units: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.products: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}

    def _product(self, x: str, y: str) -> tuple[np.ndarray, np.ndarray]:
        """The heaviest features (an n-gram of each part) of two parts and their weights; a part is paired with itself by its own n-grams."""
        for t in (x, y):
            if t not in self.units:
                self.units[t] = _unit(t, self.idf)
        (f, u), (g, v) = self.units[x], self.units[y]
        value, rare = np.outer(u, v).ravel(), np.outer(self.idf[f], self.idf[g]).ravel()
        key = np.minimum.outer(f, g).ravel() * BUCKETS + np.maximum.outer(f, g).ravel()
        if x == y:
            first, second = np.triu_indices(len(f), 1)
            at = first * len(f) + second
            value, rare, key = value[at], rare[at], key[at]
        value = value / (np.sqrt((value * value).sum()) or 1.0)
        order = np.lexsort((key, -rare))  # one order for all names, so that similar vectors meet in their heads
        before = np.cumsum(value[order] ** 2) - value[order] ** 2
        head = order[before <= 1 - self.threshold**2]
        return key[head], value[head].astype(np.float32)

    def heads(self, tokens: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(keys, weights) of a name: those of each two of its parts."""
        full = [t for t in tokens if len(t) > 2]
        if len(self.units) + len(self.products) > 200_000:
            self.units.clear()
            self.products.clear()
        found = []
        for x, y in itertools.combinations(full, 2) if len(full) > 1 else ((t, t) for t in full):
            if (x, y) not in self.products:
                self.products[x, y] = self._product(x, y)
            found.append(self.products[x, y])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        keys, weights = np.concatenate([k for k, _ in found]), np.concatenate([w for _, w in found])
        order = np.lexsort((-weights, keys))
        first = np.concatenate([[True], np.diff(keys[order]) != 0]) if len(order) else np.zeros(0, bool)
        return keys[order][first], weights[order][first]


def _short_heads(tokens: tuple[str, ...]) -> tuple[list[int], list[int]]:
    """(asking, offering) keys of names of two parts, one of them an initial or a short form in one of the names.

    A name asks for its long part beside the first letter of its short one, and offers each part beside the first letter of the other.
    """
    if len(tokens) != 2:
        return [], []
    asking, offering = [], []
    for x, y in (tokens, tokens[::-1]):
        if len(x) > 2:
            key = -1 - zlib.crc32(f"{x} {y[0]}".encode())
            offering.append(key)
            if len(y) <= 2 or (4 <= len(y) <= 6 and y[-1] in "aeiou"):
                asking.append(key)
    return asking, offering


def candidate_pairs(names: DataFrame, idf: np.ndarray, threshold: float = 0.35, shared: float = 0.05) -> DataFrame:
    """(a, b) of 64-bit name ids, a < b once a pair: names that agree in n-grams of two of their parts.

    The vectors joined are the products of the parts' n-gram vectors: a feature is an n-gram
    of one part together with an n-gram of another.  Two names that only share a part
    have no common feature, so the number of candidates follows that of the
    variants and not the square of the names.  The rarest features that hold 1 - threshold^2
    of the mass of each two parts are indexed; the join sums up the dot product over the indexed features,
    and pairs below ``shared`` are dropped.  Two names with two parts each whose product of cosines is
    ``threshold`` + ``shared`` or more are always found, most others too.  No feature is left out for being frequent;
    adaptive execution splits its join.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_hand = _Index(idf, threshold)
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1).to_pylist()
            found = [at_hand.heads(_open(k)[1]) for k in keys]
            at = pa.array(np.repeat(np.arange(len(keys), dtype=np.int32), [len(f) for f, _ in found]))
            flat = [np.concatenate([x[j] for x in found]) if found else np.zeros(0, t) for j, t in enumerate((np.int64, np.float32))]
            yield pa.RecordBatch.from_arrays([pa.array(flat[0], pa.int64()), ids.take(at), pa.array(flat[1], pa.float32())], ["f", "id", "w"])

    def index_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), []
            for i, k in enumerate(batch.column(1).to_pylist()):
                ask, offer = _short_heads(_open(k)[1])
                rows += [(f, i, True) for f in ask] + [(f, i, False) for f in offer]
            f, at, asks = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), ids.take(pa.array(at, pa.int32())), pa.array(asks, pa.bool_())], ["f", "id", "asks"])

    spread_names = spread(names.select("id", "name"))
    posts = spread_names.mapInArrow(index, "f long, id long, w float")
    left, right = posts.select("f", F.col("id").alias("a"), F.col("w").alias("u")), posts.select("f", F.col("id").alias("b"), F.col("w").alias("v"))
    met = left.join(right.hint("merge"), "f").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("u") * F.col("v")).alias("dot")).filter(F.col("dot") >= shared).select("a", "b")
    brief = spread_names.mapInArrow(index_short, "f long, id long, asks boolean")
    ask, offer = brief.filter("asks").select("f", F.col("id").alias("a")), brief.filter("not asks").select("f", F.col("id").alias("b"))
    short = ask.join(offer.hint("merge"), "f").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.unionByName(short).distinct()


def similar_names(names: DataFrame, threshold: float = 0.35, shared: float = 0.05, least: float = 0.3, top: int | None = None, listed: DataFrame | None = None) -> DataFrame:
    """(a, b, s), a < b: name keys whose vectors are similar and whose parts agree; s in 0..1.

    ``threshold``, ``shared``: see ``candidate_pairs``.  Pairs of a cosine (of the whole names' n-gram
    vectors) under ``least`` are dropped, but for those of ``listed`` (a, b), names of one record, which the record itself vouches for.
    ``top`` keeps a pair only if it is among the so many nearest of either name; without it all pairs are kept.
    """
    idf = rarity(names)
    keyed = materialise(names.select(F.xxhash64("name").alias("id"), "name"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, dict[int, float]] = {}
        for batch in batches:
            a, b, s = [], [], []
            if len(cache) > 100_000:
                cache.clear()
            for x, y, sure in zip(*[batch.column(j).to_pylist() for j in range(3)], strict=True):
                u, v = cache.get(x) or cache.setdefault(x, _vector(x, idf)), cache.get(y) or cache.setdefault(y, _vector(y, idf))
                cosine = sum(w * v[f] for f, w in u.items() if f in v)
                if cosine >= least or sure:
                    (kx, tx), (ky, ty) = _open(x), _open(y)
                    if sure and not (kx and ky and kx != ky):
                        agree, full, weak = align(tx, ty)
                        agree = agree if full >= 1 or weak >= 2 else 0.0
                    else:
                        agree = same_name(kx, tx, ky, ty)
                    if agree > 0:
                        a.append(x)
                        b.append(y)
                        s.append((cosine + agree) / 2)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(s, pa.float64())], ["a", "b", "s"])

    pairs = candidate_pairs(keyed, idf, threshold, shared).withColumn("sure", F.lit(False))
    if listed is not None:
        own = listed.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"), F.lit(True).alias("sure"))
        pairs = pairs.unionByName(own).groupBy("a", "b").agg(F.max("sure").alias("sure"))
    named = pairs.join(keyed.toDF("a", "x").hint("merge"), "a").join(keyed.toDF("b", "y").hint("merge"), "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "sure")
    found = named.mapInArrow(verify, "a string, b string, s double")
    if top is None:
        return found
    found = materialise(found)
    sides = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    near = sides.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).filter(F.col("r") <= top)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s").distinct()


def average_linkage(edges: DataFrame, threshold: float = 0.15, max_rounds: int = 10_000) -> DataFrame:
    """(v, r): cluster representative of every vertex that merges with another.

    ``edges``: (a, b, s) with a < b, one row a pair; a pair without a row has similarity 0.
    Ties are broken by a fresh hash a round, so that tied pairs merge side by side.  Goes on until no
    pair is left to merge; raises if that takes over ``max_rounds`` rounds.
    """
    work = checkpoint(edges.select("a", "b", "s", F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")))
    maps: list[DataFrame] = []
    for turn in range(max_rounds):
        mean = F.col("s") / (F.col("na") * F.col("nb"))
        good = work.filter(mean >= threshold).select("a", "b", "na", "nb", F.struct(F.round(mean, 12).alias("m"), F.xxhash64("a", "b", F.lit(turn)).alias("h"), F.col("a").alias("x"), F.col("b").alias("y")).alias("e"))
        ends = good.select(F.explode(F.array("a", "b")).alias("v"), "e", F.col("na") + F.col("nb"))
        best = ends.toDF("v", "e", "size").groupBy("v").agg(F.max(F.struct("e", "size")).alias("t"))
        pairs = best.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("t.e.x", "t.e.y", "t.size")
        moved = checkpoint(pairs.select(F.explode(F.array("x", "y")).alias("v"), F.col("x").alias("r"), "size"))
        if not moved.take(1):
            break
        maps.append(moved.select("v", "r"))
        to_a = moved.select(F.col("v").alias("a"), F.col("r").alias("ra"), F.col("size").alias("sa"))
        to_b = moved.select(F.col("v").alias("b"), F.col("r").alias("rb"), F.col("size").alias("sb"))
        step = work.join(to_a, "a", "left").join(to_b, "b", "left").select(
            F.coalesce("ra", "a").alias("p"), F.coalesce("sa", "na").alias("np"), F.coalesce("rb", "b").alias("q"), F.coalesce("sb", "nb").alias("nq"), "s"
        )
        step = step.filter("p <> q").select(
            F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "s", F.when(F.col("p") < F.col("q"), F.col("np")).otherwise(F.col("nq")).alias("na"),
            F.when(F.col("p") < F.col("q"), F.col("nq")).otherwise(F.col("np")).alias("nb"),
        )
        work = checkpoint(step.groupBy("a", "b").agg(F.sum("s").alias("s"), F.max("na").alias("na"), F.max("nb").alias("nb")))
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    if not maps:
        return work.select(F.col("a").alias("v"), F.col("b").alias("r")).limit(0)
    # a representative may merge again later: expand from the last round, adding vertices that joined in each
    merged = maps[-1]
    for rep in reversed(maps[:-1]):
        onward = merged.select(F.col("v").alias("r"), F.col("r").alias("onward"))
        moved_on = rep.join(onward, "r", "left").select("v", F.coalesce("onward", "r").alias("r"))
        merged = checkpoint(moved_on.unionByName(merged.join(rep.select("v"), "v", "left_anti")))
    return merged


def entity_clusters(records: DataFrame, key: str = "entity_id", threshold: float = 0.15) -> DataFrame:
    """(id, cluster) for every record with a usable name."""
    every = materialise(record_names(records, key))
    named = every.groupBy("id", "name").agg(F.sum("weight").alias("weight"))
    names = materialise(every.select("name").distinct())
    # the names of a row meet as a star around its first: as many pairs as names
    listed = every.filter("name <> first").select(F.least("name", "first").alias("a"), F.greatest("name", "first").alias("b")).distinct()
    edges = materialise(similar_names(names, listed=listed))
    merged = average_linkage(edges, threshold).select(F.col("v").alias("name"), F.col("r").alias("cluster"))
    held = named.join(merged, "name", "left").groupBy("id", F.coalesce("cluster", "name").alias("cluster")).agg(F.sum("weight").alias("weight"))
    held = materialise(held)
    wide = held.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cluster", F.lit(0.9).alias("bonus"))
    score = F.col("weight") + F.coalesce("bonus", F.lit(0.0))
    return held.join(wide.hint("merge"), "cluster", "left").groupBy("id").agg(F.max_by("cluster", F.struct(score, F.col("cluster"))).alias("cluster"))


def entity_classes(records: DataFrame, key: str = "entity_id") -> DataFrame:
    """(id, cluster, links): one row a record with a usable name; ``cluster`` is the smallest id of its cluster, ``links`` how many other records it holds."""
    of = materialise(entity_clusters(records, key))
    size = of.groupBy("cluster").agg(F.min("id").alias("first"), (F.count(F.lit(1)) - 1).alias("links"))
    return of.join(size.hint("merge"), "cluster").select("id", F.col("first").alias("cluster"), "links")


def entity_pairs(records: DataFrame, key: str = "entity_id") -> DataFrame:
    """(a, b), a < b: records of one cluster, all pairs (``entity_classes`` says the same in one row a record)."""
    of = materialise(entity_clusters(records, key))
    left, right = of.select("cluster", F.col("id").alias("a")), of.select("cluster", F.col("id").alias("b"))
    return left.join(right.hint("merge"), "cluster").filter("a < b").select("a", "b")
