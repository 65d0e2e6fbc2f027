"""Removing repeated articles: by address, and by set similarity within blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondhan.functions.text import or_empty, shingle_hashes
from sondhan.session import checkpoint, materialise


def normalize_url(url: Column) -> Column:
    """Lower case, without scheme, www, closing slashes and query, taken off in this order."""
    u = F.regexp_replace(F.lower(or_empty(url)), "^https?://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(u, "^www\\.", ""), "/+$", ""), "\\?.*$", "")


def dedup_url(df: DataFrame, url: str, recent: str, seq: str) -> DataFrame:
    """The most recent row of each normalised address (the first by ``seq`` on ties); rows without address are dropped.

    Written as an aggregate with map-side combine, so an address held by a third of all rows is no hot task.
    """
    rows = df.withColumn("nurl", normalize_url(F.col(url))).filter("nurl <> ''")
    stamp = F.coalesce(F.expr(f"try_cast(`{recent}` as timestamp_ntz)"), F.lit("0001-01-01").cast("timestamp_ntz"))
    newest = F.struct(stamp.alias("t"), (-F.col(seq)).alias("q"))
    return rows.groupBy("nurl").agg(F.max_by(F.struct(*df.columns), newest).alias("r")).select("nurl", "r.*")


def dedup_longest(df: DataFrame, url: str, tokens: str, seq: str) -> DataFrame:
    """The row of most tokens of each normalised address (null counts as 0; the first by ``seq`` on ties); rows without address are dropped."""
    rows = df.withColumn("nurl", normalize_url(F.col(url))).filter("nurl <> ''")
    best = F.struct(F.coalesce(F.col(tokens).cast("long"), F.lit(0).cast("long")).alias("t"), (-F.col(seq)).alias("q"))
    return rows.groupBy("nurl").agg(F.max_by(F.struct(*df.columns), best).alias("r")).select("nurl", "r.*")


def near_classes(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k, class, copies, links) for every row: its class of equal sets, how many rows the class holds, and how many other rows are linked to it.

    ``sets``: (k, c) of ``near_sets``; ``pairs``: (c, c2) of ``near_class_pairs``.  One row a row, however many copies there are.
    """
    size = sets.groupBy("c").agg(F.count(F.lit(1)).alias("copies"))
    both = pairs.select("c", "c2").unionByName(pairs.select(F.col("c2").alias("c"), F.col("c").alias("c2"))).distinct()
    near = both.join(size.withColumnRenamed("c", "c2").withColumnRenamed("copies", "m"), "c2").groupBy("c").agg(F.sum("m").alias("others"))
    whole = size.join(near, "c", "left").select("c", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return sets.select("k", "c").join(whole, "c").select("k", F.col("c").alias("class"), "copies", "links")


def near_duplicates(df: DataFrame, key: str, block: list[str], title: str, body: str, title_min: float = 0.5, body_min: float = 0.85) -> DataFrame:
    """(a, b, title_j, body_j), a < b: pairs of one block with both Jaccard indices at their minimum or above.

    Rows with a null or empty title or body have no set and no pair.  Shingles are
    compared as 64-bit hashes.  Rows of equal shingle sets form one class; classes are compared, never all pairs of
    rows.  Class pairs meet on a prefix of the body's rarest shingles: sets of size m and
    Jaccard t or more share one of the first m - ceil(t m) + 1 in a common order.
    The result has a row for every pair of rows; ``near_classes`` says the same in one row a row.
    """
    sets = near_sets(df, key, block, title, body)
    both = near_class_pairs(sets, block, title_min, body_min)
    twins = sets.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("c", F.col("c").alias("c2"), F.lit(1.0).alias("title_j"), F.lit(1.0).alias("body_j"))
    left = sets.select("c", F.col("k").alias("p"))
    pairs = both.unionByName(twins).join(left, "c").join(left.select(F.col("c").alias("c2"), F.col("p").alias("q")), "c2").filter("p <> q and (c <> c2 or p < q)")
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "title_j", "body_j")


def near_sets(df: DataFrame, key: str, block: list[str], title: str, body: str) -> DataFrame:
    """(k, block, ts, bs, c): the shingle sets of the rows that have both, and a class id of 128 bits over the block and both sets."""
    sets = df.select(F.col(key).alias("k"), *block, shingle_hashes(F.col(title), 2).alias("ts"), shingle_hashes(F.col(body), 3).alias("bs")).filter("size(ts) > 0 and size(bs) > 0")
    whole = [*[F.coalesce(F.col(x).cast("string"), F.lit("\u0000")) for x in block], "ts", "bs"]
    return checkpoint(sets.withColumn("c", F.concat_ws("-", F.hex(F.xxhash64(F.lit(1), *whole)), F.hex(F.xxhash64(F.lit(2), *whole)))))


#: Entries that the table of common shingles may have at most, whatever the corpus.
COMMON = 1_000_000


def _common(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in order, bands): the most frequent shingles with the log2 of their frequency.

    The threshold is the least power of two, 16 or more, above which there are no more than COMMON shingles.
    """
    counts = classes.select(F.explode("bs").alias("g")).groupBy("g").agg(F.floor(F.log2(F.count(F.lit(1)).cast("double"))).cast("int").alias("band"))
    counts = materialise(counts.filter("band >= 4"))
    left, least = 0, 64
    for band, n in sorted(counts.groupBy("band").agg(F.count(F.lit(1))).collect(), reverse=True):  # at most 60 rows
        if left + n > COMMON:
            break
        left, least = left + n, band
    found = counts.filter(F.col("band") >= least).toArrow().sort_by("g")
    return found.column("g").to_numpy(), found.column("band").to_numpy().astype(np.int8)


def near_class_pairs(sets: DataFrame, block: list[str], title_min: float = 0.5, body_min: float = 0.85) -> DataFrame:
    """(c, c2, title_j, body_j), c < c2: classes of one block that are similar enough.

    Shingles are ordered by band of frequency, then by hash; any order common to all sets makes the prefixes complete, and
    this one needs no more than a table of COMMON frequent shingles beside each set, so only the prefixes are shuffled.
    """
    classes = checkpoint(sets.groupBy("c").agg(*[F.first(x).alias(x) for x in (*block, "ts", "bs")]))
    numbers, bands = _common(classes)
    kinds = ", ".join(f"`{x}` {classes.schema[x].dataType.simpleString()}" for x in block)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            heads, sizes, counts = [], [], []
            for i in range(len(batch)):
                g = lists[i].values.to_numpy(zero_copy_only=False)
                m = len(g)
                at = np.minimum(np.searchsorted(numbers, g), max(0, len(numbers) - 1))
                band = np.where(numbers[at] == g, bands[at], 0) if len(numbers) else np.zeros(m, np.int8)
                n = m - int(np.ceil(body_min * m - 1e-9)) + 1
                heads.append(g[np.lexsort((g, band))[:n]])
                sizes.append(m)
                counts.append(n)
            at = pa.array(np.repeat(np.arange(len(batch), dtype=np.int32), counts))
            flat = np.concatenate(heads) if heads else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(j).take(at) for j in range(batch.num_columns - 1)], pa.array(sizes, pa.int32()).take(at), pa.array(flat, pa.int64())], [*batch.schema.names[:-1], "m", "g"])

    heads = classes.select("c", *block, "bs").mapInArrow(prefixes, f"c string, {kinds + ', ' if block else ''}m int, g long")
    right = heads.select(F.col("c").alias("c2"), F.col("m").alias("m2"), "g", *[F.col(x).alias(f"{x}2") for x in block])
    same = " and ".join([f"{x} <=> {x}2" for x in block])
    met = heads.join(right, "g").filter(f"c < c2 and {same} and least(m, m2) >= {body_min} * greatest(m, m2) - 1e-9").select("c", "c2").distinct()
    full = classes.select("c", "ts", "bs")
    other = full.select(F.col("c").alias("c2"), F.col("ts").alias("ts2"), F.col("bs").alias("bs2"))
    joined = met.join(full, "c").join(other, "c2")
    return joined.select("c", "c2", _jaccard("ts", "ts2").alias("title_j"), _jaccard("bs", "bs2").alias("body_j")).filter(f"title_j >= {title_min} and body_j >= {body_min}")


def _jaccard(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both.cast("double") / (F.size(a) + F.size(b) - both)


def duplicate_loser(date_a: Column, date_b: Column, tokens_a: Column, tokens_b: Column, a: Column, b: Column) -> Column:
    """The row of a pair to drop: the older, the undated, the shorter; the second on ties."""
    da, db = date_a, date_b
    return (
        F.when(da.isNotNull() & db.isNotNull(), F.when(da < db, a).otherwise(b)).when(da.isNotNull(), b).when(db.isNotNull(), a)
        .when(tokens_a < tokens_b, a).otherwise(b)
    )


def first_of(df: DataFrame, value: str, seq: str) -> DataFrame:
    """Distinct values in order of first appearance."""
    first = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(seq).alias("first_seq"))
    return first.orderBy("first_seq")


def quota(df: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each group; the window limit prunes before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
