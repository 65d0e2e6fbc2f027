"""Consolidating pairwise matches into groups by randomised graph contraction (problem 3).

Each round every vertex hooks to the member of its closed neighbourhood that comes
first in a fresh hash order; edges are relabelled to the chosen representatives,
loops dropped and duplicates removed.  A constant share of the vertices disappears a
round, so the total work is a small multiple of the edges.  The per-round mappings
are then expanded from the last to the first, which again costs their summed,
geometrically falling size.  Nothing is collected: the driver sees two counters a
round.  Rounds are cut with reliable checkpoints in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondhan.session import checkpoint


def _order(vertex: Column, salt: int) -> Column:
    return F.struct(F.xxhash64(vertex, F.lit(salt)).alias("h"), vertex.alias("v"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("n")), F.struct(F.col("b").alias("v"), F.col("a").alias("n")))).alias("e")).select("e.v", "e.n")


def _take(edges: DataFrame, end: str, rep: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``edges`` with the representatives of the vertices in column ``end``.

    The few vertices of very many edges are looked up by broadcast, so their edges stay where they are;
    only the rest is shuffled by vertex.
    """
    if hot is None:
        return edges.join(rep.withColumnRenamed("v", end), end).withColumn(end, F.col("r")).drop("r")
    named = hot.select(F.col("v").alias(end), F.col("r").alias("__hot"))
    known = edges.join(F.broadcast(named), end, "left")
    done = known.filter("__hot is not null").withColumn(end, F.col("__hot")).drop("__hot")
    left = known.filter("__hot is null").drop("__hot").join(rep.withColumnRenamed("v", end), end)
    return done.unionByName(left.withColumn(end, F.col("r")).drop("r"))


def _relabel(edges: DataFrame, rep: DataFrame, hot: DataFrame | None) -> DataFrame:
    both = _take(_take(edges, "a", rep, hot), "b", rep, hot).filter("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def expand(maps: list[DataFrame]) -> DataFrame:
    """Compose the (v, r) mappings of successive rounds, from the last to the first."""
    final = maps[-1]
    for rep in reversed(maps[:-1]):
        onward = final.select(F.col("v").alias("r"), F.col("r").alias("onward"))
        final = checkpoint(rep.join(onward, "r", "left").select("v", F.coalesce("onward", "r").alias("r")))
    return final


def connected_components(edges: DataFrame, left: str, right: str, seed: int = 7, max_rounds: int = 200, hot_vertices: int = 10_000) -> DataFrame:
    """(vertex, component) for every vertex of an edge with two different ends.

    ``component`` is the smallest vertex of the group.  Null ends and loops are
    ignored, repeated edges and both directions count once, no edges give no rows.
    Orders of the vertices are those of their type (binary order for strings).  A vertex of more than
    2 / ``hot_vertices`` of the edges' ends (and 1,000) counts as hot: there are fewer than ``hot_vertices`` of them, so
    their table may be broadcast at any size.
    """
    pair = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).filter("x is not null and y is not null and x <> y")
    work = checkpoint(pair.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    maps: list[DataFrame] = []
    for turn in range(max_rounds):
        best = _both_ways(work).groupBy("v").agg(F.min(_order(F.col("n"), seed + turn)).alias("m"), F.count(F.lit(1)).alias("degree"))
        rep = checkpoint(best.select("v", F.least(F.col("m"), _order(F.col("v"), seed + turn))["v"].alias("r"), "degree"))
        maps.append(rep.select("v", "r"))
        ends, most = rep.agg(F.coalesce(F.sum("degree"), F.lit(0)), F.coalesce(F.max("degree"), F.lit(0))).first()
        if not ends:
            maps.pop()
            break
        limit = max(1000, 2 * ends // hot_vertices)
        hot = rep.filter(F.col("degree") > limit).select("v", "r") if most > limit else None
        work = checkpoint(_relabel(work, maps[-1], hot))
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    if not maps:
        return work.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    final = expand(maps)
    smallest = final.groupBy("r").agg(F.min("v").alias("component"))
    return final.join(smallest, "r").select(F.col("v").alias("vertex"), "component")


def entity_edges(records: DataFrame, matches: DataFrame) -> DataFrame:
    """(a, b): ties by a true match of two known records and by a shared alias with a letter.

    All records of one alias are tied to the smallest of them (a star, not all
    pairs), pre-aggregated, so an alias held by a third of all records is no hot spot.
    """
    ids = records.filter("entity_id is not null").select("entity_id").distinct()
    true = matches.filter("matched and left_id is not null and right_id is not null and left_id <> right_id")
    known = true.select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).distinct()
    known = known.join(ids.withColumnRenamed("entity_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("entity_id", "b"), "b", "left_semi")
    listed = records.filter("entity_id is not null").select("entity_id", F.explode("aliases").alias("alias")).filter(F.col("alias").rlike("\\p{L}"))
    hub = listed.groupBy("alias").agg(F.min("entity_id").alias("a"), F.max("entity_id").alias("z")).filter("a <> z").drop("z")
    shared = listed.join(hub, "alias").filter("a <> entity_id").select("a", F.col("entity_id").alias("b"))
    return known.unionByName(shared)


def entity_groups(records: DataFrame, matches: DataFrame) -> DataFrame:
    """(entity_id, group_id) for every record of a group of two or more."""
    return connected_components(entity_edges(records, matches), "a", "b").select(F.col("vertex").alias("entity_id"), F.col("component").alias("group_id"))
