"""The entity co-occurrence graph: building, measures, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondhan.session import checkpoint


def cooccurrence(members: DataFrame, group: str, item: str, least: int = 2, most: int = 50) -> DataFrame:
    """(src, dst, weight), src < dst: items that share at least ``least`` groups; groups of more than ``most`` items are skipped by definition."""
    rows = members.select(F.col(group).alias("g"), F.col(item).alias("i")).filter("g is not null and i is not null").distinct()
    packed = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, most)).select("g")
    kept = rows.join(packed, "g", "left_semi").groupBy("g").agg(F.array_sort(F.collect_list("i")).alias("s"))
    # pairs inside one bounded set, no self-join of the table
    pairs = kept.select(F.posexplode("s").alias("p", "src"), "s").select("src", F.explode(F.slice("s", F.col("p") + 2, F.size("s"))).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= least)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), "weight"), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), "weight"))).alias("e")).select("e.*")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_centrality(edges: DataFrame, k: int = 20) -> DataFrame:
    """The k nodes of highest degree / (n - 1), ties to the smaller node."""
    deg = degrees(edges)
    n = deg.agg(F.count(F.lit(1)).alias("n"))
    score = F.round(F.coalesce(F.try_divide(F.col("degree").cast("double"), (F.col("n") - 1).cast("double")), F.lit(0.0)), 4)
    return deg.crossJoin(F.broadcast(n)).select("node", "degree", score.alias("centrality")).orderBy(F.desc("degree"), "node").limit(k)


def neighbours(edges: DataFrame, k: int = 3) -> DataFrame:
    """(node, other, weight, rank): the k strongest neighbours of each node."""
    w = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    return both_ways(edges).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): smallest node of each connected part, by min-label propagation with pointer jumping and reliable checkpoints."""
    pairs = checkpoint(both_ways(edges).select("node", "other").distinct())
    labels = checkpoint(pairs.groupBy("node").agg(F.least(F.min("other"), F.min("node")).alias("label")))
    for _ in range(max_rounds):
        around = pairs.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        stepped = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = checkpoint(stepped.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = moved.filter("old <> label").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"no end after {max_rounds} rounds")


def khop(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """The edges among the nodes within ``depth`` steps of the seeds (one column ``node``)."""
    links, reached = both_ways(edges).select("node", "other"), seeds.select("node").distinct()
    for _ in range(depth):
        reached = reached.union(links.join(reached, "node", "left_semi").select("other")).distinct()
    return induced(edges, reached)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst", "weight")


def top_subgraph(edges: DataFrame, n: int = 500) -> DataFrame:
    return induced(edges, degrees(edges).orderBy(F.desc("degree"), "node").limit(n))


def view_attributes(edges: DataFrame, n: int = 500) -> DataFrame:
    """Node sizes of the top-n subgraph for drawing: min(10 + deg / 2, 50)."""
    sub = top_subgraph(edges, n)
    return degrees(sub).select("node", "degree", F.least(F.lit(10.0) + 0.5 * F.col("degree"), F.lit(50.0)).alias("size"))


def view_edges(edges: DataFrame, n: int = 500) -> DataFrame:
    """Edges of the top-n subgraph with their width for drawing: min(1 + weight / 5, 10)."""
    return top_subgraph(edges, n).select("src", "dst", "weight", F.least(1.0 + F.lit(0.2) * F.col("weight"), F.lit(10.0)).alias("width"))
