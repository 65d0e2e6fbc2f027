"""Sequential greedy procedures, replayed in parallel rounds with the same result.

Each decides in every round all that no undecided earlier item can still change, so no group of
rows, however large, is ever collected into a task.  Rounds end with a reliable checkpoint
of what is left; the number of rounds is that of the longest chain of decisions that wait for each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondhan.session import checkpoint

MOST_ROUNDS = 10_000


def leader_clusters(edges: DataFrame) -> DataFrame:
    """(leader, member) for every vertex of an edge; a leader is its own member.

    ``edges``: (first, then, turn): two that resemble each other, the earlier in order first; ``turn`` orders the firsts.
    In order, each vertex without a leader becomes one and takes all later ones it resembles that have none.
    """
    every = checkpoint(edges.distinct())
    left, taken = every.select("first", "then"), []
    for _ in range(MOST_ROUNDS):
        if not left.take(1):
            break
        roots = left.select("first").distinct().join(left.select(F.col("then").alias("first")).distinct(), "first", "left_anti")
        follow = checkpoint(left.join(roots, "first", "left_semi").select("then").distinct())
        taken.append(follow)
        gone = roots.toDF("v").unionByName(follow.toDF("v"))
        left = checkpoint(left.join(gone.toDF("first"), "first", "left_anti").join(gone.toDF("then"), "then", "left_anti").select("first", "then"))
    else:
        raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    if not taken:
        return every.select(F.col("first").alias("leader"), F.col("then").alias("member"))
    members = reduce(DataFrame.unionByName, taken).distinct()
    leading = every.join(members.toDF("first"), "first", "left_anti")
    found = leading.join(members, "then", "left_semi").groupBy(F.col("then").alias("member")).agg(F.min_by("first", "turn").alias("leader")).select("leader", "member")
    lone = every.select(F.explode(F.array("first", "then")).alias("member")).distinct().join(members.toDF("member"), "member", "left_anti")
    return found.unionByName(lone.select(F.col("member").alias("leader"), "member"))


def best_free(wishes: DataFrame) -> DataFrame:
    """(a, b, score): each a, in order, takes the first of its wishes that is still free.

    ``wishes``: (a, b, place, score), one row a wish, ``place`` orders those of an a.
    """
    left, out = checkpoint(wishes.select("a", "b", "place", "score")), []
    for _ in range(MOST_ROUNDS):
        if not left.take(1):
            break
        first = left.groupBy("b").agg(F.min("a").alias("a"))  # whom no earlier one can forestall
        now = left.groupBy("a").agg(F.min_by(F.struct("b", "place", "score"), "place").alias("w")).select("a", "w.b", "w.score").join(first, ["a", "b"])
        now = checkpoint(now.select("a", "b", "score"))
        out.append(now)
        left = checkpoint(left.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti").select("a", "b", "place", "score"))
    else:
        raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    return reduce(DataFrame.unionByName, out) if out else left.select("a", "b", "score")


def scan_losers(pairs: DataFrame) -> DataFrame:
    """(loser): what a scan of the pairs (a, b, loser), a < b, in order of (a, b) removes.

    A pair is skipped if b is gone, or if a was gone when the scan came to its first pair; else its loser goes.
    """
    left, out = checkpoint(pairs.select("a", "b", "loser").distinct()), []
    for _ in range(MOST_ROUNDS):
        if not left.take(1):
            break
        first = left.groupBy("b").agg(F.min("a").alias("a"))
        now = left.join(first, ["a", "b"]).join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        now = checkpoint(now.select("a", "b", "loser"))
        out.append(now.select("loser"))
        fallen = now.filter("loser = b").select("b")
        rest = left.join(now.select("a", "b"), ["a", "b"], "left_anti")
        left = checkpoint(rest.join(fallen, "b", "left_anti").join(fallen.toDF("a"), "a", "left_anti").select("a", "b", "loser"))
    else:
        raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    return reduce(DataFrame.unionByName, out).distinct() if out else left.select("loser")
