"""Filling fixed-capacity containers with texts (problem 9).

Only an item longer than the largest capacity is split, into full containers and
one rest.  The remaining items go to shards by a hash of their key (a shard holds
about ``shard_items`` items whatever the size of the corpus, so no task grows), and
each shard is packed by variable-capacity best fit in decreasing order:

* an item goes into the open container whose free room it leaves least of;
* if none has room, all permitted capacities are weighed against each other.  What a
  capacity can be expected to hold beside the item is found by filling it, largest first, from the sizes
  still to come that no other container counts on; its cost is the room that stays empty plus a fixed overhead a container, for each token it
  holds.  The least costly is opened: a smaller one where no sizes are left that would fill the larger;
* at the end every container is downsized to the shortest permitted length that
  holds its contents.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondhan.session import materialise


class _Rest:
    """The sizes still to come, as counts by size, with a table that leads from a size to the next smaller one that is left."""

    def __init__(self, sizes: Sequence[int]):
        self.count = Counter(sizes)
        self.down = list(range(max(sizes, default=0) + 1))
        for s in range(len(self.down)):
            if not self.count[s]:
                self.down[s] = max(0, s - 1)

    def at_most(self, size: int) -> int:
        """The largest size left that is no larger, 0 if there is none."""
        s = min(size, len(self.down) - 1)
        path = []
        while s > 0 and self.down[s] != s:
            path.append(s)
            s = self.down[s]
        for p in path:
            self.down[p] = s
        return max(s, 0)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.down[size] = size - 1

    def fill(self, room: int) -> list[tuple[int, int]]:
        """(size, count) of the sizes left that would fill a room, the largest that fits first."""
        found, limit = [], room
        while (s := self.at_most(min(limit, room))) > 0:
            n = min(self.count[s], room // s)
            found.append((s, n))
            room -= n * s
            limit = s - 1
        return found


def best_fit(sizes: Sequence[int], capacities: Sequence[int], overhead: int = 16) -> tuple[list[int], list[int], list[int], list[int]]:
    """(bin of each item, capacity of each bin, fill of each bin, capacity each bin was opened with) for sizes no larger than the largest capacity.

    Items of size 0 need no container and get bin -1.
    """
    capacities = sorted(capacities)
    order = sorted((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: (-sizes[i], i))
    rest, promised = _Rest([sizes[i] for i in order]), Counter()
    where, room_of, opened = [-1] * len(sizes), [], []
    open_bins: list[tuple[int, int]] = []  # (free room, bin), sorted
    for i in order:
        size = sizes[i]
        if promised[size]:
            promised[size] -= 1  # counted when the container it was expected in was opened
        else:
            rest.take(size)
        at = bisect.bisect_left(open_bins, (size, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            best: tuple[float, int] | None = None
            for c in capacities[bisect.bisect_left(capacities, size) :]:
                expected = rest.fill(c - size)
                held = size + sum(s * n for s, n in expected)
                cost = ((c - held + overhead) / held, -c)
                if best is None or cost < best:
                    best, chosen = cost, expected
            room, b = -best[1], len(opened)
            for s, n in chosen:
                promised[s] += n
                for _ in range(n):
                    rest.take(s)
            opened.append(room)
            room_of.append(room)
        where[i] = b
        room_of[b] = room - size
        if room_of[b]:
            bisect.insort(open_bins, (room_of[b], b))
    fill = [c - r for c, r in zip(opened, room_of, strict=True)]
    return where, [capacities[bisect.bisect_left(capacities, f)] for f in fill], fill, opened


def pack(sizes: DataFrame, key: str, size: str, capacities: Sequence[int] = (256, 512, 768, 1024, 1536, 2048), shard_items: int = 20_000) -> DataFrame:
    """(key, part, offset, n_tokens, container, capacity): where every part of every item lies.

    ``part`` counts the pieces of a split item from 0; ``offset`` is the first token
    of the part within its item; ``container`` is unique over the whole result and
    ``capacity`` its permitted length after downsizing.  Items of null or no size get
    one row with null container and capacity.  Rows of a repeated key are items of their own.
    """
    most = max(capacities)
    # measured once: the count and both branches below read the sizes
    items = materialise(sizes.select(F.col(key).alias("k"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n")))
    shards = max(1, math.ceil(items.count() / shard_items))
    whole, rest = F.floor(F.col("n") / most).cast("long"), (F.col("n") % most).cast("int")
    full = items.filter(F.col("n") >= most).select("k", "n", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("part"))
    full = full.select(
        "k", F.col("part").cast("int").alias("part"), (F.col("part") * most).alias("offset"), F.lit(most).alias("n_tokens"),
        F.concat_ws("-", F.lit("w"), F.col("k").cast("string"), F.col("part").cast("string")).alias("container"), F.lit(most).alias("capacity"),
    )
    loose = items.filter((rest > 0) | (F.col("n") <= 0)).select(
        "k", whole.cast("int").alias("part"), (whole * most).alias("offset"), rest.alias("n_tokens"), F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(shards)).cast("int").alias("shard")
    )

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["k", "part"], kind="stable").reset_index(drop=True)
        where, caps, _, _ = best_fit(frame["n_tokens"].tolist(), capacities)
        frame["container"] = [None if b < 0 else f"s{group[0]}-{b}" for b in where]
        frame["capacity"] = pd.array([None if b < 0 else caps[b] for b in where], "Int32")
        return frame.drop(columns="shard")

    kind = sizes.schema[key].dataType.simpleString()
    packed = loose.groupBy("shard").applyInPandas(run, f"k {kind}, part int, offset long, n_tokens int, container string, capacity int")
    return full.unionByName(packed).withColumnRenamed("k", key)
