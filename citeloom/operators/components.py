"""Connected components of an edge list, by alternating large-star and small-star steps.

Each step is one aggregation (the smallest neighbour of every node, combined before the shuffle) and one
join, so a hub with very many neighbours is never gathered in one place.  The number of rounds grows with
the logarithm of the longest path.

Before the steps every partition may keep only a forest of its edges, which joins what they join; forests are put
together in fewer partitions as long as that leaves half of them away.  A network with far more edges than nodes
is small before it is shuffled; where one partition of ``FOREST_EDGES`` holds what is left, its forest is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.plans.checkpoint import cut, discard, written

#: Edges that a task makes a forest of at a time, and that a partition of forests holds on average.
FOREST_EDGES = 1_000_000


def _forest(edges: pd.DataFrame) -> pd.DataFrame:
    """(u, v) with u > v: every node of the edges and the smallest node that they join it to."""
    codes, names = pd.factorize(pd.concat([edges["u"], edges["v"]], ignore_index=True), sort=True)
    x, y = codes[: len(edges)], codes[len(edges) :]
    root = np.arange(len(names))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    names, hangs = np.asarray(names), root != np.arange(len(root))
    return pd.DataFrame({"u": names[hangs], "v": names[root[hangs]]})


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest of a partition, whose edges are taken in some at a time."""
    held, n, kept = [], 0, 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n - kept >= max(FOREST_EDGES, kept):
            held = [_forest(pd.concat(held, ignore_index=True))]
            n = kept = len(held[0])
    if n:
        out = _forest(pd.concat(held, ignore_index=True))
        for k in range(0, len(out), 100_000):
            yield out[k : k + 100_000]


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _by_forests(ends: DataFrame) -> tuple[DataFrame, bool]:
    """(u, v) that join what ``ends`` do, and whether they are one forest."""
    now = written(ends.mapInPandas(_forests, ends.schema))
    n = now.count()
    while True:
        parts = n // FOREST_EDGES + 1
        fewer = written((now.repartition(parts) if parts > 1 else now.coalesce(1)).mapInPandas(_forests, ends.schema))
        discard(now)
        now, before, n = fewer, n, fewer.count()
        if parts == 1 or 2 * n > before:
            return now, parts == 1


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60, forests: bool = False) -> DataFrame:
    """(node, component) for every node of an edge: the smallest node that its component holds.

    With ``forests`` partitions keep forests of their edges before the steps, which pays where edges are many more than nodes.
    Loops keep their node as a component of its own; null ends are dropped; an empty list gives no rows.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    lone = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
    ends = pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, done = _by_forests(ends) if forests else (cut(ends.distinct()), False)
    seen = None
    for _ in range(0 if done else most_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.join(_smallest(large), "u")
        hooked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        now = cut(hooked.where("u <> v").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        if not done:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.groupBy("v").count().select(F.col("v").alias("node"), F.col("v").alias("component"))
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
    alone = lone.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionAll(alone)
