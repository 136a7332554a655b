"""Measures of an undirected weighted network, an edge list (src, dst, weight) with src < dst."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.components import connected_components
from citeloom.operators.parts import ONE_TASK_EDGES, Graph, split
from citeloom.plans.checkpoint import BROADCAST_ROWS, bucketed, cut, discard, written

#: Rounds of label propagation in which any half of the nodes may move; later only nodes apart from each other.
FREE_ROUNDS = 24
#: Nodes whose triangles are counted by their matrix, and wedges that a task looks up at a time.
CORE, WEDGES = 2048, 1_000_000
#: Nodes of a task whose neighbours are held as bits, words of them that are looked at at a time, and words that take as long as a wedge.
BIT_NODES, BIT_WORDS, WORDS_OF_A_WEDGE = 32_768, 65_536, 16
#: Edges of a tile, on average.
TILE_EDGES = 6_000_000


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions: (a, b, weight)."""
    flat = edges.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), "weight"), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))).alias("x"))
    return flat.select("x.*")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, strength)."""
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, degree, degree_centrality): degree over the number of other nodes."""
    d = degrees(edges)
    n = d.agg(F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(n)).select("node", "degree", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(1.0).alias("degree_centrality"))


def density(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density."""
    counts = degrees(edges).agg(F.count("*").alias("nodes"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("edges"))
    return counts.withColumn("density", F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0))


def clustering(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """(node, triangles, clustering), unweighted.

    No wedge leaves a task.  A network of at most ``ONE_TASK_EDGES`` edges is counted in one task, a component
    of that size too; larger components are dealt to tiles, for each three colours of nodes the edges between
    them, where every triangle lies in one tile.
    """
    most = ONE_TASK_EDGES if one_task is None else one_task
    held = written(edges.select("src", "dst"))
    kind = held.schema["src"].dataType.simpleString()
    found = f"node {kind}, triangles long"
    n = held.count()
    if n <= most // 4:
        counts = held.withColumn("pack", F.lit(0)).groupBy("pack").applyInPandas(_triangles, found)
    else:
        near, far = split(held, "src", "dst", most)
        counts = near.groupBy("pack").applyInPandas(_triangles, found)
        large = far.count()
        if large:
            tiles = _tiles(far, int(np.ceil(3 * np.sqrt(large / (TILE_EDGES if one_task is None else most)))))
            counts = counts.unionAll(tiles.groupBy("i", "j", "k").applyInPandas(_triangles_of_tile, found)).groupBy("node").agg(F.sum("triangles").alias("triangles"))
    d = degrees(held.withColumn("weight", F.lit(1))).select("node", "degree")
    t = F.coalesce("triangles", F.lit(0))
    return d.join(counts, "node", "left").select("node", t.alias("triangles"), F.when(F.col("degree") > 1, 2 * t / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("clustering"))


def _tiles(edges: DataFrame, colours: int) -> DataFrame:
    """(i, j, k, src, far, same): every edge with the colours of its ends and each third one, in order; the far ends of a node and a colour go as one list."""
    colour = lambda c: F.pmod(F.xxhash64(c), F.lit(colours)).cast("int")
    lists = edges.groupBy("src", colour("dst").alias("b")).agg(F.collect_list("dst").alias("far"))
    dealt = lists.select("src", "far", colour("src").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.lit(colours - 1))).alias("c"))
    tile = F.array_sort(F.array("a", "b", "c"))
    return dealt.select(*[tile[n].alias(c) for n, c in enumerate("ijk")], "src", "far", (F.col("a") == F.col("b")).alias("same"))


def _triangles_of_tile(part: pd.DataFrame) -> pd.DataFrame:
    """Triangles of exactly the three colours of a tile; those of a colour that stands twice there lie in a tile of their own."""
    one_colour = part["i"].iat[0] == part["k"].iat[0]
    held = part["far"].str.len()
    ends = pd.DataFrame({"src": part["src"].repeat(held).to_numpy(), "dst": np.concatenate(part["far"].to_list())})
    same = part["same"].repeat(held).to_numpy()
    counts = _triangles(ends)
    if one_colour or not same.any():
        return counts
    within = _triangles(ends[same]).set_index("node")["triangles"]
    counts["triangles"] -= counts["node"].map(within).fillna(0).astype(np.int64)
    return counts[counts["triangles"] > 0]


def _by_bits(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Triangles of each node, from the neighbours that both ends of every edge have in common: rows of bits, laid over each other."""
    words, first = -(-n // 64), np.searchsorted(low, np.arange(n + 1))
    order = np.argsort(high, kind="stable")
    back, behind = low[order], np.searchsorted(high[order], np.arange(n + 1))
    bits, total = np.zeros((n, words), np.uint64), np.zeros(n, np.int64)
    for a in range(0, n, 512):
        z = min(n, a + 512)
        row = np.zeros((z - a, words * 64), bool)
        row[low[first[a] : first[z]] - a, high[first[a] : first[z]]] = True
        row[high[order[behind[a] : behind[z]]] - a, back[behind[a] : behind[z]]] = True
        bits[a:z] = np.packbits(row, axis=1).view(np.uint64)
    step, one = max(1, BIT_WORDS // words), np.ones(words, np.float32)
    for u in range(n):
        for k in range(first[u], first[u + 1], step):
            far = high[k : min(first[u + 1], k + step)]
            both = (np.bitwise_count(bits[far] & bits[u]).astype(np.float32) @ one).astype(np.int64)  # at most n, exact
            total[far] += both
            total[u] += both.sum()
    return total // 2


def _triangles(part: pd.DataFrame) -> pd.DataFrame:
    """(node, triangles) of the edges (src, dst) in a task, by the order of degrees.

    Where wedges are many, common neighbours are counted by bits.  Else triangles among the ``CORE`` nodes of most neighbours
    come from a product of their matrix, the others from the wedges of their node of fewest neighbours, some millions at a time.
    """
    codes, names = pd.factorize(pd.concat([part["src"], part["dst"]], ignore_index=True))
    n, half = len(names), len(part)
    rank = np.empty(n, np.int64)
    rank[np.argsort(np.bincount(codes, minlength=n), kind="stable")] = np.arange(n)
    x, y = rank[codes[:half]], rank[codes[half:]]
    keys = np.unique(np.minimum(x, y) * n + np.maximum(x, y))  # each edge from its lower rank to its higher
    low, high = keys // n, keys % n
    start = np.searchsorted(low, np.arange(n + 1))
    opened = start[low + 1] - np.arange(len(low)) - 1  # wedges that an edge opens with those behind it
    if n <= BIT_NODES and len(low) * (n // 64 + 1) < WORDS_OF_A_WEDGE * opened.sum():
        told = _by_bits(low, high, n)[rank]
        return pd.DataFrame({"node": np.asarray(names)[told > 0], "triangles": told[told > 0]})
    total, first = np.zeros(n, np.int64), max(0, n - CORE)
    inner = low >= first
    m = np.zeros((n - first, n - first), np.float32)
    m[low[inner] - first, high[inner] - first] = 1
    m += m.T
    for k in range(0, len(m), 256):
        total[first + k : first + k + 256] = ((m[k : k + 256] @ m) * m[k : k + 256]).sum(axis=1, dtype=np.float64).astype(np.int64) // 2
    later = np.where(inner, 0, opened)
    cut_at = np.searchsorted(np.cumsum(later), np.arange(0, later.sum() + WEDGES, WEDGES), side="right")
    for a, b in zip(cut_at[:-1], cut_at[1:]):
        at = np.repeat(np.arange(a, b), later[a:b])
        if len(at):
            ends = np.cumsum(later[a:b])
            other = at + 1 + np.arange(len(at)) - np.repeat(ends - later[a:b], later[a:b])
            wanted = high[at] * n + high[other]
            place = np.searchsorted(keys, wanted)
            hit = keys[np.minimum(place, len(keys) - 1)] == wanted
            for corner in (low[at[hit]], high[at[hit]], high[other[hit]]):
                total += np.bincount(corner, minlength=n)
    told = total[rank]
    return pd.DataFrame({"node": np.asarray(names)[told > 0], "triangles": told[told > 0]})


def average_clustering(edges: DataFrame) -> DataFrame:
    return clustering(edges).agg(F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("average_clustering"))


def network_metrics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, components, average_clustering."""
    parts = connected_components(edges, forests=True).agg(F.countDistinct("component").alias("components"))
    return density(edges).crossJoin(parts).crossJoin(average_clustering(edges))


def attribute_assortativity(edges: DataFrame, nodes: DataFrame, attribute: str) -> DataFrame:
    """One row (r): Newman's coefficient over the mixing matrix of both directions.

    Nodes without the attribute form a category of their own.  NaN where all weight is in one category.
    """
    kind = nodes.select(F.col("id").alias("node"), F.col(attribute).cast("string").alias("kind"))
    ends = both_ways(edges).join(kind.select(F.col("node").alias("a"), F.col("kind").alias("x")), "a", "left").join(kind.select(F.col("node").alias("b"), F.col("kind").alias("y")), "b", "left")
    cells = ends.groupBy("x", "y").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("x").eqNullSafe(F.col("y")), F.col("n")).otherwise(0)).alias("same"))
    margins = cells.groupBy("x").agg(F.sum("n").alias("m")).agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("squares"))
    row = total.crossJoin(margins)  # the matrix is symmetric, so both margins are alike
    expected = F.col("squares") / (F.col("total").cast("double") * F.col("total"))
    return row.select(F.when(expected < 1, (F.col("same") / F.col("total") - expected) / (1 - expected)).otherwise(F.lit(float("nan"))).alias("r"))


def degree_assortativity(edges: DataFrame) -> DataFrame:
    """One row (r): correlation of the degrees at both ends of the edges, in both directions; NaN where all are alike."""
    d = degrees(edges).select("node", "degree")
    ends = both_ways(edges).join(d.select(F.col("node").alias("a"), F.col("degree").alias("x")), "a").join(d.select(F.col("node").alias("b"), F.col("degree").alias("y")), "b")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")  # both ends have the same variance
    return ends.agg(F.when(F.min("x") == F.max("x"), F.lit(float("nan"))).otherwise(F.covar_pop(x, y) / F.var_pop(x)).alias("r"))


def mixing(edges: DataFrame, nodes: DataFrame | None = None, attribute: str | None = None, by_degree: bool = False, proxy: str | None = None) -> dict:
    """Assortativity by an attribute of (id, attribute), by degree, or both; ``proxy`` names what the
    attribute was derived from and adds a caution."""
    out: dict = {}
    if attribute is not None:
        out["attribute_assortativity"] = attribute_assortativity(edges, nodes, attribute).first()["r"]
    if by_degree:
        out["degree_assortativity"] = degree_assortativity(edges).first()["r"]
    if proxy is not None:
        out["proxy_disclaimer"] = f"{attribute} stands in for {proxy} and isn't the recorded affiliation: read the result with caution"
    return out


def community_composition(communities: DataFrame, nodes: DataFrame, attribute: str) -> DataFrame:
    """(community, category, fraction) for all pairs, zeros included."""
    kinds = communities.join(nodes.select(F.col("id").alias("node"), F.col(attribute).cast("string").alias("category")), "node", "left")
    counts = kinds.groupBy("community", "category").agg(F.count("*").alias("n"))
    size = kinds.groupBy("community").agg(F.count("*").alias("size"))
    grid = size.crossJoin(kinds.select("category").distinct())  # communities times categories: the result's own size
    c = counts.select(F.col("community").alias("k"), F.col("category").alias("q"), "n")
    full = grid.join(c, (F.col("community") == F.col("k")) & F.col("category").eqNullSafe(F.col("q")), "left")
    return full.select("community", "category", (F.coalesce("n", F.lit(0)) / F.col("size")).alias("fraction"))


def label_propagation(edges: DataFrame, most_rounds: int = 1000, one_task: int | None = None) -> DataFrame:
    """(node, community): every node ends with a label most common among its neighbours; ties go to the own
    label, then the smallest.  Communities are numbered by their smallest node.

    In the first rounds a fresh half of the nodes (by hash) moves, so labels cannot swap for ever in step.
    After those, of neighbours that want to move only the one of smallest hash does: each move then adds to
    the edges inside communities, so the rounds come to an end.  No label leaves a connected component: one of at
    most ``ONE_TASK_EDGES`` edges goes through the same rounds in one task, the others do by joins.
    """
    most = ONE_TASK_EDGES if one_task is None else one_task
    held = written(edges.select("src", "dst").where("src is not null and dst is not null"))  # read twice, once for components
    near, far = split(held, "src", "dst", most)
    kind = near.schema["src"].dataType.simpleString()
    hashed = near.select("pack", "src", "dst", F.xxhash64("src").alias("x"), F.xxhash64("dst").alias("y"))
    free = FREE_ROUNDS
    done = written(hashed.groupBy("pack").applyInPandas(lambda part: _settled(part, most_rounds, free), f"node {kind}, community {kind}"))
    if done.where("community is null").take(1):
        raise RuntimeError(f"labels did not settle in {most_rounds} rounds")
    return done.unionAll(_by_joins(far, most_rounds)) if far.take(1) else done


def _hashed_on(held: np.ndarray, i: int) -> np.ndarray:
    """Spark's xxhash64 of (x, i) from the hashes of x, for an int i."""
    one, two, three, five = (np.uint64(k) for k in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = (held.astype(np.int64).view(np.uint64) + five + np.uint64(4)) ^ (np.uint64(i) * one)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * two + three
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def _settled(part: pd.DataFrame, most_rounds: int, free_rounds: int) -> pd.DataFrame:
    """(node, community) of the edges (src, dst, x, y) of whole components, by the rounds of :func:`label_propagation`; null communities if they didn't settle."""
    graph = Graph(part["src"], part["dst"])
    held = np.empty(graph.n, np.int64)
    held[graph.sources()] = np.concatenate([part["x"], part["y"]])[graph.order]
    ends, label = graph.sources(), np.arange(graph.n)
    for i in range(most_rounds):
        cells, votes = np.unique(ends * graph.n + label[graph.to], return_counts=True)
        node, told = cells // graph.n, cells % graph.n
        order = np.lexsort((told, told != label[node], -votes, node))
        best = told[order[np.unique(node[order], return_index=True)[1]]]
        wants = best != label
        if not wants.any():
            break
        rank = _hashed_on(held, i)
        if i < free_rounds:
            turn = rank % 2 == 0
        else:
            a, b = ends, graph.to
            earlier = wants[a] & wants[b] & ((rank[b] < rank[a]) | ((rank[b] == rank[a]) & (b < a)))
            turn = np.ones(graph.n, bool)
            turn[a[earlier]] = False
        label = np.where(turn, best, label)
    else:
        return pd.DataFrame({"node": graph.names, "community": pd.Series([None] * graph.n, dtype=object)})
    _, first, where = np.unique(label, return_index=True, return_inverse=True)
    return pd.DataFrame({"node": graph.names, "community": graph.names[first[where]]})


def _by_joins(edges: DataFrame, most_rounds: int) -> DataFrame:
    """Rounds over links that were dealt by their near end once; up to ``BROADCAST_ROWS`` labels go to where the links are."""
    both = both_ways(edges.withColumn("weight", F.lit(1))).select("a", "b")
    links = bucketed(both, "a", 2 * edges.count())
    labels = written(links.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    beside = F.broadcast if labels.count() <= BROADCAST_ROWS else lambda x: x
    state = None
    for i in range(most_rounds):
        votes = links.join(beside(labels.withColumnRenamed("node", "b")), "b").groupBy("a", "label").agg(F.count("*").alias("n"))
        own = labels.select(F.col("node").alias("a"), F.col("label").alias("own"))
        best = votes.join(beside(own), "a").groupBy("a", "own").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label") != F.col("own"), "label")).alias("label"))
        held, state = (labels, state), written(best.withColumn("open", F.col("label") != F.col("own")))
        for table in held:
            discard(table)
        if not state.where("open").take(1):
            break
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(i)), F.col(c))  # noqa: B023, E731
        if i < FREE_ROUNDS:
            told, turn = state, F.pmod(F.xxhash64("a", F.lit(i)), F.lit(2)) == 0
        else:
            wants = state.where("open").select("a")
            near = links.join(beside(wants), "a").join(beside(wants.withColumnRenamed("a", "b")), "b")
            waits = near.where(rank("b") < rank("a")).select("a").distinct().withColumn("waits", F.lit(True))
            told, turn = state.join(waits, "a", "left"), F.col("waits").isNull()
        labels = written(told.select(F.col("a").alias("node"), F.when(turn, F.col("label")).otherwise(F.col("own")).alias("label")))
    else:
        raise RuntimeError(f"labels did not settle in {most_rounds} rounds")
    discard(links)
    labels = state.select(F.col("a").alias("node"), "label")
    first = labels.groupBy("label").agg(F.min("node").alias("first"))
    return labels.join(first, "label").select("node", F.col("first").alias("community"))


def numbered(found: DataFrame) -> DataFrame:
    """(community, n): communities numbered from 0 in their order, over range partitions and their counts."""
    ranged = found.select("community").distinct().repartitionByRange("community")
    placed = cut(ranged.withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy("part").agg(F.count("*").alias("held"))
    before = counts.select(F.col("part").alias("p"), "held").join(counts.select("part"), F.col("p") < F.col("part"), "right").groupBy("part").agg(F.coalesce(F.sum("held"), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("community"))
    return placed.join(before, "part").select("community", (F.col("before") + place - 1).alias("n"))
