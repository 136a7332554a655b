"""Read models: what surrounds a paper, a network as one record, two rounds side by side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators import aggregates, networks
from citeloom.plans.networks import NetworkSpec, build
from citeloom.schema import NetworkKind

#: What a node tells besides its id, label and centrality, where its network knows it.
NODE_EXTRAS = ("community", "year", "is_seed", "curation_status")


def surroundings(corpus: DataFrame, ident: str) -> DataFrame:
    """(relation, paper_id, title, weight) of the papers around one paper of the corpus.

    ``coupling``: papers that share references with it, by how many; ``references`` and ``cited_by``: what
    its own lists name, as far as the corpus has it.  Only the paper's own references are joined.
    """
    shared = networks.coupled_with(networks.incidence(corpus, NetworkKind.COUPLING), ident)
    own = corpus.where(F.col("id") == ident)
    rows = shared.select(F.lit("coupling").alias("relation"), F.col("node").alias("paper_id"), "weight")
    for relation, column in (("references", "references_id"), ("cited_by", "cited_by_id")):
        listed = own.select(F.explode(F.array_compact(column)).alias("paper_id"))
        rows = rows.unionAll(listed.select(F.lit(relation).alias("relation"), "paper_id", F.lit(None).cast("long").alias("weight")))
    return rows.join(corpus.select(F.col("id").alias("paper_id"), "title"), "paper_id").select("relation", "paper_id", "title", "weight")


@dataclass
class NetworkRecord:
    nodes: DataFrame
    edges: DataFrame
    metrics: dict


def network_record(corpus: DataFrame, kind: str, clustering: str | None = "louvain", seed: int | None = None) -> NetworkRecord:
    """A network of the corpus with its nodes, edges (source, target, weight) and measures."""
    a = build(corpus, NetworkSpec(kind=NetworkKind(kind), clustering=clustering), seed)
    nodes = a.nodes.select(F.col("node").alias("id"), "label", "degree_centrality", *[c for c in NODE_EXTRAS if c in a.nodes.columns])
    edges = a.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight")
    groups = a.communities.agg(F.countDistinct("community").alias("n")).first()["n"] if a.communities is not None else 0
    m = a.metrics
    return NetworkRecord(nodes, edges, {"n_nodes": m["nodes"], "n_edges": m["edges"], "density": m["density"], "num_components": m["components"], "avg_clustering": m["average_clustering"], "n_communities": groups})


@dataclass
class RoundComparison:
    changes: DataFrame
    metrics: list[dict]


def compare(older: DataFrame, newer: DataFrame, old_measures: dict | None = None, new_measures: dict | None = None) -> RoundComparison:
    """Papers added and removed, the sizes, and what both rounds measured of the same networks.

    ``old_measures`` and ``new_measures``: for each kind of network, its metrics.
    """
    metrics = [{"metric": "n_papers", "before": older.count(), "after": newer.count()}]
    for kind in sorted(set(old_measures or {}) & set(new_measures or {})):
        a, b = old_measures[kind], new_measures[kind]
        for name in ("n_communities", "density"):
            if a.get(name) is not None and b.get(name) is not None:
                metrics.append({"metric": f"{name}:{kind}", "before": a[name], "after": b[name]})
    return RoundComparison(aggregates.snapshot_diff(older, newer), metrics)
