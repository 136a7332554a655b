"""The five co-occurrence networks.  All are one plan: distinct incidence, self-join, count.

An incidence is a DataFrame (node, grp); two nodes are tied once for each group that both belong to.
Bibliographic coupling and co-citation have papers as nodes and shared items as groups; the other three
have items as nodes and papers as groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.plans.checkpoint import written
from citeloom.schema import NetworkKind

#: Column of each kind, and whether papers (not the column's items) are the nodes.
PROJECTIONS = {
    NetworkKind.COUPLING: ("references_id", True),
    NetworkKind.COCITATION: ("cited_by_id", True),
    NetworkKind.AUTHOR: ("authors_id", False),
    NetworkKind.INSTITUTION: ("institutions_id", False),
    NetworkKind.KEYWORD: ("keywords_id", False),
}

#: Nodes of a group that meet in one task as a block.
BLOCK = 1024
#: Rows of an incidence, and pairs to be counted, in a task on average.
ROWS_OF_A_TASK, PAIRS_OF_A_TASK = 100_000, 1_500_000


def exploded(corpus: DataFrame, column: str, name: str = "item") -> DataFrame:
    """(paper_id, item) for each list element; papers with null or empty lists have no rows."""
    return corpus.select(F.col("id").alias("paper_id"), F.explode(column).alias(name))


def keyword_filter(corpus: DataFrame, terms: list[str] | None, column: str = "keywords_raw") -> DataFrame:
    """Papers with a keyword that contains any of the terms, in either case; no terms: all papers."""
    if not terms:
        return corpus

    def matches(k: Column) -> Column:
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(F.lower(k), F.lit(t.lower()))
        return F.coalesce(hit, F.lit(False))

    return corpus.where(F.coalesce(F.exists(column, matches), F.lit(False)))


def incidence(corpus: DataFrame, kind: NetworkKind, scope: str = "full") -> DataFrame:
    if scope not in ("full", "seeds_only"):
        raise ValueError(f"unknown scope {scope!r}")
    column, papers = PROJECTIONS[NetworkKind(kind)]
    rows = exploded(corpus.where("is_seed") if scope == "seeds_only" else corpus, column)
    node, grp = ("paper_id", "item") if papers else ("item", "paper_id")
    return rows.select(F.col(node).alias("node"), F.col(grp).alias("grp"))


def project(inc: DataFrame, min_weight: int = 1) -> DataFrame:
    """(src, dst, weight) with src < dst: groups that two nodes share, from ``min_weight`` on.

    A node in fewer groups than ``min_weight`` has no such edge and is left out before pairs are made.  The
    members of a group of over ``BLOCK`` nodes are dealt to blocks by a hash, and each two of its blocks meet
    in a tile of their own, so that no task makes more than about BLOCK ** 2 pairs of one group.  The incidence
    is written once and counted: tiles and pairs are dealt to numbers of partitions that follow it, and aren't
    coalesced by their bytes, which say little about the pairs they make.  Pairs that mostly differ go to their
    counts as they are; where few nodes meet again and again they are counted before they are sent.
    """
    pairs = written(inc.where("node is not null and grp is not null").distinct())
    parts = max(int(inc.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count() // ROWS_OF_A_TASK + 1)
    if min_weight > 1:
        busy = pairs.groupBy("node").agg(F.count("*").alias("m")).where(F.col("m") >= min_weight).select("node")
        pairs = pairs.join(busy, "node", "left_semi")
    sizes = pairs.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1")
    made = sizes.agg(F.sum(F.col("k").cast("double") * (F.col("k") - 1) / 2)).first()[0] or 0
    nodes = pairs.agg(F.approx_count_distinct("node")).first()[0]
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    dealt = pairs.join(sizes, "grp").select("grp", "node", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    tile = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    tiles = dealt.select("grp", *tile, "own", "node").repartition(parts, "grp", "i", "j").groupBy("grp", "i", "j")
    sides = tiles.agg(*[F.collect_list(F.when(F.col("own") == F.col(k), F.col("node"))).alias(side) for k, side in (("i", "left"), ("j", "right"))])
    met = sides.select("i", "j", "right", F.explode("left").alias("x")).select("i", "j", "x", F.explode("right").alias("y")).where("i < j or x < y")
    ends = met.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))
    if nodes * nodes > made:
        ends = ends.repartition(int(made) // PAIRS_OF_A_TASK + 1, "src", "dst")
    edges = ends.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return edges.where(F.col("weight") >= min_weight) if min_weight > 1 else edges


def network(corpus: DataFrame, kind: NetworkKind, min_weight: int = 1, scope: str = "full", terms: list[str] | None = None) -> DataFrame:
    return project(incidence(keyword_filter(corpus, terms), kind, scope), min_weight)


def coupled_with(inc: DataFrame, node) -> DataFrame:
    """(node, weight): the nodes that share groups with one node, without projecting the whole network."""
    own = inc.where(F.col("node") == node).select("grp").distinct()
    return inc.where(F.col("node") != node).distinct().join(own, "grp", "left_semi").groupBy("node").agg(F.count("*").alias("weight"))


def build_preview(corpus: DataFrame) -> DataFrame:
    """(kind, would_be_empty, reason, fix): which networks a build would leave empty, and why.

    One aggregation over the papers, and one over items for each of the two paper networks.
    """
    some = lambda c: F.coalesce(F.exists(c, lambda x: x.isNotNull()), F.lit(False))
    multi = lambda c: F.coalesce(F.size(F.array_distinct(F.array_compact(c))) >= 2, F.lit(False))
    counts = corpus.agg(
        F.count("*").alias("total"), F.count_if("is_seed").alias("seeds"),
        *[F.count_if(some(c)).alias(f"n_{c}") for c in ("references_id", "authors_id", "institutions_id", "keywords_id", "keywords_raw")],
        F.count_if(some("cited_by_id") & F.col("is_seed")).alias("n_cited_by_id"),
        *[F.coalesce(F.bool_or(multi(c)), F.lit(False)).alias(f"multi_{c}") for c in ("authors_id", "institutions_id", "keywords_id")],
    )

    def shared(rows: DataFrame, column: str) -> DataFrame:
        twice = exploded(rows, column).where("item is not null").groupBy("item").agg((F.min("paper_id") != F.max("paper_id")).alias("twice"))
        return twice.agg(F.coalesce(F.bool_or("twice"), F.lit(False)).alias(f"shared_{column}"))

    facts = counts.crossJoin(shared(corpus, "references_id")).crossJoin(shared(corpus.where("is_seed"), "cited_by_id"))  # one row each

    def line(kind: NetworkKind, column: str, fine: str, why_not: str, fix: Column, of: str = "total", who: str = "papers") -> Column:
        none = F.concat_ws("", F.col(f"n_{column}").cast("string"), F.lit("/"), F.col(of).cast("string"), F.lit(f" {who} with {column}"))
        reason = F.when(F.col(f"n_{column}") == 0, none).otherwise(F.concat(none, F.lit(f" but {why_not}")))
        return F.struct(F.lit(kind.value).alias("kind"), (~F.col(fine)).alias("would_be_empty"), F.when(~F.col(fine), reason).alias("reason"), F.when(~F.col(fine), fix).alias("fix"))

    resolve = F.lit("seed --resolve")
    keyword_fix = F.when((F.col("n_keywords_raw") > 0) & (F.col("n_keywords_id") == 0), F.lit("build --thesaurus FILE")).otherwise(resolve)
    lines = [
        line(NetworkKind.COUPLING, "references_id", "shared_references_id", "no reference in two papers", resolve),
        line(NetworkKind.AUTHOR, "authors_id", "multi_authors_id", "none with two authors", resolve),
        line(NetworkKind.INSTITUTION, "institutions_id", "multi_institutions_id", "none with two institutions", resolve),
        line(NetworkKind.KEYWORD, "keywords_id", "multi_keywords_id", "none with two keywords", keyword_fix),
        line(NetworkKind.COCITATION, "cited_by_id", "shared_cited_by_id", "no citing paper in two seeds", F.lit("build"), "seeds", "seeds"),
    ]
    return facts.select(F.explode(F.array(*lines)).alias("x")).select("x.*")
