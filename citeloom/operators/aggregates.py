"""Statistics and read models over the paper table and its networks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import joined, paper_label, paper_url
from citeloom.operators.graph import degree_centrality


@dataclass(frozen=True)
class QualityThresholds:
    min_volume: int = 200
    min_doi_refs_pct: float = 0.90
    min_countries: int = 5
    min_recurrent_authors: int = 10


def stats_by(corpus: DataFrame, key: str) -> DataFrame:
    """(key, n) in the order of the key, nulls last."""
    if key not in ("curation_status", "year", "is_seed"):
        raise ValueError(f"cannot group by {key!r}")
    return corpus.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).orderBy(F.asc_nulls_last("key"))


def quality_report(corpus: DataFrame, thresholds: QualityThresholds = QualityThresholds()) -> DataFrame:
    """(measure, value, threshold, passed): volume, share with DOI, institutions, recurrent authors, overall."""
    size = corpus.agg(F.count("*").alias("n"), F.count_if(F.coalesce("doi", F.lit("")) != "").alias("with_doi"))
    places = corpus.select(F.explode("institutions_id").alias("x")).where("x is not null").agg(F.countDistinct("x").alias("places"))
    authors = corpus.select(F.explode("authors_id").alias("x")).where("x is not null").groupBy("x").count().agg(F.count_if(F.col("count") >= 2).alias("authors"))
    row = size.crossJoin(places).crossJoin(authors)  # one row each
    share = F.round(F.when(F.col("n") > 0, F.col("with_doi") / F.col("n")).otherwise(0.0), 4)
    t = thresholds
    measures = [("min_volume", F.col("n").cast("double"), float(t.min_volume)), ("min_doi_refs_pct", share, t.min_doi_refs_pct), ("min_countries", F.col("places").cast("double"), float(t.min_countries)), ("min_recurrent_authors", F.col("authors").cast("double"), float(t.min_recurrent_authors))]
    raw = {"min_doi_refs_pct": F.when(F.col("n") > 0, F.col("with_doi") / F.col("n")).otherwise(0.0)}
    passed = [raw.get(name, value) >= limit for name, value, limit in measures]
    every = passed[0]
    for p in passed[1:]:
        every = every & p
    lines = [F.struct(F.lit(name).alias("measure"), value.alias("value"), F.lit(limit).alias("threshold"), ok.alias("passed")) for (name, value, limit), ok in zip(measures, passed)]
    lines.append(F.struct(F.lit("overall").alias("measure"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"), every.alias("passed")))
    return row.select(F.explode(F.array(*lines)).alias("x")).select("x.*")


def document_frequency(corpus: DataFrame, column: str) -> DataFrame:
    """(value, n): papers in which each list element occurs."""
    return corpus.select(F.explode(F.array_distinct(column)).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def maturity(corpus: DataFrame) -> DataFrame:
    """One row: whether anything is curated, and whether growth has saturated (never known)."""
    return corpus.agg(F.coalesce(F.bool_or(F.col("curation_status").isin("accepted", "rejected")), F.lit(False)).alias("curated"), F.lit(False).alias("saturated"), F.count("*").alias("papers"))


def maturity_block(corpus: DataFrame, scope: str | None = None, empty_networks: list[str] | None = None) -> dict:
    """``maturity`` with the scope it was asked for and the networks that came out empty."""
    row = maturity(corpus).first()
    return {"curated": row["curated"], "scope": scope, "saturated": row["saturated"], "empty_networks": list(empty_networks or [])}


def readiness(corpus: DataFrame) -> DataFrame:
    """One row: papers, seeds, seeds with a source id, whether citing lists exist."""
    return corpus.agg(
        F.count("*").alias("papers"), F.count_if("is_seed").alias("seeds"), F.count_if(F.col("is_seed") & F.col("source_id").isNotNull()).alias("seeds_with_source"),
        F.coalesce(F.bool_or(F.size("cited_by_id") > 0), F.lit(False)).alias("has_cited_by"),
    )


def top_values(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """(key, value, n, rank): the most frequent values of each key; ties by value."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))).where(F.col("rank") <= n)


def cluster_table(corpus: DataFrame, communities: DataFrame, top: int = 5) -> DataFrame:
    """One row for each cluster of papers: size, seeds, statuses, years, and its most frequent authors and keywords."""
    members = communities.select(F.col("node").alias("id"), F.col("community").alias("cluster"))
    papers = members.join(corpus.select("id", "is_seed", "curation_status", "year", "authors_raw", "authors_id", "keywords_id", "keywords_raw"), "id")
    base = papers.groupBy("cluster").agg(
        F.count("*").alias("size"), F.count_if("is_seed").alias("seeds"), F.count_if(F.col("curation_status") == "candidate").alias("candidates"), F.count_if(F.col("curation_status") == "accepted").alias("accepted"),
        F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.bround(F.avg("year"), 1).alias("year_mean"),
    )

    def most(column: Column, name: str) -> DataFrame:
        values = papers.select("cluster", F.explode(F.array_distinct(column)).alias("v")).where("v is not null")
        best = top_values(values, "cluster", "v", top)
        return best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "v"))), lambda x: x["v"]).alias(name))

    authors, words = most(F.coalesce("authors_raw", "authors_id"), "top_authors"), most(F.coalesce("keywords_id", "keywords_raw"), "top_keywords")
    return base.join(authors, "cluster", "left").join(words, "cluster", "left")


def top_central(edges: DataFrame, corpus: DataFrame, n: int) -> DataFrame:
    """The n nodes of highest degree centrality, ties by id, with title and year where they are papers."""
    best = degree_centrality(edges).orderBy(F.desc("degree_centrality"), "node").limit(n)
    return best.join(corpus.select(F.col("id").alias("node"), "title", "year"), "node", "left").orderBy(F.desc("degree_centrality"), "node")


def top_pairs(edges: DataFrame, corpus: DataFrame, n: int) -> DataFrame:
    """The n heaviest edges, ties by both ends, with the titles of the ends."""
    best = edges.orderBy(F.desc("weight"), "src", "dst").limit(n)
    named = best.join(corpus.select(F.col("id").alias("src"), F.col("title").alias("src_title")), "src", "left")
    return named.join(corpus.select(F.col("id").alias("dst"), F.col("title").alias("dst_title")), "dst", "left").orderBy(F.desc("weight"), "src", "dst")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): papers added to and removed from a corpus."""
    a, b = old.select("id"), new.select("id")
    added = b.join(a, "id", "left_anti").withColumn("change", F.lit("added"))
    return added.unionAll(a.join(b, "id", "left_anti").withColumn("change", F.lit("removed")))


def display_names(corpus: DataFrame, ids: str, names: str) -> DataFrame:
    """(node, name): the first name that stands in the place of each id, by order of papers and place."""
    seq = F.col("_seq") if "_seq" in corpus.columns else F.col("id")
    pairs = corpus.select(seq.alias("s"), F.posexplode(ids).alias("pos", "node"), F.col(names).alias("names"))
    named = pairs.withColumn("name", F.get("names", "pos")).where("node is not null and coalesce(name, '') <> ''")
    return named.groupBy("node").agg(F.min_by("name", F.struct("s", "pos")).alias("name"))


def decorate(edges: DataFrame, corpus: DataFrame, kind: str, communities: DataFrame | None = None) -> DataFrame:
    """Nodes with label, degree centrality and, for papers, what is known about them; null where unknown."""
    nodes = degree_centrality(edges)
    if communities is not None:
        nodes = nodes.join(communities, "node", "left")
    if kind in ("bibliographic_coupling", "cocitation"):
        papers = corpus.select(
            F.col("id").alias("node"), paper_label(F.col("title"), F.col("year"), F.col("id")).alias("label"), "year", "is_seed", "curation_status", "doi",
            paper_url(F.col("doi"), F.col("source_id")).alias("url"), F.col("source").alias("venue"),
            F.coalesce(joined(F.col("authors_raw"), "|"), joined(F.col("authors_id"), "|")).alias("authors"), F.coalesce(joined(F.col("keywords_id"), "|"), joined(F.col("keywords_raw"), "|")).alias("keywords"),
            F.nullif(F.size("cited_by_id"), F.lit(0)).alias("cited_by_count"),
        )
        return nodes.join(papers, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if kind == "author_collab":
        nodes = nodes.join(display_names(corpus, "authors_id", "authors_raw"), "node", "left")
    elif kind == "institution_collab":
        nodes = nodes.join(display_names(corpus, "institutions_id", "institutions_raw"), "node", "left")
    else:
        nodes = nodes.withColumn("name", F.lit(None).cast("string"))
    return nodes.withColumn("label", F.coalesce("name", "node")).drop("name")
