"""Enrichment of a corpus from works that were fetched: DOIs of references, citing lists of seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import last_segment
from citeloom.operators import scent
from citeloom.operators.networks import exploded

PASSES = ("references", "cited_by")


def references(corpus: DataFrame, lookup: DataFrame) -> DataFrame:
    """``references_doi`` filled in from (id, doi), in the places of the references; a list that exists gives way."""
    found = scent.references_doi(corpus, lookup).select(F.col("id").alias("_i"), F.col("references_doi").alias("_d"))
    joined = corpus.join(found, F.col("id") == F.col("_i"), "left")
    return joined.withColumn("references_doi", F.coalesce("_d", "references_doi")).drop("_i", "_d")


def references_metric(corpus: DataFrame, lookup: DataFrame) -> DataFrame:
    """One row: different references in all, and how many of them the lookup resolves."""
    refs = exploded(corpus, "references_id", "ref").where("ref is not null").select("ref").distinct()
    known = lookup.where("doi is not null").select(F.col("id").alias("ref")).distinct().withColumn("hit", F.lit(1))
    return refs.join(known, "ref", "left").agg(F.count("*").alias("total"), F.count("hit").alias("resolved"))


def _targets(corpus: DataFrame) -> DataFrame:
    """Accepted seeds that have a source id, by its short form."""
    return corpus.where("is_seed and curation_status = 'accepted'").select(last_segment(F.col("source_id")).alias("target")).where("target is not null")


def cited_by(corpus: DataFrame, works: DataFrame, cap: int | None = None, since: str | None = None) -> DataFrame:
    """``cited_by_id`` of the accepted seeds united with the works that cite them, sorted, at most ``cap`` in all.

    Papers are known by the last segment of their source id, so that a URL will do.  An accepted seed that
    nothing cites gets an empty list; all other papers keep what they have.  (Chaining grows the lists of all
    seeds instead: :func:`citeloom.operators.scent.grown_lists`.)
    """
    targets = _targets(corpus).distinct()
    none = F.array().cast("array<string>")
    found = targets.join(scent.citing_batch(works, targets, cap, since), "target", "left").select(F.col("target").alias("_t"), F.coalesce("citers", none).alias("_c"))
    joined = corpus.join(found, last_segment(F.col("source_id")) == F.col("_t"), "left")
    union = F.array_sort(F.array_union(F.coalesce("cited_by_id", none), "_c"))
    return joined.withColumn("cited_by_id", F.when(F.col("_t").isNotNull(), union if cap is None else F.slice(union, 1, cap)).otherwise(F.col("cited_by_id"))).drop("_t", "_c")


def cited_by_metric(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: accepted seeds that were looked up, and how many citers the pass has added to lists."""
    none = F.array().cast("array<string>")
    old = before.select("id", F.coalesce("cited_by_id", none).alias("_o"))
    new = after.join(old, "id").agg(F.coalesce(F.sum(F.size(F.array_except(F.coalesce("cited_by_id", none), "_o"))), F.lit(0)).cast("long").alias("resolved"))
    return _targets(before).agg(F.count("*").alias("total")).crossJoin(new)  # one row each


def records(before: DataFrame, after: DataFrame, lookup: DataFrame | None, passes: tuple[str, ...] = PASSES) -> dict[str, dict]:
    """What each pass has resolved, of how many, for a manifest."""
    out = {}
    if "references" in passes:
        row = references_metric(before, lookup).first()
        out["references_doi"] = {"resolved": row["resolved"], "total_unique_refs": row["total"]}
    if "cited_by" in passes:
        row = cited_by_metric(before, after).first()
        out["cited_by"] = {"resolved": row["resolved"], "total": row["total"]}
    return out


def enrich(corpus: DataFrame, works: DataFrame, lookup: DataFrame, passes: tuple[str, ...] = PASSES, cap: int | None = None) -> DataFrame:
    """The passes asked for, references first; an unknown one is an error."""
    unknown = sorted(set(passes) - set(PASSES))
    if unknown:
        raise ValueError(f"unknown pass {unknown[0]!r}")
    out = corpus
    if "references" in passes:
        out = references(out, lookup)
    if "cited_by" in passes:
        out = cited_by(out, works, cap)
    return out
