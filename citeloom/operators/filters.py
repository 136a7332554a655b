"""Views, scopes and inclusion criteria over the paper table."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import provenance as prov

# Which operators each field of a criterion takes.
OPERATORS = {"year": ("gte", "lte"), "type": ("in", "not_in"), "language": ("eq", "in", "not_in"), "min_citations": ("gte",)}


@dataclass(frozen=True)
class FilterCriterion:
    field: str
    op: str
    value: Any

    def __post_init__(self) -> None:
        if self.field not in OPERATORS:
            raise ValueError(f"unknown field {self.field!r}")
        if self.op not in {o for ops in OPERATORS.values() for o in ops}:
            raise ValueError(f"unknown operator {self.op!r}")

    @property
    def name(self) -> str:
        return f"{self.field} {self.op} {self.value}"


@dataclass(frozen=True)
class FilterStep:
    name: str
    count_before: int
    count_after: int


def view(corpus: DataFrame, name: str) -> DataFrame:
    """``seed``, or the papers of one status: ``candidate``, ``accepted``, ``rejected``."""
    if name == "seed":
        return corpus.where("is_seed")
    return corpus.where(F.col("curation_status") == name)


def scoped(corpus: DataFrame, scope: str) -> DataFrame:
    """``all``, ``accepted`` (seeds and accepted papers) or ``seeds_only``."""
    if scope == "all":
        return corpus
    if scope == "seeds_only":
        return corpus.where("is_seed")
    if scope == "accepted":
        return corpus.where(F.col("is_seed") | (F.col("curation_status") == "accepted"))
    raise ValueError(f"unknown scope {scope!r}")


def dump_scope(corpus: DataFrame, scope: str) -> DataFrame:
    """``candidates`` that aren't seeds, ``seeds`` or ``all``: what a curation sheet shows."""
    if scope == "candidates":
        return corpus.where((F.col("curation_status") == "candidate") & ~F.col("is_seed"))
    if scope == "seeds":
        return corpus.where("is_seed")
    if scope == "all":
        return corpus
    raise ValueError(f"unknown scope {scope!r}")


def passes(c: FilterCriterion) -> Column:
    """Whether a paper meets a criterion; what is unknown about it doesn't."""
    if c.op not in OPERATORS[c.field]:
        raise ValueError(f"{c.field} doesn't take {c.op}")
    if c.field == "year":
        held = F.col("year") >= int(c.value) if c.op == "gte" else F.col("year") <= int(c.value)
    elif c.field == "type":
        values = [c.value] if isinstance(c.value, str) else list(c.value)
        some = F.arrays_overlap(F.coalesce("research_areas", F.array().cast("array<string>")), F.array(*map(F.lit, values)).cast("array<string>"))
        held = F.coalesce(some, F.lit(False)) if c.op == "in" else ~F.coalesce(some, F.lit(False))
    elif c.field == "language":
        own = F.lower(F.coalesce("language", F.lit("")))
        values = [v.lower() for v in ([c.value] if isinstance(c.value, str) else c.value)]
        held = own.isin(*values) if c.op in ("eq", "in") else ~own.isin(*values)
    else:
        held = F.coalesce(F.size("cited_by_id"), F.lit(0)) >= int(c.value)
    return F.coalesce(held, F.lit(False))


def apply_filters(corpus: DataFrame, criteria: list[FilterCriterion], decided_at: str, decided_by: str = "filter") -> tuple[DataFrame, list[FilterStep]]:
    """Reject, criterion by criterion, the undecided papers that fail; accepted and rejected ones stay.

    All counts come from one pass: the first criterion that a paper fails says when it leaves.
    """
    undecided = ~F.col("curation_status").isin("accepted", "rejected")
    failed = F.lit(None).cast("int")
    for k in range(len(criteria) - 1, -1, -1):
        failed = F.when(undecided & ~passes(criteria[k]), F.lit(k)).otherwise(failed)
    names = F.array(*[F.lit(c.name) for c in criteria]) if criteria else F.array().cast("array<string>")
    marked = corpus.withColumn("_failed", failed)
    counts = marked.agg(F.count_if(F.col("curation_status") != "rejected"), *[F.count_if(F.col("_failed") == k) for k in range(len(criteria))]).first()
    steps, left = [], counts[0]
    for k, c in enumerate(criteria):
        steps.append(FilterStep(c.name, left, left - counts[k + 1]))
        left -= counts[k + 1]
    hit = F.col("_failed").isNotNull()
    event = prov.event("rejected", decided_by=decided_by, decided_at=decided_at, source=F.get(names, F.col("_failed")))
    out = marked.withColumn("provenance", F.when(hit, prov.append(F.col("provenance"), event)).otherwise(F.col("provenance")))
    return out.withColumn("curation_status", F.when(hit, F.lit("rejected")).otherwise(F.col("curation_status"))).drop("_failed"), steps


def standard_criteria(min_year: int | None = None, max_year: int | None = None, languages: list[str] | None = None, types: list[str] | None = None, min_citations: int | None = None) -> list[FilterCriterion]:
    """The given limits as criteria, always in the same order."""
    given = [("year", "gte", min_year), ("year", "lte", max_year), ("language", "in", languages), ("type", "in", types), ("min_citations", "gte", min_citations)]
    return [FilterCriterion(f, o, v) for f, o, v in given if v is not None and v != []]


def papers_like(corpus: DataFrame, query: str | None = None, status: str | None = None, is_seed: bool | None = None, year: int | None = None) -> DataFrame:
    """Papers whose title holds the text, in either case, with the given status, seed mark and year."""
    out = corpus
    if query:
        out = out.where(F.contains(F.lower("title"), F.lit(query.lower())))
    if status is not None:
        out = out.where(F.col("curation_status") == status)
    if is_seed is not None:
        out = out.where(F.col("is_seed") == is_seed)
    if year is not None:
        out = out.where(F.col("year") == year)
    return out.select("id", "title", "year", "curation_status", "is_seed")
