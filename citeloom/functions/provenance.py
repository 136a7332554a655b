"""The provenance column: a JSON list of events, parsed and merged by native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.schema import EVENT

EVENTS = T.ArrayType(EVENT)
DECISIONS = ("accepted", "rejected")


def parse(provenance: Column, loud: bool = False) -> Column:
    """Events of a JSON list; null and empty text give null.  ``loud`` fails on bad JSON."""
    return F.from_json(F.nullif(provenance, F.lit("")), EVENTS, {"mode": "FAILFAST" if loud else "PERMISSIVE"})


def dump(events: Column) -> Column:
    return F.to_json(events, {"ignoreNullFields": "false"})


def event(action: str | Column, decided_by: str | None = None, decided_at: str | Column | None = None, source: str | None = None, equation_id: str | None = None, chaining_hop: int | None = None, fetched_at: str | None = None) -> Column:
    values = dict(action=action, equation_id=equation_id, chaining_hop=chaining_hop, source=source, fetched_at=fetched_at, decided_by=decided_by, decided_at=decided_at)
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(EVENT[k].dataType).alias(k) for k, v in values.items()])


def append(provenance: Column, new: Column) -> Column:
    return dump(F.concat(F.coalesce(parse(provenance), F.array().cast(EVENTS)), F.array(new)))


def latest_decision(events: Column) -> Column:
    """Time of the last human decision; ISO texts compare as texts."""
    made = F.filter(events, lambda e: e["action"].isin(*DECISIONS) & (F.coalesce(e["decided_at"], F.lit("")) != ""))
    return F.array_max(F.transform(made, lambda e: e["decided_at"]))


def merged_events(a: Column, b: Column) -> Column:
    """Events of a, then those of b that a doesn't have; null if neither has a list."""
    empty = F.array().cast(EVENTS)
    left, right = F.coalesce(a, empty), F.coalesce(b, empty)
    return F.when(a.isNotNull() | b.isNotNull(), F.concat(left, F.filter(right, lambda e: ~F.array_contains(left, e))))


def priority(status: Column) -> Column:
    return F.when(status == "accepted", 2).when(status == "rejected", 1).otherwise(0)


def merged_status(a: Column, b: Column, a_events: Column, b_events: Column) -> Column:
    """The later human decision wins; on a tie, or without any, accepted > rejected > candidate."""
    x, y = latest_decision(a_events), latest_decision(b_events)
    by_rank = F.when(priority(a) >= priority(b), a).otherwise(b)
    later = F.when(x.isNotNull() & (y.isNull() | (x > y)), a).when(y.isNotNull() & (x.isNull() | (y > x)), b).otherwise(by_rank)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(later)
