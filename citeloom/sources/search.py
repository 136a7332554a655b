"""Search equations: their files, their translation to a filter, paging with retries, a local evaluator."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.schema import SchemaError

# Statuses that are worth another try, number of tries, first wait in seconds, works a page;
# the operators of other databases that have no counterpart here.
RETRY_STATUSES = (429, 500, 502, 503, 504)
TRIES, FIRST_WAIT, PAGE, LOOKUP_BATCH, CITES_BATCH = 3, 1.0, 100, 100, 50
_NEAR = re.compile(r"\bNEAR/\d+\b", re.IGNORECASE)
_FIELD_TAG = re.compile(r"\b(?:TS|AB|TI|AU|SO|LA|DT|WC|SU)=", re.IGNORECASE)


@dataclass
class EquationSpec:
    query: str
    exclude: list[str] = field(default_factory=list)
    max_results: int = 200
    native: bool = False
    min_year: int | None = None
    max_year: int | None = None


def load_equation(path: str | Path) -> EquationSpec:
    """An equation from YAML; an unknown key is an error."""
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict) or not isinstance(data.get("equation"), dict):
        raise SchemaError("the file has no mapping named 'equation'")
    own = data["equation"]
    unknown = sorted(set(own) - {f.name for f in fields(EquationSpec)})
    if unknown:
        raise SchemaError(f"unknown key in equation: {unknown[0]}")
    if not str(own.get("query") or "").strip():
        raise SchemaError("equation has no query")
    return EquationSpec(**own)


#: What a search can't carry over, and how that is told.
_LOSSES = (
    (_NEAR.search, "NEAR/n is approximated by AND"),
    (lambda q: "*" in q, "the wildcard * works differently"),
    (_FIELD_TAG.search, "field tags have no counterpart"),
)


def translate(query: str, native: bool = False, exclude: list[str] | None = None, min_year: int | None = None, max_year: int | None = None) -> tuple[str, list[str]]:
    """The filter that a query becomes, and notes on what it can't carry over."""
    if native:
        return query, ["native query, used as it is"]
    unwanted = [w for w in (t.replace('"', "").strip() for t in exclude or () if t) if w]
    years = {"from_publication_date": min_year and f"{min_year}-01-01", "to_publication_date": max_year and f"{max_year}-12-31"}
    parts = {"title_and_abstract.search": f"({query})" + "".join(f' AND NOT "{w}"' for w in unwanted), **{k: v for k, v in years.items() if v}}
    notes = [told for found, told in _LOSSES if found(query)]
    notes += [f"{len(unwanted)} terms excluded"] * bool(unwanted) + ["limited by year"] * (len(parts) > 1)
    return ",".join(f"{k}:{v}" for k, v in parts.items()), notes


class SourceError(RuntimeError):
    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


def with_retry(call: Callable[[], tuple[int, dict]], wait: Callable[[float], None] = time.sleep) -> dict:
    """The body of a call that answers (status, body); statuses worth it are tried again, waiting twice as long."""
    for attempt in range(TRIES):
        status, body = call()
        if status < 400:
            return body
        if status not in RETRY_STATUSES:
            raise SourceError(f"the source answered {status}", status)
        if attempt + 1 < TRIES:
            wait(FIRST_WAIT * 2**attempt)
    raise SourceError(f"the source answered {status} {TRIES} times", status)


def pages(fetch: Callable[[str, int], tuple[int, dict]], limit: int, wait: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Works of a search, page by page along a cursor, no more than asked for."""
    cursor, left = "*", limit
    while left > 0 and cursor:
        body = with_retry(lambda: fetch(cursor, min(PAGE, left)), wait)
        results = body.get("results") or []
        yield from results[:left]
        left -= len(results)
        cursor = (body.get("meta") or {}).get("next_cursor") if results else None


def matches(df: DataFrame, spec: EquationSpec) -> DataFrame:
    """Local counterpart of a search over title and abstract: quoted phrases and words with AND, OR and NOT."""
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    tokens = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', spec.query)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def either():
        out = both()
        while peek() and peek().upper() == "OR":
            take()
            out = out | both()
        return out

    def both():
        out = one()
        while peek() and peek() != ")" and peek().upper() != "OR":
            if peek().upper() == "AND":
                take()
            out = out & one()
        return out

    def one():
        token = take()
        if token.upper() == "NOT":
            return ~one()
        if token == "(":
            out = either()
            if peek() == ")":
                take()
            return out
        return F.contains(text, F.lit(token.strip('"').lower().rstrip("*")))

    keep = either() if tokens else F.lit(True)
    for term in spec.exclude:
        keep = keep & ~F.contains(text, F.lit(term.strip().lower()))
    if spec.min_year is not None:
        keep = keep & F.coalesce(F.col("year") >= spec.min_year, F.lit(False))
    if spec.max_year is not None:
        keep = keep & F.coalesce(F.col("year") <= spec.max_year, F.lit(False))
    return df.where(keep).orderBy("id").limit(spec.max_results)
