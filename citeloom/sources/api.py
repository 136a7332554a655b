"""Works of a service that answers searches page by page, as a Spark data source: ``spark.read.format("works_api")``.

Options: ``fetch``, the function that asks the service, as ``module:name``; ``filter``, a search as
:func:`citeloom.sources.search.translate` makes it; ``limit``, works at most for each partition; others are
handed to ``fetch``.  The columns are those of the schema that the reader is given, and only these are asked
for; ``work`` is the whole record as JSON.

With ``spark.sql.python.filterPushdown.enabled`` conditions on ``publication_year`` and ``id`` become part of
the request, and decide about partitions: batches of ids, or else single years between two bounds, each
with a cursor and retries of its own.  Spark still checks them, so that a service that ignores one does no harm.
"""

from __future__ import annotations

import importlib
import json
from pathlib import Path

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from citeloom.sources.search import LOOKUP_BATCH, pages

SCHEMA = "id string, doi string, title string, publication_year int, language string, cited_by_count long, work string"
#: Years between two bounds up to which each is a partition.
MOST_YEARS = 200


class Request(InputPartition):
    def __init__(self, ids: list[str] | None = None, years: tuple[int | None, int | None] = (None, None)) -> None:
        self.ids, self.years = ids, years

    def filter(self, search: str | None) -> str:
        """The conditions in the form that the service takes."""
        low, high = self.years
        parts = [search or "", "" if self.ids is None else "ids:" + "|".join(self.ids), "" if low is None else f"from_publication_date:{low}-01-01", "" if high is None else f"to_publication_date:{high}-12-31"]
        return ",".join(p for p in parts if p)


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.options = schema, dict(options)
        self.ids: list[str] | None = None
        self.low: int | None = None
        self.high: int | None = None

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if name == "id" and isinstance(f, (EqualTo, In)):
                wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.ids = [x for x in wanted if x is not None and (self.ids is None or x in self.ids)]
            elif name == "publication_year" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = f.value + isinstance(f, GreaterThan)
                    self.low = low if self.low is None else max(low, self.low)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = f.value - isinstance(f, LessThan)
                    self.high = high if self.high is None else min(high, self.high)
            yield f

    def partitions(self):
        if self.ids is not None:
            ids = sorted(set(self.ids))
            return [Request(ids[k : k + LOOKUP_BATCH], (self.low, self.high)) for k in range(0, len(ids), LOOKUP_BATCH)] or [Request([])]
        if self.low is not None and self.high is not None and 0 <= self.high - self.low < MOST_YEARS:
            return [Request(None, (y, y)) for y in range(self.low, self.high + 1)]
        return [Request(None, (self.low, self.high))]

    def read(self, partition: Request):
        if partition.ids == []:
            return
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        names = self.schema.names
        asked = {**self.options, "filter": partition.filter(self.options.get("filter"))}
        if "work" not in names:
            asked["select"] = ",".join(names)
        for work in pages(lambda cursor, n: fetch({**asked, "cursor": cursor, "per_page": n}), int(self.options.get("limit", 1 << 60))):
            yield tuple(json.dumps(work, ensure_ascii=False, sort_keys=True) if c == "work" else work.get(c) for c in names)


class WorksApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "works_api"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def http(params: dict) -> tuple[int, dict]:
    """Ask the service at ``endpoint``."""
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import urlopen

    asked = {"filter": params["filter"], "cursor": params["cursor"], "per-page": params["per_page"], **{k: params[k] for k in ("select", "mailto") if k in params}}
    try:
        with urlopen(f"{params['endpoint']}?{urlencode({k: v for k, v in asked.items() if v})}", timeout=60) as answer:
            return answer.status, json.load(answer)
    except HTTPError as e:
        return e.code, {}


#: Where the page behind so many works of a search begins, for searches going on in this process.
_places: dict[tuple, tuple[int, int]] = {}
MOST_PLACES = 1024


def replay(params: dict) -> tuple[int, dict]:
    """Answer from works saved as JSON lines under ``path``, page by page, by the conditions of the request.

    A cursor is the number of works before the page.  The process remembers the file and the place in it where the next
    page begins, so that a search reads each line once; where that isn't known, it reads from the first line.  For work without a network; ``log`` names a folder in which each request leaves a file."""
    wanted = dict(part.split(":", 1) for part in params["filter"].split(",") if part)
    ids = set(wanted["ids"].split("|")) if "ids" in wanted else None
    low, high = (int(wanted[k][:4]) if k in wanted else None for k in ("from_publication_date", "to_publication_date"))
    select = params["select"].split(",") if "select" in params else None
    paths = sorted(Path(params["path"].removeprefix("file:")).glob("*.json"))
    done = 0 if params["cursor"] == "*" else int(params["cursor"])
    search = (params["path"], params["filter"])
    first, at, skip = (*_places[search, done], 0) if done and (search, done) in _places else (0, 0, done)
    page, ahead = [], None
    for k in range(first, len(paths)):
        with paths[k].open("rb") as file:
            file.seek(at if k == first else 0)
            place = file.tell()
            for line in file:
                work = json.loads(line)
                year = work.get("publication_year")
                if (ids is None or work["id"] in ids) and (low is None or (year or low - 1) >= low) and (high is None or (year or high + 1) <= high):
                    if len(page) == params["per_page"]:
                        ahead = (k, place)
                        break
                    skip -= 1
                    if skip < 0:
                        page.append(work if select is None else {c: work.get(c) for c in select})
                place += len(line)
        if ahead:
            break
    if "log" in params:
        import uuid

        Path(params["log"], uuid.uuid4().hex).write_text(json.dumps({k: params.get(k) for k in ("filter", "select", "cursor")}))
    last = done + len(page)
    if ahead:
        _places[search, last] = ahead
        while len(_places) > MOST_PLACES:
            del _places[next(iter(_places))]
    return 200, {"results": page, "meta": {"next_cursor": str(last) if ahead else None}}
