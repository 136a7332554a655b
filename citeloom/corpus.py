"""The corpus: an immutable table of papers with a manifest of how it came about."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from citeloom.functions.identity import corpus_hash, with_ids
from citeloom.operators import filters, merge as merging
from citeloom.operators.networks import exploded
from citeloom.schema import COLUMNS, conform, validate
from citeloom.store import Snapshot, now, write_snapshot


@dataclass(frozen=True)
class Manifest:
    schema_version: int = 1
    equations: tuple = ()
    chaining: dict | None = None
    preprocessors: tuple = ()
    filters: tuple = ()
    enrichers: dict = field(default_factory=dict)

    def with_enricher(self, name: str, **params) -> Manifest:
        """An enricher's entry, replacing an older one of the same name; values are kept as text."""
        return replace(self, enrichers={**{k: v for k, v in self.enrichers.items() if k != name}, name: {k: str(v) for k, v in params.items()}})

    def as_dict(self) -> dict:
        return {"schema_version": self.schema_version, "equations": list(self.equations), "chaining": self.chaining, "preprocessors": list(self.preprocessors), "filters": [vars(f) for f in self.filters], "enrichers": self.enrichers}


class Corpus:
    """Every method that changes something returns a new corpus; nothing runs before a result is asked for."""

    def __init__(self, df: DataFrame, manifest: Manifest | None = None) -> None:
        self.df, self.manifest = df, manifest or Manifest()

    @classmethod
    def of(cls, df: DataFrame, manifest: Manifest | None = None) -> Corpus:
        """A validated corpus."""
        return cls(validate(df), manifest)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: list[dict]) -> Corpus:
        """From dictionaries; missing columns are null or take their defaults, missing ids are computed."""
        from citeloom.schema import CORPUS_SCHEMA

        defaults = {"is_seed": True, "curation_status": "candidate", "title": ""}
        data = [tuple(r.get(c, defaults.get(c)) for c in COLUMNS) + (k,) for k, r in enumerate(rows, 1)]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CORPUS_SCHEMA) + f", {merging.SEQ} bigint"
        df = with_ids(spark.createDataFrame(data, fields))
        return cls(df.select(*COLUMNS, merging.SEQ))

    @property
    def table(self) -> DataFrame:
        """The 23 columns, in the order of first appearance where it is known."""
        return merging.ordered(self.df) if merging.SEQ in self.df.columns else self.df.select(*COLUMNS)

    def _new(self, df: DataFrame, **changes) -> Corpus:
        return Corpus(df, replace(self.manifest, **changes) if changes else self.manifest)

    def with_manifest(self, manifest: Manifest) -> Corpus:
        return Corpus(self.df, manifest)

    def seeds(self) -> Corpus:
        return self._new(filters.view(self.df, "seed"))

    def candidates(self) -> Corpus:
        return self._new(filters.view(self.df, "candidate"))

    def accepted(self) -> Corpus:
        return self._new(filters.view(self.df, "accepted"))

    def scoped(self, scope: str) -> Corpus:
        return self._new(filters.scoped(self.df, scope))

    def merge(self, other: Corpus) -> Corpus:
        return self._new(merging.merge(self.df, other.df))

    def add_papers(self, rows: DataFrame) -> Corpus:
        """Rows merged in: papers that are there already are updated."""
        return self._new(merging.merge(self.df, with_ids(conform(rows))))

    def _curated(self, ids: list[str], decision: str, by: str, at: str | None) -> Corpus:
        spark = self.df.sparkSession
        chosen = spark.createDataFrame([(i, decision) for i in ids], "id string, decision string")
        return self._new(merging.curate(self.df, chosen, by, at or now().isoformat()))

    def accept(self, ids: list[str], by: str = "user", at: str | None = None) -> Corpus:
        return self._curated(ids, "accepted", by, at)

    def reject(self, ids: list[str], by: str = "user", at: str | None = None) -> Corpus:
        return self._curated(ids, "rejected", by, at)

    def filter(self, criteria: list[filters.FilterCriterion], at: str | None = None) -> Corpus:
        df, steps = filters.apply_filters(self.df, criteria, at or now().isoformat())
        return self._new(df, filters=(*self.manifest.filters, *steps))

    def materialize(self, view: str) -> DataFrame:
        """(paper_id, author | keyword | institution), one row for each list element."""
        columns = {"author": "authors_id", "keyword": "keywords_id", "institution": "institutions_id"}
        if view not in columns:
            raise ValueError(f"unknown view {view!r}")
        return exploded(self.df, columns[view], view)

    def sql(self, query: str) -> DataFrame:
        self.df.select(*COLUMNS).createOrReplaceTempView("corpus")
        return self.df.sparkSession.sql(query)

    def hash(self) -> str:
        return corpus_hash(self.df)

    def snapshot(self, path: str) -> Snapshot:
        return write_snapshot(self.table, path, self.manifest.as_dict())

    def __len__(self) -> int:
        return self.df.count()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Corpus) and self.hash() == other.hash()

    __hash__ = None


__all__ = ["Corpus", "Manifest"]
