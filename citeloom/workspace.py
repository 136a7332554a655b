"""A workspace folder: library, networks, snapshots and exports, with the operations on them."""

from __future__ import annotations

import json
import os
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom import reads
from citeloom.cycle import CycleState, apply_transition, available_transitions, next_best_action
from citeloom.errors import DataError, LibraryError, UsageError
from citeloom.functions import provenance as prov
from citeloom.functions.identity import corpus_hash
from citeloom.functions.text import normalize_doi, paper_url
from citeloom.operators import aggregates, enrich, filters, merge as merging, networks, preprocess, scent
from citeloom.plans.checkpoint import cut
from citeloom.plans.networks import build_all, is_stale
from citeloom.schema import COLUMNS, NetworkKind
from citeloom.sinks.files import read_curation_sheet, write_csv, write_curation_sheet, write_graphml
from citeloom.sources import bibtex, search
from citeloom.store import Snapshot, Store, StoreError, now, write_snapshot


LIVE = "live"
#: Citing works that a step forward or an enrichment takes for each seed, unless told otherwise.
MOST_CITING = 50


class WorkspaceNotFound(LibraryError):
    pass


class WorkspaceExists(LibraryError):
    pass


class Workspace:
    def __init__(self, spark: SparkSession, root: str | Path) -> None:
        self.spark, self.root = spark, Path(root)
        self.library, self.networks, self.snapshots, self.exports = (self.root / n for n in ("library", "networks", "snapshots", "exports"))

    @classmethod
    def init(cls, spark: SparkSession, root: str | Path, name: str | None = None) -> Workspace:
        ws = cls(spark, root)
        if (ws.root / "workspace.json").exists():
            raise WorkspaceExists(f"{ws.root} is a workspace already")
        for folder in (ws.root, ws.networks, ws.snapshots, ws.exports):
            folder.mkdir(parents=True, exist_ok=True)
        (ws.root / "workspace.json").write_text(json.dumps({"name": name or ws.root.name, "schema": 1, "created_at": now().isoformat()}))
        return ws

    @classmethod
    def open(cls, spark: SparkSession, root: str | Path) -> Workspace:
        if not (Path(root) / "workspace.json").exists():
            raise WorkspaceNotFound(f"{root} is not a workspace")
        return cls(spark, root)

    @classmethod
    def resolve(cls, spark: SparkSession, flag: str | None = None, variable: str = "CITELOOM_WORKSPACE", start: str | Path = ".") -> Workspace:
        """By argument, else environment variable, else the nearest folder upwards."""
        if flag or os.environ.get(variable):
            return cls.open(spark, flag or os.environ[variable])
        here = Path(start).resolve()
        for folder in (here, *here.parents):
            if (folder / "workspace.json").exists():
                return cls(spark, folder)
        raise WorkspaceNotFound("no workspace here or above; create one first")

    @property
    def manifest(self) -> dict:
        return json.loads((self.root / "workspace.json").read_text())

    def store(self, readonly: bool = False) -> Store:
        try:
            return Store(self.spark, self.library, readonly)
        except StoreError as e:
            raise LibraryError(str(e)) from e

    # Changing the library -------------------------------------------------------------------

    def _advance(self, store: Store, action: str) -> tuple[CycleState, int]:
        state, round_ = store.state()
        new = apply_transition(CycleState(state) if state else None, action, round_)
        store.set_state(new[0].value, new[1])
        return new

    def seed(self, papers: DataFrame) -> dict:
        """Merge, normalise and de-duplicate papers; seeding a library that has a state is a reseed."""
        with self.store() as store:
            before, known = store.papers(), store.state()[0] is not None
            n = before.count()
            merged = merging.merge(before, papers.select(*COLUMNS))
            store.replace(preprocess.normalize_and_dedup(cut(merged)))
            _, round_ = self._advance(store, "reseed" if known else "seed")
            total = store.papers().count()
        return {"papers_added": total - n, "total": total, "round": round_, "reseeded": known}

    def seed_from_bibtex(self, path: str) -> dict:
        """Seed from BibTeX files; entries that say nothing new change nothing."""
        return self.seed(bibtex.load(self.spark, path, fetched_at=now().isoformat()))

    def seed_from_equation(self, works: DataFrame, equation: search.EquationSpec) -> dict:
        """Seed with the papers of ``works`` that an equation finds, and tell what the search can't carry over."""
        told = self.preview_seed(equation)
        found = search.matches(works, equation)
        return {**self.seed(found.withColumn("is_seed", F.lit(True))), "translation": told["translation"]}

    @staticmethod
    def preview_seed(equation: search.EquationSpec) -> dict:
        """The filter that an equation becomes, without running it; one without a query is an error, not everything."""
        if not (equation.query or "").strip():
            raise DataError("the equation has no query")
        executed, notes = search.translate(equation.query, equation.native, equation.exclude, equation.min_year, equation.max_year)
        return {"preview": True, "executed_query": executed, "translation": notes}

    def preview_chain(self, direction: str = "both", limit: int | None = 300) -> dict:
        """What a chaining step is expected to bring, from the library alone."""
        with self.store(readonly=True) as store:
            return {"direction": direction, **scent.growth_estimate(store.papers(), direction, limit).first().asDict()}

    def chain(self, works: DataFrame | None = None, direction: str = "both", limit: int | None = 300, since: date | None = None, lookup: DataFrame | None = None, max_citing: int | None = MOST_CITING) -> dict:
        """Rank candidates, merge those that were fetched and grow the citing lists of the seeds, by ``max_citing``
        works for each; ``since`` looks forward only, as monitoring.  With ``lookup`` (id, doi) the DOIs of the
        references are filled in too."""
        direction = "forward" if since else direction
        with self.store() as store:
            corpus = store.papers()
            ranking = cut(scent.chain(corpus, works, direction, limit, since.isoformat() if since else None, cap=max_citing))
            ahead = ranking.where("not backward_only")
            found = scent.forward_rows(ahead, works).select(*COLUMNS) if works is not None else corpus.limit(0).select(*COLUMNS)
            known = corpus.select("id")
            new = found.select("id").distinct().join(known, "id", "left_anti").count()
            grown = corpus
            if works is not None and direction != "backward":
                grown = scent.grown_lists(corpus, works.where("id is not null"), max_citing, since=since.isoformat() if since else None)
            merged = merging.merge(grown, found)
            if lookup is not None:
                merged = enrich.references(merged, lookup)
            store.replace(preprocess.normalize_and_dedup(cut(merged)))
            _, round_ = self._advance(store, "monitor" if since else "chain")
            store.add_references(ranking.where("backward_only").select(F.col("id").alias("ref_id")), round_)
            top = [(r["id"], r["scent"]) for r in scent.ranked(ranking, 10).collect()]
        return {"new_candidates": new, "round": round_, "top": top}

    def enrich(self, works: DataFrame | None = None, lookup: DataFrame | None = None, max_citing: int | None = MOST_CITING) -> dict[str, dict]:
        """Fill in DOIs of references from ``lookup`` and citing lists of accepted seeds from ``works``; what each
        pass has resolved, of how many, is told and kept with the next snapshot."""
        passes = tuple(p for p, given in (("references", lookup), ("cited_by", works)) if given is not None)
        with self.store() as store:
            before = cut(store.papers())
            after = cut(enrich.enrich(before, works, lookup, passes, max_citing))
            told = enrich.records(before, after, lookup, passes)
            store.replace(after)
            store.set_enrichers({**store.enrichers(), **{name: {k: str(v) for k, v in params.items()} for name, params in told.items()}})
        return told

    def filter(self, **limits) -> list[filters.FilterStep]:
        with self.store() as store:
            df, steps = filters.apply_filters(store.papers(), filters.standard_criteria(**limits), now().isoformat())
            store.replace(df)
            store.set_filters(steps)
            self._advance(store, "filter")
        return steps

    def curate(self, idents: list[str], decision: str, by: str = "user", at: str | None = None) -> int:
        """Accept or reject papers named by id, DOI or source id; if one is unknown nothing changes."""
        if decision not in ("accepted", "rejected"):
            raise UsageError(f"unknown decision {decision!r}")
        with self.store() as store:
            corpus = store.papers()
            found = merging.resolve(corpus, self.spark.createDataFrame([(i,) for i in idents], "ident string")).collect()
            unknown = sorted(r["ident"] for r in found if r["id"] is None)
            if unknown:
                raise DataError(f"unknown papers: {', '.join(unknown)}")
            chosen = self.spark.createDataFrame(sorted({(r["id"], decision) for r in found}), "id string, decision string")
            store.replace(merging.curate(corpus, chosen, by, at or now().isoformat()))
        return len({r["id"] for r in found})

    def dump(self, path: str | Path, scope: str = "candidates") -> int:
        with self.store(readonly=True) as store:
            return write_curation_sheet(store.papers(), path, scope)

    def apply_sheet(self, path: str, by: str = "user", at: str | None = None) -> dict:
        with self.store() as store:
            corpus = store.papers()
            rows = cut(read_curation_sheet(corpus, path))
            decided = rows.where("decision <> 'undecided'")
            counts = {r["decision"]: r["count"] for r in rows.join(corpus.select("id"), "id").groupBy("decision").count().collect()}
            missing = rows.join(corpus.select("id"), "id", "left_anti").count()
            store.replace(merging.curate(corpus, decided, by, at or now().isoformat()))
        return {"accepted": counts.get("accepted", 0), "rejected": counts.get("rejected", 0), "undecided": counts.get("undecided", 0), "not_found": missing}

    def resolve_dois(self, lookup: DataFrame) -> None:
        with self.store() as store:
            store.replace(merging.fill_source_ids(store.papers(), lookup))

    def build(self, specs=None, scope: str = "all", thesaurus: DataFrame | None = None) -> list:
        with self.store() as store:
            if thesaurus is not None:
                store.replace(preprocess.apply_thesaurus(store.papers(), thesaurus))
            built = build_all(cut(filters.scoped(store.papers(), scope)), self.networks, specs)
            self._advance(store, "build")
        return built

    def export(self, formats: tuple[str, ...] = ("csv", "graphml")) -> list[Path]:
        """Every built network again as CSV and GraphML, from its stored edges and nodes."""
        unknown = sorted(set(formats) - {"csv", "graphml"})
        if unknown:
            raise UsageError(f"unknown format {unknown[0]!r}")
        found = sorted(self.networks.glob("*/edges.parquet"))
        if not found:
            raise DataError("no networks have been built")
        for p in found:
            edges, nodes, target = self.spark.read.parquet(str(p)), self.spark.read.parquet(str(p.parent / "nodes.parquet")), self.exports / p.parent.name
            if "csv" in formats:
                write_csv(edges, nodes, target)
            if "graphml" in formats:
                write_graphml(edges, nodes, target / "network.graphml")
        return [self.exports / p.parent.name for p in found]

    def snapshot(self, name: str) -> Snapshot:
        """The papers and what is measured of the built networks, as a round to return to or compare with."""
        if name == LIVE:
            raise UsageError(f"{LIVE!r} names the library itself")
        with self.store(readonly=True) as store:
            corpus = store.load()
            out = write_snapshot(corpus, self.snapshots / name, {"maturity": aggregates.maturity_block(corpus, "all"), "enrichers": store.enrichers()})
            if not is_stale(self.networks, corpus_hash(corpus)):
                for kind, measures in self._measures(self.networks).items():
                    folder = self.snapshots / name / "networks" / kind
                    folder.mkdir(parents=True, exist_ok=True)
                    (folder / "metrics.json").write_text(json.dumps(measures, sort_keys=True), encoding="utf-8")
        return out

    def restore(self, path: str) -> int:
        """Merge a snapshot's papers into the library."""
        with self.store() as store:
            try:
                incoming = Snapshot(self.spark, path).corpus
            except Exception as e:
                raise DataError(f"cannot restore {path}: {e}") from e
            store.replace(preprocess.normalize_and_dedup(cut(merging.merge(store.papers(), incoming))))
            state, round_ = store.state()
            store.set_state(CycleState.FILTERED.value, max(1, round_))
            return store.papers().count()

    # Reading --------------------------------------------------------------------------------

    def status(self) -> dict:
        with self.store(readonly=True) as store:
            corpus, (state, round_) = store.papers(), store.state()
            preview = [r.asDict() for r in networks.build_preview(corpus).collect()]
            ready = aggregates.readiness(corpus).first().asDict()
            digest = corpus_hash(corpus)
            counts = {r["key"]: r["n"] for r in aggregates.stats_by(corpus, "curation_status").collect()}
            waiting = store.log("referenced_but_not_fetched").count()
        return {
            "state": state, "round": round_, "counts": counts, "referenced_not_fetched": waiting, "next_best_action": next_best_action(state), "transitions": available_transitions(state),
            "ready": not all(p["would_be_empty"] for p in preview) and ready["seeds_with_source"] > 0, "preview": preview, "stale": is_stale(self.networks, digest), **ready,
        }

    def paper(self, ident: str) -> dict:
        with self.store(readonly=True) as store:
            corpus = store.papers()
            found = merging.resolve(corpus, self.spark.createDataFrame([(ident,)], "ident string")).first()
            if found["id"] is None:
                raise DataError(f"unknown paper {ident}")
            row = corpus.where(F.col("id") == found["id"]).withColumn("events", prov.parse(F.col("provenance"))).withColumn("url", paper_url(F.col("doi"), F.col("source_id"))).first()
        return row.asDict(recursive=True)

    def doi(self, doi: str) -> str | None:
        """Id of the paper with a DOI."""
        with self.store(readonly=True) as store:
            wanted = self.spark.createDataFrame([(doi,)], "d string").select(normalize_doi(F.col("d")).alias("doi"))
            row = store.papers().join(wanted, "doi").orderBy("id").select("id").first()
        return row["id"] if row else None

    def coupled(self, ident: str) -> DataFrame:
        with self.store(readonly=True) as store:
            return networks.coupled_with(networks.incidence(store.papers(), NetworkKind.COUPLING), ident)

    def url(self, ident: str) -> str | None:
        """Address of the DOI of a paper, named by its id; null where it has none."""
        with self.store(readonly=True) as store:
            row = store.papers().where(F.col("id") == ident).select(paper_url(F.col("doi"), F.lit(None).cast("string")).alias("url")).first()
        return row["url"] if row else None

    def surroundings(self, ident: str) -> DataFrame:
        """(relation, paper_id, title, weight) of the papers around one; its score is the number of coupled ones."""
        with self.store(readonly=True) as store:
            corpus = store.papers()
            if not corpus.where(F.col("id") == ident).limit(1).count():
                raise DataError(f"unknown paper {ident}")
            return reads.surroundings(corpus, ident)

    def network(self, kind: str, clustering: str | None = "louvain") -> reads.NetworkRecord:
        """A network of the library as it is now."""
        with self.store(readonly=True) as store:
            try:
                return reads.network_record(store.papers(), kind, clustering)
            except ValueError as e:
                raise DataError(str(e)) from e

    @staticmethod
    def _measures(folder: Path) -> dict[str, dict]:
        return {p.parent.name: json.loads(p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*/metrics.json"))}

    def _round(self, name: str) -> tuple[DataFrame, dict]:
        """Papers and network measures of a snapshot, or of the library (``live``)."""
        if name == LIVE:
            with self.store(readonly=True) as store:
                corpus = store.papers()
            return corpus, {} if is_stale(self.networks, corpus_hash(corpus)) else self._measures(self.networks)
        if not (self.snapshots / name / "manifest.json").exists():
            raise DataError(f"no round {name}")
        return Snapshot(self.spark, self.snapshots / name).corpus, self._measures(self.snapshots / name / "networks")

    def compare(self, older: str, newer: str) -> reads.RoundComparison:
        (a, x), (b, y) = self._round(older), self._round(newer)
        return reads.compare(a, b, x, y)

    def rounds(self) -> list[dict]:
        saved = [{"name": p.parent.name, "papers": Snapshot(self.spark, p.parent).count()} for p in sorted(self.snapshots.glob("*/manifest.json"))]
        with self.store(readonly=True) as store:
            return [*saved, {"name": LIVE, "papers": store.papers().count()}]
