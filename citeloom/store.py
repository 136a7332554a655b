"""A library on disk: versions of the paper table behind a pointer file, append-only logs, one writer.

Papers are dealt to buckets by a hash of their id.  A version is a list of bucket folders; ``persist`` writes
new folders for the buckets that its papers fall into and takes the others over from the version before, so
that its cost follows what it touches.  The pointer moves last: a reader sees the old table or the new one,
and a failed write leaves the old.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.merge import SEQ, latest_by, merge, unseen, with_sequence
from citeloom.plans.checkpoint import discard, written
from citeloom.schema import COLUMNS, CORPUS_SCHEMA, check_columns, validate

# The tables beside the papers.
LOGS = {
    "loop_state_log": "state string, round int, recorded_at timestamp",
    "referenced_but_not_fetched": "ref_id string, cycle_round int, observed_at timestamp",
    "external_ids": "paper_id string, engine string, id string, written long",
    "filter_log": "name string, criteria string, count_before long, count_after long, recorded_at timestamp",
    "enricher_log": "name string, params map<string,string>, recorded_at timestamp",
}


#: Versions of the papers that stay on disk, so that frames read before a write can still be used after it.
KEPT_VERSIONS = 5
#: Papers in a bucket of a table that is written anew, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 50_000, 4096


def _bucket(id_, buckets: int):
    return F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int")


class StoreError(RuntimeError):
    """The library is locked, missing or unreadable."""


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Store:
    def __init__(self, spark: SparkSession, path: str | Path, readonly: bool = False) -> None:
        self.spark, self.path, self.readonly = spark, Path(path), readonly
        if readonly and not (self.path / "CURRENT").exists():
            raise StoreError(f"no library at {self.path}")
        self.path.mkdir(parents=True, exist_ok=True)
        self._lock = None
        if not readonly:
            try:
                self._lock = os.open(self.path / "LOCK", os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                os.write(self._lock, str(os.getpid()).encode())
            except FileExistsError:
                raise StoreError(f"the library at {self.path} is locked by another writer") from None

    def close(self) -> None:
        if self._lock is not None:
            os.close(self._lock)
            (self.path / "LOCK").unlink(missing_ok=True)
            self._lock = None

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _version(self) -> str | None:
        pointer = self.path / "CURRENT"
        return pointer.read_text().strip() if pointer.exists() else None

    def _listed(self, version: str) -> dict | None:
        """The list of a version; None for one of the older layout, a folder of its own."""
        path = self.path / f"{version}.json"
        return json.loads(path.read_text(encoding="utf-8")) if path.exists() else None

    def _point(self, listed: dict) -> None:
        version = f"list-{uuid.uuid4().hex}"
        (self.path / f"{version}.json").write_text(json.dumps(listed), encoding="utf-8")
        old = self._version()
        temporary = self.path / f".{version}"
        temporary.write_text(version)
        os.replace(temporary, self.path / "CURRENT")
        found = sorted([*self.path.glob("list-*.json"), *self.path.glob("papers-*")], key=lambda f: f.stat().st_mtime, reverse=True)
        kept = [f for k, f in enumerate(found) if k < KEPT_VERSIONS or f.name in (old, f"{old}.json", f"{version}.json")]
        for f in found:
            if f not in kept:
                shutil.rmtree(f) if f.is_dir() else f.unlink()
        used = {folder for f in kept if f.suffix == ".json" for folder in json.loads(f.read_text(encoding="utf-8"))["buckets"].values()}
        for folder in self.path.glob("data-*/bucket=*"):
            if str(folder.relative_to(self.path)) not in used:
                shutil.rmtree(folder, ignore_errors=True)
        for folder in self.path.glob("data-*"):
            if not any(folder.glob("bucket=*")):
                shutil.rmtree(folder, ignore_errors=True)

    def _put(self, papers: DataFrame, buckets: int) -> tuple[dict[str, str], int]:
        """Write papers into bucket folders of their own; the folder of each bucket, and the last number."""
        if self.readonly:
            raise StoreError("the library is open for reading only")
        name = f"data-{uuid.uuid4().hex}"
        rows = papers.select(*COLUMNS, SEQ, _bucket(F.col("id"), buckets).alias("bucket"))
        rows.repartition(min(buckets, 200), "bucket").write.partitionBy("bucket").parquet(str(self.path / name))
        found = {f.name.removeprefix("bucket="): f"{name}/{f.name}" for f in (self.path / name).glob("bucket=*")}
        last = self._read(list(found.values())).agg(F.max(SEQ)).first()[0] if found else 0
        return found, last or 0

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], f"struct<{CORPUS_SCHEMA.simpleString()[7:-1]},{SEQ}:bigint>")
        return self.spark.read.parquet(*[str(self.path / f) for f in sorted(folders)])

    def _write(self, rows: DataFrame) -> None:
        buckets = min(MOST_BUCKETS, max(1, -(-rows.count() // BUCKET_ROWS)))
        found, last = self._put(rows, buckets)
        self._point({"n": buckets, "last": last, "buckets": found})

    def _held(self, corpus: DataFrame) -> DataFrame:
        """Papers computed once, with ``_seq``: they are counted, checked and put from their columns on disk."""
        check_columns(corpus)
        rows = written(with_sequence(corpus).select(*COLUMNS, SEQ))
        try:
            return validate(rows)
        except Exception:
            discard(rows)
            raise

    def papers(self) -> DataFrame:
        """The table with ``_seq``; a column of an older layout is renamed on reading."""
        version = self._version()
        if version is None:
            return self._read([])
        listed = self._listed(version)
        found = self._read([version] if listed is None else list(listed["buckets"].values()))
        if "openalex_id" in found.columns and "source_id" not in found.columns:
            found = found.withColumnRenamed("openalex_id", "source_id")
        return with_sequence(found).select(*COLUMNS, SEQ)

    def load(self) -> DataFrame:
        """The papers in the order of their first appearance."""
        return self.papers().orderBy(SEQ).select(*COLUMNS)

    def persist(self, corpus: DataFrame) -> None:
        """Merge papers into the table; only buckets that they fall into are read and written again."""
        version = self._version()
        listed = self._listed(version) if version else None
        new = self._held(corpus)
        if listed is None:
            rows = written(merge(self.papers(), new)) if version else new
            self._write(rows)
            if version:
                discard(rows)
        else:
            touched = {str(r["b"]) for r in new.select(_bucket(F.col("id"), listed["n"]).alias("b")).distinct().collect()}
            old = self._read([f for b, f in listed["buckets"].items() if b in touched]).select(*COLUMNS, SEQ)
            found, last = self._put(merge(old, new, listed["last"]), listed["n"])
            self._point({"n": listed["n"], "last": max(last, listed["last"]), "buckets": {**listed["buckets"], **found}})
        discard(new)

    def replace(self, corpus: DataFrame) -> None:
        """All papers are exchanged; the logs stay."""
        rows = self._held(corpus)
        self._write(rows)
        discard(rows)

    def sql(self, query: str) -> DataFrame:
        """Any SELECT over ``corpus`` and the logs."""
        self.papers().select(*COLUMNS).createOrReplaceTempView("corpus")
        for name in LOGS:
            self.log(name).createOrReplaceTempView(name)
        return self.spark.sql(query)

    # Logs -----------------------------------------------------------------------------------

    def log(self, name: str) -> DataFrame:
        folder = self.path / name
        if not folder.exists():
            return self.spark.createDataFrame([], LOGS[name])
        return self.spark.read.schema(LOGS[name]).parquet(str(folder))

    def _append(self, name: str, rows: DataFrame) -> None:
        if self.readonly:
            raise StoreError("the library is open for reading only")
        rows.write.mode("append").parquet(str(self.path / name))

    def _exchange(self, name: str, rows: list) -> None:
        if self.readonly:
            raise StoreError("the library is open for reading only")
        self.spark.createDataFrame(rows, LOGS[name]).coalesce(1).write.mode("overwrite").parquet(str(self.path / name))

    def set_state(self, state: str, round_: int, at: datetime | None = None) -> None:
        self._append("loop_state_log", self.spark.createDataFrame([(state, round_, at or now())], LOGS["loop_state_log"]))

    def state(self) -> tuple[str | None, int]:
        last = self.log("loop_state_log").agg(F.max_by(F.struct("state", "round"), "recorded_at").alias("x")).first()["x"]
        return (last["state"], last["round"]) if last else (None, 0)

    def add_references(self, refs: DataFrame, round_: int, at: datetime | None = None) -> None:
        """References (ref_id) that the log doesn't have yet."""
        new = refs.select("ref_id", F.lit(round_).alias("cycle_round"), F.lit(at or now()).alias("observed_at"))
        self._append("referenced_but_not_fetched", new.dropDuplicates(["ref_id"]).join(self.log("referenced_but_not_fetched").select("ref_id"), "ref_id", "left_anti").select("ref_id", "cycle_round", "observed_at"))

    def add_external_id(self, paper_id: str, engine: str, id_: str) -> None:
        import time

        self._append("external_ids", self.spark.createDataFrame([(paper_id, engine, id_, time.time_ns())], LOGS["external_ids"]))

    def external_ids(self, paper_id: str | None = None) -> DataFrame:
        """(paper_id, engine, id): the last id written for each paper and engine."""
        rows = self.log("external_ids")
        return latest_by(rows if paper_id is None else rows.where(F.col("paper_id") == paper_id), ["paper_id", "engine"], "written").select("paper_id", "engine", "id")

    def set_filters(self, steps: list, at: datetime | None = None) -> None:
        self._exchange("filter_log", [(s.name, s.name, s.count_before, s.count_after, at or now()) for s in steps])

    def enrichers(self) -> dict[str, dict[str, str]]:
        """What the last pass of each enrichment has recorded."""
        return {r["name"]: dict(r["params"]) for r in self.log("enricher_log").collect()}

    def set_enrichers(self, refs: dict[str, dict[str, str]], at: datetime | None = None) -> None:
        self._exchange("enricher_log", [(n, p, at or now()) for n, p in refs.items()])


#: Layout of snapshots that this version writes; older ones are read too.
SNAPSHOT_VERSION = 1


class Snapshot:
    """A folder with the papers as Parquet and a manifest; loaded when first asked for."""

    def __init__(self, spark: SparkSession, path: str | Path) -> None:
        self.spark, self.path = spark, Path(path)
        self.manifest = json.loads((self.path / "manifest.json").read_text(encoding="utf-8"))
        if self.manifest.get("schema_version", 1) > SNAPSHOT_VERSION:
            raise StoreError(f"{self.path} has layout {self.manifest['schema_version']}, newer than {SNAPSHOT_VERSION}")

    @property
    def corpus(self) -> DataFrame:
        return validate(self.spark.read.parquet(str(self.path / "corpus.parquet"))).select(*COLUMNS)

    def count(self) -> int:
        """Number of papers, from file metadata."""
        return self.spark.read.parquet(str(self.path / "corpus.parquet")).count()


def write_snapshot(corpus: DataFrame, path: str | Path, manifest: dict | None = None) -> Snapshot:
    from citeloom import __version__
    from citeloom.functions.identity import corpus_hash

    path = Path(path)
    path.mkdir(parents=True, exist_ok=True)
    corpus.select(*COLUMNS).write.mode("overwrite").parquet(str(path / "corpus.parquet"))
    written = corpus.sparkSession.read.parquet(str(path / "corpus.parquet"))  # the corpus isn't computed again for its hash
    held = {"schema_version": SNAPSHOT_VERSION, "lib_version": __version__, **(manifest or {}), "corpus_hash": corpus_hash(written), "created_at": now().isoformat()}
    (path / "manifest.json").write_text(json.dumps(held, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")
    return Snapshot(corpus.sparkSession, path)


__all__ = ["LOGS", "Snapshot", "Store", "StoreError", "unseen", "write_snapshot"]
