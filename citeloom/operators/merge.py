"""Merging, upserting and curating paper tables.

Two corpora merge by id: scalars of the incoming one win where they aren't null, lists become sorted set
unions, the later human decision keeps its status, and events are appended.  Rows keep the order of their
first appearance in ``_seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import provenance as prov
from citeloom.functions.text import DOI_URL, normalize_doi
from citeloom.schema import COLUMNS, CORPUS_SCHEMA, LIST_COLUMNS, SCALAR_COLUMNS

SEQ = "_seq"
_LISTS = "array<string>"


def merged_list(*lists: Column) -> Column:
    """Sorted set union without nulls; null only if all lists are null."""
    some = F.coalesce(*lists).isNotNull()
    empty = F.array().cast(_LISTS)
    return F.when(some, F.array_sort(F.array_compact(F.array_distinct(F.concat(*[F.coalesce(x, empty) for x in lists])))))


def with_sequence(df: DataFrame) -> DataFrame:
    """``df`` with ``_seq``, unless it has one: its rows in the order in which Spark reads them.

    Offsets are counted per partition, so that no single task sees all rows.
    """
    if SEQ in df.columns:
        return df
    from citeloom.plans.checkpoint import cut

    own = cut(df.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))  # one row a partition
    return own.join(F.broadcast(before), "_part").withColumn(SEQ, F.col("_before") + F.col("_row") - F.col("_first") + 1).drop("_part", "_row", "_n", "_first", "_before")


def fold_duplicates(batch: DataFrame) -> DataFrame:
    """One row for each id: repeats within a batch merged in the order of their appearance."""
    rows = with_sequence(batch)
    ordered = F.array_sort(F.collect_list(F.struct(SEQ, "curation_status", "provenance")))
    scalars = [F.expr(f"max_by({c}, {SEQ}) filter (where {c} is not null)").alias(c) for c in SCALAR_COLUMNS]
    lists = [F.when(F.count(c) > 0, F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_list(c)))))).alias(c) for c in LIST_COLUMNS]
    grouped = rows.groupBy("id").agg(F.min(SEQ).alias(SEQ), *scalars, *lists, ordered.alias("_h"))

    state = "struct<s:string,p:string>"

    def step(acc, x):
        a, b = prov.parse(acc["p"]), prov.parse(x["provenance"])
        status = prov.merged_status(acc["s"], x["curation_status"], a, b)
        return F.struct(status.alias("s"), prov.dump(prov.merged_events(a, b)).alias("p")).cast(state)

    first = F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("p")).cast(state)
    folded = F.when(F.size("_h") == 1, F.struct(F.get("_h", F.lit(0))["curation_status"].alias("s"), F.get("_h", F.lit(0))["provenance"].alias("p")).cast(state)).otherwise(F.aggregate("_h", first, step))
    return grouped.withColumn("_f", folded).select(*[F.col("_f.s").alias(c) if c == "curation_status" else F.col("_f.p").alias(c) if c == "provenance" else F.col(c) for c in COLUMNS], SEQ)


def merge(corpus: DataFrame, incoming: DataFrame, last: int | None = None) -> DataFrame:
    """Full outer merge by id, with ``_seq``: known papers keep theirs, new ones follow in order.

    New ones follow the ``last`` number if it is told, as for a part of a corpus, else the highest there is.
    """
    a, b = with_sequence(corpus).alias("a"), fold_duplicates(incoming).alias("b")
    both = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    if last is not None:
        both = both.withColumn("_last", F.lit(last).cast("long"))
    else:
        both = both.crossJoin(F.broadcast(with_sequence(corpus).agg(F.coalesce(F.max(SEQ), F.lit(0)).alias("_last"))))  # one row
    x, y = prov.parse(F.col("a.provenance")), prov.parse(F.col("b.provenance"))
    out = []
    for f in CORPUS_SCHEMA:
        p, q = F.col(f"a.{f.name}"), F.col(f"b.{f.name}")
        if f.name == "id":
            c = F.coalesce(p, q)
        elif f.name == "curation_status":
            c = prov.merged_status(p, q, x, y)
        elif f.name == "provenance":
            c = F.when(F.col("a.id").isNull(), q).when(F.col("b.id").isNull(), p).otherwise(prov.dump(prov.merged_events(x, y)))
        elif f.name in LIST_COLUMNS:
            c = F.when(F.col("a.id").isNull(), q).when(F.col("b.id").isNull(), p).otherwise(merged_list(p, q))
        else:
            c = F.coalesce(q, p)
        out.append(c.alias(f.name))
    return both.select(*out, F.coalesce(F.col(f"a.{SEQ}"), F.col("_last") + F.col(f"b.{SEQ}")).alias(SEQ))


def append_rows(corpus: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows put behind the others as they are."""
    a = with_sequence(corpus)
    last = a.agg(F.coalesce(F.max(SEQ), F.lit(0)).alias("_last"))
    new = with_sequence(rows).crossJoin(F.broadcast(last)).withColumn(SEQ, F.col(SEQ) + F.col("_last")).drop("_last")
    return a.select(*COLUMNS, SEQ).unionByName(new.select(*COLUMNS, SEQ))


def ordered(corpus: DataFrame) -> DataFrame:
    """The papers in the order of their first appearance."""
    return corpus.orderBy(SEQ).select(*COLUMNS)


def curate(corpus: DataFrame, decisions: DataFrame, decided_by: str, decided_at: str, source: str | None = None) -> DataFrame:
    """Set the status of the papers in ``decisions`` (id, decision) and append an event to each."""
    d = decisions.select(F.col("id").alias("_id"), F.col("decision").alias("_decision")).dropDuplicates(["_id"])
    new = prov.append(F.col("provenance"), prov.event(F.col("_decision"), decided_by=decided_by, decided_at=decided_at, source=source))
    joined = corpus.join(d, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    return joined.withColumn("curation_status", F.when(hit, F.col("_decision")).otherwise(F.col("curation_status"))).withColumn("provenance", F.when(hit, new).otherwise(F.col("provenance"))).drop("_id", "_decision")


def resolve(corpus: DataFrame, idents: DataFrame) -> DataFrame:
    """(ident, id): each identifier looked up as id, then DOI, then source id; null where unknown."""
    wanted = idents.select("ident").distinct()
    keys = corpus.select("id", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("id").alias("key")), F.struct(F.lit(1).alias("rank"), F.col("doi").alias("key")), F.struct(F.lit(2).alias("rank"), F.col("source_id").alias("key")))).alias("k")).select("id", "k.*").where("key is not null")
    as_is = wanted.withColumn("key", F.col("ident"))
    as_doi = wanted.withColumn("key", normalize_doi("ident")).where(F.col("key").isNotNull() & (F.col("key") != F.col("ident")))
    hits = as_is.join(keys, "key").unionByName(as_doi.join(keys.where("rank = 1"), "key"))
    best = hits.groupBy("ident").agg(F.min(F.struct("rank", "id")).alias("x")).select("ident", F.col("x.id").alias("id"))
    return wanted.join(best, "ident", "left")


def unseen(log: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``log`` with the rows of ``new`` whose key it doesn't hold yet."""
    return log.unionByName(new.dropDuplicates([key]).join(log.select(key), key, "left_anti").select(*log.columns))


def latest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row written for each key."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("x")).select(*keys, "x.*")


def fill_source_ids(corpus: DataFrame, lookup: DataFrame) -> DataFrame:
    """Source ids filled in from a lookup (doi, source_id) where they are null."""
    found = lookup.select(normalize_doi(F.col("doi")).alias("_doi"), F.col("source_id").alias("_sid")).where("_doi is not null").dropDuplicates(["_doi"])
    joined = corpus.join(found, normalize_doi(F.col("doi")) == F.col("_doi"), "left")
    return joined.withColumn("source_id", F.coalesce("source_id", "_sid")).drop("_doi", "_sid")


__all__ = ["DOI_URL", "SEQ", "append_rows", "curate", "fill_source_ids", "fold_duplicates", "latest_by", "merge", "merged_list", "ordered", "resolve", "unseen", "with_sequence"]
