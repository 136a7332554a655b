"""Citation scent: ranking papers outside the corpus by their overlap with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.networks import exploded


def known_ids(corpus: DataFrame) -> DataFrame:
    """(ref): every id and source id in the corpus."""
    own = corpus.select(F.explode(F.array("id", "source_id")).alias("ref"))
    return own.where("ref is not null").distinct()


def backward_scent(corpus: DataFrame) -> DataFrame:
    """(id, scent): papers outside the corpus by the number of corpus papers that cite them."""
    refs = exploded(corpus, "references_id", "ref").where("ref is not null").distinct()
    return refs.join(known_ids(corpus), "ref", "left_anti").groupBy(F.col("ref").alias("id")).agg(F.count("*").alias("scent"))


def forward_scent(corpus: DataFrame, citing: DataFrame) -> DataFrame:
    """(id, scent): papers of ``citing`` (id, references_id) outside the corpus, by references into it.

    A reference that a list repeats counts as often as it stands there.
    """
    own = known_ids(corpus)
    refs = citing.select("id", F.explode("references_id").alias("ref"))
    hits = refs.join(own, "ref", "left_semi").groupBy("id").agg(F.count("*").alias("scent"))
    return hits.join(own, hits["id"] == own["ref"], "left_anti")


def citing_batch(works: DataFrame, targets: DataFrame, cap: int | None = None, since: str | None = None) -> DataFrame:
    """(target, citers): the works that cite each target, sorted, at most ``cap`` for each.

    ``works`` has id, references_id and, for ``since``, publication_date.
    """
    rows = works if since is None else works.where(F.col("publication_date") >= F.lit(since))
    refs = rows.select(F.col("id").alias("citer"), F.explode("references_id").alias("target")).distinct()
    hits = refs.join(targets.select("target").distinct(), "target")
    if cap is not None:
        hits = hits.withColumn("_n", F.row_number().over(Window.partitionBy("target").orderBy("citer"))).where(F.col("_n") <= cap).drop("_n")
    return hits.groupBy("target").agg(F.array_sort(F.collect_list("citer")).alias("citers"))


def forward_scores(corpus: DataFrame, works: DataFrame, since: str | None = None, cap: int | None = None) -> DataFrame:
    """(id, scent): papers outside the corpus by the number of different seeds that they cite; of each seed's
    citers the first ``cap`` by id."""
    own = known_ids(corpus)
    seeds = corpus.where("is_seed").select(F.col("id").alias("seed"), F.explode(F.array("id", "source_id")).alias("target")).where("target is not null").distinct()
    rows = works if since is None else works.where(F.col("publication_date") >= F.lit(since))
    refs = rows.select("id", F.explode("references_id").alias("target")).distinct()
    pairs = refs.join(seeds, "target").select("id", "seed").distinct()
    if cap is not None:
        pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy("id"))).where(F.col("_n") <= cap)
    hits = pairs.groupBy("id").agg(F.count("*").alias("scent"))
    return hits.join(own, hits["id"] == own["ref"], "left_anti")


def combined(*scents: DataFrame) -> DataFrame:
    out = scents[0].select("id", "scent")
    for s in scents[1:]:
        out = out.unionAll(s.select("id", "scent"))
    return out.groupBy("id").agg(F.sum("scent").alias("scent"))


def ranked(scent: DataFrame, limit: int | None = None) -> DataFrame:
    """By scent downwards, then id."""
    out = scent.orderBy(F.desc("scent"), "id")
    return out if limit is None else out.limit(limit)


def chain(corpus: DataFrame, works: DataFrame | None = None, direction: str = "both", limit: int | None = None, since: str | None = None, depth: int = 1, cap: int | None = None) -> DataFrame:
    """(id, scent, backward_only) of the best candidates in one or both directions; ``cap`` citers of a seed count."""
    if depth > 1:
        raise NotImplementedError("chaining goes one hop at a time")
    if direction not in ("backward", "forward", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    back = backward_scent(corpus) if direction != "forward" else None
    fore = forward_scores(corpus, works, since, cap) if direction != "backward" and works is not None else None
    parts = [p for p in (back, fore) if p is not None]
    if not parts:
        raise ValueError("forward chaining needs works")
    if fore is None:
        found = parts[0].withColumn("backward_only", F.lit(True))
    elif back is None:
        found = parts[0].withColumn("backward_only", F.lit(False))
    else:
        both = back.withColumn("b", F.lit(True)).unionAll(fore.select("id", "scent").withColumn("b", F.lit(False)))
        found = both.groupBy("id").agg(F.sum("scent").alias("scent"), F.bool_and("b").alias("backward_only"))
    return ranked(found, limit)


def forward_rows(ranking: DataFrame, works: DataFrame) -> DataFrame:
    """Full rows of the ranked works that were fetched, stubs titled ``[candidate:ID]`` for the rest."""
    from citeloom.schema import COLUMNS, conform

    full = conform(works)
    joined = ranking.select(F.col("id").alias("_rid"), "scent").join(full, F.col("_rid") == F.col("id"), "left")
    title = F.coalesce("title", F.concat(F.lit("[candidate:"), F.col("_rid"), F.lit("]")))
    return joined.withColumn("title", title).withColumn("id", F.col("_rid")).withColumn("is_seed", F.lit(False)).withColumn("curation_status", F.lit("candidate")).select(*COLUMNS, "scent")


def cited_by_updates(corpus: DataFrame, citers: DataFrame, cap: int | None = None, accepted_only: bool = False) -> DataFrame:
    """(id, cited_by_id) of the seeds whose citing list grows by ``citers`` (target, citers)."""
    seeds = corpus.where("is_seed and source_id is not null")
    if accepted_only:
        seeds = seeds.where("curation_status = 'accepted'")
    old = F.coalesce("cited_by_id", F.array().cast("array<string>"))
    new = F.array_sort(F.array_distinct(F.concat(old, "citers")))
    if cap is not None:
        new = F.slice(new, 1, cap)
    joined = seeds.join(citers, F.col("source_id") == F.col("target")).select("id", old.alias("old"), new.alias("cited_by_id"))
    return joined.where("old <> cited_by_id").select("id", "cited_by_id")


def grown_lists(corpus: DataFrame, works: DataFrame, cap: int | None = None, since: str | None = None) -> DataFrame:
    """The corpus after a forward step: citing lists of all seeds grown by at most ``cap`` works for each."""
    targets = corpus.where("is_seed and source_id is not null").select(F.col("source_id").alias("target"))
    grown = cited_by_updates(corpus, citing_batch(works, targets, cap, since)).select(F.col("id").alias("_i"), F.col("cited_by_id").alias("_c"))
    joined = corpus.join(grown, F.col("id") == F.col("_i"), "left")
    return joined.withColumn("cited_by_id", F.coalesce("_c", "cited_by_id")).drop("_i", "_c")


def references_doi(corpus: DataFrame, lookup: DataFrame) -> DataFrame:
    """(id, references_doi): the DOI of each reference in its place, null where the lookup has none."""
    refs = corpus.select("id", F.posexplode("references_id").alias("pos", "ref"))
    found = refs.join(lookup.select(F.col("id").alias("ref"), "doi").dropDuplicates(["ref"]), "ref", "left")
    return found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doi"))), lambda x: x["doi"]).alias("references_doi"))


def growth_estimate(corpus: DataFrame, direction: str = "both", limit: int | None = None) -> DataFrame:
    """One row: what a step is expected to bring from what the corpus knows, each direction up to ``limit``.

    (backward, forward, estimated_new, forward_requires_fetch, forward_from_cited_by, capped).  Without any
    citing list the forward part can't be told: it is 0 and has to be fetched.  A direction not asked for is null.
    """
    if direction not in ("backward", "forward", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    own = known_ids(corpus)

    def ahead(column: str) -> DataFrame:
        return exploded(corpus, column, "ref").where("coalesce(ref, '') <> ''").select("ref").distinct().join(own, "ref", "left_anti").agg(F.count("*").alias(column))

    row = corpus.agg(F.coalesce(F.bool_or(F.size("cited_by_id") > 0), F.lit(False)).alias("known"))
    if direction != "forward":
        row = row.crossJoin(ahead("references_id"))  # one row each
    if direction != "backward":
        row = row.crossJoin(ahead("cited_by_id"))
    most = lambda c: c if limit is None else F.least(c, F.lit(limit))
    nothing = F.lit(None).cast("long")
    back = F.col("references_id") if direction != "forward" else nothing
    fore = F.when(F.col("known"), F.col("cited_by_id")).otherwise(0).cast("long") if direction != "backward" else nothing
    zero = lambda c: F.coalesce(c, F.lit(0))
    local = F.col("known") & F.lit(direction != "backward")
    return row.select(
        most(back).cast("long").alias("backward"), most(fore).cast("long").alias("forward"), (zero(most(back)) + zero(most(fore))).cast("long").alias("estimated_new"),
        (~F.col("known") & F.lit(direction != "backward")).alias("forward_requires_fetch"), local.alias("forward_from_cited_by"),
        (F.lit(False) if limit is None else (zero(back) > limit) | (zero(fore) > limit)).alias("capped"),
    )


def growth_preview(corpus: DataFrame) -> DataFrame:
    """One row: how many candidates a backward and a forward step would bring, without fetching anything."""
    own = known_ids(corpus)
    back = exploded(corpus, "references_id", "ref").where("ref is not null").select("ref").distinct().join(own, "ref", "left_anti").agg(F.count("*").alias("backward"))
    fore = exploded(corpus.where("is_seed"), "cited_by_id", "ref").where("ref is not null").select("ref").distinct().join(own, "ref", "left_anti").agg(F.count("*").alias("forward"))
    state = corpus.agg(F.count_if(F.col("is_seed")).alias("seeds"), F.coalesce(F.bool_or(F.size("cited_by_id") > 0), F.lit(False)).alias("has_cited_by"))
    return back.crossJoin(fore).crossJoin(state)  # one row each
