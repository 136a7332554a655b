"""Normalisation, thesaurus and fuzzy de-duplication of authors and keywords."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.text import fold_text, normalize_language, normalize_list, token_sort_ratio
from citeloom.operators.aggregates import document_frequency
from citeloom.operators.components import connected_components
from citeloom.plans.checkpoint import cut, written

AUTHOR_THRESHOLD, KEYWORD_THRESHOLD = 0.92, 0.90
#: A lookup is broadcast up to this size in bytes; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Characters of texts that are listed without one, and without two, of their characters.
MOST_LISTED, MOST_LISTED_TWICE = 64, 20


def normalize(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("authors_id", normalize_list(F.col("authors_id"))).withColumn("language", normalize_language(F.col("language")))


def thesaurus(spark: SparkSession, source: dict | str | Path) -> DataFrame:
    """(alias, canonical) from {canonical: aliases}, aliases flat or by language; the last entry wins."""
    entries = source if isinstance(source, dict) else json.loads(Path(source).read_text(encoding="utf-8"))
    lookup = {}
    for canonical, aliases in entries.items():
        groups = aliases.values() if isinstance(aliases, dict) else [aliases]
        for group in groups:
            for alias in [group] if isinstance(group, str) else group:
                lookup[fold_text(alias)] = canonical
    return spark.createDataFrame(sorted(lookup.items()), "alias string, canonical string")


def _bounded(lookup: DataFrame) -> DataFrame:
    """Broadcast a lookup whose size is measured and small; leave a large one to a shuffle join."""
    size = lookup.agg(F.coalesce(F.sum(sum((F.octet_length(c) for c in lookup.columns), F.lit(0)) + 32), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(lookup) if size <= BROADCAST_BYTES else lookup


def apply_thesaurus(corpus: DataFrame, lookup: DataFrame) -> DataFrame:
    """keywords_id from keywords_raw: canonical terms, unmatched ones normalised, distinct in order."""
    terms = corpus.select("id", F.posexplode(normalize_list(F.col("keywords_raw"))).alias("pos", "term"))
    mapped = terms.join(_bounded(lookup), F.col("term") == F.col("alias"), "left").select("id", "pos", F.coalesce("canonical", "term").alias("term"))
    lists = mapped.groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"])).alias("_kw"))
    out = corpus.join(lists, "id", "left")
    return out.withColumn("keywords_id", F.coalesce("_kw", "keywords_id")).drop("_kw")


def thesaurus_coverage(corpus: DataFrame, lookup: DataFrame) -> DataFrame:
    """One row: keywords in all, and how many of them the thesaurus knows."""
    terms = corpus.select(F.explode(normalize_list(F.col("keywords_raw"))).alias("term"))
    return terms.join(_bounded(lookup), F.col("term") == F.col("alias"), "left").agg(F.count("*").alias("total"), F.count("alias").alias("mapped"))


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda x: x != "")), " ")


def _least_common(t: float, m: Column, n: Column) -> Column:
    """Length of the common subsequence from which on texts of m and n characters are similar."""
    least = F.ceil(t * (m + n) / 2 - 1e-6).cast("int")
    return F.when(200.0 * least / (m + n) >= 100 * t, least).otherwise(least + 1)


def _near(t: float, m: Column, n: Column) -> Column:
    """Whether texts of m <= n characters that are similar are alike but for so few characters that all texts without them can be listed."""
    away = n - _least_common(t, m, n)
    return (n <= MOST_LISTED) & ((away <= 1) | ((away == 2) & (n <= MOST_LISTED_TWICE)))


def near_links(values: DataFrame, threshold: float) -> DataFrame:
    """(a, b) that join what the similar pairs among :func:`_near` lengths join, without making these pairs.

    Texts of m and n characters are similar if a text of the least common length is left of both when characters are
    taken away.  For each two lengths that occur, texts are listed with what can be left of them; all that share
    it hang on the smallest.  Rows are in proportion to the texts, however many are similar to each other.
    """
    t, m, n = threshold, F.col("m"), F.col("n")
    v = values.select("value").distinct().select("value", _sorted_tokens(F.col("value")).alias("s")).withColumn("held", F.length("s")).where(F.col("held").between(1, MOST_LISTED))
    lengths = v.select("held").distinct()
    two = lengths.select(F.col("held").alias("m")).crossJoin(lengths.select(F.col("held").alias("n"))).where("m <= n")  # lengths up to MOST_LISTED
    two = two.withColumn("least", _least_common(t, m, n)).where((F.col("least") <= m) & _near(t, m, n))
    sides = two.select("m", "n", "least", F.explode(F.array_distinct(F.array("m", "n"))).alias("held"))
    without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.length(x))))
    s, away = F.col("s"), F.col("held") - F.col("least")
    left = F.when(away == 0, F.array(s)).when(away == 1, without(s)).otherwise(F.flatten(F.transform(without(s), without)))
    listed = cut(v.join(F.broadcast(sides), "held").select("value", "m", "n", "held", F.explode(F.array_distinct(left)).alias("left")))
    met = listed.groupBy("m", "n", "left").agg(F.min("value").alias("to"), F.count("*").alias("k"), F.min("held").alias("low"), F.max("held").alias("high"))
    met = met.where((F.col("k") > 1) & (F.col("low") == m) & (F.col("high") == n)).select("m", "n", "left", "to")
    return listed.join(met, ["m", "n", "left"]).where("value <> to").select(F.col("to").alias("a"), F.col("value").alias("b"))


def similar_pairs(values: DataFrame, threshold: float, far: bool = False) -> DataFrame:
    """(a, b) with a < b: variants whose token-sort similarity reaches ``threshold`` (0 to 1); with ``far`` only those that :func:`near_links` leaves out.

    No pair is lost.  With similarity 2*LCS/(m+n) >= t, the edit distance by insertions and deletions is at
    most d = (1-t)*(m+n), where m >= r*n with r = t/(2-t).  The longer string is cut into k pieces of about
    two characters, more than d if it has so many characters.  An edit spoils at most one piece, so the shorter
    string holds k-d of them, each shifted by at most d, and at least one of any d+1.  Variants meet in blocks of
    (length, piece number, piece) on the d+1 pieces of the longer one that are rarest among all variants, so
    that a beginning that very many have in common brings nobody together while the rest tells them apart.  A
    pair is made at the first of these pieces that it has in common, and goes on to the similarity only if
    enough of all pieces are.  Values that repeat count once.  Both sides meet by a shuffle: a table of pieces is
    small in a shuffle and many times as large in memory, so it is never broadcast.
    """
    t = threshold
    ratio = t / (2 - t)
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = cut(values.select("value").distinct().repartition(parts, "value").select("value", _sorted_tokens(F.col("value")).alias("s")).withColumn("n", F.length("s")))

    def edits(of: Column) -> Column:
        return F.floor((1 - t) * of + 1e-9).cast("int")

    def pieces(n: Column) -> Column:
        """How many pieces a longer string of n characters is cut into."""
        return F.greatest(F.lit(1), F.least(n, F.greatest(edits(2 * n) + 1, F.floor(n / 2).cast("int"))))

    def bound(n: Column, k: Column, i: Column) -> Column:
        return F.floor(n * i / k).cast("int")

    def cut_up(x: Column, n: Column, k: Column) -> Column:
        """(number, start, piece) of all pieces."""
        one = lambda i: F.struct(i.alias("i"), bound(n, k, i).alias("at"), x.substr(bound(n, k, i) + 1, bound(n, k, i + 1) - bound(n, k, i)).alias("p"))
        return F.transform(F.sequence(F.lit(0), k - 1), one)

    def asked(m: Column, n: Column) -> Column:
        return (_least_common(t, m, n) <= m) & ~_near(t, m, n) if far else F.lit(True)

    longer = v.where("n > 0").where(F.exists(F.sequence(F.greatest(F.lit(1), F.floor(F.col("n") * ratio).cast("int")), F.col("n")), lambda m: asked(m, F.col("n"))))
    whole = longer.withColumn("k", pieces(F.col("n"))).withColumn("all", cut_up(F.col("s"), F.col("n"), F.col("k")))
    flat = whole.select("value", "n", F.explode("all").alias("x")).select("value", "n", "x.i", "x.at", "x.p")
    times = cut(flat.groupBy("n", "i", "p").agg(F.count("*").alias("times")))
    rare = flat.join(times.hint("merge"), ["n", "i", "p"]).groupBy("value").agg(F.array_sort(F.collect_list(F.struct("times", "i", "at", "p"))).alias("rare"))
    chosen = F.slice("rare", 1, F.least(F.col("k"), edits(2 * F.col("n")) + 1))
    index = whole.join(rare.hint("merge"), "value").select(F.col("value").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb"), "k", "all", chosen.alias("rare"))
    index = index.select("b", "sb", "nb", "k", "all", "rare", F.posexplode("rare").alias("place", "x")).select("b", "sb", "nb", "k", "all", F.slice("rare", F.lit(1), F.col("place")).alias("earlier"), "x.i", "x.p")

    # Pieces of every length that a longer partner may have are looked up on the shorter side.
    sizes = F.sequence(F.col("n"), F.greatest(F.col("n"), F.floor(F.col("n") / ratio + 1e-9).cast("int")))
    short = v.where("n > 0").select("value", "s", "n", F.explode(sizes).alias("nb")).where(asked(F.col("n"), F.col("nb"))).withColumn("k", pieces(F.col("nb"))).withColumn("d", edits(F.col("n") + F.col("nb")))
    short = short.select("value", "s", "n", "nb", "k", "d", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    at, size = bound(F.col("nb"), F.col("k"), F.col("i")), bound(F.col("nb"), F.col("k"), F.col("i") + 1) - bound(F.col("nb"), F.col("k"), F.col("i"))
    starts = F.filter(F.sequence(at - F.col("d"), at + F.col("d")), lambda x: (x >= 0) & (x + size <= F.col("n")))
    found = F.array_distinct(F.transform(starts, lambda x: F.col("s").substr(x + 1, size)))
    short = short.select(F.col("value").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na"), "nb", "i", "d", F.explode(found).alias("p"))

    def held(x: Column) -> Column:
        """Whether the shorter string has a piece, shifted by at most d."""
        first = F.greatest(F.lit(0), x["at"] - F.col("d"))
        return F.contains(F.col("sa").substr(first + 1, F.least(F.col("na"), x["at"] + F.length(x["p"]) + F.col("d")) - first), x["p"])

    met = short.repartition(parts, "nb", "i", "p").join(index.repartition(parts, "nb", "i", "p").hint("merge"), ["nb", "i", "p"]).where("a <> b and (na < nb or a < b)").where(~F.exists("earlier", held))
    likely = met.where(F.size(F.filter("all", held)) >= F.col("k") - F.col("d"))
    blank = v.where("n = 0").select("value")
    empty_pairs = blank.agg(F.min("value").alias("m")).join(blank, F.col("m") < F.col("value")).select(F.col("m").alias("a"), F.col("value").alias("b"))
    close = likely.where(_similarity("sa", "sb") >= 100 * t)
    return close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionAll(empty_pairs)


def variant_clusters(frequency: DataFrame, threshold: float, spare: str | None = None) -> DataFrame:
    """(value, canonical) for the variants that change: of each connected group of similar ones the most
    frequent, ties by value.  Values matching the pattern ``spare`` are left alone; of a value that repeats the counts are added."""
    every = frequency if spare is None else frequency.where(~F.col("value").rlike(spare))
    rows = cut(every.groupBy("value").agg(F.sum("n").alias("n")))
    links = written(similar_pairs(rows, threshold, far=True).unionAll(near_links(rows, threshold)))
    groups = connected_components(links, "a", "b", forests=True)
    held = groups.join(rows, groups["node"] == rows["value"]).select("value", "n", "component")
    best = held.groupBy("component").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("canonical"))
    return held.join(best, "component").where("value <> canonical").select("value", "canonical")


def remap(corpus: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """List elements replaced by their canonical form, distinct in order; lists that end up empty are null."""
    items = corpus.select("id", F.posexplode(column).alias("pos", "value"))
    mapped = items.join(_bounded(mapping), "value", "left").select("id", "pos", F.coalesce("canonical", "value").alias("v"))
    lists = mapped.where("v is not null").groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"])).alias("_l"))
    return corpus.join(lists, "id", "left").withColumn(column, F.col("_l")).drop("_l")


def deduplicate(corpus: DataFrame, column: str, threshold: float, spare: str | None = None) -> DataFrame:
    return remap(corpus, column, cut(variant_clusters(document_frequency(corpus, column), threshold, spare)))


def normalize_and_dedup(corpus: DataFrame, author_threshold: float = AUTHOR_THRESHOLD, keyword_threshold: float = KEYWORD_THRESHOLD, spare_ids: str | None = None) -> DataFrame:
    """The ingestion pipeline: normalise, merge author variants, merge keyword variants."""
    out = deduplicate(normalize(corpus), "authors_id", author_threshold, spare_ids)
    return deduplicate(out, "keywords_id", keyword_threshold)
