"""Quality rules: a learned decision list over text statistics.  DataFrame functions only.

``features`` computes the statistics of a text in one row, without exploding it.  ``learn`` fits an
ordered list of conjunctions of thresholds to labelled rows by sequential covering: each rule is grown,
condition by condition, for the best gain in low-quality rows on two thirds of the rows, pruned from its
end on the rest, and kept while it is precise there; the rows it covers are then set aside.  ``verdict``
turns the list into one ordered ``CASE WHEN``.

Growing needs only label counts by binned statistics, so that is all the driver gets.

Defined results: a null text has the statistics of an empty one (all zero) and fails the base rules; ties
between conditions go to the first statistic, then the lower threshold; without labelled rows of both
kinds the list is empty and only the base rules decide.  Repeated rows get the same verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.plans.checkpoint import cut

from .common import WORD_BREAK, hash_share

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEAT_PERCENT = 20
#: Learning reads about this many labelled rows at most, chosen by a hash of the id.
TRAIN_ROWS = 12_000
BINS = 16
MOST_RULES, MOST_CONDITIONS = 12, 4
#: On the pruning rows a rule must cover this many rows and be this precise.
LEAST_COVER, LEAST_PRECISION = 4, 0.75

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The statistics that conditions compare, by name, as expressions over the raw ones.
RATIOS = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, bound once: an optimiser that inlines columns can't repeat it inside a lambda."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _windows(words: Column) -> Column:
    """A hash of each window of WINDOW words."""

    def hashes(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))

    return F.when(F.size(words) >= WINDOW, _let(words, hashes)).otherwise(F.array().cast("array<bigint>"))


def _repeats(grams: Column) -> Column:
    """Words in windows that the text has twice or more: sorted window hashes with equal neighbours mark
    the windows, and each marked start adds the words up to the next one, at most a window."""

    def marked(s):
        def twice(x, j):
            before, after = F.get(s, j - 1)["h"] == x["h"], F.get(s, j + 1)["h"] == x["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return F.array_sort(F.transform(F.filter(s, twice), lambda x: x["i"]))

    def covered(acc, p):
        return F.struct((acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).cast("int").alias("n"), (p + WINDOW).cast("int").alias("end"))

    tagged = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.aggregate(_let(tagged, marked), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), covered)["n"]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the raw statistics as long columns."""
    kept = [c for c in docs.columns if c != text and c not in (*BASE, "n_lines", "n_distinct", "n_upper", "n_bangs")]
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*kept, t.alias("__t"))
    rows = rows.withColumn("__w", F.filter(F.split("__t", WORD_BREAK), lambda w: w != ""))
    rows = rows.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("n_words", F.size("__w").cast("long"))
    rows = rows.withColumn("__g", _windows(F.col("__w")))
    again = F.size(F.array_distinct("__g")) < F.size("__g")
    return rows.select(
        *kept,
        "n_words",
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(again, _repeats(F.col("__g"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
        (F.length("__t") - F.length(F.translate("__t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length("__t") - F.length(F.replace("__t", F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(RATIOS[self.name])
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    from math import log2

    return p * (log2((p + 1e-9) / (p + n + 1e-9)) - log2((p0 + 1e-9) / (p0 + n0 + 1e-9)))


def _cover(names: list[str], cuts: dict[str, list[float]], rows: list[tuple[tuple[int, ...], int, int, int, int]]) -> list[Rule]:
    """rows: (bin of each statistic, low and high quality among growing rows, and among pruning rows)."""
    rules: list[Rule] = []

    def holds(bins, condition) -> bool:
        f, above, b = condition
        return bins[f] > b if above else bins[f] <= b

    while len(rules) < MOST_RULES:
        inside, chosen = rows, []
        while len(chosen) < MOST_CONDITIONS:
            p0, n0 = sum(r[1] for r in inside), sum(r[2] for r in inside)
            if not p0 or not n0:
                break
            best = None
            for f, name in enumerate(names):
                low, high = [0] * (len(cuts[name]) + 1), [0] * (len(cuts[name]) + 1)
                for bins, p, n, _, _ in inside:
                    low[bins[f]] += p
                    high[bins[f]] += n
                p = n = 0
                for b in range(len(cuts[name])):
                    p, n = p + low[b], n + high[b]
                    for above, x, y in ((False, p, n), (True, p0 - p, n0 - n)):
                        g = _gain(x, y, p0, n0)
                        if x >= LEAST_COVER and (best is None or g > best[0] + 1e-9):
                            best = (g, (f, above, b))
            if best is None or best[0] <= 1e-6:
                break
            chosen.append(best[1])
            inside = [r for r in inside if holds(r[0], best[1])]

        def worth(conditions) -> tuple[float, int, int]:
            hit = [r for r in rows if all(holds(r[0], c) for c in conditions)]
            p, n = sum(r[3] for r in hit), sum(r[4] for r in hit)
            return (p - n) / (p + n + 1), p, n

        while len(chosen) > 1 and worth(chosen[:-1])[0] >= worth(chosen)[0]:
            chosen = chosen[:-1]
        if not chosen:
            break
        _, p, n = worth(chosen)
        if p + n < LEAST_COVER or p < LEAST_PRECISION * (p + n):
            break
        rules.append(tuple(Condition(names[f], above, cuts[names[f]][b]) for f, above, b in chosen))
        rows = [r for r in rows if not all(holds(r[0], c) for c in chosen)]
    return rules


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> list[Rule]:
    """The rules, in order; each describes texts of low quality (label 0)."""
    y = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y is not null")
    share = TRAIN_ROWS / max(1, y.count())
    y = y.where(hash_share(F.col("i"), 29) < share).groupBy("i").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("text")).join(F.broadcast(y), "i")
    held = cut(features(rows).select("i", "y", "n_words", "n_repeat_words", *[F.expr(e).alias(f"r_{n}") for n, e in RATIOS.items()]))
    stats = held.where(~base_failed()).select("i", "y", *[F.col(f"r_{n}").alias(n) for n in RATIOS])
    names = list(RATIOS)
    shares = [k / BINS for k in range(1, BINS)] + [0.98, 0.99]
    found = stats.agg(*[F.percentile_approx(n, shares, 10_000).alias(n) for n in names]).first()
    if found[0] is None:
        return []
    cuts = {n: sorted(set(found[n])) for n in names}
    binned = [_bin(n, cuts[n]).alias(n) for n in names]
    prune = F.pmod(F.xxhash64("i", F.lit(31)), F.lit(3)) == 0
    counts = stats.select(prune.alias("prune"), "y", *binned).groupBy(*names).agg(
        F.count_if(~F.col("prune") & (F.col("y") == 0)), F.count_if(~F.col("prune") & (F.col("y") > 0)), F.count_if(F.col("prune") & (F.col("y") == 0)), F.count_if(F.col("prune") & (F.col("y") > 0))
    )
    k = len(names)
    return _cover(names, cuts, sorted((tuple(r)[:k], r[k], r[k + 1], r[k + 2], r[k + 3]) for r in counts.collect()))


def _bin(name: str, cuts: list[float]) -> Column:
    """Number of thresholds below a value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(name)))


def verdict(rules: list[Rule]) -> Column:
    """True for texts that no rule describes; over the columns of ``features``."""
    out = None
    for rule in rules:
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = F.when(both, F.lit(False)) if out is None else out.when(both, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` without the text, with statistics, ``base_failed`` and ``kept``."""
    rows = features(docs, text).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(rules))
