"""PII: base patterns, and bootstrapped contextual extraction of what they miss.  DataFrame functions only.

Base matches (e-mail, IPv4, payment card, phone) are the seed entities.  Identifier-like words (a digit or
``@`` in them) outside the seeds, and outside what a base rule has examined and refused, are candidates.  Both
stand in lexical patterns: the word before them, the two words before them, and the word after them.  Patterns
and instances (the strings themselves) form a bipartite graph that Spark scores iteratively: a pattern's
confidence is the sure share of all words that stand in its place in the corpus, ordinary words included,
shrunk by ``PRIOR`` virtual doubtful ones; an unseeded instance is as sure as its patterns on average.
Candidates in a pattern of high confidence with enough different seeds become ``context`` spans.

Positions of all matches come from ``split`` and ``regexp_extract_all`` by the same pattern: lengths of
pieces and matches add up to offsets, in code points.  Sums and maxima along an array go block by block
(:func:`running`), so that a text of n matches costs n to the power 1.5 pointer copies and no more.
Patterns are possessive, so that no text, however long, makes them backtrack.

Defined results: null counts as an empty text, with zero counts, no spans and the hash of the empty
string.  Rows that repeat are reported as often as they come.  Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.plans.checkpoint import cut

KINDS = ("email", "ip", "card", "phone", "context")
# The base patterns, each in a form that cannot backtrack.  ``\G`` and the lookbehinds only
# skip starts at which no leftmost match can begin.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for the pattern to be worth running.
_MAYBE = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
#: Identifier-like words: runs outside white space with a digit or @; punctuation at the end is cut off.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@](?:[^\x20\x09-\x0D]*[A-Za-z0-9])?"
#: Parameters of the model: rounds of scoring, virtual doubtful instances of a pattern, what a trusted pattern
#: needs, and the length from which a word can be an identifier (shorter ones are mostly years and amounts).
ROUNDS = 3
PRIOR = 2.0
LEAST_CONFIDENCE = 0.6
LEAST_SEEDS = 3
LEAST_SIGNS = 6
#: Patterns are broadcast to count their places up to this size in bytes; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Characters on either side that are looked at for the words around a match: a lexical pattern is that close.
REACH = 200


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def add(acc, i):
        x = F.substring(d, i + 1, 1).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


def _small(part: Column) -> Column:
    """Whether a run of digits is at most 255."""
    value = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(value) <= 3, F.coalesce(value.try_cast("int"), F.lit(0)) <= 255).otherwise(False)


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _small),
    "card": lambda m: F.when(F.length(_digits(m)).between(14, 19), _luhn(m)).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}
# What a base rule refuses for what it is: a number that looks like a card, an address or a phone and isn't one.
_REFUSED = {
    "ip": lambda m: ~_VALID["ip"](m),
    "card": lambda m: F.when(F.length(_digits(m)).between(14, 19), ~_luhn(m)).otherwise(False),
    "phone": lambda m: ~_VALID["phone"](m),
}
_SPAN = "array<struct<s:int,e:int,m:string,l:array<string>>>"
_GAP, _IN = r"[\x20\x09-\x0D]++", r"[^\x20\x09-\x0D]++"


def _let(value: Column, f) -> Column:
    """``f(value)``, the value computed once however often ``f`` uses it within lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(items: Column, value, zero: int, op) -> Column:
    """For each item ``op`` over the values (int) of those before it, from ``zero`` on.

    Blocks of about the root of the length are folded by themselves: growing one array over all items
    would copy it at every item.
    """
    none = F.array().cast("array<int>")
    state = "struct<at:int,all:array<int>>"

    def along(part: Column, first: Column, of) -> Column:
        step = lambda acc, x: F.struct(op(acc["at"], of(x)).cast("int").alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")).cast(state)
        return F.aggregate(part, F.struct(first.cast("int").alias("at"), none.alias("all")).cast(state), step)["all"]

    def blocked(a: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(a))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / size).cast("int") - 1), lambda b: F.slice(a, b * size + 1, size))
        return _let(parts, joined)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), lambda acc, x: op(acc, value(x)).cast("int")))
        firsts = along(totals, F.lit(zero), lambda x: x)
        return F.flatten(F.zip_with(blocks, firsts, lambda b, first: along(b, first, value)))

    return F.when(F.size(items) > 0, _let(items, blocked)).otherwise(none)


def _located(text: Column, pattern: str) -> Column:
    """All matches as (start, end, match, lexical patterns around it)."""

    def zipped(pieces: Column) -> Column:
        found = F.arrays_zip(pieces.alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.slice(pieces, 2, F.size(pieces)).alias("q"))
        return F.filter(found, lambda x: x["m"].isNotNull())

    def around(x: Column) -> Column:
        before, after = F.lower(F.right(x["p"], F.lit(REACH))), F.lower(F.left(x["q"], F.lit(REACH)))
        before = F.when(F.length(x["p"]) > REACH, F.regexp_replace(before, f"^{_IN}", "")).otherwise(before)  # no part of a word
        after = F.when(F.length(x["q"]) > REACH, F.regexp_replace(after, f"{_IN}$", "")).otherwise(after)
        two = F.regexp_extract(before, f"(?<![^\\x20\\x09-\\x0D])({_IN}{_GAP}{_IN}){_GAP}$", 1)
        keys = F.array(
            F.concat(F.lit("1 "), F.nullif(F.regexp_extract(before, f"(?<![^\\x20\\x09-\\x0D])({_IN}){_GAP}$", 1), F.lit(""))),
            F.concat(F.lit("2 "), F.nullif(F.regexp_replace(two, _GAP, " "), F.lit(""))),
            F.concat(F.lit("3 "), F.nullif(F.regexp_extract(after, f"^[.,;:!?)]*+{_GAP}({_IN})", 1), F.lit(""))),
        )
        return F.array_compact(keys)

    def placed(pairs: Column) -> Column:
        starts = running(pairs, lambda x: F.length(x["p"]) + F.length(x["m"]), 0, lambda a, b: a + b)
        at = lambda x, first: (first + F.length(x["p"])).cast("int")
        return F.zip_with(pairs, starts, lambda x, first: F.struct(at(x, first).alias("s"), (at(x, first) + F.length(x["m"])).alias("e"), x["m"].alias("m"), around(x).alias("l"))).cast(_SPAN)

    return _let(F.split(text, pattern, -1), lambda pieces: _let(zipped(pieces), placed))


def _outside(words: Column, base: Column) -> Column:
    """The spans of ``words`` that no span of ``base`` overlaps, by one sorted pass in each direction."""
    far = (1 << 31) - 1
    event = lambda x, k: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m"), x["l"].alias("l"))

    def kept(all_: Column) -> Column:
        ends = running(all_, lambda x: F.when(x["k"] == 0, x["e"]).otherwise(0), 0, F.greatest)
        nexts = F.reverse(running(F.reverse(all_), lambda x: F.when(x["k"] == 0, x["s"]).otherwise(far), far, F.least))
        free = F.filter(F.arrays_zip(all_.alias("x"), ends.alias("end"), nexts.alias("next")), lambda y: (y["x"]["k"] == 1) & (y["end"] <= y["x"]["s"]) & (y["next"] >= y["x"]["e"]))
        return F.transform(free, lambda y: F.struct(y["x"]["s"].alias("s"), y["x"]["e"].alias("e"), y["x"]["m"].alias("m"), y["x"]["l"].alias("l"))).cast(_SPAN)

    return _let(F.array_sort(F.concat(F.transform(base, lambda x: event(x, 0)), F.transform(words, lambda x: event(x, 1)))), kept)


def base_matches(text: Column, kind: str) -> Column:
    """All matches of a base pattern, valid or not."""
    return F.when(_MAYBE[kind](text), _located(text, PATTERNS[kind])).otherwise(F.array().cast(_SPAN))


def _of_kind(number: int, kind: str) -> Column:
    def numbered(x):
        return F.struct(x["s"].alias("s"), F.lit(number).alias("k"), x["e"].alias("e"), x["m"].alias("m"), x["l"].alias("l"))

    return F.transform(kind, numbered)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Checkpointed (doc_id, h, base, candidates): what the texts hold, before any scoring."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    for kind in PATTERNS:
        rows = rows.withColumn(kind, base_matches(F.col("t"), kind))
    for kind in PATTERNS:
        rows = rows.withColumn(f"no_{kind}", F.filter(kind, lambda x: _REFUSED[kind](x["m"])) if kind in _REFUSED else F.array().cast(_SPAN))  # noqa: B023
        rows = rows.withColumn(kind, F.filter(kind, lambda x: _VALID[kind](x["m"])))  # noqa: B023
    rows = rows.withColumn("examined", F.concat(*[f"{no}{kind}" for kind in PATTERNS for no in ("", "no_")]))
    rows = rows.withColumn("base", F.array_sort(F.concat(*[_of_kind(n, kind) for n, kind in enumerate(PATTERNS)])))
    words = F.when(F.col("t").rlike("[0-9@]"), _located(F.col("t"), CANDIDATE)).otherwise(F.array().cast(_SPAN))
    rows = rows.withColumn("words", F.filter(words, lambda w: (F.length(w["m"]) >= LEAST_SIGNS) & (F.size(w["l"]) > 0)))
    return cut(rows.select("doc_id", F.xxhash64("t").alias("h"), "base", F.when(F.size("words") > 0, _outside(F.col("words"), F.col("examined"))).otherwise(F.array().cast(_SPAN)).alias("candidates")))


def places(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, places): how many words of all ``texts`` (t) stand where each of the ``wanted`` patterns has its instance."""
    words = texts.where("t is not null").select(F.filter(F.split(F.lower("t"), _GAP), lambda w: w != "").alias("w")).where("size(w) > 1")
    n = F.size("w")
    keys = F.concat(
        F.transform(F.slice("w", 1, n - 1), lambda x: F.concat(F.lit("1 "), x)),
        F.zip_with(F.slice("w", 1, n - 2), F.slice("w", 2, n - 2), lambda x, y: F.concat(F.lit("2 "), x, F.lit(" "), y)),
        F.transform(F.slice("w", 2, n - 1), lambda x: F.concat(F.lit("3 "), x)),
    )
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("pattern") + 32), F.lit(0)).alias("b")).first()["b"]
    lookup = wanted.select("pattern")
    found = words.select(F.explode(keys).alias("pattern")).join(F.broadcast(lookup) if size <= BROADCAST_BYTES else lookup, "pattern")
    return found.groupBy("pattern").agg(F.count("*").alias("places"))


def patterns(scanned: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, confidence, seeds): the graph of patterns and instances, scored ROUNDS times.

    Only patterns with LEAST_SEEDS different seeds can be trusted; the others are left out.
    """
    def seen(column: str, seed: int) -> DataFrame:
        spans = scanned.select(F.explode(column).alias("x")).select(F.col("x.m").alias("instance"), F.explode("x.l").alias("pattern"))
        return spans.select("pattern", "instance", F.lit(seed).alias("seed"))

    edges = cut(seen("base", 1).unionByName(seen("candidates", 0)).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")))
    wanted = cut(edges.groupBy("pattern").agg(F.sum("seed").alias("seeds")).where(F.col("seeds") >= LEAST_SEEDS))
    held = cut(wanted.join(places(texts, wanted), "pattern", "left"))
    edges = cut(edges.join(wanted.select("pattern"), "pattern", "left_semi"))
    instances = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("sure"))
    scored = None
    for _ in range(ROUNDS):
        sums = edges.join(instances, "instance").groupBy("pattern").agg(F.sum(F.col("sure") * F.col("n")).alias("sure"), F.sum("n").alias("n"))
        scored = held.join(sums, "pattern").select("pattern", "seeds", (F.col("sure") / (F.greatest(F.coalesce("places", F.lit(0)), "n") + PRIOR)).alias("confidence"))
        instances = edges.join(scored, "pattern").groupBy("instance").agg(F.when(F.max("seed") == 1, 1.0).otherwise(F.avg("confidence")).alias("sure"))
    return cut(scored)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def detect(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans) for each row of ``docs``."""
    scanned = scan(docs, text, doc_id)
    trusted = patterns(scanned, docs.select(F.col(text).alias("t"))).where((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("seeds") >= LEAST_SEEDS)).select("pattern")
    spans = "struct<s:int,k:int,e:int>"
    found = (
        scanned.select("doc_id", "h", F.explode("candidates").alias("x")).select("doc_id", "h", "x", F.explode("x.l").alias("pattern")).join(trusted, "pattern")
        .groupBy("doc_id", "h").agg(F.collect_set(F.struct(F.col("x.s").alias("s"), F.lit(4).alias("k"), F.col("x.e").alias("e")).cast(spans)).alias("added"))
    )
    found = found.select(F.col("doc_id").alias("i"), F.col("h").alias("g"), "added")
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    out = scanned.select("doc_id", "h", base.alias("base")).join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{spans}>"))))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select("doc_id", *[count(k) for k in range(4)], F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_context"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))
