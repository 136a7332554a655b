"""Phrase collocations: frequent word sequences mined where their rarest word is, and scored by their weakest cut.

Texts, with A-Z in lower case, fall into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
``[^\\x20\\x09]+``; everything is counted by language.

1. Words are counted, combined in each task.  Words under ``LEAST`` occurrences are in no frequent phrase.
2. The words in a broadcast table, the most frequent ones up to ``TABLE`` entries and ``TABLE_BYTES``, are
   ordered by frequency, the others behind them by hash: of the words of a phrase the last in this order is
   its pivot.  While all frequent words fit the table, other words are breaks; beyond that they are kept, so
   that results never depend on the table.
3. Each occurrence of a word sends a fragment, the up to three words at either side as far as none is rarer
   (before it: none as rare), to a bucket by that word.  Fragments that are alike travel once from each
   task, with their number.  Fragments of a very frequent word are dealt over several buckets by their content.
4. A bucket counts the phrases of its fragments that hold their pivot: each occurrence of a phrase is in the
   one fragment of its first pivot.  Counts of words that are dealt over buckets are added up afterwards;
   of the others only frequent phrases leave the bucket.
5. Phrases meet the counts of their parts by joins on (language, phrase).

Defined results: a null text counts as empty, a null language as ``und``; repeated rows all count; without a
frequent phrase there is no row; ids and other columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.plans.checkpoint import written

from .common import hash_words, lean, mix64, slices, to_bytes

#: A phrase is frequent from so many occurrences on; words of the longest phrase; phrases reported for a language.
LEAST, LONGEST, TOP = 30, 4, 2000
#: A longer phrase with this share of a phrase's occurrences, in per cent, stands for it.
COVERS = 80
#: Entries and bytes of the broadcast table of words.
TABLE, TABLE_BYTES = 1 << 20, 32 << 20
#: Occurrences from which a word's fragments are dealt over several buckets; fragments in a bucket, and in a task before it sends them.
HOT, BUCKET, FLUSH = 500_000, 1_000_000, 800_000
#: Parts of a language that are ranked apart before the first ``TOP`` of each are ranked together.
RANKED_APART = 16

_SIDE = LONGEST - 1
_WIDTH = 2 * _SIDE + 1
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[list(_BREAKS)] = 10
_ENDS = np.zeros(256, bool)
_ENDS[list(_BREAKS)] = True


def _words(texts: list[bytes]):
    """For runs of texts: (first text; hash, start, end, text and piece of each word; folded bytes)."""
    for a, b in slices(texts):
        raw = np.frombuffer(b"\n".join(texts[a:b]), np.uint8)
        buf = _FOLD[raw]
        h, start, end = hash_words(buf)
        piece = np.cumsum(_ENDS[raw])[start] if len(raw) else start
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        yield a, h, start, end, np.searchsorted(bounds, start, "right") - 1, piece, buf.tobytes()


def _tongues(column) -> list[str]:
    return [x if x is not None else "und" for x in column.to_pylist()]


def _by_language(texts, langs):
    """The words of runs of texts, one language after the other: (language, hash, start, end, piece, bytes)."""
    for a, h, start, end, doc, piece, buf in _words(texts):
        names = langs[a : a + (int(doc[-1]) + 1 if len(doc) else 0)]
        order = {x: k for k, x in enumerate(dict.fromkeys(names))}
        of = np.array([order[x] for x in names], np.int64)[doc] if names else doc
        for lang, k in order.items():
            own = np.flatnonzero(of == k)
            if len(own):
                yield lang, h[own], start[own], end[own], piece[own], buf


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an example of each hash, which one every element has, how many have it)"""
    _, first, which, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    return first, which, times


def _count_words(batches):
    """(lang, word, n): words of a task, and with a null word their total."""
    held: dict[tuple, int] = {}

    def pack():
        langs, words = zip(*held)
        batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(words, pa.binary()), pa.array(held.values(), pa.int64())], ["lang", "word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for lang, h, start, end, _, buf in _by_language(to_bytes(batch.column(1)), _tongues(batch.column(0))):
            first, _, times = _distinct(h)
            for x, y, n in zip(start[first].tolist(), end[first].tolist(), times.tolist()):
                key = lang, buf[x:y]
                held[key] = held.get(key, 0) + n
            held[lang, None] = held.get((lang, None), 0) + len(h)
        if len(held) > FLUSH:
            yield pack()
    if held:
        yield pack()


def word_counts(texts: DataFrame) -> DataFrame:
    """Of (lang, t): (lang, word, n) for all words; the row with a null word has the language's total."""
    found = texts.mapInArrow(lean(_count_words), "lang string, word binary, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Table:
    """The most frequent words, by language and hash; place 0 is the most frequent one."""

    def __init__(self, rows: pa.Table, complete: bool):
        rows = rows.sort_by([("n", "descending"), ("lang", "ascending"), ("word", "ascending")])
        self.words = rows["word"].to_pylist()
        #: Over how many parts of the buckets the fragments of each word are dealt.
        self.spread = np.maximum(1, np.asarray(rows["n"], np.int64) // HOT)
        self.complete = complete
        self.key_of = _keyed(hash_words(np.frombuffer(b"\n".join(self.words), np.uint8))[0], rows["lang"].to_pylist())
        self.place = np.argsort(self.key_of)
        self.keys = self.key_of[self.place]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.place[at], -1)


def _keyed(h: np.ndarray, langs) -> np.ndarray:
    """Word hashes made different for each language; ``langs``: one name, or one for each word."""
    names = [langs] if isinstance(langs, str) else langs
    seeds = {x: hash_words(np.frombuffer(b"_" + x.encode().hex().encode(), np.uint8))[0][0] for x in set(names)}
    return mix64(h + np.array([seeds[x] for x in names], np.uint64))


def table_of(counts: DataFrame) -> Table:
    """The words from a power of two of occurrences on, as small a one as the bounds allow."""
    words = counts.where(F.col("word").isNotNull())
    level = (F.length(F.bin("n")) - 1).alias("level")
    sizes = words.groupBy(level).agg(F.count("*").alias("words"), F.sum(F.octet_length("word") + F.octet_length("lang")).alias("bytes")).orderBy(F.desc("level")).collect()
    held, size, least, complete = 0, 0, None, True
    for r in sizes:  # a row for each power of two
        held, size = held + r["words"], size + r["bytes"]
        if held > TABLE or size > TABLE_BYTES:
            complete = False
            break
        least = 1 << r["level"]
    return Table(words.where(F.col("n") >= least if least else F.lit(False)).select("lang", "word", "n").toArrow(), complete)


def _same_as_before(rows: np.ndarray) -> np.ndarray:
    return np.concatenate(([False], (rows[1:] == rows[:-1]).all(axis=1)))


def _combined(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of a matrix, and the sum of n over each."""
    if not len(rows):
        return rows, n
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = mix64(h * np.uint64(0xD1342543DE82EF95) + rows[:, k].astype(np.uint64) + np.uint64(k + 1))
    order = np.argsort(h, kind="stable")
    same = _same_as_before(rows[order])
    if ((h[order][1:] == h[order][:-1]) & ~same[1:]).any():  # two rows with one hash
        order = np.lexsort(rows.T)
        same = _same_as_before(rows[order])
    start = np.flatnonzero(~same)
    return rows[order[start]], np.add.reduceat(n[order], start)


def _fragments(symbol: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """A row of words for each occurrence that has a neighbour: itself in the middle, -1 where nothing is taken."""
    size = len(symbol)
    out = np.full((size, _WIDTH), -1, np.int64)
    out[:, _SIDE] = symbol
    for sign in (-1, 1):
        going = symbol >= 0
        for k in range(1, min(_SIDE, size - 1) + 1):
            near, same = np.full(size, -1, np.int64), np.zeros(size, bool)
            here, there = (slice(k, None), slice(None, -k)) if sign < 0 else (slice(None, -k), slice(k, None))
            near[here], same[here] = symbol[there], piece[there] == piece[here]
            going = going & same & (near >= 0) & (near < symbol if sign < 0 else near <= symbol)
            out[going, _SIDE + sign * k] = near[going]
    return out[(out[:, _SIDE - 1] >= 0) | (out[:, _SIDE + 1] >= 0)]


def _send(shared, buckets: int):
    """Rows (bucket, lang, words, n, others): different fragments and how often each occurs.

    words: 32-bit places in the table, and behind its end those in ``others``."""

    def pack(lang, rows, n, others):
        table = shared.value
        rows, n = _combined(rows, n)
        size = len(table.words)
        pivot = rows[:, _SIDE]
        keys = np.empty(len(rows), np.uint64)
        known = pivot < size
        keys[known] = table.key_of[pivot[known]]
        keys[~known] = pivot[~known].astype(np.uint64)
        spread = np.ones(len(rows), np.uint64)
        spread[known] = table.spread[pivot[known]].astype(np.uint64)
        content = mix64(rows.astype(np.uint64) @ (np.arange(_WIDTH, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
        bucket = (mix64(keys + content % spread) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows, n, bucket = rows[order], n[order], bucket[order]
        edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        out = []
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            part, names = rows[x:y], []
            beyond = part >= size
            if beyond.any():
                values, which = np.unique(part[beyond], return_inverse=True)
                names = [others[v] for v in values.tolist()]
                part = part.copy()
                part[beyond] = size + which
            out.append((int(bucket[x]), lang, part.astype(np.int32).tobytes(), n[x:y].tobytes(), names))
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["bucket", "lang", "words", "n", "others"])

    def run(batches):
        table = shared.value
        size = len(table.words)
        held: dict[str, list] = {}
        others: dict[str, dict] = {}
        waiting = 0

        def flush(lang):
            rows = np.concatenate(held.pop(lang))
            return pack(lang, rows, np.ones(len(rows), np.int64), others.pop(lang, {}))

        for batch in batches:
            for lang, h, start, end, piece, buf in _by_language(to_bytes(batch.column(1)), _tongues(batch.column(0))):
                first, which, _ = _distinct(h)
                keys = _keyed(h[first], lang)
                symbol = table.find(keys)
                if not table.complete:
                    new = np.flatnonzero(symbol < 0)
                    symbol[new] = size + (keys[new] >> np.uint64(2)).astype(np.int64)
                    names = others.setdefault(lang, {})
                    for v, x, y in zip(symbol[new].tolist(), start[first[new]].tolist(), end[first[new]].tolist()):
                        names[v] = buf[x:y]
                found = _fragments(symbol[which], piece)
                if len(found):
                    held.setdefault(lang, []).append(found)
                    waiting += len(found)
                if waiting > FLUSH:
                    yield from map(flush, list(held))
                    waiting = 0
        yield from map(flush, list(held))

    return run


#: Words before and behind the pivot, for each phrase of a fragment that holds it.
_SPANS = [(a, b) for a in range(LONGEST) for b in range(LONGEST - a) if a + b]


def _mine(shared, least: int):
    """Counts (lang, phrase, words, n) of the phrases in the fragments of a bucket."""

    def run(group: pa.Table) -> pa.Table:
        table = shared.value
        size = len(table.words)
        by_lang: dict[str, list] = {}
        for _, lang, words, n, others in zip(*(group.column(k).to_pylist() for k in range(5))):
            by_lang.setdefault(lang, []).append((words, n, others))
        langs, phrases, lengths, counts = [], [], [], []
        for lang, parts in by_lang.items():
            names = sorted({x for _, _, others in parts for x in others})
            place = {x: size + k for k, x in enumerate(names)}
            rows = []
            for words, _, others in parts:
                one = np.frombuffer(words, np.int32).reshape(-1, _WIDTH)
                if others:
                    own = np.array([place[x] for x in others], np.int32)
                    one = one.copy()
                    one[one >= size] = own[one[one >= size] - size]
                rows.append(one)
            rows, n = np.concatenate(rows), np.concatenate([np.frombuffer(x, np.int64) for _, x, _ in parts])
            rows, n = _combined(rows, n)
            partial = np.zeros(len(rows), bool)
            known = rows[:, _SIDE] < size
            partial[known] = table.spread[rows[known, _SIDE]] > 1
            word = lambda k: table.words[k] if k < size else names[k - size]  # noqa: B023, E731
            for length in range(2, LONGEST + 1):
                for whole in (True, False):
                    found, times = [], []
                    for a, b in _SPANS:
                        if a + b + 1 == length:
                            has = (rows[:, _SIDE - a] >= 0) & (rows[:, _SIDE + b] >= 0) & (partial != whole)
                            found.append(rows[has, _SIDE - a : _SIDE + b + 1])
                            times.append(n[has])
                    found, times = _combined(np.concatenate(found), np.concatenate(times))
                    keep = times >= (least if whole else 1)
                    for phrase, count in zip(found[keep].tolist(), times[keep].tolist()):
                        langs.append(lang)
                        phrases.append(b" ".join(map(word, phrase)))
                        lengths.append(length)
                        counts.append(count)
        return pa.table({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "words": pa.array(lengths, pa.int32()), "n": pa.array(counts, pa.int64())})

    return run


def frequent_phrases(texts: DataFrame, counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, n): phrases of two to ``LONGEST`` words with at least ``least`` occurrences.

    ``counts`` has those words, at least, that occur so often."""
    spark = texts.sparkSession
    total = counts.where(F.col("word").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shared = spark.sparkContext.broadcast(table_of(counts.where(F.col("n") >= least)))
    buckets = max(1, math.ceil(total / BUCKET))
    sent = texts.mapInArrow(lean(_send(shared, buckets)), "bucket long, lang string, words binary, n binary, others array<binary>")
    mined = sent.groupBy("bucket").applyInArrow(_mine(shared, least), "lang string, phrase string, words int, n long")
    return mined.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _part(phrase, first, last):
    return F.array_join(F.slice(phrase, first, last - first + 1), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("t"))
    counts = written(word_counts(texts).where((F.col("n") >= least) | F.col("word").isNull()))
    phrases = written(frequent_phrases(texts, counts, least))
    words = counts.where(F.col("word").isNotNull()).select("lang", F.col("word").cast("string").alias("part"), "n")
    known = words.unionByName(phrases.select("lang", F.col("phrase").alias("part"), "n"))

    split = phrases.select("lang", "phrase", F.col("n").alias("a"), "words", F.split("phrase", " ").alias("w"))
    cuts = split.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("head"), _part(F.col("w"), F.col("k") + 1, F.col("words")).alias("tail"))
    left = known.select("lang", F.col("part").alias("head"), F.col("n").alias("l"))
    right = known.select("lang", F.col("part").alias("tail"), F.col("n").alias("r"))
    scored = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"])
    scored = scored.withColumn("score", F.expr("cast(a as decimal(20,0)) * 2000000 div (l + r)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    spans = F.expr("filter(flatten(transform(sequence(1, words - 1), i -> transform(sequence(2, words - 1), m -> if(i + m - 1 <= words, array_join(slice(w, i, m), ' '), null)))), x -> x is not null)")
    inside = split.where("words > 2").select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    alone = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (exact("most") * 100 < exact("a") * COVERS))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART))).orderBy(*order)
    ahead = alone.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where(F.col("word").isNull()).select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
