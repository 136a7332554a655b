"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document's set holds its distinct 5-word shingles (words lower-cased in A-Z; fewer than five words: the
whole sequence).  Two documents link when the sets' Jaccard similarity is at least ``THRESHOLD``.

1. Equal sets collapse into a class, named by a hash of the set.
2. Every class sends its prefix, the first ``n - ceil(0.75 n) + 1`` shingles in one global order, to tiles
   by shingle; linked sets share a prefix shingle, so nothing is lost.  The order puts shingles that a
   bounded sample shows to be frequent last, the most frequent very last, so that passages and lines that
   many documents hold fall out of the prefixes.  Prefixes travel as packed arrays; a shingle that a task
   sees in several classes goes on at once with a marker in the tile, so that a tile's size follows its
   different shingles and not the size of a group of near copies.
3. Prefixes are longer by ``spare(n)`` shingles than they must be, so that linked sets share that many more,
   and each class forgets as many as its smallest partner has to spare: those that most classes hold,
   counted exactly.  The least frequent one that two linked sets share is then still known to both.
4. A shingle's place in the two orders bounds the overlap from above: of two linked sets the smaller one
   holds their first common shingle in its first seventh.  Only pairs that satisfy this are ever formed.
5. Rounds of pivots: for each shingle, the classes that no chain of links joins yet are compared with a
   few pivots of it, those that hold it earliest, which are the ones with the fewest shingles of their own.
   That is linear in the index, and groups of near copies fall together in it.
6. What is still apart after the rounds meets in tiles by shingle and size band (the smaller set in its
   own band, the larger one in its own and the next smaller band), all pairs of different components.
7. Every pair, from 5 or from 6, first passes the bit counts of two hashed bitmaps, which bound its overlap
   from above, and is then decided by exact intersection of the two sorted arrays.

Pairs within one component are left out, since they change no answer; links between components are all
found.  Sets are named by 64-bit hashes of hashed shingles: two of N sets share one with probability N^2 / 2^65.

Defined results: null, empty or blank text has no shingles, links with nothing and is its own component.
Copies share a component.  Rows with a null id link like others but are never a component's smallest id; a
component of null ids only has a null ``component_id``.  Ids may repeat: each row has the component of its
own text, and nothing links by id.  Only id and text are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.components import connected_components
from citeloom.plans.checkpoint import cut, written

from .common import chained, hash_share, lean, mix64, slices, to_bytes, words_of

WORDS = 5
THRESHOLD = 0.75
#: Bounds of the sample that orders the shingles: classes, and their shingles; a shingle in COMMON_ROWS of them is frequent.
SAMPLE_ROWS, SAMPLE_SHINGLES, COMMON_ROWS = 32_768, 1 << 24, 2
#: Prefix shingles of a tile, and of a task before it sends them off.
TILE, FLUSH = 500_000, 500_000
#: A set's prefix is longer by a shingle for each SPARE shingles of the set.
SPARE = 8
#: Pivots of a shingle in a round; rounds at most before the rest is compared.
PIVOTS, ROUNDS = 4, 8
#: The rest is compared when it makes this many pairs for an entry, or when a round has joined less than this share of what was apart.
REST, GAIN = 2, 0.02
#: Most keys that are broadcast, 8 MB of them; beyond it the texts are shuffled to them.
BROADCAST_KEYS = 1 << 20


def shingle_sets(texts: list[bytes]):
    """The sorted distinct shingle hashes of each text."""
    for a, b in slices(texts):
        h, _, _, first, _ = words_of(texts[a:b], lower=True)
        grams = chained(h, WORDS)
        for i in range(b - a):
            s, e = first[i], first[i + 1]
            if e - s >= WORDS:
                yield np.unique(grams[s : e - WORDS + 1])
            else:
                yield chained(h[s:e], e - s) if e > s else np.empty(0, np.uint64)


def class_key(shingles: np.ndarray) -> int:
    """A 64-bit hash of a set: a wrapping sum, so the order doesn't matter."""
    return int((mix64(mix64(shingles) ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(shingles))).astype(np.int64))


def band(n: Column) -> Column:
    """Size band: sets that link are in the same band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(1 / THRESHOLD) + 1e-9).cast("int")


def bitmap(shingles: np.ndarray) -> bytes:
    """Hashed bitmap with two bits or more for each shingle, from 256 to 32,768 bits."""
    width = 1 << min(15, max(8, int(2 * len(shingles)).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(shingles >> np.uint64(20)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits).tobytes()


def _bits(data: bytes, width: int) -> np.ndarray:
    """A bitmap folded to ``width`` bytes: its indexes are taken modulo a smaller power of two."""
    return np.bitwise_or.reduce(np.frombuffer(data, np.uint8).reshape(-1, width), axis=0)


def overlap_bound(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """No fewer than the shingles in common: each bit set on one side only is a shingle missing on the other."""
    width = min(len(a), len(b))
    x, y = _bits(a, width), _bits(b, width)
    only_a, only_b = int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())
    return min(n_a - only_a, n_b - only_b)


def links(n_a: int, n_b: int, shared: int) -> bool:
    return 100 * shared >= 75 * (n_a + n_b - shared)


def spare(n: int) -> int:
    """How many shingles a set's prefix holds beyond what it must."""
    return n // SPARE


def prefix(shingles: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles by which a set is found, in the global order: by hash, but the sorted ``common`` ones last, by ``often``."""
    n = len(shingles)
    if not n:
        return shingles
    size = n - math.ceil(THRESHOLD * n) + 1 + spare(n)
    if len(common):
        at = np.searchsorted(common, shingles)
        at[at == len(common)] = 0
        late = common[at] == shingles
        if late.any():
            last = shingles[late][np.argsort(often[at[late]], kind="stable")]
            shingles = np.concatenate((shingles[~late], last))
    return shingles[:size]


def _sets(batches):
    """The number of shingles, the class and the bitmap of each document, for its text."""
    for batch in batches:
        found = [(len(s), class_key(s), bitmap(s)) for s in shingle_sets(to_bytes(batch.column("t")))]
        out = batch.drop_columns(["t"])
        for k, (name, kind) in enumerate((("n", pa.int64()), ("k", pa.int64()), ("bits", pa.binary()))):
            out = out.append_column(name, pa.array([f[k] for f in found], kind))
        yield out


def _common(batches):
    for batch in batches:
        values = list(shingle_sets(to_bytes(batch.column(0))))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*values, np.empty(0, np.uint64)]).view(np.int64))], ["s"])


_PACKED = "tile long, tokens binary, at binary, places binary, classes binary, sizes binary"


def _prefixes(tiles: int, common):
    """Packed entries (32 bits of a shingle, its place in the order, its class and the class's size) by tile.

    Tiles below zero hold entries of shingles that this task has seen in several classes; for those the
    shingle's own tile gets one entry and a second one of no class (size 0) that marks it as shared.
    """

    def pack(tile, tokens, at, keys, sizes, out):
        edge = np.concatenate(([0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]))
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if x == y:
                continue
            own, first, place = np.unique(keys[x:y], return_index=True, return_inverse=True)
            kind = np.uint16 if len(own) < 1 << 16 else np.uint32
            spot = np.uint16 if at[x:y].max() < 1 << 16 else np.uint32
            out.append((int(tile[x]), tokens[x:y].tobytes(), at[x:y].astype(spot).tobytes(), place.astype(kind).tobytes(), own.tobytes(), sizes[x:y][first].astype(np.int32).tobytes()))

    def send(held):
        tokens = mix64(np.concatenate([t for t, _, _ in held]))
        lengths = [len(t) for t, _, _ in held]
        keys, sizes = np.repeat(np.array([k for _, k, _ in held], np.int64), lengths), np.repeat(np.array([n for _, _, n in held], np.int64), lengths)
        at = np.concatenate([np.arange(x) for x in lengths])
        order = np.argsort(tokens, kind="stable")
        tokens, keys, sizes, at = tokens[order], keys[order], sizes[order], at[order]
        same = tokens[1:] == tokens[:-1]
        many, first = np.zeros(len(tokens), bool), np.ones(len(tokens), bool)
        many[1:] |= same
        many[:-1] |= same
        first[1:] = ~same
        tile = ((tokens >> np.uint64(32)) % np.uint64(tiles)).astype(np.int64)
        low = tokens.astype(np.uint32)
        mark = many & first
        out: list = []
        to_tile = np.concatenate((tile[first & ~many], tile[mark]))
        by_tile = np.argsort(to_tile, kind="stable")
        blank = np.zeros(int(mark.sum()), np.int64)
        pack(to_tile[by_tile], *(x[by_tile] for x in (np.concatenate((low[first & ~many], low[mark])), np.concatenate((at[first & ~many], blank)), np.concatenate((keys[first & ~many], blank)), np.concatenate((sizes[first & ~many], blank)))), out)
        if many.any():
            whole = low[many].astype(np.int64) | tile[many] << 32
            spread = -1 - zlib.crc32(whole.tobytes()) % (1 << 20)
            pack(np.full(len(whole), spread), whole, at[many], keys[many], sizes[many], out)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k == 0 else pa.binary()) for k in range(6)], ["tile", "tokens", "at", "places", "classes", "sizes"])

    def run(batches):
        held, known, size = [], set(), 0
        often, levels = common.value
        for batch in batches:
            for s in shingle_sets(to_bytes(batch.column(0))):
                key = class_key(s)
                if len(s) and key not in known:
                    known.add(key)
                    held.append((prefix(s, often, levels), key, len(s)))
                    size += len(held[-1][0])
                    if size > FLUSH:
                        yield send(held)
                        held, size = [], 0
        if held:
            yield send(held)

    return run


def _shared(group: pa.Table) -> pa.Table:
    """The entries of a tile whose shingle two classes or more have: (token, k, n, at).

    Different shingles can meet in 32 bits; that makes a pair more to check, and loses none.
    """
    parts: list[list[np.ndarray]] = [[], [], [], []]
    direct = group.column("tile")[0].as_py() < 0
    for tile, t, a, p, c, n in zip(*(group.column(k).to_pylist() for k in range(6))):
        token = np.frombuffer(t, np.int64) if direct else np.frombuffer(t, np.uint32).astype(np.int64) | tile << 32
        place = np.frombuffer(p, np.uint16 if len(p) == 2 * len(token) else np.uint32)
        at = np.frombuffer(a, np.uint16 if len(a) == 2 * len(token) else np.uint32).astype(np.int32)
        for held, x in zip(parts, (token, np.frombuffer(c, np.int64)[place], np.frombuffer(n, np.int32)[place], at)):
            held.append(x)
    token, key, n, at = (np.concatenate(x) for x in parts)
    if not direct:
        order = np.lexsort((at, key, n > 0, token))
        token, key, n, at = token[order], key[order], n[order], at[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | ((n[1:] > 0) != (n[:-1] > 0))
        token, key, n, at = token[fresh], key[fresh], n[fresh], at[fresh]
        same = token[1:] == token[:-1]
        many = np.zeros(len(token), bool)
        many[1:] |= same
        many[:-1] |= same
        many &= n > 0
        token, key, n, at = token[many], key[many], n[many], at[many]
    return pa.table({"token": token, "k": key, "n": n, "at": at})


def _sorted_sets(batches):
    """(k, s): the sorted shingles of each class from the text of one of its documents."""
    for batch in batches:
        rows = [(key, s.tobytes()) for key, s in zip(batch.column("k").to_pylist(), shingle_sets(to_bytes(batch.column("t")))) if class_key(s) == key]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], ["k", "s"])


def _bounded(batches):
    """Pairs whose bitmaps leave the link possible."""
    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in ("a_bits", "b_bits", "a_n", "b_n")}
        keep = [links(n, m, overlap_bound(x, n, y, m)) for x, y, n, m in zip(c["a_bits"], c["b_bits"], c["a_n"], c["b_n"])]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b", "a_c", "b_c"])


def _intersected(batches):
    """Pairs that link, by the exact intersection of their sorted arrays."""
    for batch in batches:
        a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(side).to_pylist()] for side in ("a_s", "b_s"))
        keep = [links(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))) for x, y in zip(a, b)]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a_c", "b_c"])


def _decided(pairs: DataFrame, signs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Checkpointed (a_c, b_c): the components of those pairs (a, b, a_c, b_c) that link."""
    both = pairs.join(signs.toDF("a", "a_n", "a_bits"), "a").join(signs.toDF("b", "b_n", "b_bits"), "b")
    possible = cut(both.mapInArrow(lean(_bounded), "a long, b long, a_c long, b_c long"))
    needed = possible.select(F.col("a").alias("k")).unionAll(possible.select(F.col("b").alias("k"))).distinct()
    needed = cut(needed.join(classes, "k").select("k", "row"))
    texts = rows.join(F.broadcast(needed) if needed.count() <= BROADCAST_KEYS else needed, "row").select("k", "t")
    sets = texts.mapInArrow(lean(_sorted_sets), "k long, s binary").dropDuplicates(["k"])
    met = possible.join(sets.toDF("a", "a_s"), "a").join(sets.toDF("b", "b_s"), "b")
    return cut(met.select("a_c", "b_c", "a_s", "b_s").mapInArrow(lean(_intersected), "a_c long, b_c long").distinct())


def _feasible(a: str, b: str) -> Column:
    """What a shingle's places leave possible: sizes, and the shingles from it on, of entries ``a`` and ``b``.

    Common shingles before it can only be forgotten ones.  Both sets forget in one order, so all of those
    that they share are among the forgotten ones of one of the two.
    """
    x, y = (F.col(f"{s}_n") for s in (a, b))
    rest = F.least(x - F.col(f"{a}_at"), y - F.col(f"{b}_at")) + F.greatest(f"{a}_lost", f"{b}_lost")
    return (4 * F.least(x, y) >= 3 * F.greatest(x, y)) & (7 * rest >= 3 * (x + y))


#: An entry in the first seventh of its set, but for the spare ones: the smaller of two linked sets holds a common shingle there.
_EARLY = f"7 * (at - floor(n / {SPARE})) <= n"


def _side(entries: DataFrame, side: str) -> DataFrame:
    return entries.select("token", *(F.col(c).alias(f"{side}{e}") for c, e in (("k", ""), ("n", "_n"), ("at", "_at"), ("lost", "_lost"), ("c", "_c"))))


def _ordered(met: DataFrame) -> DataFrame:
    """Different pairs, the smaller name first."""
    swap = F.col("a") > F.col("b")
    return met.select(*(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("a_c", "b_c"), ("b_c", "a_c")))).distinct()


def _pivot_pairs(entries: DataFrame, turn: int) -> DataFrame:
    """Pairs of an entry with the pivots of its shingle, where another component holds them."""
    drawn = entries.where(_EARLY).withColumn("draw", F.xxhash64("k", F.lit(turn)))
    pivots = drawn.groupBy("token", F.pmod("draw", F.lit(PIVOTS)).alias("bucket")).agg(F.min(F.struct("at", "draw", "k", "n", "lost", "c")).alias("p"))
    right = pivots.select("token", F.col("p.k").alias("b"), F.col("p.n").alias("b_n"), F.col("p.at").alias("b_at"), F.col("p.lost").alias("b_lost"), F.col("p.c").alias("b_c"))
    return _ordered(_side(entries, "a").join(right, "token").where((F.col("a_c") != F.col("b_c")) & _feasible("a", "b")))


def _all_pairs(entries: DataFrame) -> DataFrame:
    """All pairs of different components that a shingle leaves possible, in tiles by shingle and size band."""
    small = _side(entries.where(_EARLY), "a").withColumn("band", band(F.col("a_n")))
    large = _side(entries, "b").withColumn("band", F.explode(F.array(band(F.col("b_n")), band(F.col("b_n")) - 1)))
    order = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") < F.col("b")))
    return _ordered(small.join(large, ["token", "band"]).where((F.col("a_c") != F.col("b_c")) & order & _feasible("a", "b")))


def _rarest(entries: DataFrame) -> DataFrame:
    """Checkpointed entries without the shingles of each class that most classes hold, with how many of those came before (``lost``).

    A class of n forgets one less than ``spare(0.75 n)``, since two of its shingles may meet in 32 bits.
    """
    held = entries.groupBy("token").agg(F.count("*").alias("held"))
    of_class = Window.partitionBy("k")
    ranked = entries.join(held, "token").withColumn("rank", F.row_number().over(of_class.orderBy(F.desc("held"), "token")))
    gone = (F.col("rank") < F.floor(F.floor(F.col("n") * THRESHOLD) / SPARE)).cast("int")
    ranked = ranked.withColumn("gone", gone).withColumn("lost", F.sum("gone").over(of_class.orderBy("at", "token")).cast("int"))
    return cut(ranked.where("gone = 0").select("token", "k", "n", "at", "lost"))


def _apart(entries: DataFrame) -> DataFrame:
    """The entries of shingles that different components hold, with their number and how many pairs they make at most."""
    of_part = entries.groupBy("token", "c").agg(F.count("*").alias("all"), F.count_if(F.expr(_EARLY)).alias("early"))
    mixed = of_part.groupBy("token").agg(F.sum("all").alias("all"), F.sum("early").alias("early"), F.sum(F.col("all") * F.col("early").cast("double")).alias("own"), F.count("*").alias("parts")).where("parts > 1 and early > 0")
    return entries.join(mixed.select("token", F.col("all").alias("held"), (F.col("early") * F.col("all").cast("double") - F.col("own")).alias("pairs")), "token")


def _joined(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(k, c) after the components of ``parts`` have been joined along ``edges``."""
    merged = connected_components(edges, "a_c", "b_c").select(F.col("node").alias("c"), "component")
    return cut(parts.join(merged, "c", "left").select("k", F.coalesce("component", "c").alias("c")))


def _parts(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(k, c) for each class that shares a prefix shingle with another: the class and its component.

    ``rows`` are (row, t), ``members`` (row, n, k, bits)."""
    classes = cut(members.where("n > 0").groupBy("k").agg(F.min("row").alias("row"), F.min("n").alias("n")))
    totals = classes.agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()

    share = min(SAMPLE_ROWS / max(1, totals["c"]), SAMPLE_SHINGLES / max(1, totals["s"]))
    sample = rows.join(F.broadcast(classes.where(hash_share(F.col("k"), 41) < share).select("row")), "row").dropDuplicates(["row"]).select("t")
    often = sample.mapInArrow(lean(_common), "s long").groupBy("s").count().where(F.col("count") >= COMMON_ROWS).toArrow()
    s, count = often.column("s").to_numpy().view(np.uint64), often.column("count").to_numpy()
    order = np.argsort(s)
    common = rows.sparkSession.sparkContext.broadcast((s[order], count[order].astype(np.uint16)))

    tiles = max(1, math.ceil(totals["s"] * (1 - THRESHOLD) / TILE))
    packed = rows.select("t").mapInArrow(lean(_prefixes(tiles, common)), _PACKED)
    entries = packed.groupBy("tile").applyInArrow(_shared, "token long, k long, n int, at int")
    entries = _rarest(cut(entries.groupBy("token", "k").agg(F.min("n").alias("n"), F.min("at").alias("at"))))
    parts = cut(entries.select("k").distinct().withColumn("c", F.col("k")))
    signs = members.select("k", "n", "bits").dropDuplicates(["k"]).join(parts.select("k"), "k")
    signs = cut(signs.select("k", F.col("n").cast("int").alias("n"), "bits"))

    gain = 1.0
    for turn in range(ROUNDS + 1):
        entries = cut(_apart(entries.select("token", "k", "n", "at", "lost").join(parts, "k")))
        rest = entries.agg(F.count("*").alias("all"), F.coalesce(F.sum(F.col("pairs") / F.col("held")), F.lit(0.0)).alias("pairs"), F.count_distinct("c").alias("parts")).first()
        if not rest["all"]:
            break
        last = turn == ROUNDS or gain < GAIN or rest["pairs"] <= REST * rest["all"]
        edges = _decided(_all_pairs(entries) if last else _pivot_pairs(entries, turn), signs, rows, classes)
        parts = _joined(parts, edges)
        if last:
            break
        gain = edges.count() / rest["parts"]
    return parts


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_row: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document: the smallest id reachable by links.

    With ``keep_row`` also ``row``, a hash of id and text, and ``part``, a name of the component (null without shingles).
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), F.xxhash64(doc_id, text).alias("row"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    members = written(rows.mapInArrow(lean(_sets), f"doc_id {id_type}, row long, n long, k long, bits binary"))
    smallest = members.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("rep"))
    placed = cut(smallest.join(_parts(rows.select("row", "t"), members), "k", "left").select("k", "rep", F.coalesce("c", "k").alias("c")))
    named = placed.join(placed.groupBy("c").agg(F.min("rep").alias("component")), "c").select("k", "c", "component")
    out = members.select("doc_id", "row", "n", "k").join(named, "k", "left")
    linked = F.col("n") > 0
    extra = [F.col("row"), F.when(linked, F.col("c")).alias("part")] if keep_row else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), *extra)


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with its smallest id stays.

    A row with a null id stays only where its component has no other; of rows with the same id, the one
    with the smallest hash of id and text; of rows equal in id and text, one.  Rows without shingles all
    stay.  All columns are kept.
    """
    found = cut(components(docs, text, doc_id, keep_row=True).where("part is not null").select("doc_id", "row", "part"))
    best = found.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x"))
    chosen = found.select("doc_id", "row", "part").join(best.select("part", F.col("x.row").alias("row")), ["part", "row"]).groupBy("row").agg(F.count("*").alias("times"))
    chosen = cut(chosen)
    gone = cut(found.select("row").distinct().join(chosen, "row", "left").select("row", F.coalesce("times", F.lit(0)).alias("times")).where("times <> 1"))
    marked = docs.withColumn("_row", F.xxhash64(doc_id, text)).join(gone.select(F.col("row").alias("_row"), "times"), "_row", "left")
    kept = marked.where("times is null").drop("_row", "times")
    if gone.where("times > 1").isEmpty():
        return kept
    return kept.unionByName(marked.where("times > 1").dropDuplicates(["_row"]).drop("_row", "times"))
