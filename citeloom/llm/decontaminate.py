"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified.

An item counts as found in a document when at least ``THRESHOLD`` of the item's distinct 5-word shingles
(words lower-cased in A-Z; fewer than five words: the whole sequence) occur in the document.

Items are partitioned by the size of their shingle set.  The bottom-s MinHash sketch of an item holds its
s smallest shingle hashes, with s set by its partition so that more than ``1 - THRESHOLD`` of the largest
item there would have to be missing for the sketch to be missed altogether: a document that contains an
item always contains a sketched shingle.  Documents stream past the index, sketch hits are candidates,
and each is verified by comparing the shingles themselves.  A document's length never enters, so short
items are found inside long documents.

The index is broadcast in blocks of about ``BLOCK_BYTES`` of distinct item text; each block is one more pass
over the documents.  No shuffle of documents.  A block is chosen by a hash, so its size varies a little, and
an item is never divided.

Defined results: items or documents without words match nothing; repeated item ids are items of their
own; a document repeated in the input is reported as often.  Only id and text are read on both sides.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chained, lean, slices, to_bytes, words_of

WORDS = 5
THRESHOLD = 0.75
#: Item text in one broadcast index; more items are searched in more blocks.
BLOCK_BYTES = 16 << 20
_BITS = 20


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes.lower changes A-Z only


def shingles(text: bytes) -> set[tuple[bytes, ...]]:
    w = _words(text)
    if len(w) < WORDS:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)}


def sketch_size(n: int, threshold: float = THRESHOLD) -> int:
    """Sketch length of the partition of sets with n shingles: sizes 1, 2-3, 4-7, and so on."""
    largest = (2 << int(math.log2(n))) - 1
    return min(n, largest - math.ceil(threshold * largest) + 1)


class Index:
    """Sketches of one block of items (id, text, how often the row occurs).

    Only texts and sketches are held; the shingles of an item are made when a candidate needs them.
    """

    def __init__(self, items: list[tuple[int, bytes, int]], threshold: float = THRESHOLD) -> None:
        self.threshold, self.items = threshold, items
        self.shingles = lru_cache(4096)(lambda k: shingles(self.items[k][1]))
        keys: dict[int, list[tuple[int, int]]] = {}
        for k, (_, text, _) in enumerate(items):
            h = words_of([text], lower=True)[0]
            if not len(h):
                continue
            width = min(WORDS, len(h))
            values = np.unique(chained(h, width))
            for v in values[: sketch_size(len(values), threshold)].tolist():
                keys.setdefault(width, []).append((v, k))
        self.by_width = {}
        for width, pairs in keys.items():
            pairs.sort()
            v = np.array([p[0] for p in pairs], np.uint64)
            seen = np.zeros(1 << _BITS, bool)
            seen[(v >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.by_width[width] = (v, np.array([p[1] for p in pairs]), seen)

    def candidates(self, texts: list[bytes]):
        """Pairs (document, item) with a common sketched shingle."""
        for a, b in slices(texts):
            h, _, _, first, _ = words_of(texts[a:b], lower=True)
            for width, (values, owners, seen) in self.by_width.items():
                grams = chained(h, width)
                at = np.flatnonzero(seen[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
                lo, hi = np.searchsorted(values, grams[at], "left"), np.searchsorted(values, grams[at], "right")
                at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
                doc = np.searchsorted(first, at, "right") - 1
                inside = at + width <= first[doc + 1]  # not across two documents
                found = {(d, int(owners[j])) for d, x, y in zip(doc[inside].tolist(), lo[inside].tolist(), hi[inside].tolist()) for j in range(x, y)}
                for d, k in sorted(found):
                    yield a + d, k

    def search(self, texts: list[bytes]):
        """(document, item id, shared shingles, item shingles) for every containment that holds."""
        last, own = -1, {}
        for d, k in self.candidates(texts):
            if d != last:
                last, own, words = d, {}, _words(texts[d])
            item, _, times = self.items[k]
            wanted = self.shingles(k)
            width = len(next(iter(wanted)))
            if width not in own:
                own[width] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
            shared = len(wanted & own[width])
            if shared >= self.threshold * len(wanted):
                for _ in range(times):
                    yield d, item, shared, len(wanted)


_HELD: list = []


def _index(shared, threshold: float) -> Index:
    """The index of a broadcast block, kept by the worker process for its next task on the same block."""
    key = (shared._path, threshold)
    if not _HELD or _HELD[0] != key:
        _HELD[:] = [key, Index(shared.value, threshold)]
    return _HELD[1]


def _blocks(items: DataFrame, block_bytes: int):
    """Broadcasts of the distinct items, each of about ``block_bytes`` of text; the driver holds one at a time."""
    wanted = items.where("t is not null").groupBy("k", "t").agg(F.count("*").alias("times"))
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, math.ceil(total / block_bytes))
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).collect()
        held = sorted(((r["k"], r["t"].encode(), r["times"]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield items.sparkSession.sparkContext.broadcast(held)


def find(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for every item found in a document."""
    wanted = items.select(F.col(item_id).cast("long").alias("k"), F.col(item_text).alias("t"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def search(shared) -> DataFrame:
        def run(batches):
            index = _index(shared, threshold)
            for batch in batches:
                ids = batch.column(0)
                found = list(index.search(to_bytes(batch.column(1))))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([f[0] for f in found], pa.int64())), *(pa.array([f[j] for f in found], pa.int64()) for j in (1, 2, 3)),
                     pa.array([f[2] / f[3] for f in found], pa.float64())],
                    ["doc_id", "item_id", "n_shared", "n_item", "containment"],
                )

        return rows.mapInArrow(lean(run), f"doc_id {id_type}, item_id long, n_shared long, n_item long, containment double")

    parts = [search(shared) for shared in _blocks(wanted, block_bytes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that contain an item.

    The filter runs inside the same pass, so no join back to the documents is needed.
    """
    keep = docs.columns
    at = keep.index(text)
    out = docs
    for shared in _blocks(items.select(F.col("item_id").cast("long").alias("k"), F.col("text").alias("t")), BLOCK_BYTES):

        def run(batches, shared=shared):
            index = _index(shared, threshold)
            for batch in batches:
                hit = {f[0] for f in index.search(to_bytes(batch.column(at)))}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(lean(run), docs.schema)
    return out
