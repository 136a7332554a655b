"""Substring dedup: an FM-index per shard, matching statistics of streamed documents by backward search.

A window is ``SIZE`` consecutive words of one document.  Every word is removed that a window covers whose
word sequence also starts in a document with a smaller id.

1. Each window has an anchor, the smallest hash of its 5-word runs, so equal windows have equal anchors.
   Documents send their anchors to tiles, packed, a few bytes each; tiles answer which anchors occur in
   two documents or more.  Windows with other anchors occur in one document only and need no search.
2. Documents send the segments around the anchors that are left (runs of windows with one anchor) to
   shards by anchor.  Equal segments travel once from each task, with a list of where they occur.
3. Each shard builds a compressed FM-index of its different segments and streams the documents' segments
   past it: backward search gives the matching statistics, for each word the length of the longest run
   that ends there and that another segment has too.  Where it reaches SIZE, the smallest document over the
   suffixes of the match is compared with each document that holds the segment.  Runs of duplicate windows
   become word intervals.
4. Intervals go back to their documents.

A shard's or tile's size is set by its number of entries, so their number follows the input.  An anchor in
very many documents is combined in each task before it is sent.

Defined results: null or blank text has no words; texts under SIZE words lose nothing; of equal documents
the one with the smallest id keeps its words.  Repeats within a document are kept.  Ids are integers; rows
with the same id count as one document for comparison, so that they take no words from each other; each is
reported and loses the words that its own text has in common with smaller documents.  A row without an id is
no document that others are compared with, and loses nothing.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chained, mix64, slices, to_bytes, words_of
from .fm_index import FMIndex

SIZE = 13
ANCHOR = 5
#: Anchors in a tile, and words of segments in a shard; entries that a task holds before it sends them.
TILE, SHARD, FLUSH = 1_000_000, 400_000, 1_500_000


def _anchors(h: np.ndarray) -> np.ndarray:
    """The anchor of the window that starts at each word."""
    g, n = chained(h, ANCHOR), len(h) - SIZE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    width = SIZE - ANCHOR + 1
    two = np.minimum(g[:-1], g[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    assert width == 9
    return np.minimum(eight[:n], g[8 : 8 + n])


def _codes(anchors: np.ndarray, tiles: int) -> np.ndarray:
    """Tile and 32 more bits of each anchor, as one integer."""
    x = mix64(anchors)
    return ((x >> np.uint64(32)) % np.uint64(tiles)) << np.uint64(32) | (x & np.uint64(0xFFFFFFFF))


def _windows(texts: list[bytes], tiles: int):
    """For runs of documents: (first document, word hashes, first words, start, document and code of each window)."""
    for a, b in slices(texts):
        h, _, _, first, _ = words_of(texts[a:b])
        codes = _codes(_anchors(h), tiles)
        doc = np.repeat(np.arange(b - a), np.diff(first))
        at = np.flatnonzero(doc[: len(codes)] == doc[SIZE - 1 : SIZE - 1 + len(codes)])
        yield a, h, first, at, doc[at], codes[at]


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs in which no column changes."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    change = np.zeros(len(columns[0]), bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _send_anchors(tiles: int):
    """Rows (tile, codes, places, docs): 32-bit codes and the place of each one's document in docs.

    What a task itself sees in two documents goes on as finished marks, in rows with a negative tile."""
    names = ["tile", "codes", "places", "docs"]

    def pack(codes, docs):
        order = np.argsort(codes, kind="stable")
        codes, docs = codes[order], docs[order]
        start = _edges(codes)
        size = np.diff(np.append(start, len(codes)))
        lo, hi = np.minimum.reduceat(docs, start), np.maximum.reduceat(docs, start)
        known = np.repeat(lo != hi, size)
        out = []
        if known.any():
            marked, owners = codes[known], docs[known]
            for i, part in enumerate(np.array_split(np.arange(len(marked)), max(1, len(marked) // 50_000))):
                out.append((-1 - i % tiles, marked[part].tobytes(), b"", owners[part].tobytes()))
        codes, docs = codes[start], lo
        tile = (codes >> np.uint64(32)).astype(np.int64)
        edge = np.append(_edges(tile), len(tile))
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            own, place = np.unique(docs[x:y], return_inverse=True)
            kind = np.uint16 if len(own) < 1 << 16 else np.uint32
            out.append((int(tile[x]), codes[x:y].astype(np.uint32).tobytes(), place.astype(kind).tobytes(), own.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k == 0 else pa.binary()) for k in range(4)], names)

    def run(batches):
        codes, docs, held = [], [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            for a, _, _, _, doc, code in _windows(to_bytes(batch.column(1)), tiles):
                first = _edges(doc, code)
                codes.append(code[first])
                docs.append(ids[a + doc[first]])
                held += len(first)
                if held > FLUSH:
                    yield pack(np.concatenate(codes), np.concatenate(docs))
                    codes, docs, held = [], [], 0
        if held:
            yield pack(np.concatenate(codes), np.concatenate(docs))

    return run


def _marks(group: pa.Table) -> pa.Table:
    """(doc_id, code) for every document with an anchor that another document has too."""
    codes, docs, done_codes, done_docs = [], [], [], []
    for tile, c, p, d in zip(*(group.column(k).to_pylist() for k in range(4))):
        if tile < 0:
            done_codes.append(np.frombuffer(c, np.uint64))
            done_docs.append(np.frombuffer(d, np.int64))
            continue
        code = np.frombuffer(c, np.uint32)
        place = np.frombuffer(p, np.uint16 if len(p) == 2 * len(code) else np.uint32)
        codes.append(code.astype(np.uint64) | np.uint64(tile) << np.uint64(32))
        docs.append(np.frombuffer(d, np.int64)[place])
    if codes:
        code, doc = np.concatenate(codes), np.concatenate(docs)
        order = np.argsort(code, kind="stable")
        code, doc = code[order], doc[order]
        start = _edges(code)
        many = np.repeat(np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start), np.diff(np.append(start, len(code))))
        done_codes.append(code[many])
        done_docs.append(doc[many])
    return pa.table({"doc_id": np.concatenate(done_docs), "code": np.concatenate(done_codes).view(np.int64)})


def _send_segments(tiles: int, shards: int):
    """Rows (shard, words, sizes, docs, texts, starts, times): different segments and where each occurs.

    words: 32-bit word hashes; sizes: words in each segment; times: its occurrences in docs, texts (their hashes) and starts."""

    def pack(segments):
        by_shard: dict[int, list] = {}
        for key, (shard, where) in segments.items():
            by_shard.setdefault(shard, []).append((key, where))
        rows = []
        for shard, found in by_shard.items():
            docs, own, starts = zip(*(w for _, where in found for w in where))
            rows.append((
                shard, b"".join(k for k, _ in found), np.array([len(k) // 4 for k, _ in found], np.uint32).tobytes(),
                np.array(docs, np.int64).tobytes(), np.array(own, np.int64).tobytes(), np.array(starts, np.uint32).tobytes(), np.array([len(w) for _, w in found], np.uint32).tobytes(),
            ))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.binary()) for k in range(7)], ["shard", "words", "sizes", "docs", "texts", "starts", "times"])

    def run(batches):
        segments: dict[bytes, tuple[int, list]] = {}
        held = 0
        for batch in batches:
            ids, marks, hashes = batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist()
            for a, h, first, at, doc, code in _windows(to_bytes(batch.column(1)), tiles):
                own = [np.sort(np.asarray(marks[a + i].values, np.int64)).view(np.uint64) for i in range(len(first) - 1)]
                edge = np.append(_edges(doc, code), len(code))
                words = h.astype(np.uint32)
                heads, runs_doc = edge[:-1], doc[edge[:-1]] if len(edge) > 1 else np.empty(0, np.int64)
                keep = np.zeros(len(heads), bool)
                bounds = np.searchsorted(runs_doc, np.arange(len(own) + 1))
                for i, m in enumerate(own):
                    x, y = bounds[i], bounds[i + 1]
                    if len(m) and y > x:
                        c = code[heads[x:y]]
                        k = np.searchsorted(m, c)
                        k[k == len(m)] = 0
                        keep[x:y] = m[k] == c
                shard = (mix64(code[heads]) % np.uint64(shards)).astype(np.int64) if len(heads) else heads
                lo, hi = at[heads], at[edge[1:] - 1] + SIZE
                for r in np.flatnonzero(keep).tolist():
                    d = int(runs_doc[r])
                    key = words[lo[r] : hi[r]].tobytes()
                    if key in segments:
                        segments[key][1].append((ids[a + d], hashes[a + d], int(lo[r] - first[d])))
                        held += 5
                    else:
                        segments[key] = (int(shard[r]), [(ids[a + d], hashes[a + d], int(lo[r] - first[d]))])
                        held += len(key) // 4
                if held > FLUSH:
                    yield pack(segments)
                    segments, held = {}, 0
        if segments:
            yield pack(segments)

    return run


def _search(group: pa.Table) -> pa.Table:
    """(doc_id, h, first, last): word intervals that windows of smaller documents cover."""
    segments: dict[bytes, list] = {}
    for _, words, sizes, docs, texts, starts, times in zip(*(group.column(k).to_pylist() for k in range(7))):
        docs, texts, starts = np.frombuffer(docs, np.int64), np.frombuffer(texts, np.int64), np.frombuffer(starts, np.uint32)
        end, p = 0, 0
        for size, n in zip(np.frombuffer(sizes, np.uint32).tolist(), np.frombuffer(times, np.uint32).tolist()):
            segments.setdefault(words[4 * end : 4 * (end + size)], []).append((docs[p : p + n], texts[p : p + n], starts[p : p + n]))
            end, p = end + size, p + n
    keys = list(segments)
    size = np.array([len(k) // 4 for k in keys])
    raw = np.frombuffer(b"".join(keys), np.uint32)
    values, symbols = np.unique(raw, return_inverse=True)
    head = np.concatenate(([0], np.cumsum(size + 1)))[:-1]  # segments with a separator behind each
    text = np.zeros(len(raw) + len(keys), np.int64)
    inside = np.ones(len(text), bool)
    inside[head + size] = False
    text[inside] = symbols + 1
    where = [[np.concatenate(x) for x in zip(*segments[k])] for k in keys]
    least = np.array([d.min() for d, _, _ in where], np.int64)

    ids, by_age = np.unique(least, return_inverse=True)
    index = FMIndex(text, len(values) + 1, SIZE, np.repeat(by_age, size + 1))
    n_windows = size - SIZE + 1
    begin = np.concatenate(([0], np.cumsum(n_windows)))
    starts = np.repeat(head - begin[:-1], n_windows) + np.arange(begin[-1])
    length, lo, hi = index.matching_statistics(text, starts + SIZE - 1, SIZE)
    smallest = np.repeat(least, n_windows)  # of a window that no other segment has
    found = length >= SIZE
    at, back = np.unique(lo[found], return_inverse=True)
    ends = np.zeros(len(at), np.int64)
    ends[back] = hi[found]
    if len(at):
        edges = np.stack((at, ends), 1).ravel()
        smallest[found] = ids[np.minimum.reduceat(np.append(index.owners, index.owners[-1]), edges)[::2]][back]

    times = np.array([len(d) for d, _, _ in where])
    doc, own, start = (np.concatenate(x) for x in zip(*where))
    start = start.astype(np.int64)
    segment = np.repeat(np.arange(len(keys)), times)
    per = n_windows[segment]
    offset = np.concatenate(([0], np.cumsum(per)))
    window = np.arange(offset[-1]) - np.repeat(offset[:-1], per)
    twice = smallest[np.repeat(begin[:-1][segment], per) + window] < np.repeat(doc, per)
    occurrence = np.repeat(np.arange(len(doc)), per)
    edge = np.append(_edges(twice, occurrence), len(twice))
    runs = np.flatnonzero(twice[edge[:-1]])
    a, b = edge[:-1][runs], edge[1:][runs] - 1
    return pa.table({"doc_id": doc[occurrence[a]], "h": own[occurrence[a]], "first": start[occurrence[a]] + window[a], "last": start[occurrence[a]] + window[b] + SIZE})


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, h, first, last): intervals of words that a smaller document repeats, in the text of that hash; they can overlap."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()["b"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / (64 << 20)))
    tiles = max(1, math.ceil(size / 28 / TILE))  # a word has about 5 bytes, and a fifth of the words starts a new anchor
    shards = max(1, math.ceil(size / 8 / SHARD))
    anchors = rows.mapInArrow(_send_anchors(tiles), "tile long, codes binary, places binary, docs binary")
    marks = anchors.groupBy("tile").applyInArrow(_marks, "doc_id long, code long").groupBy("doc_id").agg(F.collect_list("code").alias("codes"))
    marked = rows.repartition(parts, "doc_id").join(marks, "doc_id").select("doc_id", "t", "codes", F.xxhash64("t").alias("h"))
    segments = marked.mapInArrow(_send_segments(tiles, shards), "shard long, words binary, sizes binary, docs binary, texts binary, starts binary, times binary")
    return segments.groupBy("shard").applyInArrow(_search, "doc_id long, h long, first long, last long")


def _kept(batches):
    for batch in batches:
        out = []
        for text, spans in zip(to_bytes(batch.column(1)), batch.column(2).to_pylist()):
            words, gone = text.split(), 0
            if spans:
                keep = np.ones(len(words), bool)
                for s in spans:
                    keep[s["first"] : s["last"]] = False
                gone = int(len(words) - keep.sum())
                words_left = [w for w, k in zip(words, keep.tolist()) if k]
            else:
                words_left = words
            kept = b" ".join(words_left)
            out.append((len(words), gone, hashlib.sha256(kept).hexdigest(), kept.decode()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for each document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    spans = repeated(docs, text, doc_id).groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    joined = rows.join(spans, ["doc_id", "h"], "left").select("doc_id", "t", "spans")
    return joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
