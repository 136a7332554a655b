"""Line dedup: two Bloom filters, of keys seen once and of keys seen twice, leave few lines to compare.

A line's key is the line without white space at its ends, with A-Z in lower case.  A key of at least
``LEAST`` code points that stands in two documents or more keeps its lines in the document of smallest id
alone.

1. Tasks send the hashes of their keys, 32 bits each and once for each task, to segments of the hash space,
   with a mark on those that the task itself has seen in two documents.  Each segment passes what arrives,
   a batch at a time, through two Bloom filters: what the first has goes into the second as well.  The first
   filters grow with the input and never leave their segments.
2. The second filters, of keys seen twice, are broadcast: ``MOST_BITS`` bits at most, whatever the input.
   Where very many keys repeat, they let more lines through that don't, and no line is lost.
3. Only lines that pass, suspected repeats, are shuffled, to confirm by the key itself that it is in two
   documents and to find the smallest of them.  A frequent key is combined in each task first; where its lines
   meet that answer, the join is one that Spark can split.
4. The keys that each document loses go back to it.

Defined results: a null or empty text is one empty line, and stays; a text of white space has short keys and
stays.  Rows of one id count as one document, so that a key in these alone is no repeat, and lines of any of
them stay where that id is the smallest; rows without an id count as one document behind all others.  Repeats
within one document stay.  Other columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.plans.checkpoint import written

from .common import hash_spans, lean, mix64, slices, to_bytes

LEAST = 10
#: Keys in a segment, and bits of its first filter for each key.
SEGMENT, BITS = 250_000, 16
#: Bits of all second filters together: 64 MB.
MOST_BITS = 1 << 29
#: Keys that a task holds before it sends them.
FLUSH = 1_000_000
NO_ID = (1 << 63) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _key(line: bytes) -> bytes:
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _lines(texts: list[bytes]):
    """For runs of documents: (first document; document, start, end and hash of each key that is long enough; bytes)."""
    for a, b in slices(texts):
        joined = b"\n".join(texts[a:b]) + b"\n"
        buf = np.frombuffer(joined, np.uint8)
        stop = np.flatnonzero(buf == 10)
        begin = np.concatenate(([0], stop[:-1] + 1))
        solid = np.flatnonzero(~_SPACE[buf])
        lo, hi = np.searchsorted(solid, begin), np.searchsorted(solid, stop)
        some = hi > lo
        start, end = solid[lo[some]], solid[hi[some] - 1] + 1
        points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
        long = points[end] - points[start] >= LEAST
        start, end = start[long], end[long]
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        doc = np.searchsorted(bounds, start, "right") - 1
        yield a, doc, start, end, hash_spans(buf, start, end), joined


def _places(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each code in a filter."""
    x = mix64(codes.astype(np.uint64) + np.uint64(0x51ED270B))
    return (x >> np.uint64(33)) % np.uint64(bits), (x & np.uint64(0xFFFFFFFF)) % np.uint64(bits)


class Bloom:
    """A set of codes that may say yes too often, never no."""

    def __init__(self, bits: int, held: bytes | None = None):
        self.bits = bits
        self.bytes = np.zeros((bits + 7) // 8, np.uint8) if held is None else np.frombuffer(held, np.uint8)

    def add(self, codes: np.ndarray) -> None:
        for at in _places(codes, self.bits):
            np.bitwise_or.at(self.bytes, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def has(self, codes: np.ndarray) -> np.ndarray:
        found = np.ones(len(codes), bool)
        for at in _places(codes, self.bits):
            found &= (self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _coded(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    return ((h >> np.uint64(32)) % np.uint64(segments)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _send(segments: int):
    """Rows (segment, codes, twice): the codes of a task's keys, and of those it has seen in two documents."""

    def pack(h, docs):
        order = np.argsort(h, kind="stable")
        h, docs = h[order], docs[order]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        many = np.minimum.reduceat(docs, start) != np.maximum.reduceat(docs, start)
        segment, code = _coded(h[start], segments)
        order = np.argsort(segment, kind="stable")
        segment, code, many = segment[order], code[order], many[order]
        edge = np.append(np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1]))), len(segment))
        rows = [(int(segment[x]), code[x:y].tobytes(), code[x:y][many[x:y]].tobytes()) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.binary()) for k in range(3)], ["segment", "codes", "twice"])

    def run(batches):
        hashes, docs, held = [], [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            for a, doc, _, _, h, _ in _lines(to_bytes(batch.column(1))):
                if len(h):
                    hashes.append(h)
                    docs.append(ids[a + doc])
                    held += len(h)
                if held > FLUSH:
                    yield pack(np.concatenate(hashes), np.concatenate(docs))
                    hashes, docs, held = [], [], 0
        if held:
            yield pack(np.concatenate(hashes), np.concatenate(docs))

    return run


def _filter(once_bits: int, twice_bits: int):
    """(segment, filter): the codes that come a second time, of the segments that a task is dealt."""

    def run(batches):
        held: dict[int, tuple[Bloom, Bloom]] = {}
        for batch in batches:
            for segment, codes, twice in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if segment not in held:
                    held[segment] = Bloom(once_bits), Bloom(twice_bits)
                first, second = held[segment]
                codes = np.frombuffer(codes, np.uint32)
                second.add(codes[first.has(codes)])
                second.add(np.frombuffer(twice, np.uint32))
                first.add(codes)
        for segment, (_, second) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([zlib.compress(second.bytes.tobytes(), 1)], pa.binary())], ["segment", "filter"])

    return run


def _suspects(filters, twice_bits: int, segments: int):
    """(id, key) of each line whose key may stand in two documents; once for each document and run."""

    def run(batches):
        second = {}  # unpacked on demand, and held by the task
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keys, owners = [], []
            for a, doc, start, end, h, joined in _lines(to_bytes(batch.column(1))):
                segment, code = _coded(h, segments)
                order = np.argsort(segment, kind="stable")
                edge = np.append(np.flatnonzero(np.diff(segment[order], prepend=-1)), len(order))
                hit = np.zeros(len(h), bool)
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    s = int(segment[order[x]])
                    if s not in second:
                        packed = filters.value.get(s)
                        second[s] = packed and Bloom(twice_bits, zlib.decompress(packed))
                    if second[s]:
                        hit[order[x:y]] = second[s].has(code[order[x:y]])
                found = {(ids[a + d], joined[x:y].lower()) for d, x, y in zip(doc[hit].tolist(), start[hit].tolist(), end[hit].tolist())}
                for owner, key in found:
                    owners.append(owner)
                    keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(keys, pa.binary())], ["id", "key"])

    return run


def repeated(rows: DataFrame) -> DataFrame:
    """Of (id, t): (id, key) for each document that is not the first with a repeated key; key as UTF-8 bytes."""
    spark = rows.sparkSession
    breaks = F.octet_length("t") - F.octet_length(F.replace("t", F.lit("\n"))) + 1
    n = rows.agg(F.coalesce(F.sum(breaks), F.lit(0)).alias("n")).first()["n"]
    segments = max(1, -(-n // SEGMENT))
    once_bits = BITS * max(1024, min(n, SEGMENT))
    twice_bits = max(8, min(once_bits, MOST_BITS // segments))
    codes = rows.mapInArrow(lean(_send(segments)), "segment long, codes binary, twice binary")
    built = codes.repartition(segments, "segment").mapInArrow(lean(_filter(once_bits, twice_bits)), "segment long, filter binary")
    filters = spark.sparkContext.broadcast({r["segment"]: bytes(r["filter"]) for r in built.collect()})  # MOST_BITS together
    lines = written(rows.mapInArrow(lean(_suspects(filters, twice_bits, segments)), "id long, key binary"))
    first = lines.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    first = written(first.select("key", "first"))  # else the join would use the aggregate's shuffle, which can't be split
    return lines.join(first, "key").where("id <> first").select("id", "key")


def _kept(batches):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        out = []
        for text, gone in zip(to_bytes(batch.column(1)), batch.column(2).to_pylist()):
            lines = text.split(b"\n")
            gone = set(gone or ())
            left = [x for x in lines if _key(x) not in gone] if gone else lines
            kept = b"\n".join(left)
            out.append((len(lines), len(lines) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, kept_text) for each document."""
    own = F.col(doc_id).cast("long")
    rows = docs.select(F.coalesce(own, F.lit(NO_ID)).alias("id"), F.col(text).alias("t"))
    gone = repeated(rows).groupBy("id").agg(F.collect_set("key").alias("gone"))
    joined = docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(NO_ID)).alias("id"), F.col(text).alias("t")).join(gone, "id", "left").select("doc_id", "t", "gone")
    return joined.mapInArrow(lean(_kept), "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string")
