"""Quality by importance resampling: two hashed n-gram models, sampled by Gumbel top-k.

Words and word pairs are hashed into ``BUCKETS``.  The raw model counts them over all documents; the
target model over documents labelled as good.  A document's log importance weight is the mean log ratio of
the two models over its n-grams, times ``SHARPNESS``: the weight of a text of so many n-grams like its own.
The plain sum over all n-grams would grow with the length, and against noise of fixed scale long texts
would always be taken or always be left.  Adding Gumbel noise to the weights and taking the k largest sums
samples k documents without replacement in proportion to these weights.  The noise is a function of id and
text, so a rerun samples the same documents.

The k-th largest sum is found by counting in narrowing bins, so nothing is sorted globally; equal sums go
by the hash of id and text.

Defined results: a text without words has log weight ``EMPTY``; without target rows all weights are 0 and
sampling is uniform.  k rows are selected, and with the k-th one the rows that repeat its id and text.
Null ids are fine.  Only id and text are read, and id and label.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.plans.checkpoint import cut

from .common import chained, hash_share, slices, to_bytes, words_of

BUCKETS = 10_007
#: The target model reads about this many labelled rows at most, chosen by a hash of the id.
TARGET_ROWS = 12_000
SHARPNESS = 100.0
EMPTY = -1000.0
#: Share of the documents that the query selects.
SHARE = 0.85
_BINS, _SORTED = 512, 50_000


def _buckets(texts: list[bytes]):
    """For runs of documents: (first, bucket of each n-gram, its document)."""
    for a, b in slices(texts):
        h, _, _, first, _ = words_of(texts[a:b], lower=True)
        doc = np.repeat(np.arange(b - a), np.diff(first))
        pairs = chained(h, 2)
        same = doc[: len(pairs)] == doc[1 : 1 + len(pairs)]
        x = np.concatenate((h, pairs[same])) % np.uint64(BUCKETS)
        yield a, x.astype(np.int64), np.concatenate((doc, doc[: len(pairs)][same])), b - a


def _counts(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, bucket, _, _ in _buckets(to_bytes(batch.column(0))):
            total += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])


def _model(texts: DataFrame) -> np.ndarray:
    """Smoothed log probabilities; BUCKETS sums reach the driver."""
    counts = np.full(BUCKETS, 0.5)
    for bucket, n in texts.mapInArrow(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] += n
    return np.log(counts / counts.sum())


def log_ratio(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> np.ndarray:
    """Log probability in the target model minus log probability in the raw one, by bucket."""
    good = labels.where(F.col(label) == 1).select(F.col(doc_id).alias("i")).where("i is not null")
    share = TARGET_ROWS / max(1, good.count())
    good = good.where(hash_share(F.col("i"), 37) < share).distinct()
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    target = rows.join(F.broadcast(good), "i").select("t")
    if not target.take(1):
        return np.zeros(BUCKETS)
    return _model(target) - _model(rows.select("t"))


def weigh(docs: DataFrame, ratio: np.ndarray, text: str = "text", doc_id: str = "doc_id", seed: int = 5) -> DataFrame:
    """(doc_id, row, log_weight, noisy): the log importance weight, and the same with Gumbel noise; ``row`` hashes id and text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text, F.lit(seed)).alias("row"), F.col(text).alias("t"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = np.full(batch.num_rows, EMPTY)
            for a, bucket, doc, n in _buckets(to_bytes(batch.column("t"))):
                size = np.bincount(doc, minlength=n)
                total = np.bincount(doc, ratio[bucket], minlength=n)
                some = np.flatnonzero(size)
                out[a + some] = SHARPNESS * total[some] / size[some]
            if not ratio.any():
                out[:] = 0
            yield batch.drop_columns(["t"]).append_column("log_weight", pa.array(out, pa.float64()))

    weighed = rows.mapInArrow(run, f"doc_id {id_type}, row long, log_weight double")
    u = (hash_share(F.col("row"), seed) * (1 << 30) + 0.5) / float(1 << 30)
    return weighed.withColumn("noisy", F.col("log_weight") - F.log(-F.log(u)))


def boundary(weighed: DataFrame, k: int) -> tuple[float, int | None] | None:
    """(noisy weight, row) of the k-th document by weight downwards, then row; None if there are no more than k."""
    lo, hi, n = weighed.agg(F.min("noisy"), F.max("noisy"), F.count("*")).first()
    if k >= n:
        return None
    if k <= 0:
        return (math.inf, None)
    left = k
    while True:
        inside = weighed.where(F.col("noisy").between(lo, hi))
        width = (hi - lo) / _BINS
        if width <= 0 or inside.count() <= _SORTED or lo + width == lo:
            last = inside.orderBy(F.desc("noisy"), "row").select("noisy", "row").offset(left - 1).limit(1).first()
            return last["noisy"], last["row"]
        bin_ = F.least(F.floor((F.col("noisy") - lo) / width), F.lit(_BINS - 1)).alias("b")
        bins = inside.groupBy(bin_).agg(F.count("*").alias("n"), F.min("noisy").alias("lo"), F.max("noisy").alias("hi")).collect()
        for row in sorted(bins, key=lambda r: -r["b"]):
            if left <= row["n"]:
                lo, hi = row["lo"], row["hi"]
                break
            left -= row["n"]


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, log_weight, noisy, selected) for each document; ``share`` of them are selected."""
    weighed = cut(weigh(docs, log_ratio(docs, labels, text, doc_id), text, doc_id))
    last = boundary(weighed, round(share * weighed.count()))
    if last is None:
        return weighed.drop("row").withColumn("selected", F.lit(True))
    above = F.col("noisy") > last[0]
    if last[1] is not None:
        above = above | ((F.col("noisy") == last[0]) & (F.col("row") <= F.lit(last[1])))
    return weighed.withColumn("selected", above).drop("row")
