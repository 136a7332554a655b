"""Language ID: multinomial naive Bayes over hashed character n-grams.

``fit`` counts the 1- to 3-grams of lower-cased training texts by language into ``BUCKETS`` hash
buckets; ``predict`` broadcasts the log-probability matrix (languages x BUCKETS floats, so its size
does not depend on the corpus) and adds up, in numpy, the rows that a batch of whole texts selects.

Defined results: a null text, an empty text or one without a letter gives ``und`` with score 0.  Without
any training row every prediction is ``und``.  Ties go to the alphabetically first language.  Repeated
rows are predicted alike; other columns pass through, except those that carry the output names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_share, lean

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Training uses at most about this many rows of each language, chosen by a hash of the id.
ROWS_PER_LANGUAGE = 4000
MAX_LANGUAGES = 1000
_CHUNK = 1 << 18


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # BUCKETS x languages, float32
    log_prior: np.ndarray


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each between spaces, as one array of code points, and the text of each."""
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in padded])
    return codes, owner


def _runs(texts: list[str], most: int = 1 << 20):
    """Runs (first, last) of consecutive texts with about ``most`` characters, which bound the arrays' size."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield first, i
            first, held = i, 0
        held += len(t) + 2
    if first < len(texts):
        yield first, len(texts)


def _grams(codes: np.ndarray, owner: np.ndarray):
    """Chunk by chunk, for each order: (bucket of each n-gram, its text, whether it stays within it)."""
    longest = ORDERS[-1] - 1
    for a in range(0, len(codes), _CHUNK):
        c, o = codes[a : a + _CHUNK + longest], owner[a : a + _CHUNK + longest]
        m = min(_CHUNK, len(codes) - a)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, longest + 2):
            size = len(c) - n + 1
            if size <= 0:
                break
            h = (h[:size] ^ c[n - 1 : n - 1 + size]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if n in ORDERS:
                k = min(m, size)
                yield (h[:k] * np.uint32(0x85EBCA6B)) >> np.uint32(18), o[:k], o[:k] == o[n - 1 : n - 1 + k]


def _count(languages: list[str]):
    index = {x: i for i, x in enumerate(languages)}

    def run(batches):
        counts = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            if not texts:
                continue
            of = np.array([index[x] for x in batch.column(1).to_pylist()])
            for a, b in _runs(texts):
                for bucket, owner, within in _grams(*_code_points(texts[a:b])):
                    cell = of[a + owner[within]] * BUCKETS + bucket[within]
                    counts += np.bincount(cell, minlength=len(counts))
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(counts[cell], pa.int64())], ["cell", "n"])

    return run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LanguageModel:
    """Learn from the rows of ``docs`` with a language: about ROWS_PER_LANGUAGE of each, whole texts.

    Only languages x BUCKETS sums reach the driver.
    """
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null")
    found = rows.groupBy("l").count().orderBy("l").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the model is a dense matrix over them")
    languages = [r["l"] for r in found]
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    share = F.coalesce(*[F.when(F.col("l") == r["l"], F.lit(ROWS_PER_LANGUAGE / r["count"])) for r in found])
    sample = rows.where(hash_share(F.col("i")) < share).select("t", "l")
    cells = sample.mapInArrow(lean(_count(languages)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(languages) * BUCKETS)
    for cell, n in cells:
        counts[cell] = n
    counts = counts.reshape(len(languages), BUCKETS) + 0.5
    log_prob = np.log(counts / counts.sum(1, keepdims=True)).T
    prior = np.array([r["count"] for r in found], float)
    return LanguageModel(languages, np.ascontiguousarray(log_prob, np.float32), np.log(prior / prior.sum()))


def _score(texts: list[str], model: LanguageModel) -> np.ndarray:
    out = np.tile(model.log_prior, (len(texts), 1))
    for a, b in _runs(texts):
        for bucket, owner, within in _grams(*_code_points(texts[a:b])):
            if len(owner):
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                part = model.log_prob[bucket]
                part[~within] = 0
                out[a + owner[first]] += np.add.reduceat(part, first, axis=0, dtype=np.float64)
    return out


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the posterior probability of that language."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = keep.index(text)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            known = np.array([bool(m.languages) and any(map(str.isalpha, t)) for t in texts], bool)
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if known.any():
                s = _score([t for t, k in zip(texts, known) if k], m)
                s -= s.max(1, keepdims=True)
                best = s.argmax(1)
                lang[known] = np.array(m.languages, object)[best]
                score[known] = 1 / np.exp(s).sum(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"]
            )

    return docs.select(*keep).mapInArrow(lean(run), schema)
