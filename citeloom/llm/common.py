"""What several operators share: table access, samples with a documented bound, word hashing.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  ``bytes.split()`` splits at exactly
those six characters, and in UTF-8 no other character contains one of their bytes.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words, as a Java/Python character class and as bytes.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"


#: Bytes in an Arrow batch, an eighth of the default: both sides of a transfer hold a batch whole, Python several times.
_ARROW_KEY, _ARROW_BYTES, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "8m", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Arrow transfers, in a session that still has the default bound."""
    if spark.conf.get(_ARROW_KEY) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_KEY, _ARROW_BYTES)


def lean(f):
    """``f`` over batches; when its task ends, the worker gives freed memory back instead of holding it for its next task."""

    def run(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``: the fixed split of the contracts."""
    return F.crc32(doc_id.cast("string")) % folds


def hash_share(doc_id: Column, seed: int = 17) -> Column:
    """A number in [0, 1) that depends on the id only; a sample is a threshold on it."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def input_parts(spark: SparkSession, least: int = 1) -> int:
    """Number of partitions for shuffles; follows the session, which the cluster sizes to the input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------------------------------------
# Vectorised word hashing (numpy), used by the operators on shingles and windows.

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["p"]) < n:
        size = max(n, 1 << 20)
        for key, base in (("p", _R), ("q", _R_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POW[key] = np.cumprod(x, dtype=np.uint64)
    return _POW["p"][:n], _POW["q"]


def _byte_values(lower: bool) -> np.ndarray:
    values = np.random.RandomState(20240229).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    for b in SPACES:
        values[b] = 0
    return values


_VALUES = {False: _byte_values(False), True: _byte_values(True)}
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(buf: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a byte buffer: (64-bit hash, start, end), lower-casing A-Z if asked.

    The hash of a word is a polynomial in random byte values, taken from one prefix sum, so the cost
    is a few vector operations a byte whatever the words are.
    """
    n = len(buf)
    if not n:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e
    space = _IS_SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    if not space[-1]:
        edge = np.concatenate((edge, [n]))
    start, end = edge[0::2], edge[1::2]
    p, q = _powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUES[lower][buf] * p, out=total[1:])
    h = (total[end] - total[start]) * q[start]
    return mix64(h + (end - start).astype(np.uint64)), start, end


_SPAN_VALUES = np.random.RandomState(20240301).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_SPAN_VALUES[65:91] = _SPAN_VALUES[97:123]


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of a byte buffer, white space included, with A-Z as a-z."""
    p, q = _powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_SPAN_VALUES[buf] * p, out=total[1:])
    return mix64((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))


def slices(texts: list[bytes], most: int = 1 << 20):
    """Runs (first, last) of consecutive documents with about ``most`` bytes; a longer one stands alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def words_of(texts: list[bytes], lower: bool = False):
    """For documents: (hash, start, end, first word of each document and the end, the joined bytes)."""
    joined = b"\n".join(texts)
    buf = np.frombuffer(joined, np.uint8)
    h, start, end = hash_words(buf, lower)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return h, start, end, np.searchsorted(start, bounds, "left"), joined


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent 64-bit hash of each run of ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = h[:n].copy()
    for j in range(1, k):
        x = mix64(x * np.uint64(0xD1342543DE82EF95) + h[j : j + n] + np.uint64(j))
    return x


def to_bytes(column) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null as empty."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]
