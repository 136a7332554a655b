"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length.

Folding lower-cases, strips accents, maps look-alike letters of other scripts and digits standing for
letters to Latin letters, and turns everything else into single spaces.  Lexicon entries are word
beginnings or whole words (`` idio``, `` idiot ``) with a log-odds weight learned from labelled rows;
exception phrases (an entry with a neighbouring word that only harmless rows show) cancel the entries
they cover.  Hit weights, their density in the text and the number of different entries feed a logistic
curve fitted on the same rows.

Defined results: null or empty text has no hits and gets the curve's base score, as every text without
hits does.  Without labelled rows of both classes the lexicon is empty and every score is the smoothed
share of label 1.  Repeated rows score alike.  Only id and text of ``docs`` and id and label of ``labels``
are read, so other columns can have any name.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_share

#: Training reads about this many labelled rows at most, chosen by a hash of the id.
TRAIN_ROWS = 12_000
MOST_ENTRIES = 4000
MOST_EXCEPTIONS = 2000
LEAST_Z, LEAST_LOG_ODDS, LEAST_ROWS = 4.0, 1.0, 5
_FLUSH = 400_000

# Letters of other scripts and signs that look like a Latin letter.
_LOOKALIKES = dict(zip("аеорсухіѕјкмтнвԁɡαορνικτυεςøłđı|", "aeopcyxisjkmthbdgaopviktueso" "ldil")) | {"ß": "ss", "æ": "ae", "œ": "oe"}
# Digits and signs that stand for a letter.
_DIGITS = dict(zip("013457@$", "oieastas"))


class _Fold(dict):
    """Character to folded text, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)).lower():
            c = _LOOKALIKES.get(c, _DIGITS.get(c, c))
            if not unicodedata.combining(c[0]):
                out += c if c.isalnum() else " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    return text.translate(_FOLD).split()


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None, 0.0))
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), entry, weight))
        if len(found):
            found.make_automaton()
        return found


def _hits(padded: str, automaton) -> list[tuple[int, int, str, float]]:
    """(start, end, entry, weight) of the lexicon's hits outside exception phrases."""
    if not len(automaton):
        return []
    hits, spared = [], []
    for last, (size, entry, weight) in automaton.iter(padded):
        if entry is None:
            spared.append((last + 1 - size, last + 1))
        else:
            hits.append((last + 1 - size, last + 1, entry, weight))
    if spared:
        hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in spared)]
    return hits


def _features(text: str, automaton) -> tuple[float, float, float, float]:
    words = fold(text)
    hits = _hits(f" {' '.join(words)} ", automaton)
    total = sum(h[3] for h in hits)
    return 1.0, math.log1p(total), math.log1p(100 * total / (len(words) + 10)), math.log1p(len({h[2] for h in hits}))


def _candidates(batches):
    """(candidate entry, rows with label 1, rows with label 0), summed up in the task."""
    pos, neg = Counter(), Counter()

    def flush():
        keys = list(pos.keys() | neg.keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())],
            ["entry", "pos", "neg"],
        )
        pos.clear()
        neg.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = set()
            for w in set(fold(text or "")):
                if len(w) <= 32:
                    found.add(f" {w} ")
                    found.update(f" {w[:n]}" for n in range(4, min(9, len(w))))
            (pos if label else neg).update(found)
            if len(pos) + len(neg) > _FLUSH:
                yield flush()
    yield flush()


def _contexts(model: ToxicityModel):
    def run(batches):
        automaton, pos, neg = model.automaton(), Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                padded, found = f" {' '.join(fold(text or ''))} ", set()
                for a, b, _, _ in _hits(padded, automaton):
                    end = padded.index(" ", max(b - 1, a + 1))
                    before = padded.rfind(" ", 0, a) if a else -1
                    after = padded.find(" ", end + 1)
                    if before >= 0 and a - before <= 33:
                        found.add(padded[before : end + 1])
                    if after > 0 and after - end <= 33:
                        found.add(padded[a : after + 1])
                (pos if label else neg).update(found)
        keys = list(neg)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())],
            ["entry", "pos", "neg"],
        )
        seen = [k for k in pos if k not in neg]
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.string()), pa.array([pos[k] for k in seen], pa.int64()), pa.array([0] * len(seen), pa.int64())],
            ["entry", "pos", "neg"],
        )

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", least_z: float = LEAST_Z) -> ToxicityModel:
    """Learn lexicon, exceptions and curve from about TRAIN_ROWS labelled rows at most.

    The driver gets the best-scored candidate entries, at most MOST_EXCEPTIONS phrases and four numbers a
    training row.
    """
    y = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y is not null")
    share = TRAIN_ROWS / max(1, y.count())
    y = y.where(hash_share(F.col("i"), 23) < share).groupBy("i").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(y), "i").select("t", "y").persist()
    try:
        sizes = {bool(r["y"]): r["n"] for r in rows.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
        n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
        if not n1 or not n0:
            p = (n1 + 0.5) / (n1 + n0 + 1)
            return ToxicityModel(curve=np.array([math.log(p / (1 - p)), 0, 0, 0]))
        summed = "entry string, pos long, neg long"
        odds = lambda k, n: F.log((F.col(k) + 0.5) / (F.lit(n) - F.col(k) + 0.5))
        found = (
            rows.mapInArrow(_candidates, summed).groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .where(F.col("pos") >= LEAST_ROWS).withColumn("weight", odds("pos", n1) - odds("neg", n0))
            .withColumn("z", F.col("weight") / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5)))
            .where((F.col("z") >= least_z) & (F.col("weight") >= LEAST_LOG_ODDS))
            .orderBy(F.desc("z"), "entry").limit(5 * MOST_ENTRIES).collect()
        )
        model = ToxicityModel()
        for r in found:  # of entries that contain one another, the best supported stays
            e = r["entry"]
            if len(model.weights) < MOST_ENTRIES and not any(e.startswith(k) or k.startswith(e) for k in model.weights):
                model.weights[e] = float(r["weight"])
        model.exceptions = [
            r["entry"] for r in rows.mapInArrow(_contexts(model), summed).groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .where((F.col("pos") == 0) & (F.col("neg") >= LEAST_ROWS)).orderBy(F.desc("neg"), "entry").limit(MOST_EXCEPTIONS).collect()
        ]

        def numbers(batches):
            automaton = model.automaton()
            for batch in batches:
                x = [_features(t or "", automaton) for t in batch.column(0).to_pylist()]
                cols = [pa.array([float(r[k]) for r in x], pa.float64()) for k in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([*cols, batch.column(1)], ["a", "b", "c", "y"])

        got = rows.mapInArrow(numbers, "a double, b double, c double, y int").collect()
        x = np.array([(1.0, r["a"], r["b"], r["c"]) for r in got])
        model.curve = _logistic(x, np.array([float(r["y"] > 0) for r in got]))
        return model
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` and ``hits``, the number of lexicon hits that count."""
    added = ["score", "predicted", "hits"]
    keep = [c for c in docs.columns if c not in added]
    at = keep.index(text)
    schema = T.StructType([docs.schema[c] for c in keep]).add("score", T.DoubleType()).add("predicted", T.IntegerType()).add("hits", T.LongType())

    def run(batches):
        automaton, curve = model.automaton(), model.curve
        for batch in batches:
            scores, counts = [], []
            for t in batch.column(at).to_pylist():
                words = fold(t or "")
                hits = _hits(f" {' '.join(words)} ", automaton)
                total = sum(h[3] for h in hits)
                x = curve[0] + curve[1] * math.log1p(total) + curve[2] * math.log1p(100 * total / (len(words) + 10)) + curve[3] * math.log1p(len({h[2] for h in hits}))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))
                counts.append(len(hits))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(counts, pa.int64())],
                [*keep, *added],
            )

    return docs.select(*keep).mapInArrow(run, schema)
