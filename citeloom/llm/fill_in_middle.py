"""Fill-in-middle: documents cut in three at unit boundaries and put together with the middle last.

A text is cut into units: words with the white space (``[\\x20\\x09-\\x0D]``) before them, and what white space
is left at its end.  One Aho-Corasick automaton runs over the text once and reports sparse events: the white
space characters, where the class of characters changes, and the sentinels.  Where two neighbouring white
space events leave a gap, that gap is one word, so the events alone give the number of units and, by rank,
the place where any of them ends; the words themselves are never looked at.

Which documents are rewritten, in which order of parts and where they are cut follows from a hash of seed and
id: ``RATE`` per cent are rewritten, ``SPM`` per cent of them with the suffix first.  A text with a sentinel in
it stays plain, so that every output can be taken apart again by :func:`restore`.

Defined results: a null text counts as empty, has no unit and stays plain; a null id hashes like an empty one;
repeated rows give the same output; other columns are left out.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WHITE = "\t\n\x0b\x0c\r "
SEED, RATE, SPM = 42, 50, 80
#: Texts of an Arrow batch that are held as Python strings at a time, in characters.
_RUN = 1 << 20
_SPACE, _SENTINEL = 0, 1


def scanner():
    """The automaton: white space characters and sentinels, told apart by their values."""
    found = ahocorasick.Automaton()
    for c in WHITE:
        found.add_word(c, _SPACE)
    for s in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(s, _SENTINEL)
    found.make_automaton()
    return found


def events(automaton, text: str) -> tuple[np.ndarray, bool]:
    """Places of the white space in a text, ascending, and whether a sentinel is in it."""
    at, sentinel = [], False
    for end, kind in automaton.iter(text):
        if kind == _SPACE:
            at.append(end)
        else:
            sentinel = True
    return np.array(at, np.int64), sentinel


def unit_ends(space: np.ndarray, size: int) -> np.ndarray:
    """Where each unit of a text of ``size`` characters ends, from the places of its white space.

    A gap before an event ends a word; what stands behind the last word is a unit too.
    """
    before = np.concatenate(([-1], space))
    ends = np.append(space, size)[np.append(space, size) - before > 1]
    return np.append(ends, size) if size and (not len(ends) or ends[-1] < size) else ends


def numbers(seed: int, doc_id) -> list[int]:
    """The first four groups of eight hex digits of the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def rewrite(automaton, text: str, doc_id, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple:
    """(n units, form, characters of the prefix and of the middle, output) of one text."""
    space, sentinel = events(automaton, text)
    ends = unit_ends(space, len(text))
    n = len(ends)
    a, b, chosen, order = numbers(seed, doc_id)
    if not text or sentinel or chosen % 100 >= rate:
        return n, "plain", None, None, text
    x, y = sorted((a % (n + 1), b % (n + 1)))
    i, j = (int(ends[k - 1]) if k else 0 for k in (x, y))
    first, middle, last = text[:i], text[i:j], text[j:]
    if order % 100 < spm:
        return n, "spm", i, j - i, f"{SUFFIX}{last}{PREFIX}{first}{MIDDLE}{middle}"
    return n, "psm", i, j - i, f"{PREFIX}{first}{SUFFIX}{last}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    left, middle = output[len(one) :].split(MIDDLE)
    x, y = left.split(two)
    return (y + middle + x) if form == "spm" else (x + middle + y)


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, rate: int = RATE, spm: int = SPM, output: bool = True) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each document, and its output."""
    fields = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * output
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"][: 7 + output]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def pieces(column):
        """Slices of a batch with texts of about ``_RUN`` bytes."""
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        first, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > _RUN:
                yield first, i
                first, held = i, 0
            held += size
        if first < len(sizes):
            yield first, len(sizes)

    def run(batches):
        automaton = scanner()
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                part, rows = batch.slice(a, b - a), []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    t = t or ""
                    *cut, made = rewrite(automaton, t, i, seed, rate, spm)
                    rows.append((*cut, digest(made), digest(restore(made, cut[1])), made))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names) - 1))], names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(lean(run), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, {fields}")
