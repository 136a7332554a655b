"""Secret scans: base patterns, and dictionary-primed zstandard novelty for what they miss.

The base finds assignments to a sensitive name, access key ids and long hexadecimal runs.  The method adds
``novel`` spans: every other token of key characters that stands close behind a sensitive word is
compressed by zstandard primed with a dictionary of identifiers and the code around it; when the token
adds almost as many bytes as random characters would, it is reported.  The values of base matches are measured
alike, to count the placeholders among them.  What it is made of and how long it is
decide only through those bytes: a short token must add more for each of its characters.  The dictionary is a fixed list
and, before it, the words and identifiers that most of all documents hold (:func:`identifiers`).

Positions are code points, ends exclusive.  Defined results: null counts as an empty text; a text without
matches gives zero counts, no spans and the hash of the empty string.  Rows that repeat are reported as
often as they come; ids are not read.  One pass, no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

KINDS = ("assign", "access", "hex", "novel")
# The base patterns, letters in either case in the first, and least sizes.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

#: Words of the dictionary, those in most documents; each must be in so many.
DICTIONARY_WORDS, LEAST_DOCS = 400, 5
#: A candidate of the method: a run of key characters, so close behind a sensitive word.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}")
_SENSITIVE = re.compile(r"password|passwd|pwd|secret|token|api.?key|private.?key|access.?key|credential|auth|bearer|signature", re.ASCII | re.IGNORECASE)
#: One of these is in every text that a sensitive word is in.
_HINTS = ("password", "passwd", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "signature")
REACH = 48
#: Context on either side that primes the compressor; a token is novel from so many marginal bytes on, and so many for each character.
AROUND = 512
NOVEL_BYTES, NOVEL_SHARE = 4.0, 0.6

# Identifiers and fragments of code that prime the compressor.
IDENTIFIERS = (
    "import return class function public private static const string self this null true false none config "
    "settings environment variable client server session request response header authorization bearer token "
    "secret password username credential access_key_id secret_access_key api_key private_key public_key "
    "encryption signature certificate database connection host port user admin default example localhost "
    "http https www com org net json yaml xml html utf-8 base64 sha256 md5 uuid version build release "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef "
    "xxxxxxxxxxxxxxxxxxxxxxxx 000000000000000000000000 111111111111 test_test_test your_api_key_here changeme placeholder"
)


@lru_cache(maxsize=4)
def _compressor(dictionary: str):
    import zstandard

    primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def marginal_bytes(token: str, around: str, dictionary: str = IDENTIFIERS) -> int:
    """Bytes that the token adds to its compressed surroundings."""
    c = _compressor(dictionary)
    return len(c.compress((around + token).encode())) - len(c.compress(around.encode()))


_HEX_ONLY = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"x" * LEAST_HEX in text.encode("latin-1", "replace").translate(_HEX_ONLY):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the tokens that are measured: close behind a sensitive word, outside base spans."""
    folded = text.lower()
    if not any(w in folded for w in _HINTS):
        return []
    out, starts, ends = set(), [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))
    for word in _SENSITIVE.finditer(text):
        at = word.end()
        while (m := _TOKEN.search(text, at)) and m.start() <= word.start() + REACH:
            a, at = m.span()
            before = bisect_left(starts, at)
            if not before or ends[before - 1] <= a:
                out.add((a, at))
    return sorted(out)


def is_novel(text: str, start: int, end: int, dictionary: str = IDENTIFIERS) -> bool:
    """Whether a part of a text hardly compresses in its surroundings."""
    around = text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND] + "\n"
    return marginal_bytes(text[start:end], around, dictionary) >= NOVEL_BYTES + NOVEL_SHARE * (end - start)


def _value(text: str, span: tuple[int, int, int]) -> int:
    """Where the secret itself begins in a base span."""
    return ASSIGN.match(text, span[0]).start(2) if span[1] == 0 else span[0]


def identifiers(docs: DataFrame, text: str = "text") -> str:
    """A dictionary for :func:`scan_documents`: words without digits that most documents hold, the fixed list behind them.

    Words are counted over all documents; copies count each.
    """
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\b([A-Za-z][A-Za-z_]{3,23})\b"), F.lit(1)))).alias("w"))
    held = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "w").limit(DICTIONARY_WORDS).collect()
    return " ".join([*(r["w"] for r in reversed(held)), IDENTIFIERS])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(text: str, dictionary: str = IDENTIFIERS) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Base spans and all spans of a text, how many tokens were measured, and how many base spans are placeholders.

    A base span stays in any case; one that compresses well is counted as a placeholder.
    Runs of hexadecimal digits have half a byte a character by nature and aren't measured.
    """
    base = base_spans(text)
    others = candidates(text, base)
    added = [(a, 3, b) for a, b in others if is_novel(text, a, b, dictionary)]
    values = [(_value(text, x), x[2]) for x in base if x[1] != 2]
    values = [(a, b) for a, b in values if not HEX.fullmatch(text, a, b)]
    plain = sum(not is_novel(text, a, b, dictionary) for a, b in values)
    return base, sorted(base + added), len(others) + len(values), plain


def scan_documents(docs: DataFrame, text: str = "text", redact: str | None = None, dictionary: str = IDENTIFIERS) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, n_novel, n_measured, n_placeholder (see :func:`scan`), base_sha256 and spans.

    With ``redact`` the spans in the text are replaced by it and no columns are added.
    """
    added = [] if redact is not None else ["n_assign", "n_access", "n_hex", "n_novel", "n_measured", "n_placeholder", "base_sha256", "spans"]
    keep = [c for c in docs.columns if c not in added]
    at = keep.index(text)
    schema = T.StructType([docs.schema[c] for c in keep])
    for name in added:
        schema = schema.add(name, T.LongType() if name.startswith("n_") else T.StringType())

    def cleaned(t: str | None) -> str | None:
        end, out = 0, []
        for a, _, b in scan(t or "", dictionary)[1]:
            if a >= end:
                out += [t[end:a], redact]
            end = max(end, b)
        return "".join([*out, t[end:]]) if out else t

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            columns = list(batch.columns)
            if redact is not None:
                columns[at] = pa.array([cleaned(t) for t in texts], columns[at].type)
            else:
                found = [scan(t or "", dictionary) for t in texts]
                columns += [pa.array([sum(k == n for _, k, _ in every) for _, every, *_ in found], pa.int64()) for n in range(4)]
                columns += [pa.array([x[n] for x in found], pa.int64()) for n in (2, 3)]
                columns.append(pa.array([hashlib.sha256(joined(x[0]).encode()).hexdigest() for x in found], pa.string()))
                columns.append(pa.array([joined(x[1]) for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*keep, *added])

    return docs.select(*keep).mapInArrow(lean(run), schema)
