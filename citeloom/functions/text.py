"""Scalar functions over strings and lists of the paper table."""

from __future__ import annotations

import re
import unicodedata
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOI_URL = "https://doi.org/"
WORK_URL = "https://openalex.org/"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^[\s\x1c-\x1f\x85   -     　]+|[\s\x1c-\x1f\x85   -     　]+$", "")


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def fold_text(text: str) -> str:
    """Lower case, no accents, single spaces: the form in which names and terms are compared."""
    decomposed = unicodedata.normalize("NFD", text.strip().lower())
    return " ".join("".join(c for c in decomposed if unicodedata.category(c) != "Mn").split())


@F.pandas_udf(T.ArrayType(T.StringType()))
def _folded_lists(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else [None if x is None else fold_text(x) for x in v])


def normalize_list(values: Column) -> Column:
    """Each element folded; null and empty lists become null.

    Spark has no Unicode decomposition, so texts beyond ASCII go through an Arrow function; lists that
    are plain ASCII stay in the JVM.
    """
    ascii_only = F.transform(values, lambda x: F.regexp_replace(F.lower(stripped(x)), r"\s+", " "))
    plain = ~F.exists(values, lambda x: F.coalesce(x.rlike(r"[^\x00-\x7f]"), F.lit(False)))
    beyond = _folded_lists(F.when(plain, F.lit(None)).otherwise(values))
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.when(plain, ascii_only).otherwise(beyond))


def normalize_language(c: Column) -> Column:
    """First subtag, lower case; empty becomes null."""
    return non_empty(F.lower(F.get(F.split(F.replace(stripped(c), F.lit("_"), F.lit("-")), "-"), F.lit(0))))


def normalize_doi(c: Column) -> Column:
    return non_empty(F.lower(F.regexp_replace(c, r"^https?://doi\.org/", "")))


def last_segment(url: Column) -> Column:
    """What follows the last slash; empty becomes null."""
    return non_empty(F.substring_index(url, "/", -1))


def paper_url(doi: Column, source_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit(DOI_URL), non_empty(doi)), F.concat(F.lit(WORK_URL), non_empty(source_id)))


def work_url(source_id: Column) -> Column:
    return F.when(source_id.rlike("^W[0-9]+$"), F.concat(F.lit(WORK_URL), source_id))


def joined(values: Column, sep: str = " | ") -> Column:
    """Non-empty elements in one string; null if there are none."""
    return non_empty(F.array_join(F.filter(values, lambda x: x.isNotNull() & (x != "")), sep))


def authors_display(raw: Column, ids: Column) -> Column:
    return F.coalesce(joined(raw), joined(ids), F.lit(""))


def keywords_display(raw: Column, ids: Column) -> Column:
    return F.coalesce(joined(ids), joined(raw), F.lit(""))


def paper_label(title: Column, year: Column, paper_id: Column) -> Column:
    """``title (year)``, cut after 60 characters; the id where there is no title."""
    full = F.concat(title, F.when(year.isNotNull(), F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(""))
    return F.when(F.coalesce(title, F.lit("")) == "", paper_id).when(F.length(full) > 60, F.concat(F.left(full, F.lit(60)), F.lit("..."))).otherwise(full)


def parse_since(value: str, today: date | None = None) -> date:
    """An ISO date, or so many days, months of 30 days or years of 365 before today: 10d, 6m, 2y."""
    m = re.fullmatch(r"(\d+)([dmy])", value.strip().lower())
    if m:
        return (today or date.today()) - timedelta(days=int(m[1]) * {"d": 1, "m": 30, "y": 365}[m[2]])
    return date.fromisoformat(value.strip())


def community_seed(corpus_hash: str) -> int:
    return int(corpus_hash[:8], 16) % 2**31


def token_sort_ratio(a: str, b: str) -> float:
    """Similarity of two texts with their words sorted: 200 * LCS / (len a + len b)."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not a and not b:
        return 100.0
    # Bit-parallel longest common subsequence: bit i of ``state`` is 0 where row i adds to the length.
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for c in b:
        m = state & masks.get(c, 0)
        state = (state + m | state - m) & full
    return 200.0 * (len(a) - state.bit_count()) / (len(a) + len(b))
