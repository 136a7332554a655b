"""BibTeX files as paper rows: a tokenizer in Python, everything after it in native expressions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import provenance as prov
from citeloom.functions.identity import with_ids
from citeloom.functions.text import non_empty, normalize_doi, stripped
from citeloom.schema import COLUMNS, CORPUS_SCHEMA

FIELDS = ("title", "author", "year", "journal", "booktitle", "doi", "abstract", "keywords", "language", "publisher")


def _value(text: str, at: int, strings: dict[str, str]) -> tuple[str, int]:
    """A field's value from ``at`` on: braced, quoted or bare parts joined by #."""
    parts = []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            raise ValueError("a value is missing")
        if text[at] in '{"':
            close, depth, start = "}" if text[at] == "{" else '"', 0, at + 1
            at += 1
            while at < len(text) and not (text[at] == close and depth == 0):
                depth += (text[at] == "{") - (text[at] == "}")
                at += 2 if text[at] == "\\" else 1
            if at >= len(text):
                raise ValueError("a value isn't closed")
            parts.append(text[start:at])
            at += 1
        else:
            start = at
            while at < len(text) and text[at] not in ",}#" and not text[at].isspace():
                at += 1
            bare = text[start:at]
            parts.append(strings.get(bare.lower(), bare))
        while at < len(text) and text[at].isspace():
            at += 1
        if at < len(text) and text[at] == "#":
            at += 1
            continue
        return "".join(parts), at


def entries(text: str) -> Iterator[dict[str, str]]:
    """Entries with their fields in lower case, braces and line breaks taken out."""
    strings: dict[str, str] = {}
    at = text.find("@")
    while at >= 0:
        brace = text.find("{", at)
        if brace < 0:
            raise ValueError("an entry has no body")
        kind, at = text[at + 1 : brace].strip().lower(), brace + 1
        if kind in ("comment", "preamble"):
            depth = 1
            while at < len(text) and depth:
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
        else:
            found = {"_kind": kind}
            if kind != "string":
                comma = text.find(",", at)
                end = text.find("}", at)
                if end >= 0 and (comma < 0 or end < comma):
                    comma = end
                found["_key"], at = text[at:comma].strip(), comma + (text[comma : comma + 1] == ",")
            while True:
                while at < len(text) and (text[at].isspace() or text[at] == ","):
                    at += 1
                if at >= len(text):
                    raise ValueError(f"entry {found.get('_key', '')} isn't closed")
                if text[at] == "}":
                    at += 1
                    break
                equals = text.find("=", at)
                if equals < 0:
                    raise ValueError(f"entry {found.get('_key', '')}: a field has no value")
                name = text[at:equals].strip().lower()
                raw, at = _value(text, equals + 1, strings)
                found[name] = raw if name == "author" else " ".join(raw.replace("{", "").replace("}", "").split())
                if kind == "string":
                    strings[name] = found[name]
            if kind != "string":
                if "author" in found:
                    found["author"] = " ".join(found["author"].replace("{", "").replace("}", "").split())
                yield found
        at = text.find("@", at)


#: Entries that leave a parsing task at a time.
ENTRIES_AT_ONCE = 2_000


def parsed(texts: Iterable[str], files: Iterable[str], most: int = ENTRIES_AT_ONCE) -> Iterator:
    """Frames (file, place, fields) of at most ``most`` entries."""
    import pandas as pd

    rows = ((file, k, *(e.get(f) for f in FIELDS)) for text, file in zip(texts, files) for k, e in enumerate(entries(text.removeprefix("\ufeff"))))
    while some := list(islice(rows, most)):
        yield pd.DataFrame(some, columns=["file", "place", *FIELDS])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, fields) of every entry; each file is parsed where it is read, a file at a time."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))

    def run(batches):
        for batch in batches:
            yield from parsed(batch["value"], batch["file"])

    return files.mapInPandas(run, "file string, place int, " + ", ".join(f"{f} string" for f in FIELDS))


def to_papers(rows: DataFrame, is_seed: bool = True, fetched_at: str | None = None) -> DataFrame:
    """The 23 columns; entries without a title are left out."""
    some = lambda c: F.when(F.size(c) > 0, c)
    listed = lambda c, sep: some(F.filter(F.transform(F.split(c, sep), stripped), lambda x: x != ""))
    authors, words = listed(F.col("author"), r"\s+and\s+"), listed(F.col("keywords"), "[,;]")
    event = prov.event("seeded", source="bibtex", fetched_at=fetched_at)
    values = {
        "doi": normalize_doi(stripped(F.col("doi"))), "title": stripped(F.col("title")), "year": stripped(F.col("year")).try_cast("int"), "abstract": non_empty(F.col("abstract")),
        "source": F.coalesce(non_empty(F.col("journal")), non_empty(F.col("booktitle"))), "language": non_empty(F.col("language")), "publisher": non_empty(F.col("publisher")),
        "is_seed": F.lit(is_seed), "curation_status": F.lit("candidate"), "provenance": prov.dump(F.array(event)), "authors_raw": authors, "authors_id": authors, "keywords_raw": words, "keywords_id": words,
    }
    titled = rows.where("coalesce(trim(title), '') <> ''")
    return with_ids(titled.select(*[values.get(c, F.lit(None)).cast(CORPUS_SCHEMA[c].dataType).alias(c) for c in COLUMNS])).select(*COLUMNS)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    return to_papers(read(spark, path), **options)
