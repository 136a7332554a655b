"""The paper table: 23 fixed columns, and checks of a DataFrame against them."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _A = T.StringType(), T.ArrayType(T.StringType())


class SchemaError(ValueError):
    """A table that isn't a paper table; the message names the column."""


class CurationStatus(str, Enum):
    CANDIDATE = "candidate"
    ACCEPTED = "accepted"
    REJECTED = "rejected"


class NetworkKind(str, Enum):
    COUPLING = "bibliographic_coupling"
    COCITATION = "cocitation"
    AUTHOR = "author_collab"
    INSTITUTION = "institution_collab"
    KEYWORD = "keyword_cooccurrence"


# Names, types and order of the columns.
CORPUS_SCHEMA = T.StructType([
    T.StructField("id", _S, False), T.StructField("source_id", _S), T.StructField("doi", _S), T.StructField("title", _S, False),
    T.StructField("year", T.IntegerType()), T.StructField("abstract", _S), T.StructField("source", _S), T.StructField("language", _S),
    T.StructField("publisher", _S), T.StructField("research_areas", _A), T.StructField("is_seed", T.BooleanType(), False),
    T.StructField("curation_status", _S, False), T.StructField("provenance", _S), T.StructField("authors_raw", _A),
    T.StructField("authors_id", _A), T.StructField("authors_affiliations", _A), T.StructField("keywords_raw", _A),
    T.StructField("keywords_id", _A), T.StructField("institutions_raw", _A), T.StructField("institutions_id", _A),
    T.StructField("references_id", _A), T.StructField("references_doi", _A), T.StructField("cited_by_id", _A),
])
COLUMNS = CORPUS_SCHEMA.names
LIST_COLUMNS = [f.name for f in CORPUS_SCHEMA if isinstance(f.dataType, T.ArrayType)]
REQUIRED = [f.name for f in CORPUS_SCHEMA if not f.nullable]
SCALAR_COLUMNS = [c for c in COLUMNS if c not in LIST_COLUMNS and c not in ("id", "curation_status", "provenance")]
STATUSES = [s.value for s in CurationStatus]

#: An event of the provenance column, a JSON list of these.
EVENT = T.StructType([
    T.StructField("action", _S), T.StructField("equation_id", _S), T.StructField("chaining_hop", T.IntegerType()),
    T.StructField("source", _S), T.StructField("fetched_at", _S), T.StructField("decided_by", _S), T.StructField("decided_at", _S),
])


def check_columns(df: DataFrame) -> None:
    """An error unless ``df`` has every column with its exact type; columns beyond the 23 are tolerated."""
    have = {f.name: f.dataType for f in df.schema}
    missing = sorted(set(COLUMNS) - have.keys())
    if missing:
        raise SchemaError(f"missing column: {missing[0]}")
    for field in CORPUS_SCHEMA:
        if have[field.name].simpleString() != field.dataType.simpleString():
            raise SchemaError(f"column {field.name}: {have[field.name].simpleString()} instead of {field.dataType.simpleString()}")


def validate(df: DataFrame) -> DataFrame:
    """``df`` itself if it has every column with its exact type and no null in a required one.

    One aggregation counts the nulls of all required columns.
    """
    check_columns(df)
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in REQUIRED]).first().asDict()
    for c in REQUIRED:
        if nulls[c]:
            raise SchemaError(f"column {c}: {nulls[c]} null values")
    return df


def conform(df: DataFrame) -> DataFrame:
    """The 23 columns in order, those that are missing as nulls (or their defaults)."""
    defaults = {"is_seed": F.lit(True), "curation_status": F.lit("candidate"), "title": F.lit("")}
    out = []
    for f in CORPUS_SCHEMA:
        c = F.col(f.name) if f.name in df.columns else defaults.get(f.name, F.lit(None))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.regexp_replace(c, r"^\s+|\s+$", "") == "")


def problems(df: DataFrame) -> DataFrame:
    """One row: papers with an empty id, an empty title or an unknown status."""
    return df.agg(
        F.count("*").alias("papers"),
        F.count_if(is_blank(F.col("id"))).alias("empty_id"),
        F.count_if(is_blank(F.col("title"))).alias("empty_title"),
        F.count_if(F.col("curation_status").isNull() | ~F.col("curation_status").isin(*STATUSES)).alias("bad_status"),
    )
