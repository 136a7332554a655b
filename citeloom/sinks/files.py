"""Networks as GraphML and CSV files, and a corpus as a curation sheet.

Files of one network are written by the driver from a row iterator, so memory holds one partition at a time.
"""

from __future__ import annotations

import csv
import json
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import authors_display, keywords_display, work_url
from citeloom.operators.filters import dump_scope

# Columns of the curation sheet, in order.
SHEET_COLUMNS = ["id", "source_id", "title", "year", "authors", "venue", "doi", "keywords", "cited_by_count", "references_count", "is_seed", "openalex_url", "scent_score", "cluster", "decision", "note"]
_KINDS = {"int": "int", "bigint": "long", "double": "double", "float": "double", "boolean": "boolean"}


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def write_graphml(edges: DataFrame, nodes: DataFrame, path: str | Path) -> Path:
    """An undirected graph; null attributes are left out."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    attributes = [(c, _KINDS.get(t, "string")) for c, t in nodes.dtypes if c != "node"]
    with path.open("w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for k, (name, kind) in enumerate(attributes):
            f.write(f'<key id="n{k}" for="node" attr.name={quoteattr(name)} attr.type="{kind}"/>\n')
        f.write('<key id="w" for="edge" attr.name="weight" attr.type="long"/>\n<graph edgedefault="undirected">\n')
        for r in nodes.orderBy("node").toLocalIterator():
            f.write(f"<node id={quoteattr(str(r['node']))}>")
            for k, (name, _) in enumerate(attributes):
                if r[name] is not None:
                    f.write(f'<data key="n{k}">{escape(_text(r[name]))}</data>')
            f.write("</node>\n")
        for r in edges.orderBy("src", "dst").toLocalIterator():
            f.write(f"<edge source={quoteattr(str(r['src']))} target={quoteattr(str(r['dst']))}><data key=\"w\">{r['weight']}</data></edge>\n")
        f.write("</graph>\n</graphml>\n")
    return path


def read_graphml(path: str | Path) -> tuple[list[tuple[str, dict]], list[tuple[str, str, int]]]:
    """(nodes with attributes, edges) of a file that ``write_graphml`` wrote."""
    import xml.etree.ElementTree as ET

    ns = "{http://graphml.graphdrawing.org/xmlns}"
    root = ET.parse(path).getroot()
    names = {k.get("id"): k.get("attr.name") for k in root.iter(f"{ns}key")}
    nodes = [(n.get("id"), {names[d.get("key")]: d.text for d in n}) for n in root.iter(f"{ns}node")]
    return nodes, [(e.get("source"), e.get("target"), int(e[0].text)) for e in root.iter(f"{ns}edge")]


def write_csv(edges: DataFrame, nodes: DataFrame, folder: str | Path) -> tuple[Path, Path]:
    """``aristas.csv`` and ``nodos.csv`` with a byte order mark; attributes in alphabetical order."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    extra = sorted(c for c in nodes.columns if c not in ("node", "label"))
    with (folder / "aristas.csv").open("w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f)
        out.writerow(["source", "target", "weight"])
        for r in edges.orderBy("src", "dst").toLocalIterator():
            out.writerow([r["src"], r["dst"], r["weight"]])
    with (folder / "nodos.csv").open("w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f)
        out.writerow(["id", "label", *extra])
        for r in nodes.orderBy("node").toLocalIterator():
            label = r["label"] if "label" in nodes.columns else r["node"]
            out.writerow([r["node"], label, *("" if r[c] is None else r[c] for c in extra)])
    return folder / "aristas.csv", folder / "nodos.csv"


def write_artifacts(folder: str | Path, metrics: dict, clusters: DataFrame | None = None) -> None:
    """``metrics.json`` and, for networks of papers, ``clusters.csv``."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "metrics.json").write_text(json.dumps(metrics, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")
    if clusters is not None:
        with (folder / "clusters.csv").open("w", newline="", encoding="utf-8-sig") as f:
            out = csv.writer(f)
            out.writerow(clusters.columns)
            for r in clusters.orderBy("cluster").toLocalIterator():
                out.writerow(["; ".join(map(str, v)) if isinstance(v, list) else "" if v is None else v for v in r])


def scent_told(provenance: Column) -> Column:
    """The scent that the first event with one tells; null without."""
    events = F.from_json(F.nullif(provenance, F.lit("")), "array<map<string,string>>")
    return F.get(F.filter(F.transform(events, lambda e: F.try_element_at(e, F.lit("scent"))), lambda x: x.isNotNull()), 0)


def curation_rows(corpus: DataFrame, scope: str = "candidates") -> DataFrame:
    """The sheet's 16 columns, as text."""
    blank, text = F.lit(""), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    decision = F.when(F.col("curation_status").isin("accepted", "rejected"), F.col("curation_status")).otherwise("undecided")
    values = {
        "id": text("id"), "source_id": text("source_id"), "title": text("title"), "year": text("year"), "authors": authors_display(F.col("authors_raw"), F.col("authors_id")), "venue": text("source"), "doi": text("doi"),
        "keywords": keywords_display(F.col("keywords_raw"), F.col("keywords_id")), "is_seed": F.when(F.col("is_seed"), "True").otherwise("False"), "openalex_url": F.coalesce(work_url(F.col("source_id")), blank), "decision": decision,
        "scent_score": F.coalesce(scent_told(F.col("provenance")), blank),
    }
    return dump_scope(corpus, scope).select(*[values.get(c, blank).alias(c) for c in SHEET_COLUMNS])


def write_curation_sheet(corpus: DataFrame, path: str | Path, scope: str = "candidates") -> int:
    path, n = Path(path), 0
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f)
        out.writerow(SHEET_COLUMNS)
        for r in curation_rows(corpus, scope).orderBy("id").toLocalIterator():
            out.writerow(r)
            n += 1
    return n


def write_curation_sheet_parts(corpus: DataFrame, folder: str, scope: str = "candidates") -> None:
    """The sheet as a folder of CSV files in the order of ids, each with a header, written where its rows are.

    For corpora that are too large to pass through the driver; :func:`read_curation_sheet` takes either form.
    """
    rows = curation_rows(corpus, scope).orderBy("id")
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)


def read_curation_sheet(corpus: DataFrame, path: str) -> DataFrame:
    """(id, decision) of a sheet, a file or a folder of files; a byte order mark in front is fine, an unknown decision is an error."""
    spark = corpus.sparkSession
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip().strip('"') for c in rows.columns])
    missing = sorted({"id", "decision"} - set(rows.columns))
    if missing:
        raise ValueError(f"the sheet has no column {missing[0]}")
    rows = rows.select(F.col("id"), F.lower(F.trim(F.coalesce("decision", F.lit("undecided")))).alias("decision")).where("coalesce(id, '') <> ''")
    rows = rows.withColumn("decision", F.when(F.col("decision") == "", "undecided").otherwise(F.col("decision")))
    bad = rows.where(~F.col("decision").isin("accepted", "rejected", "undecided")).select("decision").first()
    if bad:
        raise ValueError(f"unknown decision {bad[0]!r}")
    return rows
