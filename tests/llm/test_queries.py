"""All thirteen queries and the pipeline's stages through the entry point: null ids, repeated rows, empty tables, clashing columns."""

import hashlib
import zlib

import pytest
from tests.llm.test_operators import ODD, corpus

import __spark_entry__
import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, hits string, k long, n long, t string, row long, token string, held_out string"
OPS = [n for n in __spark_entry__.queries() if n.startswith("op")]


def write(spark, out, docs, labels, items):
    extra = (None, "x", 1, 2, "y", 3, "z", "w")
    spark.createDataFrame([(*r, *extra) for r in docs], DOCS).repartition(2).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string, doc_id long").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


@pytest.fixture(scope="module")
def rows():
    own = [*ODD, *corpus()]
    return [*own, own[12], own[12], own[15], (None, own[20][1], None, None, None), (None, None, "en", "s", 0), (None, "no id and no copy of this text", "en", "s", 1)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory, rows):
    labels = [(r[0], r[0] % 2, r[0] % 3 == 0, "t") for r in corpus()] + [(None, 1, 1, "t"), (5, None, None, None), (12, 0, 0, "t")]
    items = [(1, " ".join(rows[15][1].split()[3:30]), 9), (1, " ".join(rows[15][1].split()[3:30]), 9), (None, None, None), (2, "", 1)]
    return write(spark, tmp_path_factory.mktemp("odd"), rows, [(a, b, None if c is None else int(c), d) for a, b, c, d in labels], items)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [])


def test_there_are_thirteen():
    assert len(OPS) == 13


@pytest.mark.parametrize("name", OPS)
def test_odd_rows(spark, odd, empty, rows, name):
    found = __spark_entry__.queries()[name](spark, odd)
    out = found.collect()
    if name.startswith("op11"):  # a row for each phrase
        assert out and len({(r["lang"], r["rank"]) for r in out}) == len(out)
        assert __spark_entry__.queries()[name](spark, empty).count() == 0
        return
    key = lambda i: (i is None, i or 0)
    if name.startswith("op7"):
        assert sum(r["doc_id"] == rows[15][0] for r in out) == 4  # a document twice, an item twice
    else:
        assert sorted((r["doc_id"] for r in out), key=key) == sorted((r[0] for r in rows), key=key)
    if "held_out" in found.columns:
        folds, held = (5, 0) if name.startswith("op1") else (4, 2)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in out)
    twins = [r for r in out if r["doc_id"] == rows[12][0]]
    assert all(r == twins[0] for r in twins)
    assert __spark_entry__.queries()[name](spark, empty).count() == 0


def test_stages_on_odd_rows(spark, odd, empty, tmp_path):
    for folder in (odd, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            path = f"{tmp_path}/{hashlib.md5(folder.encode()).hexdigest()}-{k}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() == len(set(docs.select("doc_id", "ids_sha256").collect())) and (folder == odd) == (docs.count() > 0)
