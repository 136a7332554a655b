"""The pipeline's stages, one after the other, on a small corpus."""

import public_tokenizers
import pytest
from tests.llm.test_operators import ODD, SCHEMA, components, corpus

import corpus_pipeline
from citeloom.llm import byte_bpe


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    rows = [*ODD, *corpus(), (200, "my token = 'abcdefghijklmnop' and more plain words here", "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{out}/documents.parquet")
    words = corpus()[3][1].split()
    spark.createDataFrame([(1, " ".join(words[:15]))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"]: r for r in docs.collect()})
    texts = {r[0]: r[1] for r in [*ODD, *corpus()]}
    assert set(texts) - set(kept[0]) <= {0, 1, 2, 8, *range(3, 8), 9} and {0, 1, 2, 8}.isdisjoint(kept[0])
    first = components({k: r["text"] for k, r in kept[0].items()})
    assert set(kept[1]) == {k for k, (_, c) in first.items() if k == c}
    assert set(kept[1]) - set(kept[2]) == {13}
    assert set(kept[3]) == set(kept[2]) == set(kept[4]) and corpus_pipeline.REDACTED in kept[3][200]["text"]
    c = byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert all(c.decode(r["ids"]).decode() == kept[3][k]["text"] for k, r in kept[4].items())


def test_run(spark, folder):
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} >= {14, 200}
