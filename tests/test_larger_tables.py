"""Steps whose memory, time or traffic grew faster than their input."""

import csv
import json
import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from citeloom import file_queries, queries, row_queries
from citeloom.llm import secrets
from citeloom.schema import conform
from citeloom.sinks import files
from citeloom.sources import api, bibtex
from citeloom.store import Store, write_snapshot
from citeloom.functions import identity
from citeloom.operators import communities, graph, networks, paths, preprocess
from citeloom.plans import checkpoint, star


def test_repeated_names_count_once_and_no_piece_table_is_broadcast(spark):
    rows = [("Supplier#000000017", 1), ("Supplier#000000018", 3), ("Supplier#000000017", 1), ("Supplier#000000018", 1), ("Another one entirely", 2)] * 3
    names = spark.createDataFrame(rows, "value string, n long")
    found = preprocess.variant_clusters(names, 0.92).collect()
    assert [tuple(r) for r in found] == [("Supplier#000000017", "Supplier#000000018")]
    pairs = preprocess.similar_pairs(names, 0.92)
    assert [tuple(r) for r in pairs.collect()] == [("Supplier#000000017", "Supplier#000000018")]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def _cliques(spark):
    """Three rings of cliques and a pair, apart from each other, with names that aren't in order."""
    rows = []
    for part, size in enumerate((4, 5, 6)):
        name = lambda c, i: (c * 37 + i * 5 + 1) * 10 + part  # noqa: B023, E731
        for c in range(5):
            rows += [(name(c, i), name(c, j), 2) for i in range(size) for j in range(i)]
            rows.append((name(c, 0), name((c + 1) % 5, 1), 1))
    rows.append((9_000_001, 9_000_002, 1))
    return spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in rows], "src long, dst long, weight long"), {(min(a, b), max(a, b)) for a, b, _ in rows}


def _members(found, name="community"):
    return {r["node"]: r[name] for r in found.collect()}


def test_betweenness_by_components(spark):
    edges, _ = _cliques(spark)
    by_joins = _members(paths.betweenness(edges, 10**9), "betweenness")
    for one_task in (1_000, 60):  # all components in a task each; the largest by joins
        found = _members(paths.betweenness(edges, one_task=one_task), "betweenness")
        assert found.keys() == by_joins.keys() and all(abs(found[v] - by_joins[v]) < 1e-12 for v in found)


def test_communities_by_components(spark, monkeypatch):
    edges, _ = _cliques(spark)
    steps = []
    for name in ("_mutual_merges",):
        monkeypatch.setattr(communities, name, lambda *a: steps.append(a) or 1 / 0)
    whole, parts = (_members(communities.greedy_modularity(edges, one_task=k)) for k in (1_000, 90))
    assert whole == parts and not steps  # before, these edges went through rounds of joins
    monkeypatch.undo()
    whole = _members(communities.louvain(edges, one_task=1_000))
    for one_task in (90, 60):  # the second leaves the largest component to joins
        found = communities.louvain(edges, one_task=one_task)
        assert _members(found).keys() == whole.keys()
        assert communities.modularity(edges, found).first()[0] > 0.9 * communities.modularity(edges, communities.louvain(edges, one_task=1_000)).first()[0]


def test_labels_by_components_are_those_by_joins(spark):
    draw = random.Random(5)
    pairs = {tuple(sorted(draw.sample(range(10**6, 10**6 + 24), 2))) for _ in range(50)}
    edges = spark.createDataFrame([(*p, 1) for p in sorted(pairs)] + [(1, 2, 1)], "src long, dst long, weight long")
    assert _members(graph.label_propagation(edges, one_task=1_000)) == _members(graph.label_propagation(edges, one_task=0))


def test_hashes_of_rounds_are_those_of_spark(spark):
    rows = spark.range(-3, 40).select("id", F.xxhash64("id").alias("held"), F.xxhash64("id", F.lit(31)).alias("h")).toPandas()
    assert (graph._hashed_on(rows["held"].to_numpy(), 31) == rows["h"].to_numpy()).all()


def test_works_files_grow_in_number_not_in_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(file_queries, "WORKS_OF_A_FILE", 100)
    monkeypatch.setattr(file_queries, "_folder", lambda _: str(tmp_path / "works"))
    rows = file_queries.works_file_rows(spark, "/root/testdata/sf0.01")
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count()
    sizes = [len(json.loads(f.read_text())) for f in (tmp_path / "works").glob("part-*.txt")]
    assert len(sizes) > 120 and max(sizes) < 180  # 40 files of some 375 before


def test_replay_reads_on_from_its_cursor(tmp_path, monkeypatch):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text("".join(json.dumps({"id": f"W{k * 100 + i}", "publication_year": 2000 + i % 2, "title": "é"}) + "\n" for i in range(100)))
    told, loads = [], json.loads
    monkeypatch.setattr(api.json, "loads", lambda line: told.append(line) or loads(line))
    found, cursor, asked = [], "*", 0
    while cursor is not None:
        _, answer = api.replay({"path": str(tmp_path), "filter": "from_publication_date:2001-01-01", "cursor": cursor, "per_page": 10})
        found += [w["id"] for w in answer["results"]]
        cursor, asked = answer["meta"]["next_cursor"], asked + 1
    assert found == [f"W{k}" for k in range(300) if k % 2] and asked == 15
    assert len(told) <= 300 + asked  # each line once and what is looked ahead at; before, all lines for every page


def test_sheet_in_parts(spark, tmp_path):
    rows = spark.range(50).select(F.format_string("p%02d", "id").alias("id"), F.lit('a "b", c\nd').alias("title"), F.lit("candidate").alias("curation_status"), F.lit(False).alias("is_seed"))
    corpus = conform(rows)
    files.write_curation_sheet(corpus, tmp_path / "one.csv")
    files.write_curation_sheet_parts(corpus, str(tmp_path / "parts"))
    one, parts = (files.read_curation_sheet(corpus, str(tmp_path / n)).collect() for n in ("one.csv", "parts"))
    assert sorted(one) == sorted(parts) and len(one) == 50
    told = [list(csv.reader(f.open(encoding="utf-8-sig", newline=""))) for f in sorted((tmp_path / "parts").glob("part-*.csv"))]
    assert [r for t in told for r in t[1:]] == list(csv.reader((tmp_path / "one.csv").open(encoding="utf-8-sig", newline="")))[1:]


def test_bibtex_entries_leave_a_task_in_parts(spark, tmp_path):
    sizes = []
    texts = ["@string{j = {J}}\n" + "".join(f"@article{{k{i}, title = {{T {i}}}, journal = j}}\n" for i in range(25))] * 2
    for part in bibtex.parsed(texts, ["a", "b"], 10):
        sizes.append(len(part))
        assert set(part["journal"]) == {"J"}
    assert sum(sizes) == 50 and max(sizes) <= 10


def test_dictionary_counts_all_documents(spark):
    docs = spark.createDataFrame([(i, "common words " + ("rarest_name" if i % 1000 == 7 else "other")) for i in range(6000)], "doc_id long, text string")
    assert "rarest_name" in secrets.identifiers(docs).split()  # in six documents: a sample of 2,000 hardly holds five of them


def test_triangles_by_components_and_tiles(spark, monkeypatch):
    draw = random.Random(3)
    pairs = sorted({tuple(sorted(draw.sample(range(60), 2))) for _ in range(500)} | {(a, b) for a in range(100, 106) for b in range(a + 1, 106)} | {(200, 201)})
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    expected = {v: sum(b in near[a] for a in m for b in m if a < b) for v, m in near.items()}
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long")
    for core, wedges in ((2048, 4_000_000), (10, 50), (0, 7)):
        monkeypatch.setattr(graph, "CORE", core)
        monkeypatch.setattr(graph, "WEDGES", wedges)
        rows = graph._triangles(pd.DataFrame(pairs, columns=["src", "dst"]))
        assert dict(zip(rows["node"], rows["triangles"])) == {v: t for v, t in expected.items() if t}
    monkeypatch.undo()
    for one_task in (10_000, 600, 100):  # one task, one a component, and tiles for the larger component
        assert _members(graph.clustering(edges, one_task), "triangles") == expected


def _partitions(df):
    """Partitions that hold rows, and the most rows of one."""
    held = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return len(held), max(held)


def test_papers_are_dealt_by_their_number(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    before = sorted(map(repr, star.papers(spark, d).collect()))
    monkeypatch.setattr(star, "LINES_OF_A_TASK", 100, raising=False)
    parts, most = _partitions(star.papers(spark, d))
    assert parts > 40 and most < 70  # four partitions of some 375 papers before
    assert sorted(map(repr, star.papers(spark, d).collect())) == before


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(networks, "PAIRS_OF_A_TASK", 2_000, raising=False)
    edges = networks.project(star.coupling(spark, "/root/testdata/sf0.001"))
    parts, most = _partitions(edges)
    assert edges.count() == 84_761 and parts > 40 and most < 2_400  # four partitions before
    few = networks.project(star.institutions(spark, "/root/testdata/sf0.001"))
    assert "REPARTITION_BY_NUM" not in few._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(src")[0]


def test_corpora_are_computed_once_for_files(spark, tmp_path):
    told = spark.sparkContext.accumulator(0)

    def name(i):
        told.add(1)
        return f"title {i}"

    title = F.udf(name, "string").asNondeterministic()
    corpus = conform(spark.range(40).select(F.col("id").cast("string").alias("id"), title("id").alias("title"), (F.col("id") + 1).alias("_seq"))).withColumn("_seq", F.col("id").cast("long") + 1)
    held = write_snapshot(corpus, tmp_path / "snapshot")
    assert told.value == 40 and held.manifest["corpus_hash"] == identity.corpus_hash(held.corpus)
    with Store(spark, tmp_path / "store") as store:
        store.replace(corpus)
        assert told.value == 80
        store.persist(corpus)
        assert told.value == 120 and store.papers().count() == 40


def test_hashed_corpora_are_read_not_computed(spark, monkeypatch):
    hashed, own = [], identity.corpus_hash
    monkeypatch.setattr(identity, "corpus_hash", lambda df: hashed.append(df) or own(df))
    assert tuple(row_queries.content_hash_invariants(spark, "/root/testdata/sf0.001").first()) == (True, True, True, False, False)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in hashed]
    assert len(plans) == 6 and not any("Aggregate" in p or "RepartitionByExpression [year#" in p and ", 7" in p for p in plans)


def test_few_texts_at_a_time_are_held_as_words():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": [f"a b{i} a\tc\u00a0d" for i in range(100)]})
    found = list(queries._inverted([batch]))
    assert max(b.num_rows for b in found) <= queries.ABSTRACTS_AT_ONCE < 100
    rows = [r for b in found for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(100)) and rows[7]["ix"] == [("a", [0, 2]), ("b7", [1]), ("c\u00a0d", [3])]


def test_works_are_parsed_once(spark):
    found = row_queries.works_institutions(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "aggregate(" not in plan


def _joined_cliques(spark):
    """Two cliques of twelve with a bridge, in one component of 133 edges."""
    pairs = [(c * 100 + i, c * 100 + j) for c in (1, 2) for i in range(12) for j in range(i + 1, 12)] + [(103, 207)]
    return spark.createDataFrame([(*p, 1) for p in pairs], "src long, dst long, weight long")


def test_betweenness_of_dense_components_needs_no_joins(spark, monkeypatch):
    edges = _joined_cliques(spark)
    by_joins = _members(paths.betweenness(edges, 10**9), "betweenness")
    monkeypatch.setattr(paths, "ONE_TASK_EDGES", 20)
    monkeypatch.setattr(paths, "_levels", lambda *a: 1 / 0)  # before, a component of that many edges went by joins, whatever its nodes
    found = _members(paths.betweenness(edges), "betweenness")
    assert found.keys() == by_joins.keys() and all(abs(found[v] - by_joins[v]) < 1e-12 for v in found)
    graph_ = paths.Graph(*(edges.toPandas()[c] for c in ("src", "dst")))
    one_by_one = sum(paths._hanging(graph_, v) for v in range(graph_.n))
    assert abs(paths._hanging_of_all(graph_, paths.np.arange(graph_.n)) - one_by_one).max() < 1e-9


def test_greedy_modularity_of_dense_components_needs_no_joins(spark, monkeypatch):
    edges = _joined_cliques(spark)
    whole = _members(communities.greedy_modularity(edges, one_task=1_000))
    monkeypatch.setattr(communities, "ONE_TASK_EDGES", 20)
    monkeypatch.setattr(communities, "_mutual_merges", lambda *a: 1 / 0)  # before, a component of that many edges went by joins, whatever its nodes
    assert _members(communities.greedy_modularity(edges)) == whole and len(set(whole.values())) == 2


def test_greedy_modularity_by_matrix_is_that_by_heap():
    for seed in range(20):
        draw = random.Random(seed)
        pairs = sorted({tuple(sorted(draw.sample(range(20), 2))) for _ in range(60)} | {(i, i + 1) for i in range(19)})
        x, y = (paths.np.array(c) for c in zip(*pairs))
        graph_ = {v: {} for v in range(20)}
        for a, b in pairs:
            graph_[a][b] = graph_[b][a] = 1.0
        found = communities._finish_greedy(graph_, {}, 2.0 * len(pairs))
        assert [found[v] for v in range(20)] == communities._finish_greedy_matrix(x, y, paths.np.ones(len(x)), 20, 2.0 * len(pairs)).tolist()


def test_names_alike_but_for_few_characters_are_joined_without_pairs(spark, monkeypatch):
    draw = random.Random(3)
    words = ["".join(draw.choices("ab01", k=draw.randint(1, 5))) for _ in range(12)]
    names = sorted({" ".join(draw.sample(words, draw.randint(1, 5))) for _ in range(150)} | {"", " "})
    rows = spark.createDataFrame([(v, 1 + draw.randrange(3)) for v in names], "value string, n long")
    for t in (0.92, 0.85):
        pairs = [tuple(r) for r in preprocess.similar_pairs(rows, t).collect()]
        links = [tuple(r) for f in (preprocess.similar_pairs(rows, t, far=True), preprocess.near_links(rows, t)) for r in f.collect()]

        def groups(edges):
            name = {v: v for v in names}
            for a, b in edges:
                if name[a] == name[b]:
                    continue
                x, y = sorted((name[a], name[b]))
                name = {v: x if c == y else c for v, c in name.items()}
            return name

        assert groups(pairs) == groups(links) and len(pairs) > 20
    row = spark.range(400).select(F.format_string("Supplier#%09d", "id").alias("value"), F.lit(1).cast("long").alias("n"))
    similar = preprocess.similar_pairs
    seen = []
    monkeypatch.setattr(preprocess, "similar_pairs", lambda *a, **k: seen.append(similar(*a, **k).count()) or similar(*a, **k))
    found = {r["value"]: r["canonical"] for r in preprocess.variant_clusters(row, 0.92).collect()}
    assert len(found) == 399 and set(found.values()) == {"Supplier#000000000"} and seen == [0]  # before, thousands of pairs


def test_triangles_by_bits_and_tiles_of_lists(spark, monkeypatch):
    draw = random.Random(8)
    pairs = sorted({tuple(sorted(draw.sample(range(10**6, 10**6 + 90), 2))) for _ in range(1500)})
    edges = spark.createDataFrame([(*p, 1) for p in pairs], "src long, dst long, weight long")
    frame = pd.DataFrame(pairs, columns=["src", "dst"])
    told = []
    for wedge in (10**9, 0):  # by bits, and not
        monkeypatch.setattr(graph, "WORDS_OF_A_WEDGE", wedge)
        told.append(graph._triangles(frame).sort_values("node").reset_index(drop=True))
    pd.testing.assert_frame_equal(*told)
    tiles = graph._tiles(edges.select("src", "dst"), 3)
    assert tiles.count() < len(pairs) and tiles.agg(F.sum(F.size("far"))).first()[0] == 3 * len(pairs)  # a row for each copy of an edge before
    assert _members(graph.clustering(edges, one_task=100), "triangles") == _members(graph.clustering(edges), "triangles") == dict(zip(told[0]["node"], told[0]["triangles"]))


def test_rounds_send_no_links(spark, monkeypatch):
    edges = _joined_cliques(spark)
    links = checkpoint.bucketed(graph.both_ways(edges).select("a", "b"), "a", 266)
    labels = F.broadcast(links.select(F.col("a").alias("b")).distinct().withColumn("label", F.col("b")))
    plan = links.join(labels, "b").groupBy("a", "label").count()
    assert plan.agg(F.sum("count")).first()[0] == 266 and "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(graph, "cut", lambda *a: 1 / 0)  # before, links were checkpointed and sent in every round
    found = _members(graph.label_propagation(edges, one_task=0))
    assert found == _members(graph.label_propagation(edges, one_task=1_000)) and len(found) == 24
    checkpoint.discard(links)
    assert not spark.catalog.tableExists(links.named)


def test_decorated_pairs_are_sent_as_numbers(spark, monkeypatch):
    kinds, project = [], queries.networks.project
    monkeypatch.setattr(queries.networks, "project", lambda inc, *a: kinds.append(dict(inc.dtypes)["node"]) or project(inc, *a))
    out = row_queries.decorate_all_fields(spark, "/root/testdata/sf0.001")
    assert kinds == ["bigint"] and dict(out.dtypes)["node"] == "string"  # strings before
