"""Networks and measures on graphs small enough to work out by hand."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeloom.corpus import Corpus
from citeloom.operators import aggregates, communities, graph, networks, paths
from citeloom.operators.components import connected_components
from citeloom.schema import NetworkKind


def corpus(spark, rows):
    return Corpus.from_rows(spark, [{"title": "t", **r} for r in rows]).df


def edges_of(df):
    return sorted((r["src"], r["dst"], r["weight"]) for r in df.collect())


def graph_of(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long")


@pytest.mark.parametrize(
    "kind, column, lists, least, expected",
    [
        (NetworkKind.COUPLING, "references_id", {"P1": ["R1", "R2", "R3", None], "P2": ["R1", "R2", "R2"], "P3": ["R3"], "P4": None, "P5": []}, 1, [("P1", "P2", 2), ("P1", "P3", 1)]),
        (NetworkKind.AUTHOR, "authors_id", {"PA": ["A1", "A2"], "PB": ["A1", "A2", "A3"], "PC": ["A2", "A3"]}, 1, [("A1", "A2", 2), ("A1", "A3", 1), ("A2", "A3", 2)]),
        (NetworkKind.AUTHOR, "authors_id", {"PA": ["A1", "A2"], "PB": ["A1", "A2", "A3"], "PC": ["A2", "A3"]}, 2, [("A1", "A2", 2), ("A2", "A3", 2)]),
        (NetworkKind.INSTITUTION, "institutions_id", {"PA": ["I1", "I2"], "PB": ["I1", "I3"], "PC": ["I2", "I3"]}, 1, [("I1", "I2", 1), ("I1", "I3", 1), ("I2", "I3", 1)]),
        (NetworkKind.KEYWORD, "keywords_id", {"PA": ["K1", "K2", "K3"], "PB": ["K1", "K2"], "PC": ["K2", "K3"]}, 1, [("K1", "K2", 2), ("K1", "K3", 1), ("K2", "K3", 2)]),
        (NetworkKind.COCITATION, "cited_by_id", {"P1": ["C1", "C2", "C3"], "P2": ["C1", "C2"], "P3": ["C3", "C4"]}, 1, [("P1", "P2", 2), ("P1", "P3", 1)]),
    ],
)
def test_projection(spark, kind, column, lists, least, expected):
    df = corpus(spark, [{"id": k, column: v} for k, v in lists.items()])
    assert edges_of(networks.network(df, kind, least)) == expected


def test_scope_and_keyword_filter(spark):
    df = corpus(spark, [{"id": "P1", "cited_by_id": ["C1", "C2"]}, {"id": "P2", "is_seed": False, "cited_by_id": ["C1", "C2"]}])
    assert edges_of(networks.network(df, NetworkKind.COCITATION, scope="seeds_only")) == []
    assert edges_of(networks.network(df, NetworkKind.COCITATION)) == [("P1", "P2", 2)]
    words = {"P1": ["Complexity", "Systems thinking"], "P2": ["Ecological economics"], "P3": ["Complexity", "Ecology"], "P4": None, "P5": []}
    df = corpus(spark, [{"id": k, "keywords_raw": v} for k, v in words.items()])
    ids = lambda terms: sorted(r["id"] for r in networks.keyword_filter(df, terms).collect())
    assert ids(["complex"]) == ["P1", "P3"] and ids(["ecolog"]) == ["P2", "P3"] and ids([""]) == ["P1", "P2", "P3"] and len(ids([])) == 5


def test_star_and_triangle(spark):
    star, triangle = graph_of(spark, [(0, 1), (0, 2), (0, 3)]), graph_of(spark, [(0, 1), (0, 2), (1, 2)])
    m = graph.network_metrics(star).first()
    assert (m["nodes"], m["edges"], m["density"], m["components"], m["average_clustering"]) == (4, 3, 0.5, 1, 0.0)
    m = graph.network_metrics(triangle).first()
    assert (m["density"], m["components"], m["average_clustering"]) == (1.0, 1, 1.0)
    c = {r["node"]: r["degree_centrality"] for r in graph.degree_centrality(star).collect()}
    assert c[0] == 1.0 and c[1] == pytest.approx(1 / 3)
    b = {r["node"]: r["betweenness"] for r in paths.betweenness(star).collect()}
    assert b == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.0}


def test_assortativity_and_composition(spark):
    pairs = graph_of(spark, [(0, 1), (2, 3)])
    nodes = spark.createDataFrame([(0, "N"), (1, "N"), (2, "S"), (3, "S")], "id long, place string")
    assert graph.attribute_assortativity(pairs, nodes, "place").first()["r"] == pytest.approx(1.0)
    groups = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "node long, community long")
    found = {(r["community"], r["category"]): r["fraction"] for r in graph.community_composition(groups, nodes, "place").collect()}
    assert found == {(0, "N"): 1.0, (0, "S"): 0.0, (1, "N"): 0.0, (1, "S"): 1.0}


@pytest.mark.parametrize("method", communities.METHODS)
def test_two_cliques_are_two_communities(spark, method):
    clique = [(a, b) for g in (range(5), range(5, 10)) for a in g for b in g if a < b]
    edges = graph_of(spark, [*clique, (4, 5)])
    found = {r["node"]: r["community"] for r in communities.detect_communities(edges, method, seed=3).collect()}
    assert found == {n: n // 5 for n in range(10)}
    assert found == {r["node"]: r["community"] for r in communities.detect_communities(edges, method, seed=3).collect()}


def settled(pairs, found):
    """Whether every node holds a label most common among its neighbours, counted in plain Python."""
    near = {n: [b if a == n else a for a, b in pairs if n in (a, b)] for n in found}
    count = {n: Counter(found[m] for m in ms) for n, ms in near.items()}
    return all(count[n][found[n]] == max(count[n].values()) for n in found)


def test_labels_settle(spark):
    pairs = [(2 * i, 2 * i + 1) for i in range(20)]  # each is one community, whatever the hashes
    found = {r["node"]: r["community"] for r in graph.label_propagation(graph_of(spark, pairs)).collect()}
    assert found == {n: n - n % 2 for n in range(40)}
    clique = [(a, b) for a in range(7) for b in range(a + 1, 7)]
    path = [(i, i + 1) for i in range(100, 130)]
    mixed = [(a, b) for a in range(200, 240) for b in range(a + 1, 240) if (a * a + 7 * b + a * b) % 6 == 0]
    found = {r["node"]: r["community"] for r in graph.label_propagation(graph_of(spark, clique + path + mixed)).collect()}
    assert settled(clique + path + mixed, found) and {found[n] for n in range(7)} == {0}


def test_labels_settle_where_only_nodes_apart_move(spark, monkeypatch):
    monkeypatch.setattr(graph, "FREE_ROUNDS", 0)
    pairs = [(0, 1), (2, 3), (4, 5), (5, 6), (6, 4)]
    found = {r["node"]: r["community"] for r in graph.label_propagation(graph_of(spark, pairs)).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4}
    with pytest.raises(RuntimeError, match="settle"):
        graph.label_propagation(graph_of(spark, pairs), most_rounds=1)


def test_every_community_is_numbered(spark):
    edges = graph_of(spark, [(2 * i, 2 * i + 1) for i in range(30)])
    found = {r["node"]: r["community"] for r in communities.detect_communities(edges, "label_prop").collect()}
    assert found == {n: n // 2 for n in range(60)}


def test_components_of_a_long_chain_a_loop_and_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (None, 3)], "src long, dst long")
    found = {r["node"]: r["component"] for r in connected_components(chain).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 200: 200, 201: 200}
    assert connected_components(chain.limit(0)).count() == 0


def test_cluster_table(spark):
    rows = [
        {"id": "P1", "year": 2020, "curation_status": "accepted", "authors_raw": ["Autor A", "Autor B"], "keywords_id": ["ml", "redes"]},
        {"id": "P2", "year": 2021, "curation_status": "accepted", "authors_raw": ["Autor B", "Autor C"], "keywords_id": ["ml"]},
        {"id": "P3", "year": 2022, "is_seed": False, "authors_raw": ["Autor C"], "keywords_id": ["redes", "grafos"]},
        {"id": "P4", "year": 2019, "is_seed": False, "authors_raw": ["Autor A"], "keywords_id": ["grafos"]},
    ]
    groups = spark.createDataFrame([("P1", 0), ("P2", 0), ("P3", 1), ("P4", 1)], "node string, community long")
    a, b = sorted(aggregates.cluster_table(corpus(spark, rows), groups).collect(), key=lambda r: r["cluster"])
    assert (a["size"], a["seeds"], a["candidates"], a["accepted"], a["year_min"], a["year_max"], a["year_mean"]) == (2, 2, 0, 2, 2020, 2021, 2020.5)
    assert a["top_authors"] == ["Autor B", "Autor A", "Autor C"] and a["top_keywords"] == ["ml", "redes"]
    assert (b["size"], b["seeds"], b["candidates"], b["year_mean"]) == (2, 0, 2, 2020.5) and b["top_keywords"] == ["grafos", "redes"] and b["top_authors"] == ["Autor A", "Autor C"]


def weighed(pairs, found):
    """Modularity by its definition, over pairs of nodes."""
    w, k = {}, Counter()
    for a, b, x in pairs:
        w[a, b] = w[b, a] = x
        k[a] += x
        k[b] += x
    m2 = sum(k.values())
    return sum(w.get((a, b), 0) - k[a] * k[b] / m2 for a in k for b in k if found[a] == found[b]) / m2


def blocks(seed, n=60, groups=4):
    r = random.Random(seed)
    return [(a, b, r.randint(1, 3)) for a in range(n) for b in range(a + 1, n) if r.random() < (0.5 if a % groups == b % groups else 0.06)]


@pytest.mark.parametrize("method", ["louvain", "greedy_modularity"])
def test_levels_by_joins_are_as_good_as_one_task(spark, method, monkeypatch):
    """Planted groups: moves and merges by joins alone come to about the same modularity."""
    monkeypatch.setattr(communities, "MOST_ROUNDS", 3)
    pairs = blocks(5, 40)
    edges = spark.createDataFrame(pairs, "src long, dst long, weight long")
    run = getattr(communities, method)
    small, large = ({r["node"]: r["community"] for r in run(edges, one_task=k).collect()} for k in (10_000, 0))
    planted = weighed(pairs, {n: n % 4 for n in range(40)})
    assert weighed(pairs, small) > 0.8 * planted and weighed(pairs, large) > 0.6 * planted
    if method == "louvain":
        named = spark.createDataFrame(sorted(large.items()), "node long, community long")
        assert communities.modularity(edges, named).first()[0] == pytest.approx(weighed(pairs, large))


@pytest.mark.parametrize("one_task", [0, 1000])
def test_communities_of_odd_networks(spark, one_task):
    none = graph_of(spark, [(0, 1)]).limit(0)
    assert communities.louvain(none, one_task=one_task).count() == communities.greedy_modularity(none, one_task=one_task).count() == 0
    star = graph_of(spark, [(0, k) for k in range(1, 6)] + [(9, 8)])
    for run in [communities.louvain, communities.greedy_modularity][: 2 if one_task else 1]:
        found = {x["node"]: x["community"] for x in run(star, one_task=one_task).collect()}
        assert found[8] == found[9] == 8 and all(found[x] < 8 for x in range(6))


def brandes(pairs):
    """Betweenness by its definition: the share of shortest paths between all other pairs."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    dist, paths = {}, {}
    for s in near:
        d, p, row = {s: 0}, Counter({s: 1}), [s]
        for v in row:
            for w in near[v]:
                if w not in d:
                    d[w] = d[v] + 1
                    row.append(w)
                if d[w] == d[v] + 1:
                    p[w] += p[v]
        dist[s], paths[s] = d, p
    n, out = len(near), {}
    for v in near:
        total = sum(paths[s][v] * paths[v][t] / paths[s][t] for s in near for t in near if len({s, t, v}) == 3 and t in dist[s] and v in dist[s] and dist[s][v] + dist[v][t] == dist[s][t])
        out[v] = total / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return out


@pytest.mark.parametrize("batch_rows", [None, 1500])
def test_betweenness(spark, batch_rows):
    r = random.Random(7)
    pairs = sorted({(a, b) for a, b in ((r.randrange(25), r.randrange(25)) for _ in range(40)) if a < b} | {(100, 101), (101, 102), (102, 103), (200, 201)})
    found = {x["node"]: x["betweenness"] for x in paths.betweenness(graph_of(spark, pairs), batch_rows).collect()}
    assert found == pytest.approx(brandes(pairs))


def test_betweenness_of_little(spark):
    assert paths.betweenness(graph_of(spark, [(0, 1)]).limit(0)).count() == 0
    assert {tuple(x) for x in paths.betweenness(graph_of(spark, [(0, 1)])).collect()} == {(0, 0.0), (1, 0.0)}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_projection_of_heavy_groups(spark, monkeypatch, least):
    """Groups of many blocks, repeated rows, nulls and nodes in one group give the edges of the plain definition."""
    monkeypatch.setattr(networks, "BLOCK", 5)
    r = random.Random(3)
    rows = [(n, g) for g in range(6) for n in r.sample(range(60), (2, 3, 5, 11, 40, 60)[g])] + [(k, 100 + k) for k in range(20)] + [(None, 1), (7, None), (3, 5), (3, 5)]
    inc = spark.createDataFrame(rows, "node long, grp long")
    held = {}
    for n, g in set(rows):
        if n is not None and g is not None:
            held.setdefault(g, []).append(n)
    expected = Counter((a, b) for ns in held.values() for a in ns for b in ns if a < b)
    found = {(x["src"], x["dst"]): x["weight"] for x in networks.project(inc, least).collect()}
    assert found == {k: v for k, v in expected.items() if v >= least}


def test_no_task_has_a_heavy_group_alone(spark, monkeypatch):
    """Pairs of one group that holds all nodes are made in all partitions alike."""
    monkeypatch.setattr(networks, "BLOCK", 50)
    inc = spark.range(1000).selectExpr("id as node", "1 as grp")
    edges = networks.project(inc)
    assert edges.count() == 1000 * 999 // 2
    inner = inc.selectExpr("grp", "node", "pmod(xxhash64(node), 20) as own").selectExpr("grp", "node", "own", "explode(sequence(0, 19)) as other").selectExpr("grp", "least(own, other) as i", "greatest(own, other) as j")
    parts = [x["count"] for x in inner.repartition(4, "grp", "i", "j").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(parts) == 4 and max(parts) < 2 * min(parts)


def test_build_preview_says_why(spark):
    df = corpus(spark, [{"id": "P1", "keywords_raw": ["a"], "authors_id": ["x"]}, {"id": "P2", "references_id": ["R"]}])
    rows = {r["kind"]: r for r in networks.build_preview(df).collect()}
    assert all(r["would_be_empty"] for r in rows.values())
    assert rows["bibliographic_coupling"]["reason"].startswith("1/2 papers with references_id but") and rows["institution_collab"]["reason"] == "0/2 papers with institutions_id"
    assert "thesaurus" in rows["keyword_cooccurrence"]["fix"] and rows["cocitation"]["reason"] == "0/2 seeds with cited_by_id"
