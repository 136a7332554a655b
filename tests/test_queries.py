"""Queries on tables small enough to work out in plain Python: nothing of their input may be left out."""

from datetime import datetime
from itertools import combinations

import pytest

from citeloom import queries


def tables(spark, folder, **rows):
    """A folder of tables, each given as (schema, rows)."""
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def star_tables(spark, folder, lines, names=None, **more):
    """The star schema around order lines (order, part, supplier); parts are named by ``names``."""
    orders, parts, suppliers = ({x[k] for x in lines} for k in range(3))
    return tables(
        spark, folder, **more,
        lineitem=("l_orderkey long, l_partkey long, l_suppkey long", lines),
        orders=("o_orderkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string", [(o, "F", datetime(2000, 1, 1), "5-LOW") for o in sorted(orders)]),
        part=("p_partkey long, p_name string, p_brand string", [(p, (names or {}).get(p, "none"), "Brand#1") for p in sorted(parts)]),
        supplier=("s_suppkey long, s_nationkey int", [(s, 1) for s in sorted(suppliers)]),
    )


#: Suppliers that meet in few orders, and parts that meet in one.
LINES = [(o, 100 + (o * 3 + k * k) % 11, s) for o in range(14) for k, s in enumerate(((o * o) % 7, (o * 3 + 1) % 8, (o + 4) % 9))]


def neighbours(lines, k):
    """{node: neighbours} of the whole network in which orders link their parts (k = 1) or suppliers (k = 2)."""
    near = {}
    for o in {x[0] for x in lines}:
        for a, b in combinations(sorted({x[k] for x in lines if x[0] == o}), 2):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


def test_abstracts_are_rebuilt_whole(spark, tmp_path):
    long = " ".join(f"w{i % 700}" for i in range(3000))
    d = tables(spark, tmp_path, documents=("doc_id long, text string", [(1, f"  a\tb \n a {long} the end "), (2, " \n"), (3, "x" * 900)]))
    found = {r["doc_id"]: r["abstract"] for r in queries.abstract_rebuild(spark, d).collect()}
    assert found == {1: f"a b a {long} the end", 3: "x" * 900}


def test_clustering_of_the_whole_author_network(spark, tmp_path):
    near = neighbours(LINES, 2)
    found = {r["node"]: (r["triangles"], r["clustering"]) for r in queries.clustering_coefficients(spark, star_tables(spark, tmp_path, LINES)).collect()}
    closed = {n: sum(b in near[a] for a, b in combinations(ms, 2)) for n, ms in near.items()}
    assert any(closed.values())
    assert found == {n: (t, pytest.approx(2 * t / max(1, len(near[n]) * (len(near[n]) - 1)), abs=1e-6)) for n, t in closed.items()}


def test_identifiers_resolve_in_all_orders(spark, tmp_path):
    users = [3, 58, 59, 60, 61, 62, 199, 200, 201]
    d = star_tables(spark, tmp_path, [(o, 1, 1) for o in range(200)], events=("user_id long", [(u,) for u in users]))
    ident = lambda u: (str(u), f"https://doi.org/10.5/A{u}", f"W{u}")[u % 3]
    assert {r["ident"]: r["id"] for r in queries.resolve_ident(spark, d).collect()} == {ident(u): str(u) if u < 200 else None for u in users}


def test_every_part_has_its_citers(spark, tmp_path):
    lines = [(o, p, 1) for p in range(1, 8) for o in range(2 * p)]
    found = {r["target"]: r["citers"] for r in queries.citers_capped(spark, star_tables(spark, tmp_path, lines)).collect()}
    assert found == {str(p): ",".join(sorted(str(o) for o in range(2 * p))[:10]) for p in range(1, 8)}


def paths(near, a, b):
    """All shortest paths from a to b, by trying lengths one after the other."""
    found, now = [], [[a]]
    while now and not found:
        now = [[*p, n] for p in now for n in near[p[-1]] if n not in p]
        found = [p for p in now if p[-1] == b]
    return found


def test_measures_see_whole_networks(spark, tmp_path):
    d, authors, parts = star_tables(spark, tmp_path, LINES), neighbours(LINES, 2), neighbours(LINES, 1)
    expected = dict.fromkeys(authors, 0.0)
    for a, b in combinations(authors, 2):
        between = paths(authors, a, b)
        for n in (n for p in between for n in p[1:-1]):
            expected[n] += 2 / len(between) / ((len(authors) - 1) * (len(authors) - 2))
    assert {r["node"]: r["betweenness"] for r in queries.betweenness(spark, d).collect()} == pytest.approx(expected) and any(expected.values())
    nodes = lambda df: sorted(r["node"] for r in df.select("node").collect())
    assert nodes(queries.greedy_modularity(spark, d)) == sorted(authors)
    assert nodes(queries.louvain(spark, d)) == nodes(queries.label_propagation(spark, d)) == sorted(parts)


def test_every_name_is_in_the_thesaurus(spark, tmp_path):
    names = {p: f"{('red', 'blue', 'green')[p % 3]} thing{p}" for p in range(1500)}
    d = star_tables(spark, tmp_path, [(p // 3, p, 1) for p in names], names)
    found = {r["id"]: r["words"] for r in queries.thesaurus_map(spark, d).collect()}
    assert found == {str(o): f"colour_blue,colour_red,green thing{3 * o + 2}" for o in range(500)}
