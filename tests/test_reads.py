"""Read models and the workspace operations around them."""

import pytest

from citeloom.corpus import Corpus
from citeloom.errors import DataError, UsageError
from citeloom.operators import aggregates, graph, scent
from citeloom.plans.networks import NetworkSpec, build
from citeloom.sources.search import EquationSpec
from citeloom.store import Snapshot, StoreError
from citeloom.workspace import Workspace


def papers(spark, *rows):
    return Corpus.from_rows(spark, [{"title": f"t{r['id']}", **r} for r in rows]).df


def test_growth_estimate(spark):
    bare = papers(spark, {"id": "A", "references_id": ["X", "Y", "B", ""]}, {"id": "B", "source_id": "W"})
    assert tuple(scent.growth_estimate(bare).first()) == (2, 0, 2, True, False, False)
    cited = papers(spark, {"id": "A", "references_id": ["X", "Y"], "cited_by_id": ["P", "Q", "R", "W"]}, {"id": "B", "source_id": "W"})
    assert tuple(scent.growth_estimate(cited, limit=2).first()) == (2, 2, 4, False, True, True)
    assert tuple(scent.growth_estimate(cited, "forward").first()) == (None, 3, 3, False, True, False)
    assert tuple(scent.growth_estimate(cited, "backward").first()) == (2, None, 2, False, False, False)
    assert tuple(scent.growth_estimate(bare.limit(0)).first()) == (0, 0, 0, True, False, False)
    with pytest.raises(ValueError):
        scent.growth_estimate(bare, "up")


def test_surroundings_network_and_url(spark, tmp_path):
    ws = Workspace.init(spark, tmp_path / "ws")
    ws.seed(papers(spark, {"id": "A", "doi": "10.1/a", "references_id": ["R", "S", "B"], "cited_by_id": ["C", "Z"]}, {"id": "B", "references_id": ["R", "S"]}, {"id": "C", "references_id": ["S"]}, {"id": "D"}))
    around = sorted(tuple(r) for r in ws.surroundings("A").collect())
    assert around == [("cited_by", "C", "tC", None), ("coupling", "B", "tB", 2), ("coupling", "C", "tC", 1), ("references", "B", "tB", None)]
    assert ws.surroundings("D").collect() == []
    with pytest.raises(DataError):
        ws.surroundings("nobody")
    assert ws.url("A") == "https://doi.org/10.1/a" and ws.url("B") is None and ws.url("nobody") is None
    record = ws.network("bibliographic_coupling")
    assert {(r["source"], r["target"], r["weight"]) for r in record.edges.collect()} == {("A", "B", 2), ("A", "C", 1), ("B", "C", 1)}
    assert record.metrics == {"n_nodes": 3, "n_edges": 3, "density": 1.0, "num_components": 1, "avg_clustering": 1.0, "n_communities": 1}
    assert {"id", "label", "degree_centrality", "community", "year", "is_seed", "curation_status"} == set(record.nodes.columns)
    assert ws.network("keyword_cooccurrence").metrics["n_nodes"] == 0
    with pytest.raises(DataError):
        ws.network("friends")


def test_rounds_compared(spark, tmp_path):
    ws = Workspace.init(spark, tmp_path / "ws")
    ws.seed(papers(spark, {"id": "A", "references_id": ["R"]}, {"id": "B", "references_id": ["R"]}))
    ws.build([NetworkSpec(kind="bibliographic_coupling")])
    assert ws.snapshot("one").manifest["maturity"] == {"curated": False, "scope": "all", "saturated": False, "empty_networks": []}
    ws.seed(papers(spark, {"id": "C", "references_id": ["R"]}, {"id": "D", "references_id": ["Q"]}))
    with_live = ws.compare("one", "live")  # the networks are older than the library: sizes only
    assert {tuple(r) for r in with_live.changes.collect()} == {("C", "added"), ("D", "added")} and with_live.metrics == [{"metric": "n_papers", "before": 2, "after": 4}]
    ws.build([NetworkSpec(kind="bibliographic_coupling")])
    assert {m["metric"]: (m["before"], m["after"]) for m in ws.compare("one", "live").metrics} == {"n_papers": (2, 4), "n_communities:bibliographic_coupling": (1, 1), "density:bibliographic_coupling": (1.0, 1.0)}
    assert {p.name for p in ws.export(("graphml",))[0].iterdir()} == {"network.graphml"}
    with pytest.raises(UsageError):
        ws.export(("pdf",))
    with pytest.raises(DataError):
        ws.compare("one", "two")
    with pytest.raises(UsageError):
        ws.snapshot("live")
    manifest = ws.snapshots / "one" / "manifest.json"
    manifest.write_text(manifest.read_text().replace('"schema_version": 1', '"schema_version": 2'))
    with pytest.raises(StoreError):
        Snapshot(spark, ws.snapshots / "one")


def test_seeding_from_an_equation_and_bibtex(spark, tmp_path):
    ws = Workspace.init(spark, tmp_path / "ws")
    equation = EquationSpec(query='"water quality" AND river*')
    told = ws.preview_seed(equation)
    assert told["preview"] and "water quality" in told["executed_query"] and told["translation"]
    works = papers(spark, {"id": "A", "abstract": "Water quality of rivers", "references_id": ["R"]}, {"id": "B", "abstract": "water"})
    assert ws.seed_from_equation(works, equation)["papers_added"] == 1
    (tmp_path / "x.bib").write_text("@article{k, title={Lakes}, year={2001}}", encoding="utf-8")
    assert ws.seed_from_bibtex(str(tmp_path / "x.bib")) == {"papers_added": 1, "total": 2, "round": 2, "reseeded": True}
    assert ws.preview_chain()["estimated_new"] == 1


def test_mixing_tells_what_it_leaves_out_and_what_it_stands_on(spark, caplog):
    c = papers(spark, *[{"id": x, "references_id": ["R"], "language": "en" if x < "C" else "fr"} for x in "ABC"])
    with caplog.at_level("WARNING"):
        a = build(c, NetworkSpec(kind="bibliographic_coupling", assortativity_attribute="colour"))
    assert a.assortativity == {} and "colour" in caplog.text
    a = build(c, NetworkSpec(kind="bibliographic_coupling", assortativity_attribute="language"))
    assert {(r["category"], round(r["fraction"], 3)) for r in a.composition.collect()} == {("en", 0.667), ("fr", 0.333)}
    told = graph.mixing(a.edges, c, "language", by_degree=False, proxy="publisher")
    assert set(told) == {"attribute_assortativity", "proxy_disclaimer"} and "publisher" in told["proxy_disclaimer"]
    assert aggregates.maturity_block(c, "accepted", ["cocitation"]) == {"curated": False, "scope": "accepted", "saturated": False, "empty_networks": ["cocitation"]}
