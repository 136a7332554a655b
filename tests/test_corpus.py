"""Identity, merge, curation, filters, scent, preprocessing and storage."""

import hashlib
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.corpus import Corpus
from citeloom.cycle import CycleState, apply_transition, available_transitions, next_best_action
from citeloom.errors import DataError, envelope
from citeloom.functions import provenance as prov, text
from citeloom.operators import filters, merge, preprocess, scent
from citeloom.schema import SchemaError, conform, problems, validate
from citeloom.sinks.files import read_curation_sheet, read_graphml, write_csv, write_graphml
from citeloom.sources import bibtex, search, works_json
from citeloom.store import Snapshot, Store, StoreError
from citeloom.workspace import Workspace


def corpus(spark, *rows):
    return Corpus.from_rows(spark, [{"title": "t", **r} for r in rows])


def ids(df):
    return [r["id"] for r in df.collect()]


def test_ids(spark):
    short = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    rows = [{"doi": "https://doi.org/10.1/AB", "title": "x"}, {"source_id": "W1", "title": "x"}, {"title": " \tA b\n", "year": 2000}, {"title": "Ab"}]
    assert ids(Corpus.from_rows(spark, rows).table) == [f"doi:{short('10.1/ab')}", f"src:{short('W1')}", f"tt:{short('a b|2000')}", f"tt:{short('ab|None')}"]


def test_validate(spark):
    c = corpus(spark, {"id": "A"})
    validate(c.df)
    with pytest.raises(SchemaError, match="missing column: abstract"):
        validate(c.df.drop("abstract", "year"))
    with pytest.raises(SchemaError, match="year"):
        validate(c.df.withColumn("year", F.lit("2000")))
    with pytest.raises(SchemaError, match="title"):
        validate(c.df.withColumn("title", F.lit(None).cast("string")))
    row = problems(c.df.withColumn("curation_status", F.lit("odd"))).first()
    assert (row["papers"], row["empty_id"], row["bad_status"]) == (1, 0, 1)


def test_merge_fixture_and_laws(spark):
    a = corpus(spark, {"id": "A", "title": "Paper A", "keywords_id": ["b", "a"]}, {"id": "B", "year": 1999})
    b = corpus(spark, {"id": "C"}, {"id": "A", "title": "Paper A bis", "keywords_id": ["c", None, "a"], "is_seed": False})
    m = a.merge(b)
    rows = m.table.collect()
    assert [r["id"] for r in rows] == ["A", "B", "C"]
    assert rows[0]["title"] == "Paper A bis" and rows[0]["keywords_id"] == ["a", "b", "c"] and rows[0]["is_seed"] is False and rows[1]["year"] == 1999
    assert m.merge(m) == m and a.merge(a).merge(a) == a.merge(a)
    assert a != b and Corpus(a.df.orderBy(F.desc("id"))) == a
    assert Corpus(a.df.withColumn("provenance", F.lit("[]"))) == a


def test_hash_tells_null_from_empty(spark):
    a, b = corpus(spark, {"id": "A", "keywords_id": None}), corpus(spark, {"id": "A", "keywords_id": []})
    assert a.hash() != b.hash()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ABCD"), st.lists(st.sampled_from("xyz"), max_size=3), st.one_of(st.none(), st.integers(1990, 1993))), min_size=1, max_size=5))
def test_merging_again_changes_nothing(spark, rows):
    c = corpus(spark, *({"id": i, "keywords_id": k, "year": y} for i, k, y in rows))
    once = c.merge(c)
    assert once.merge(c) == once


def test_later_decision_wins(spark):
    a = corpus(spark, {"id": "A"}).accept(["A"], at="2024-01-01T00:00:00")
    b = corpus(spark, {"id": "A"}).reject(["A"], at="2024-02-01T00:00:00")
    both = a.merge(b).df.select("curation_status", F.size(prov.parse(F.col("provenance"))).alias("n")).first()
    assert (both["curation_status"], both["n"]) == ("rejected", 2)
    assert b.merge(a).df.first()["curation_status"] == "rejected"
    assert corpus(spark, {"id": "A"}).merge(a).df.first()["curation_status"] == "accepted"


def test_duplicates_in_a_batch_fold(spark):
    batch = corpus(spark, {"id": "X", "year": 1, "keywords_id": ["b"]}, {"id": "X", "year": None, "keywords_id": ["a"]}, {"id": "X", "title": "last"})
    r = merge.fold_duplicates(batch.df).first()
    assert (r["year"], r["title"], r["keywords_id"]) == (1, "last", ["a", "b"])


def test_filter_flow(spark):
    data = [("P1", 2015, "en", 2), ("P2", 2020, "en", 3), ("P3", 2021, "es", 1), ("P4", 2022, "en", 0), ("P5", 2023, "fr", 2)]
    c = corpus(spark, *({"id": i, "year": y, "language": g, "cited_by_id": [str(k) for k in range(n)]} for i, y, g, n in data))
    out, steps = filters.apply_filters(c.df, filters.standard_criteria(min_year=2018, languages=["en", "es"], min_citations=2), "2024")
    assert [(s.count_before, s.count_after) for s in steps] == [(5, 4), (4, 3), (3, 1)] and out.count() == 5
    extra = corpus(spark, {"id": "N", "year": None}, {"id": "K", "year": 1900, "curation_status": "accepted"})
    out, _ = filters.apply_filters(extra.df, [filters.FilterCriterion("year", "gte", 2000)], "2024")
    assert {r["id"]: r["curation_status"] for r in out.collect()} == {"N": "rejected", "K": "accepted"}
    with pytest.raises(ValueError):
        filters.FilterCriterion("venue", "eq", "x")


def test_scent(spark):
    c = corpus(spark, {"id": "P1", "source_id": "W1", "references_id": ["A", "B", "C", "A", "P2"]}, {"id": "P2", "source_id": "W2", "references_id": ["A", "B", "W1"]}, {"id": "P3", "references_id": ["A"]})
    assert [(r["id"], r["scent"]) for r in scent.ranked(scent.backward_scent(c.df)).collect()] == [("A", 3), ("B", 2), ("C", 1)]
    citing = spark.createDataFrame([("Y1", ["P1", "W2"]), ("Y2", ["P1"]), ("Y3", ["W2"]), ("Y4", ["EXT"]), ("P1", ["P2"])], "id string, references_id array<string>")
    assert [(r["id"], r["scent"]) for r in scent.ranked(scent.forward_scent(c.df, citing)).collect()] == [("Y1", 2), ("Y2", 1), ("Y3", 1)]
    with pytest.raises(NotImplementedError):
        scent.chain(c.df, depth=2)


def test_normalise(spark):
    rows = [(["García, Luis", "MÜLLER, Hans"],), (["  Smith,   John  "],), (None,), ([],)]
    df = spark.createDataFrame(rows, "a array<string>").select(text.normalize_list(F.col("a")).alias("x"))
    assert [r["x"] for r in df.collect()] == [["garcia, luis", "muller, hans"], ["smith, john"], None, None]
    df = spark.createDataFrame([("en-US",), ("es_419",), ("ES",), ("",), (None,)], "a string").select(text.normalize_language(F.col("a")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["en", "es", "es", None, None]


@pytest.mark.parametrize("t, names, expected", [(0.85, {"john smith": 1, "john smyth": 1}, {"john smyth": "john smith"}), (0.92, {"john smith": 1, "alice johnson": 1}, {}), (0.70, {"john smith": 3, "j smith": 1}, {"j smith": "john smith"}), (0.50, {"anna a": 1, "anna b": 1, "anna c": 1}, {"anna b": "anna a", "anna c": "anna a"})])
def test_fuzzy(spark, t, names, expected):
    df = spark.createDataFrame(sorted(names.items()), "value string, n long")
    assert {r["value"]: r["canonical"] for r in preprocess.variant_clusters(df, t).collect()} == expected


def test_fuzzy_pairs_lose_none(spark):
    names = sorted({f"{a} {b}" for a in ("maria", "mario", "marian", "marta") for b in ("lopez", "lopes", "gomez", "x")} | {"lopez maria", "", "q"})
    for t in (0.9, 0.8):
        want = {(a, b) for a in names for b in names if a < b and text.token_sort_ratio(a, b) >= 100 * t}
        got = {(r["a"], r["b"]) for r in preprocess.similar_pairs(spark.createDataFrame([(n,) for n in names], "value string"), t).collect()}
        assert got == want


@pytest.mark.parametrize("t", [0.6, 0.9, 1.0])
def test_fuzzy_pairs_by_brute_force(spark, t):
    """Variants of all lengths, many with one beginning, each pair once."""
    r = random.Random(11)
    names = {"", "  ", "a", "ab", "b a", "ba", "aa aa"}
    for k in range(70):
        base = r.choice(["university of ", "", "inst "]) + "".join(r.choice("abcde ") for _ in range(r.randint(1, 14)))
        names.add(base)
        for _ in range(2):
            x = list(base)
            for _ in range(r.randint(0, 3)):
                x[r.randrange(len(x) + 1) : r.randrange(len(x) + 1)] = r.choice(["", "a", "xy"])
            names.add("".join(x))
    names = sorted(names)
    rows = spark.createDataFrame([(x, 1) for x in names], "value string, n long")
    found = [tuple(x) for x in preprocess.similar_pairs(rows, t).collect()]
    blank = sorted(x for x in names if not x.strip())
    expected = {(a, b) for a in names for b in names if a < b and a.strip() and b.strip() and text.token_sort_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) >= 100 * t}
    assert len(found) == len(set(found)) and set(found) == expected | {(blank[0], x) for x in blank[1:]}


def test_a_common_beginning_makes_no_large_block(spark):
    """Of 3,000 names that all begin alike, only few pairs are made before the similarity."""
    r = random.Random(12)
    names = sorted({"department of " + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for _ in range(3000)})
    twin = names[5][:-1] + "#"
    rows = spark.createDataFrame([(x, 1) for x in [*names, twin]], "value string, n long")
    assert [tuple(x) for x in preprocess.similar_pairs(rows, 0.92).collect()] == [tuple(sorted((names[5], twin)))]


def test_thesaurus(spark):
    entries = {"unequal_exchange": {"en": ["Unequal exchange"], "es": ["Intercambio ecológico desigual"]}}
    c = corpus(spark, {"id": "A", "keywords_raw": ["unequal Exchange", "intercambio ecologico desigual", "Ótro"]}, {"id": "B", "keywords_id": ["kept"]})
    out = {r["id"]: r["keywords_id"] for r in preprocess.apply_thesaurus(c.df, preprocess.thesaurus(spark, entries)).collect()}
    assert out == {"A": ["unequal_exchange", "otro"], "B": ["kept"]}


def test_works_json(spark, tmp_path):
    work = """[{"id": "https://x.org/W1", "doi": "https://doi.org/10.1/A", "title": "T", "publication_year": 2001, "abstract_inverted_index": {"b": [1, 3], "a": [0]},
      "authorships": [{"author": {"id": "https://x.org/A1", "display_name": "Ann", "orcid": "https://orcid.org/0-1"}, "institutions": [{"id": "https://x.org/I1", "display_name": "Inst", "country_code": null}]}, {"author": {"id": null, "display_name": ""}, "institutions": [{"id": "https://x.org/I1", "display_name": "Inst"}]}],
      "keywords": [{"id": "https://x.org/k/1", "display_name": "Kw"}], "referenced_works": ["https://x.org/W2", ""]}, {"id": "https://x.org/W9", "title": null, "display_name": "D"}]"""
    (tmp_path / "works.json").write_text(work)
    a, b = works_json.load(spark, str(tmp_path / "works.json")).orderBy("source_id").collect()
    assert (a["source_id"], a["doi"], a["abstract"], a["authors_id"], a["authors_raw"]) == ("W1", "10.1/a", "a b  b", ["0-1", "unknown"], ["Ann"])
    assert a["authors_affiliations"] == ["Inst (??)", "Inst (??)"] and a["institutions_id"] == ["I1"] and a["references_id"] == ["W2"] and a["keywords_id"] == ["1"]
    assert b["title"] == "D" and b["authors_id"] is None and b["cited_by_id"] == [] and b["abstract"] is None
    validate(conform(works_json.load(spark, str(tmp_path / "works.json"))))


def test_bibtex(spark, tmp_path):
    (tmp_path / "a.bib").write_text('@comment{x}\n@string{j = "Journal"}\n@article{k1, title = {A {B} c}, author = {Doe, Jane and {Corp Inc}}, year = 2001, journal = j, doi = "https://doi.org/10.1/X", keywords = {a, b; c}}\n@book{k2, author = {No Title}}\n@inproceedings{k3, title = "Conf", booktitle = {Proc}, year = {n.d.}}', encoding="utf-8")
    a, b = sorted(bibtex.load(spark, str(tmp_path / "a.bib")).collect(), key=lambda r: r["title"])
    assert (a["title"], a["authors_raw"], a["year"], a["source"], a["doi"], a["keywords_raw"]) == ("A B c", ["Doe, Jane", "Corp Inc"], 2001, "Journal", "10.1/x", ["a", "b", "c"])
    assert (b["title"], b["source"], b["year"], b["cited_by_id"]) == ("Conf", "Proc", None, None)
    with pytest.raises(ValueError):
        list(bibtex.entries("@article{k, title = {never closed"))


def test_search(tmp_path):
    assert search.translate("a AND b", exclude=['x "y"', " "], min_year=2000, max_year=2001)[0] == 'title_and_abstract.search:(a AND b) AND NOT "x y",from_publication_date:2000-01-01,to_publication_date:2001-12-31'
    assert search.translate("q", native=True)[0] == "q" and len(search.translate("TS=a NEAR/3 b*")[1]) == 3
    (tmp_path / "e.yaml").write_text("equation: {query: a, odd: 1}")
    with pytest.raises(SchemaError, match="odd"):
        search.load_equation(tmp_path / "e.yaml")
    waits, answers = [], iter([(429, {}), (503, {}), (200, {"results": [{"id": 1}], "meta": {"next_cursor": None}})])
    assert list(search.pages(lambda c, n: next(answers), 5, waits.append)) == [{"id": 1}] and waits == [1.0, 2.0]
    with pytest.raises(search.SourceError):
        search.with_retry(lambda: (404, {}))


def test_works_api_pushes_conditions_and_columns(spark, tmp_path):
    from citeloom.sources.api import WorksApi

    (tmp_path / "log").mkdir()
    rows = [(f"W{k}", f"t{k}", 2000 + k % 4, k) for k in range(250)] + [("W900", "no year", None, 1)]
    spark.createDataFrame(rows, "id string, title string, publication_year int, cited_by_count long").write.json(f"{tmp_path}/works")
    session = spark.newSession()
    session.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    session.dataSource.register(WorksApi)

    def asked():
        out = sorted((tuple(json.loads(p.read_text()).values()) for p in (tmp_path / "log").iterdir()), key=str)
        for p in (tmp_path / "log").iterdir():
            p.unlink()
        return out

    def api(schema):
        return session.read.format("works_api").schema(schema).option("fetch", "citeloom.sources.api:replay").option("path", f"{tmp_path}/works").option("log", f"{tmp_path}/log").load()

    found = api("id string, publication_year int").where("publication_year between 2001 and 2002").collect()
    assert sorted(map(tuple, found)) == sorted((x[0], x[2]) for x in rows if x[2] in (2001, 2002))
    assert asked() == [(f"from_publication_date:{y}-01-01,to_publication_date:{y}-12-31", "id,publication_year", "*") for y in (2001, 2002)]
    wanted = [f"W{k}" for k in range(120)]
    assert sorted(r["id"] for r in api("id string, title string").where(F.col("id").isin(wanted)).collect()) == sorted(wanted)
    assert len(asked()) == 2  # batches of a hundred ids
    whole = api("id string, work string").collect()
    assert len(whole) == 251 and json.loads(whole[0]["work"])["id"] == whole[0]["id"] and [x[2] for x in asked()] == ["*", "100", "200"]


def test_store_restart_and_lock(spark, tmp_path):
    with Store(spark, tmp_path / "lib") as s:
        s.persist(corpus(spark, {"id": "A"}, {"id": "B"}).df)
        with pytest.raises(StoreError):
            Store(spark, tmp_path / "lib")
        s.persist(corpus(spark, {"id": "C"}, {"id": "A", "title": "new"}).df)
        s.set_state("SEEDED", 1)
        s.add_external_id("A", "e", "1")
        s.add_external_id("A", "e", "2")
    with Store(spark, tmp_path / "lib", readonly=True) as s:
        assert [(r["id"], r["title"]) for r in s.load().collect()] == [("A", "new"), ("B", "t"), ("C", "t")]
        assert s.state() == ("SEEDED", 1) and [r["id"] for r in s.external_ids("A").collect()] == ["2"]
        assert s.sql("select count(*) n from corpus").first()["n"] == 3
    with pytest.raises(StoreError):
        Store(spark, tmp_path / "none", readonly=True)


def test_persist_writes_only_the_buckets_it_touches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("citeloom.store.BUCKET_ROWS", 10)
    papers = corpus(spark, *[{"id": f"P{k}", "doi": f"10.1/{k}", "year": 2000} for k in range(80)])
    with Store(spark, tmp_path / "lib") as store:
        store.persist(papers.df)
        first = store._listed(store._version())
        before = store.papers()
        store.persist(corpus(spark, {"id": "P7", "doi": "10.1/7", "year": 2021}, {"id": "NEW", "doi": "10.1/new"}, {"id": "P7", "title": "again"}).df)
        second = store._listed(store._version())
        changed = [b for b in second["buckets"] if second["buckets"][b] != first["buckets"].get(b)]
        assert first["n"] == 8 and 1 <= len(changed) <= 2
        rows = {r["id"]: r for r in store.papers().collect()}
        assert len(rows) == 81 and rows["P7"]["year"] == 2021 and rows["P7"]["title"] == "again" and rows["P7"]["_seq"] == 8 and rows["NEW"]["_seq"] > 80 and second["last"] == rows["NEW"]["_seq"]
        assert ids(store.load())[-1] == "NEW" and {r["year"] for r in before.collect()} == {2000}  # a reader of the version before
        whole = {r["id"]: r for r in merge.merge(papers.df, corpus(spark, {"id": "P7", "doi": "10.1/7", "year": 2021}, {"id": "NEW", "doi": "10.1/new"}, {"id": "P7", "title": "again"}).df).collect()}
        assert {k: tuple(r[c] for c in ("doi", "year", "title", "curation_status")) for k, r in rows.items()} == {k: tuple(r[c] for c in ("doi", "year", "title", "curation_status")) for k, r in whole.items()}
        for k in range(7):  # folders that no kept version names go
            store.persist(corpus(spark, {"id": "P7", "year": 2030 + k}).df)
        named = {f for p in store.path.glob("list-*.json") for f in store._listed(p.stem)["buckets"].values()}
        assert {str(f.relative_to(store.path)) for f in store.path.glob("data-*/bucket=*")} == named and store.papers().where("year = 2036").count() == 1


def test_enrichment_records(spark, tmp_path):
    ws = Workspace.init(spark, tmp_path / "ws")
    rows = [
        {"id": "A", "source_id": "https://x.org/W1", "curation_status": "accepted", "references_id": ["R1", "R2"], "cited_by_id": ["z9"]},
        {"id": "B", "source_id": "W2", "references_id": ["R1"], "cited_by_id": ["z9"]}, {"id": "C", "source_id": "W3", "curation_status": "accepted"},
    ]
    with ws.store() as store:
        store.replace(corpus(spark, *rows).df)
    works = spark.createDataFrame([(f"c{k}", ["W1", "W2"]) for k in range(5)], "id string, references_id array<string>")
    lookup = spark.createDataFrame([("R1", "10.1/r")], "id string, doi string")
    assert ws.enrich(works, lookup, max_citing=3) == {"references_doi": {"resolved": 1, "total_unique_refs": 2}, "cited_by": {"resolved": 3, "total": 2}}
    with ws.store(readonly=True) as store:
        found = {r["id"]: r for r in store.papers().collect()}
        assert [found[k]["cited_by_id"] for k in "ABC"] == [["c0", "c1", "c2"], ["z9"], []] and found["A"]["references_doi"] == ["10.1/r", None]
        assert store.enrichers()["cited_by"] == {"resolved": "3", "total": "2"}
    with pytest.raises(DataError, match="no query"):
        ws.preview_seed(search.EquationSpec("  "))


def test_workspace_loop(spark, tmp_path):
    ws = Workspace.init(spark, tmp_path / "ws")
    data = [{"id": f"P{k}", "source_id": f"W{k}", "year": 2000 + k, "references_id": ["R1", "R2", f"R{k}"], "authors_id": [f"A{k}", "B"]} for k in range(3)]
    assert ws.seed(corpus(spark, *data).df)["papers_added"] == 3
    top = ws.chain(direction="backward")["top"]
    assert top[:2] == [("R1", 3), ("R2", 3)]
    assert ws.curate(["W1"], "accepted") == 1 and ws.paper("P1")["curation_status"] == "accepted"
    with pytest.raises(DataError):
        ws.curate(["nobody"], "accepted")
    built = ws.build()
    assert built[0].metrics["edges"] == 3 and (ws.networks / "bibliographic_coupling" / "nodos.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    assert ws.export() and ws.status()["state"] == "BUILT" and ws.status()["stale"] is False
    assert ws.dump(tmp_path / "sheet.csv", "all") == 3
    ws.snapshot("one")
    assert Snapshot(spark, ws.snapshots / "one").count() == 3 and ws.restore(str(ws.snapshots / "one")) == 3


def test_files(spark, tmp_path):
    edges = spark.createDataFrame([("a<", 'b"', 2)], "src string, dst string, weight long")
    nodes = spark.createDataFrame([("a<", "A & B", 1.5), ('b"', None, None)], "node string, label string, x double")
    found, links = read_graphml(write_graphml(edges, nodes, tmp_path / "g.graphml"))
    assert links == [("a<", 'b"', 2)] and dict(found)["a<"] == {"label": "A & B", "x": "1.5"} and dict(found)['b"'] == {}
    write_csv(edges, nodes, tmp_path)
    assert (tmp_path / "nodos.csv").read_text(encoding="utf-8-sig").splitlines()[0] == "id,label,x"
    (tmp_path / "s.csv").write_text("﻿id,decision\nA,accepted\nB,\n", encoding="utf-8")
    c = corpus(spark, {"id": "A"}, {"id": "B"})
    assert {(r["id"], r["decision"]) for r in read_curation_sheet(c.df, str(tmp_path / "s.csv")).collect()} == {("A", "accepted"), ("B", "undecided")}


def test_cycle_and_envelope():
    assert apply_transition(None, "seed", 0) == (CycleState.SEEDED, 1) and apply_transition(CycleState.BUILT, "reseed", 1) == (CycleState.SEEDED, 2)
    assert available_transitions(None) == ["seed"] and next_best_action("BUILT") == "read"
    with pytest.raises(ValueError):
        apply_transition(None, "fly", 1)
    e = envelope("read", error=DataError("no", "X"))
    assert e["exit_code"] == 2 and not e["ok"] and e["error"]["subcode"] == "X"
