"""More queries with their SQL: sources, rows of papers, provenance, chaining, node tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citeloom import reads
from citeloom.functions import identity, provenance as prov, text
from citeloom.operators import aggregates, enrich, filters, merge as merging, networks, preprocess, scent
from citeloom.plans import star
from citeloom.plans.checkpoint import shared_folder, written
from citeloom.queries import BOTH, HEADS, REFS, edges_cte, query
from citeloom.schema import conform
from citeloom.sinks.files import curation_rows, scent_told
from citeloom.sources import bibtex, search, works_json

# Sources ------------------------------------------------------------------------------------

_LINES = "ln AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS r, l_suppkey AS s, l_partkey AS p, s_name, s_nationkey AS n, n_name, p_brand FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)"


def _works(spark, d):
    """Orders as works of a bibliographic API, through JSON and back: lines are authorships, parts references."""
    part = star.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    nation = star.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    supplier = star.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    url = lambda p, c: F.concat(F.lit(f"https://x.org/{p}"), c.cast("string"))

    def authorship(y):
        s, n = y["l_suppkey"], y["s_nationkey"]
        institution = F.struct(F.when(n % 3 != 0, url("I", n)).alias("id"), y["n_name"].alias("display_name"), F.when(n % 2 == 0, F.concat(F.lit("C"), n.cast("string"))).alias("country_code"), F.when(n % 6 == 0, url("R", n)).alias("ror"))
        author = F.struct(url("A", s).alias("id"), F.when(s % 4 != 0, y["s_name"]).alias("display_name"), F.when(s % 3 == 0, url("0-", s)).alias("orcid"))
        return F.struct(author.alias("author"), F.array(institution).alias("institutions"))

    keyword = lambda y: F.struct(F.when(y["l_partkey"] % 2 == 0, url("k/", y["p_brand"])).alias("id"), F.when(y["l_partkey"] % 7 != 0, y["p_brand"]).alias("display_name"))
    held = star.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    parts = star.parts_for(held)
    line = F.struct("l_linenumber", "l_suppkey", "l_partkey", "p_brand", "s_name", "s_nationkey", "n_name")  # what is told about them is made where the work is
    listed = held.join(part, "l_partkey").join(supplier, "l_suppkey").join(nation, "s_nationkey").repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    o = star.table(spark, d, "orders").repartition(parts, "o_orderkey").join(listed, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    reference = lambda y: url("W", y["l_partkey"])
    work = F.struct(
        url("W", k).alias("id"), F.when(k % 2 == 0, F.concat(F.lit("https://doi.org/10.5/A"), k.cast("string"))).alias("doi"), F.when(k % 5 != 0, F.concat(F.lit("Order "), k.cast("string"))).alias("title"),
        F.col("o_orderpriority").alias("display_name"), F.year("o_orderdate").alias("publication_year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"), F.lit("en").alias("language"),
        F.struct(F.struct(F.when(k % 3 == 0, F.col("o_orderstatus")).alias("display_name")).alias("source")).alias("primary_location"), F.transform("x", authorship).alias("authorships"), F.transform("x", keyword).alias("keywords"), F.transform("x", reference).alias("referenced_works"),
    )
    return o.select(F.inline(F.array(F.from_json(F.to_json(work), works_json.WORKS_SCHEMA))))  # filters on works don't parse them once more


@query("""SELECT 'W' || o_orderkey AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN '10.5/a' || o_orderkey END AS doi, CASE WHEN o_orderkey % 2 = 0 THEN 'doi:' || left(sha256('10.5/a' || o_orderkey), 16) ELSE 'src:' || left(sha256('W' || o_orderkey), 16) END AS id,
CASE WHEN o_orderkey % 5 <> 0 THEN 'Order ' || o_orderkey ELSE o_orderpriority END AS title, CAST(year(o_orderdate) AS INTEGER) AS year, 'en' AS language, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS source, true AS is_seed, 'candidate' AS curation_status FROM orders""")
def works_scalars(spark, d):
    return works_json.to_papers(_works(spark, d)).select("source_id", "doi", "id", "title", "year", "language", "source", "is_seed", "curation_status")


@query(f"""WITH {_LINES} SELECT 'W' || k AS source_id, string_agg(CASE WHEN s % 4 <> 0 THEN s_name END, '|' ORDER BY r) AS names, string_agg(CASE WHEN s % 3 = 0 THEN '0-' || s ELSE 'A' || s END, '|' ORDER BY r) AS ids,
string_agg(n_name || ' (' || CASE WHEN n % 2 = 0 THEN 'C' || n ELSE '??' END || ')', '|' ORDER BY r) AS affiliations FROM ln GROUP BY 1""")
def works_authors(spark, d):
    rows = works_json.to_papers(_works(spark, d)).where("authors_id is not null")
    return rows.select("source_id", F.array_join("authors_raw", "|").alias("names"), F.array_join("authors_id", "|").alias("ids"), F.array_join("authors_affiliations", "|").alias("affiliations"))


@query(f"""WITH {_LINES}, i AS (SELECT k, CASE WHEN n % 3 <> 0 THEN 'I' || n WHEN n % 6 = 0 THEN 'R' || n ELSE n_name END AS id, min(n_name) AS name, min(r) AS r FROM ln GROUP BY 1, 2)
SELECT 'W' || k AS source_id, string_agg(id, '|' ORDER BY r) AS ids, string_agg(name, '|' ORDER BY r) AS names FROM i GROUP BY 1""")
def works_institutions(spark, d):
    rows = works_json.to_papers(_works(spark, d)).where("institutions_id is not null")
    return rows.select("source_id", F.array_join("institutions_id", "|").alias("ids"), F.array_join("institutions_raw", "|").alias("names"))


@query(f"""WITH {_LINES}, w AS (SELECT k, string_agg(p_brand, '|' ORDER BY r) AS words, string_agg(p_brand, '|' ORDER BY r) AS ids FROM ln WHERE p % 7 <> 0 GROUP BY 1), f AS (SELECT k, string_agg('W' || p, '|' ORDER BY r) AS refs FROM ln GROUP BY 1)
SELECT 'W' || k AS source_id, words, ids, refs FROM f LEFT JOIN w USING (k)""")
def works_keywords_references(spark, d):
    rows = works_json.to_papers(_works(spark, d)).where("references_id is not null")
    return rows.select("source_id", F.array_join("keywords_raw", "|").alias("words"), F.array_join("keywords_id", "|").alias("ids"), F.array_join("references_id", "|").alias("refs"))


@query("SELECT 'W' || o_orderkey AS id, '10.5/a' || o_orderkey AS doi FROM orders WHERE o_orderkey % 2 = 0")
def works_doi_lookup(spark, d):
    return works_json.doi_lookup(_works(spark, d))


@query("SELECT 'https://x.org/W' || o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT user_id FROM events)")
def works_by_ids(spark, d):
    ids = star.table(spark, d, "events").select(F.concat(F.lit("W"), F.col("user_id").cast("string")).alias("id"))
    return works_json.by_ids(_works(spark, d), ids).select("id")


@query("SELECT 'W' || p_partkey AS id, 1990 + p_size AS publication_year FROM part WHERE p_size BETWEEN 5 AND 12")
def works_api_years(spark, d):
    """Parts saved as works and asked for by year through the data source: eight partitions, two columns."""
    from citeloom.sources.api import WorksApi

    p = star.table(spark, d, "part")
    path = f"{shared_folder(spark)}/works-{uuid.uuid4().hex}"
    p.select(F.concat(F.lit("W"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), (F.lit(1990) + F.col("p_size")).alias("publication_year")).write.json(path)
    session = spark.newSession()  # the setting for pushdown is not the caller's
    session.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    session.dataSource.register(WorksApi)
    works = session.read.format("works_api").schema("id string, publication_year int").option("fetch", "citeloom.sources.api:replay").option("path", path).load()
    return works.where("publication_year >= 1995 and publication_year < 2003")


@query("""SELECT CASE WHEN p_partkey % 2 = 0 THEN '10.1/p' || p_partkey END AS doi, p_name AS title, CASE WHEN p_partkey % 3 <> 0 THEN 1990 + p_size END AS year, CASE WHEN p_partkey % 5 <> 0 THEN p_type ELSE p_brand END AS source, p_brand || ', A.|Zoë ' || p_type AS authors, 'red thing|' || p_brand || CASE WHEN p_size > 25 THEN '|big' ELSE '' END AS words,
CASE WHEN p_partkey % 2 = 0 THEN 'doi:' || left(sha256('10.1/p' || p_partkey), 16) ELSE 'tt:' || left(sha256(lower(p_name) || '|' || CASE WHEN p_partkey % 3 <> 0 THEN CAST(1990 + p_size AS VARCHAR) ELSE 'None' END), 16) END AS id FROM part WHERE p_partkey % 11 <> 0""")
def bibtex_rows(spark, d):
    """Parts written as BibTeX files of at most 5,000 entries and read back; every eleventh has no title and is left out."""
    p, key = star.table(spark, d, "part"), F.col("p_partkey")
    field = lambda name, value, when=F.lit(True): F.when(when, F.concat(F.lit(f",\n  {name} = "), value)).otherwise("")  # noqa: E731, B008
    braced, quoted = (lambda v: F.concat(F.lit("{"), v, F.lit("}"))), (lambda v: F.concat(F.lit('"'), v, F.lit('"')))
    entry = F.concat(
        F.lit("@Article{k"), key.cast("string"), field("Title", F.concat(F.lit("{{"), F.replace("p_name", F.lit(" "), F.lit("}\n {")), F.lit("}}")), key % 11 != 0), field("doi", quoted(F.concat(F.lit("https://doi.org/10.1/P"), key.cast("string"))), key % 2 == 0),
        field("year", braced((F.lit(1990) + F.col("p_size")).cast("string")), key % 3 != 0), field("journal", F.concat(quoted(F.substring("p_type", 1, 2)), F.lit(" # "), braced(F.expr("substring(p_type, 3)"))), key % 5 != 0), field("booktitle", braced(F.col("p_brand"))),
        field("author", braced(F.concat("p_brand", F.lit(", A. and\n Zoë "), "p_type"))), field("keywords", braced(F.concat(F.lit("red thing; "), "p_brand", F.when(F.col("p_size") > 25, ", big").otherwise("")))), F.lit("\n}\n"),
    )
    path = f"{shared_folder(spark)}/bibtex-{uuid.uuid4().hex}"
    p.select(entry.alias("value")).write.option("maxRecordsPerFile", 5_000).text(path)  # a file is parsed whole
    rows = bibtex.load(spark, path)
    return rows.select("doi", "title", "year", "source", F.array_join("authors_raw", "|").alias("authors"), F.array_join("keywords_raw", "|").alias("words"), "id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE ((contains(lower(p_name), 'red w') OR contains(lower(p_name), 'blue')) AND NOT contains(lower(p_name), 'ring')) AND NOT contains(lower(p_name), 'bolt') ORDER BY CAST(p_partkey AS VARCHAR) LIMIT 500")
def search_matches(spark, d):
    """A search equation evaluated on titles: groups, phrases, OR, NOT, an excluded term and a limit."""
    spec = search.EquationSpec(query='("red w" OR blue) AND NOT ring', exclude=["Bolt"], max_results=500, max_year=2000)
    return search.matches(star.cited_parts(spark, d), spec).select("id")


# Rows of papers -----------------------------------------------------------------------------


@query(f"WITH {HEADS} SELECT k, CASE WHEN k % 4 = 0 THEN id WHEN k % 4 = 1 THEN 'doi:' || left(sha256('10.9/ab' || k), 16) WHEN k % 4 = 2 THEN 'src:' || left(sha256('W' || k), 16) ELSE 'tt:' || left(sha256('order|' || year), 16) END AS id FROM heads")
def fill_ids(spark, d):
    k = F.col("k")
    h = star.heads(spark, d).withColumn("k", F.col("id").cast("long"))
    h = h.select("k", F.when(k % 4 == 0, F.col("id")).when(k % 4 == 1, "").alias("id"), F.when(k % 4 == 1, F.concat(F.lit("10.9/AB"), k.cast("string"))).alias("doi"), F.when(k % 4 == 2, F.concat(F.lit("W"), k.cast("string"))).alias("source_id"), F.lit(" Order").alias("title"), "year")
    return identity.with_ids(h).select("k", "id")


@query("SELECT true AS same_in_any_order, true AS list_order_is_free, true AS provenance_is_free, false AS one_year_changed, false AS null_is_empty")
def content_hash_invariants(spark, d):
    """What a corpus's hash sees and doesn't, on all papers."""
    p = written(star.papers(spark, d))
    own = identity.corpus_hash(p)
    same = lambda df: identity.corpus_hash(df) == own
    last = p.agg(F.max("id")).first()[0]
    answers = (
        same(p.repartition("year", "id")), same(p.withColumn("references_id", F.reverse("references_id"))), same(p.withColumn("provenance", F.lit("[]"))),
        same(p.withColumn("year", F.when(F.col("id") == last, F.lit(1)).otherwise(F.col("year")))), same(p.withColumn("cited_by_id", F.coalesce("cited_by_id", F.array().cast("array<string>")))),
    )
    return spark.createDataFrame([answers], "same_in_any_order boolean, list_order_is_free boolean, provenance_is_free boolean, one_year_changed boolean, null_is_empty boolean")


@query("""WITH e AS (SELECT user_id, event_id, event_type || '@' || event_id AS a FROM events WHERE event_type <> 'view'), l AS (SELECT *, 0 AS side FROM e WHERE event_id % 2 = 0 UNION ALL SELECT *, 1 FROM e WHERE event_id % 2 = 1)
SELECT user_id, string_agg(a, ',' ORDER BY side, event_id) AS actions FROM l GROUP BY 1""")
def provenance_merge(spark, d):
    """Two logs of each user as JSON, the second one holding all events: those of the first stay in front, each once."""
    e = star.table(spark, d, "events").where("event_type <> 'view'")
    event = prov.event(F.concat("event_type", F.lit("@"), F.col("event_id").cast("string")))
    logs = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", event.alias("e")))).alias("x"))
    both = logs.select("user_id", prov.dump(F.transform(F.filter("x", lambda y: y["event_id"] % 2 == 0), lambda y: y["e"])).alias("a"), prov.dump(F.transform("x", lambda y: y["e"])).alias("b"))
    merged = prov.merged_events(prov.parse(F.col("a")), prov.parse(F.col("b")))
    return both.select("user_id", F.array_join(F.transform(merged, lambda y: y["action"]), ",").alias("actions"))


@query("""WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN 'Order ' || o_orderkey END AS title FROM orders), l AS (SELECT o_custkey AS c, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS words FROM lineitem JOIN o ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT CAST(o_custkey AS VARCHAR) AS id, arg_max(title, o_orderkey) FILTER (WHERE title IS NOT NULL) AS title, CAST(year(arg_max(o_orderdate, o_orderkey)) AS INTEGER) AS year, any_value(words) AS words, CASE max(CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 1 ELSE 0 END) WHEN 2 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'candidate' END AS status FROM o LEFT JOIN l ON c = o_custkey GROUP BY 1""")
def batch_duplicates(spark, d):
    """Orders under their customer's id: a batch full of repeats, folded to one row each."""
    k = F.col("id").cast("long")
    o = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("c"))
    p = star.papers(spark, d).withColumn("k", k).join(o, "k").withColumn("title", F.when(F.col("k") % 3 != 0, F.col("title"))).withColumn("id", F.col("c")).withColumn("_seq", F.col("k"))
    out = merging.fold_duplicates(p.drop("k", "c"))
    return out.select("id", "title", "year", F.array_join("keywords_id", ",").alias("words"), F.col("curation_status").alias("status"))


@query(f"WITH {HEADS} SELECT id, k + 1 AS seq FROM heads UNION ALL SELECT 'p' || p_partkey, (SELECT max(k) + 1 FROM heads) + p_partkey + 1 FROM part")
def append_rows(spark, d):
    a = conform(star.heads(spark, d)).withColumn("_seq", F.col("id").cast("long") + 1)
    b = star.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_partkey") + 1).alias("_seq"))
    return merging.append_rows(a, conform(b).withColumn("_seq", F.expr("cast(substring(id, 2) as bigint) + 1"))).select("id", F.col("_seq").alias("seq"))


@query(f"WITH {HEADS} SELECT id, CASE WHEN k % 3 = 0 THEN 'own' || id WHEN k % 2 = 0 THEN 'W' || id END AS source_id FROM heads")
def source_ids_filled(spark, d):
    k = F.col("id").cast("long")
    corpus = conform(star.heads(spark, d).withColumn("doi", F.concat(F.lit("10.5/A"), "id")).withColumn("source_id", F.when(k % 3 == 0, F.concat(F.lit("own"), "id"))))
    lookup = star.heads(spark, d).where(k % 2 == 0).select(F.concat(F.lit("https://doi.org/10.5/a"), "id").alias("doi"), F.concat(F.lit("W"), "id").alias("source_id"))
    return merging.fill_source_ids(corpus, lookup).select("id", "source_id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, lower(p_name) AS authors, CASE WHEN p_size > 25 THEN 'pt' END AS language FROM part")
def normalize_rows(spark, d):
    p = star.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.array(F.concat(F.lit(" "), F.replace(F.upper("p_name"), F.lit("A"), F.lit("Á")), F.lit("  "))).alias("authors_id"), F.when(F.col("p_size") > 25, " PT_br").otherwise(" ").alias("language"))
    return preprocess.normalize(conform(p)).select("id", F.array_join("authors_id", "|").alias("authors"), "language")


@query("""WITH v AS (SELECT l_orderkey AS k, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'first' ELSE p_brand END AS v, min(p_brand) AS b FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT CAST(k AS VARCHAR) AS id, string_agg(v, ',' ORDER BY b) AS words FROM v GROUP BY 1""")
def list_remap(spark, d):
    mapping = spark.createDataFrame([("Brand#1", "first"), ("Brand#2", "first"), ("Brand#none", "x")], "value string, canonical string")
    return preprocess.remap(star.papers(spark, d), "keywords_id", mapping).where("keywords_id is not null").select("id", F.array_join("keywords_id", ",").alias("words"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE p_name LIKE 'red %') AS mapped FROM (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)")
def thesaurus_coverage(spark, d):
    names = star.table(spark, d, "part").where(F.startswith("p_name", F.lit("red "))).select(F.lower("p_name").alias("alias"), F.lit("red").alias("canonical")).distinct()
    return preprocess.thesaurus_coverage(star.papers(spark, d), names)


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'https://doi.org/10.1/p' || p_partkey WHEN p_partkey % 3 = 1 THEN 'https://openalex.org/W' || p_partkey END AS url, CASE WHEN p_partkey % 3 = 1 THEN 'https://openalex.org/W' || p_partkey END AS work, 'W' || p_partkey AS short,
CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_size > 25 THEN left(repeat(p_name || ' ', 9), 60) || '...' ELSE p_name || CASE WHEN p_partkey % 4 = 1 THEN '' ELSE ' (2001)' END END AS label FROM part""")
def paper_links(spark, d):
    k = F.col("p_partkey")
    p = star.table(spark, d, "part").withColumn("doi", F.when(k % 3 == 0, F.concat(F.lit("10.1/p"), k.cast("string")))).withColumn("sid", F.when(k % 3 == 1, F.concat(F.lit("W"), k.cast("string"))).when(k % 3 == 2, ""))
    title = F.when(k % 4 == 0, "").when(F.col("p_size") > 25, F.repeat(F.concat("p_name", F.lit(" ")), F.lit(9))).otherwise(F.col("p_name"))
    return p.select(k.alias("k"), text.paper_url(F.col("doi"), F.col("sid")).alias("url"), text.work_url(F.col("sid")).alias("work"), text.last_segment(F.concat(F.lit("https://x/W"), k.cast("string"))).alias("short"), text.paper_label(title, F.when(k % 4 != 1, 2001), k.cast("string")).alias("label"))


@query(f"""WITH {HEADS}, a AS (SELECT l_orderkey AS k, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ' | ' ORDER BY CAST(l_suppkey AS VARCHAR)) AS a, string_agg(DISTINCT p_brand, ' | ' ORDER BY p_brand) AS w FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT id, 'W' || id AS source_id, 'Order ' || id AS title, CAST(year AS VARCHAR) AS year, coalesce(a, '') AS authors, 'Journal' AS venue, CASE WHEN k % 2 = 0 THEN '10.5/' || id ELSE '' END AS doi, coalesce(w, '') AS keywords, '' AS cited_by_count, '' AS references_count, CASE WHEN is_seed THEN 'True' ELSE 'False' END AS is_seed, 'https://openalex.org/W' || id AS openalex_url, '' AS scent_score, '' AS cluster, CASE WHEN curation_status = 'candidate' THEN 'undecided' ELSE curation_status END AS decision, '' AS note FROM heads LEFT JOIN a USING (k)""")
def curation_sheet_all_columns(spark, d):
    p = star.papers(spark, d).withColumn("source_id", F.concat(F.lit("W"), "id")).withColumn("source", F.lit("Journal")).withColumn("doi", F.when(F.col("id").cast("long") % 2 == 0, F.concat(F.lit("10.5/"), "id")))
    return curation_rows(p, "all")


@query("SELECT count(*) AS papers, count(*) FILTER (WHERE p_size <= 25) AS seeds, count(*) FILTER (WHERE p_size <= 25 AND p_partkey % 2 = 0) AS seeds_with_source, (SELECT count(*) > 0 FROM lineitem) AS has_cited_by FROM part")
def seed_readiness(spark, d):
    return aggregates.readiness(star.cited_parts(spark, d).withColumn("source_id", F.when(F.col("id").cast("long") % 2 == 0, F.concat(F.lit("W"), "id"))))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_type IN ('ECONOMY', 'SMALL')")
def filter_type_in(spark, d):
    return star.cited_parts(spark, d).where(filters.passes(filters.FilterCriterion("type", "in", ["ECONOMY", "SMALL"]))).select("id")


@query("SELECT doc_id FROM documents WHERE lang NOT IN ('en', 'es')")
def filter_language_not_in(spark, d):
    docs = star.table(spark, d, "documents").select("doc_id", F.col("lang").alias("language"))
    return docs.where(filters.passes(filters.FilterCriterion("language", "not_in", ["en", "ES"])) & F.col("language").isNotNull()).select("doc_id")


# Chaining -----------------------------------------------------------------------------------

_SEEDS = "seeds AS (SELECT p_partkey AS part FROM part WHERE p_size <= 25)"


def _seeded(spark, d):
    """Parts as a corpus, found in references by their source ids; small parts are the seeds."""
    return star.cited_parts(spark, d).withColumn("source_id", F.col("id")).withColumn("id", F.concat(F.lit("p"), "id"))


def _dated(spark, d):
    """Orders as works (id, references_id, publication_date)."""
    o = star.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"))
    return star.papers(spark, d).select("id", "title", "references_id").join(o, "id").withColumn("id", F.concat(F.lit("o"), "id"))


@query(f"WITH {REFS}, {_SEEDS} SELECT 'o' || paper AS id, count(*) AS scent FROM refs JOIN seeds USING (part) JOIN orders ON o_orderkey = paper GROUP BY 1")
def forward_scores(spark, d):
    return scent.forward_scores(_seeded(spark, d), _dated(spark, d))


@query(f"WITH {REFS}, {_SEEDS} SELECT 'o' || paper AS id, count(*) AS scent FROM refs JOIN seeds USING (part) JOIN orders ON o_orderkey = paper WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def forward_scores_since(spark, d):
    return scent.forward_scores(_seeded(spark, d), _dated(spark, d), text.parse_since("1998-01-01").isoformat())


def _both_ways(spark, d):
    """The seeded corpus, whose parts also cite: the order numbers that equal their size."""
    return _seeded(spark, d).join(star.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), "p_size"), "id").withColumn("references_id", F.array(F.concat(F.lit("o"), F.col("p_size").cast("string")), F.lit("far"))).drop("p_size")


@query(f"""WITH {REFS}, {_SEEDS}, s AS (SELECT 'o' || p_size AS id, count(*) AS n, true AS b FROM part GROUP BY 1 UNION ALL SELECT 'far', count(*), true FROM part UNION ALL SELECT 'o' || paper, count(*), false FROM refs JOIN seeds USING (part) JOIN orders ON o_orderkey = paper GROUP BY 1)
SELECT id, CAST(sum(n) AS BIGINT) AS scent, bool_and(b) AS backward_only FROM s GROUP BY 1""")
def chain_both(spark, d):
    return scent.chain(_both_ways(spark, d), _dated(spark, d), "both")


@query(f"""WITH {REFS}, {_SEEDS}, s AS (SELECT 'o' || paper AS id, count(*) AS scent FROM refs JOIN seeds USING (part) JOIN orders ON o_orderkey = paper GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200)
SELECT id, scent, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN 'Order ' || substr(id, 2) ELSE '[candidate:' || id || ']' END AS title, false AS is_seed, 'candidate' AS curation_status FROM s""")
def chain_forward_rows(spark, d):
    """The best candidates of a forward step with their rows; every second one was not fetched."""
    works = _dated(spark, d)
    ranking = scent.chain(_seeded(spark, d), works, "forward", 200)
    fetched = works.where(F.expr("cast(substring(id, 2) as bigint) % 2 = 0")).select("id", "title", "references_id")
    return scent.forward_rows(ranking, fetched).select("id", "scent", "title", "is_seed", "curation_status")


@query(f"""WITH c AS (SELECT DISTINCT l_partkey AS t, 'o' || l_orderkey AS o FROM lineitem JOIN orders ON o_orderkey = l_orderkey), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY o) AS n FROM c), {_SEEDS},
a AS (SELECT t, o FROM r WHERE n <= 10 UNION SELECT part, 'a' || part FROM seeds WHERE part % 2 = 0)
SELECT 'p' || t AS id, string_agg(o, ',' ORDER BY o) AS cited_by FROM a WHERE t IN (SELECT part FROM seeds) AND t IN (SELECT t FROM c) GROUP BY 1""")
def seed_cited_by_updates(spark, d):
    """Citing lists of the seeds after a forward step of at most ten citers each."""
    corpus = _seeded(spark, d).withColumn("cited_by_id", F.when(F.col("source_id").cast("long") % 2 == 0, F.array(F.concat(F.lit("a"), "source_id"))))
    citers = scent.citing_batch(_dated(spark, d), corpus.select(F.col("source_id").alias("target")), 10)
    return scent.cited_by_updates(corpus, citers).select("id", F.array_join("cited_by_id", ",").alias("cited_by"))


@query("WITH f AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 25) SELECT CAST(0 AS BIGINT) AS backward, n AS forward, (SELECT count(*) FROM part WHERE p_size <= 25) AS seeds, true AS has_cited_by FROM f")
def growth_preview_forward(spark, d):
    return scent.growth_preview(_seeded(spark, d).withColumn("cited_by_id", F.transform("cited_by_id", lambda x: F.concat(F.lit("o"), x))))


@query(f"WITH {REFS} SELECT count(DISTINCT part) AS total, count(DISTINCT part) FILTER (WHERE part % 4 <> 0) AS resolved FROM refs JOIN orders ON o_orderkey = paper")
def references_metric(spark, d):
    lookup = star.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string"))).alias("doi"))
    return enrich.references_metric(star.papers(spark, d), lookup)


_CITERS = """c AS (SELECT DISTINCT l_partkey AS t, 'o' || l_orderkey AS o FROM lineitem JOIN orders ON o_orderkey = l_orderkey), r AS (SELECT t, o, row_number() OVER (PARTITION BY t ORDER BY o) AS n FROM c),
acc AS (SELECT p_partkey AS t FROM part WHERE p_size <= 25 AND p_partkey % 3 = 0), old AS (SELECT p_partkey AS t, unnest(['a' || p_partkey, 'z' || p_partkey]) AS o FROM part WHERE p_partkey % 2 = 0),
u AS (SELECT t, o FROM r WHERE n <= 10 AND t IN (SELECT t FROM acc) UNION SELECT t, o FROM old WHERE t IN (SELECT t FROM acc)), k AS (SELECT t, o, row_number() OVER (PARTITION BY t ORDER BY o) AS n FROM u)"""


def _to_enrich(spark, d):
    """Parts with references, a third of them accepted, half of them with a citing list, a fifth with URLs as source ids."""
    size = star.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), "p_size", F.col("p_partkey").alias("k"))
    joined = _seeded(spark, d).join(size, "id")
    k = F.col("k").cast("string")
    refs = F.array(F.concat(F.when(F.col("k") % 3 == 0, "s").otherwise("t"), F.col("p_size").cast("string")), F.lit("far"))
    corpus = joined.withColumn("references_id", refs).withColumn("curation_status", F.when(F.col("k") % 3 == 0, "accepted").otherwise("candidate"))
    corpus = corpus.withColumn("cited_by_id", F.when(F.col("k") % 2 == 0, F.array(F.concat(F.lit("a"), k), F.concat(F.lit("z"), k))))
    corpus = corpus.withColumn("source_id", F.when(F.col("k") % 5 == 0, F.concat(F.lit("https://works.example.org/"), k)).otherwise(k))
    lookup = size.select(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("id"), F.concat(F.lit("10.1/"), F.col("p_size").cast("string")).alias("doi")).distinct()
    return corpus.drop("p_size", "k"), lookup


@query(f"""WITH {_CITERS}, grown AS (SELECT t, string_agg(o, ',' ORDER BY o) AS v FROM k WHERE n <= 10 GROUP BY 1), kept AS (SELECT t, string_agg(o, ',' ORDER BY o) AS v FROM old GROUP BY 1)
SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey IN (SELECT t FROM acc) THEN coalesce(grown.v, '') ELSE kept.v END AS cited_by, CASE WHEN p_partkey % 3 = 0 THEN '10.1/' || p_size || ',-' ELSE '-,-' END AS dois FROM part LEFT JOIN grown ON grown.t = p_partkey LEFT JOIN kept ON kept.t = p_partkey""")
def enrich_both(spark, d):
    """Both passes: DOIs of the references in their places; citing lists of accepted seeds, united with what they
    hold and capped at ten, while seeds that are candidates keep theirs."""
    corpus, lookup = _to_enrich(spark, d)
    out = enrich.enrich(corpus, _dated(spark, d), lookup, cap=10)
    return out.select("id", F.array_join("cited_by_id", ",").alias("cited_by"), F.array_join("references_doi", ",", "-").alias("dois"))


@query(f"WITH {_CITERS} SELECT (SELECT count(*) FROM acc) AS total, (SELECT count(*) FROM k WHERE n <= 10 AND (t, o) NOT IN (SELECT t, o FROM old)) AS resolved")
def enrich_cited_by_metric(spark, d):
    """What the pass over citing lists records: accepted seeds, and citers that it has added."""
    corpus, _ = _to_enrich(spark, d)
    return enrich.cited_by_metric(corpus, enrich.cited_by(corpus, _dated(spark, d), 10))


@query(f"""WITH {_CITERS}, e AS (SELECT t, o FROM r WHERE n <= 10 UNION SELECT t, o FROM old), m AS (SELECT t, o, row_number() OVER (PARTITION BY t ORDER BY o) AS n FROM e WHERE t IN (SELECT t FROM acc) AND t IN (SELECT t FROM c) AND t % 5 <> 0)
SELECT 'p' || t AS id, string_agg(o, ',' ORDER BY o) AS cited_by FROM m WHERE n <= 4 GROUP BY 1""")
def citing_lists_capped(spark, d):
    """Citing lists of accepted seeds after a forward step, cut to four; source ids are compared as they stand."""
    corpus, _ = _to_enrich(spark, d)
    citers = scent.citing_batch(_dated(spark, d), corpus.select(F.col("source_id").alias("target")), 10)
    return scent.cited_by_updates(corpus, citers, cap=4, accepted_only=True).select("id", F.array_join("cited_by_id", ",").alias("cited_by"))


@query(f"""WITH {REFS}, {_SEEDS}, h AS (SELECT DISTINCT part, 'o' || paper AS o FROM refs JOIN seeds USING (part) JOIN orders ON o_orderkey = paper), n AS (SELECT o, row_number() OVER (PARTITION BY part ORDER BY o) AS n FROM h)
SELECT o AS id, count(*) AS scent FROM n WHERE n <= 3 GROUP BY 1""")
def forward_scores_capped(spark, d):
    """Candidates of a forward step that takes three citers of each seed."""
    return scent.forward_scores(_seeded(spark, d), _dated(spark, d), cap=3)


# Node tables --------------------------------------------------------------------------------


@query(f"""WITH {edges_cte('cocitation', 2)}, {BOTH} SELECT CAST(node AS VARCHAR) AS node, degree, p_name || ' (2000)' AS label, 2000 AS year, p_size <= 25 AS is_seed, 'candidate' AS curation_status, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_partkey = node) AS cited_by_count FROM deg JOIN part ON p_partkey = node""")
def decorate_papers(spark, d):
    edges = networks.project(star.cocitation(spark, d).withColumn("node", F.col("node").cast("string")), 2)
    out = aggregates.decorate(edges, star.cited_parts(spark, d), "cocitation")
    return out.select("node", "degree", "label", "year", "is_seed", "curation_status", F.col("cited_by_count").cast("long").alias("cited_by_count"))


@query(f"""WITH {HEADS}, {edges_cte('coupling', 2)}, {BOTH}, a AS (SELECT l_orderkey AS o, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), '|' ORDER BY CAST(l_suppkey AS VARCHAR)) AS authors, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS keywords FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT CAST(node AS VARCHAR) AS node, degree, round(degree / (SELECT count(*) - 1 FROM deg), 6) AS degree_centrality, 'Order ' || node || ' (' || year || ')' AS label, year, is_seed, curation_status, CASE WHEN node % 2 = 0 THEN '10.1/' || node END AS doi,
CASE WHEN node % 2 = 0 THEN '{text.DOI_URL}10.1/' || node WHEN node % 3 = 0 THEN '{text.WORK_URL}W' || node END AS url, 'J' || node % 7 AS venue, authors, keywords, CASE WHEN node % 5 > 0 THEN node % 5 END AS cited_by_count FROM deg JOIN heads ON k = node LEFT JOIN a ON o = node""")
def decorate_all_fields(spark, d):
    """Every field that a node of a paper network carries."""
    k = F.col("id").cast("long")
    corpus = star.papers(spark, d).withColumn("doi", F.when(k % 2 == 0, F.concat(F.lit("10.1/"), "id"))).withColumn("source_id", F.when(k % 3 == 0, F.concat(F.lit("W"), "id")))
    corpus = corpus.withColumn("source", F.concat(F.lit("J"), (k % 7).cast("string"))).withColumn("cited_by_id", F.array_repeat(F.lit("c"), (k % 5).cast("int")))
    edges = networks.project(star.coupling(spark, d), 2).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight")  # pairs are sent as numbers
    out = aggregates.decorate(edges, corpus, "bibliographic_coupling").withColumn("degree_centrality", F.round("degree_centrality", 6))
    return out.withColumn("cited_by_count", F.col("cited_by_count").cast("long")).select("node", "degree", "degree_centrality", "label", "year", "is_seed", "curation_status", "doi", "url", "venue", "authors", "keywords", "cited_by_count")


@query(f"""WITH {edges_cte('authors')}, {BOTH} SELECT CAST(node AS VARCHAR) AS node, degree, 'author ' || node AS label FROM deg""")
def decorate_authors(spark, d):
    edges = networks.project(star.authors(spark, d).withColumn("node", F.col("node").cast("string")))
    named = star.papers(spark, d).withColumn("authors_raw", F.transform("authors_id", lambda a: F.concat(F.lit("author "), a)))
    return aggregates.decorate(edges, named, "author_collab").select("node", "degree", "label")


@query("SELECT CAST(l_suppkey AS VARCHAR) AS node, 'name in ' || min(l_orderkey) AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 2 = 1 GROUP BY 1")
def display_names(spark, d):
    """The first name that any paper gives an author; papers of even number give none."""
    k = F.col("id").cast("long")
    named = star.papers(spark, d).withColumn("authors_raw", F.transform("authors_id", lambda a: F.when(k % 2 == 1, F.concat(F.lit("name in "), "id")).otherwise(""))).withColumn("_seq", k)
    return aggregates.display_names(named, "authors_id", "authors_raw")


# Read models --------------------------------------------------------------------------------


@query(f"""WITH {HEADS}, {REFS}, own AS (SELECT part FROM refs WHERE paper = 7), a AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS s FROM lineitem WHERE l_orderkey = 7),
r AS (SELECT 'coupling' AS relation, CAST(paper AS VARCHAR) AS paper_id, count(*) AS weight FROM refs WHERE paper <> 7 AND part IN (SELECT part FROM own) GROUP BY 1, 2
UNION ALL SELECT 'references', CAST(part AS VARCHAR), NULL FROM own UNION ALL SELECT 'cited_by', s, NULL FROM a) SELECT relation, paper_id, 'Order ' || paper_id AS title, weight FROM r JOIN heads ON id = paper_id""")
def paper_surroundings(spark, d):
    """Order 7, its parts and suppliers read as the orders of those numbers."""
    return reads.surroundings(star.papers(spark, d).withColumn("cited_by_id", F.col("authors_id")), "7")


_AHEAD = f"WITH {REFS}, b AS (SELECT count(DISTINCT part) AS b FROM refs JOIN orders ON o_orderkey = paper WHERE part NOT IN (SELECT o_orderkey FROM orders)), f AS (SELECT count(DISTINCT l_suppkey) AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query(f"{_AHEAD} SELECT b AS backward, CAST(0 AS BIGINT) AS forward, b AS estimated_new, true AS forward_requires_fetch, false AS forward_from_cited_by, false AS capped FROM b")
def growth_estimate_unfetched(spark, d):
    return scent.growth_estimate(star.papers(spark, d))


@query(f"{_AHEAD} SELECT least(b, 50) AS backward, least(f, 50) AS forward, least(b, 50) + least(f, 50) AS estimated_new, false AS forward_requires_fetch, true AS forward_from_cited_by, b > 50 OR f > 50 AS capped FROM b, f")
def growth_estimate_capped(spark, d):
    """Suppliers as citing works that the corpus doesn't have; each direction up to 50."""
    citing = F.transform("authors_id", lambda a: F.concat(F.lit("s"), a))
    return scent.growth_estimate(star.papers(spark, d).withColumn("cited_by_id", citing), "both", 50)


@query("SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN '' || p_size WHEN p_size % 3 = 1 THEN '7.5' END AS scent FROM part")
def scent_of_events(spark, d):
    size = F.col("p_size").cast("string")
    told = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('[{"action": "seeded"}, {"scent": '), size, F.lit('}, {"scent": 1}]'))).when(F.col("p_size") % 3 == 1, '[{"action": "chained", "scent": 7.5}]').otherwise("not a list")
    return star.table(spark, d, "part").select(F.col("p_partkey").alias("k"), scent_told(told).alias("scent"))


@query(f"WITH {edges_cte('institutions')}, {BOTH} SELECT CAST(node AS VARCHAR) AS id, 'place ' || node AS label, round(degree / (SELECT count(*) - 1 FROM deg), 6) AS degree_centrality FROM deg")
def network_record_nodes(spark, d):
    places = F.transform("institutions_id", lambda a: F.concat(F.lit("place "), a))
    record = reads.network_record(star.papers(spark, d).withColumn("institutions_raw", places), "institution_collab", None)
    return record.nodes.withColumn("degree_centrality", F.round("degree_centrality", 6))
