"""Queries over the star view of the corpus, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import identity, provenance as prov, text
from citeloom.operators import aggregates, communities, filters, graph, merge as merging, networks, paths, preprocess, scent
from citeloom.operators.components import connected_components
from citeloom.plans import star
from citeloom.schema import NetworkKind, conform
from citeloom.sinks.files import curation_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Texts that a task turns into inverted indexes at a time.
ABSTRACTS_AT_ONCE = 32


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Parts of the SQL ---------------------------------------------------------------------------

HEADS = """heads AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus = 'F' AS is_seed,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'accepted' WHEN '5-LOW' THEN 'rejected' ELSE 'candidate' END AS curation_status, o_orderkey AS k FROM orders)"""
REFS = "refs AS (SELECT DISTINCT l_orderkey AS paper, l_partkey AS part FROM lineitem)"
INC = {
    "coupling": "SELECT DISTINCT l_orderkey AS node, l_partkey AS grp FROM lineitem",
    "cocitation": "SELECT DISTINCT l_partkey AS node, l_orderkey AS grp FROM lineitem",
    "authors": "SELECT DISTINCT l_suppkey AS node, l_orderkey AS grp FROM lineitem",
    "institutions": "SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS node, l_orderkey AS grp FROM lineitem JOIN supplier ON s_suppkey = l_suppkey",
    "keywords": "SELECT DISTINCT p_brand AS node, l_orderkey AS grp FROM lineitem JOIN part ON p_partkey = l_partkey",
}


def edges_cte(kind: str, min_weight: int = 1) -> str:
    return f"inc AS ({INC[kind]}), edges AS (SELECT a.node AS src, b.node AS dst, count(*) AS weight FROM inc a JOIN inc b ON a.grp = b.grp AND a.node < b.node GROUP BY 1, 2 HAVING count(*) >= {min_weight})"


def edges_sql(kind: str, min_weight: int = 1) -> str:
    return f"WITH {edges_cte(kind, min_weight)} SELECT src, dst, weight FROM edges"


BOTH = "ends AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges), deg AS (SELECT a AS node, count(*) AS degree FROM ends GROUP BY 1)"

# Networks -----------------------------------------------------------------------------------


@query(edges_sql("coupling"))
def coupling_edges(spark, d):
    return networks.project(star.coupling(spark, d))


@query(edges_sql("coupling", 2))
def coupling_edges_min2(spark, d):
    return networks.project(star.coupling(spark, d), 2)


@query(edges_sql("cocitation"))
def cocitation_edges(spark, d):
    return networks.project(star.cocitation(spark, d))


@query(f"WITH inc AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS node, l_orderkey AS grp FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 25), edges AS (SELECT a.node AS src, b.node AS dst, count(*) AS weight FROM inc a JOIN inc b ON a.grp = b.grp AND a.node < b.node GROUP BY 1, 2) SELECT * FROM edges")
def cocitation_seeds_only(spark, d):
    return networks.network(star.cited_parts(spark, d), NetworkKind.COCITATION, scope="seeds_only")


@query(edges_sql("authors"))
def author_collab_edges(spark, d):
    return networks.project(star.authors(spark, d))


@query(edges_sql("institutions"))
def institution_collab_edges(spark, d):
    return networks.project(star.institutions(spark, d))


@query(edges_sql("keywords"))
def keyword_cooccurrence_edges(spark, d):
    return networks.project(star.keywords(spark, d))


@query("""WITH chosen AS (SELECT DISTINCT l_orderkey AS o FROM lineitem JOIN part ON p_partkey = l_partkey WHERE contains(lower(p_name), 'red w') OR contains(lower(p_name), 'blue')),
inc AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS node, l_partkey AS grp FROM lineitem JOIN chosen ON o = l_orderkey)
SELECT a.node AS src, b.node AS dst, count(*) AS weight FROM inc a JOIN inc b ON a.grp = b.grp AND a.node < b.node GROUP BY 1, 2 HAVING count(*) >= 2""")
def keyword_filtered_coupling(spark, d):
    return networks.network(star.papers(spark, d), NetworkKind.COUPLING, 2, terms=["Red W", "blue"])


@query(f"WITH inc AS ({INC['coupling']}), own AS (SELECT grp FROM inc WHERE node = 7) SELECT node, count(*) AS weight FROM inc WHERE node <> 7 AND grp IN (SELECT grp FROM own) GROUP BY 1")
def paper_coupling_lens(spark, d):
    return networks.coupled_with(star.coupling(spark, d), 7)


@query(f"WITH {edges_cte('coupling', 2)}, {BOTH}, top AS (SELECT node, degree, round(degree / (SELECT count(*) - 1 FROM deg), 6) AS degree_centrality FROM deg ORDER BY degree DESC, node LIMIT 20) SELECT node, degree, degree_centrality, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS title FROM top LEFT JOIN orders ON o_orderkey = node")
def coupling_top_central(spark, d):
    """The flagship: coupled papers, their centrality, and what is known about the most central ones."""
    o = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("title"))
    best = aggregates.top_central(networks.project(star.coupling(spark, d), 2), o, 20)
    return best.select("node", "degree", F.round("degree_centrality", 6).alias("degree_centrality"), "year", "title")


@query(f"""WITH {HEADS}, {REFS}, l AS (SELECT h.*, EXISTS (SELECT 1 FROM refs WHERE paper = k) AS has FROM heads h),
multi AS (SELECT max(a) >= 2 AS a, max(i) >= 2 AS i, max(w) >= 2 AS w FROM (SELECT count(DISTINCT l_suppkey) AS a, count(DISTINCT s_nationkey) AS i, count(DISTINCT p_brand) AS w FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)),
shared AS (SELECT max(n) >= 2 AS s FROM (SELECT count(*) AS n FROM refs GROUP BY part)),
f AS (SELECT count(*) AS total, count(*) FILTER (WHERE is_seed) AS seeds, count(*) FILTER (WHERE has) AS n FROM l)
SELECT 'bibliographic_coupling' AS kind, NOT s AS would_be_empty FROM shared UNION ALL SELECT 'author_collab', NOT a FROM multi UNION ALL SELECT 'institution_collab', NOT i FROM multi UNION ALL SELECT 'keyword_cooccurrence', NOT w FROM multi UNION ALL SELECT 'cocitation', true""")
def build_preview(spark, d):
    return networks.build_preview(star.papers(spark, d)).select("kind", "would_be_empty")


# Measures -----------------------------------------------------------------------------------


@query(f"WITH {edges_cte('cocitation', 2)}, {BOTH} SELECT node, degree, round(degree / (SELECT count(*) - 1 FROM deg), 6) AS degree_centrality FROM deg")
def degree_centrality(spark, d):
    c = graph.degree_centrality(networks.project(star.cocitation(spark, d), 2))
    return c.select("node", "degree", F.round("degree_centrality", 6).alias("degree_centrality"))


@query(f"WITH {edges_cte('cocitation', 2)}, {BOTH}, n AS (SELECT count(*) AS nodes FROM deg), m AS (SELECT count(*) AS edges FROM edges) SELECT nodes, edges, round(2.0 * edges / (nodes * (nodes - 1)), 6) AS density FROM n, m")
def network_density(spark, d):
    return graph.density(networks.project(star.cocitation(spark, d), 2)).withColumn("density", F.round("density", 6))


@query(f"""WITH {edges_cte('authors')}, {BOTH}, tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON z.src = x.src AND z.dst = y.dst),
corners AS (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri), t AS (SELECT node, count(*) AS triangles FROM corners GROUP BY 1)
SELECT node, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS clustering FROM deg LEFT JOIN t USING (node)""")
def clustering_coefficients(spark, d):
    return graph.clustering(networks.project(star.authors(spark, d))).withColumn("clustering", F.round("clustering", 6))


@query(f"""WITH {edges_cte('keywords')}, {BOTH}, tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON z.src = x.src AND z.dst = y.dst),
corners AS (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri), t AS (SELECT node, count(*) AS triangles FROM corners GROUP BY 1)
SELECT round(avg(CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END), 6) AS average_clustering FROM deg LEFT JOIN t USING (node)""")
def avg_clustering_brand(spark, d):
    return graph.average_clustering(networks.project(star.keywords(spark, d))).select(F.round("average_clustering", 6).alias("average_clustering"))


@query(f"WITH RECURSIVE {edges_cte('cocitation', 3)}, {BOTH}, reach(node, c) AS (SELECT node, node FROM deg UNION SELECT e.b, r.c FROM reach r JOIN ends e ON e.a = r.node) SELECT node, min(c) AS component FROM reach GROUP BY 1")
def components_cocit_min3(spark, d):
    return connected_components(networks.project(star.cocitation(spark, d), 3), forests=True)


@query(f"WITH {edges_cte('cocitation', 2)}, {BOTH} SELECT round(corr(x.degree, y.degree), 6) AS r FROM ends JOIN deg x ON x.node = a JOIN deg y ON y.node = b")
def degree_assortativity(spark, d):
    return graph.degree_assortativity(networks.project(star.cocitation(spark, d), 2)).select(F.round("r", 6).alias("r"))


@query(f"""WITH {edges_cte('cocitation', 2)}, {BOTH}, cells AS (SELECT p.p_type AS x, q.p_type AS y, count(*) AS n FROM ends JOIN part p ON p.p_partkey = a JOIN part q ON q.p_partkey = b GROUP BY 1, 2),
tot AS (SELECT sum(n)::DOUBLE AS total, sum(n) FILTER (WHERE x = y)::DOUBLE AS same FROM cells), mar AS (SELECT sum(m * m)::DOUBLE AS squares FROM (SELECT sum(n)::DOUBLE AS m FROM cells GROUP BY x))
SELECT round((same / total - squares / (total * total)) / (1 - squares / (total * total)), 6) AS r FROM tot, mar""")
def attribute_assortativity(spark, d):
    parts = star.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type")
    return graph.attribute_assortativity(networks.project(star.cocitation(spark, d), 2), parts, "p_type").select(F.round("r", 6).alias("r"))


@query("""WITH c AS (SELECT o_custkey % 7 AS community, o_orderstatus AS category FROM orders), n AS (SELECT community, category, count(*) AS n FROM c GROUP BY 1, 2), s AS (SELECT community, count(*) AS size FROM c GROUP BY 1)
SELECT s.community, k.category, round(coalesce(n, 0) / size, 6) AS fraction FROM s CROSS JOIN (SELECT DISTINCT category FROM c) k LEFT JOIN n ON n.community = s.community AND n.category = k.category""")
def community_composition(spark, d):
    o = star.table(spark, d, "orders")
    found = graph.community_composition(o.select(F.col("o_orderkey").alias("node"), (F.col("o_custkey") % 7).alias("community")), o.select(F.col("o_orderkey").alias("id"), "o_orderstatus"), "o_orderstatus")
    return found.withColumn("fraction", F.round("fraction", 6))


@query(f"""WITH {HEADS}, p AS (SELECT h.*, k % 11 AS cluster FROM heads h), base AS (SELECT cluster, count(*) AS size, count(*) FILTER (WHERE is_seed) AS seeds, count(*) FILTER (WHERE curation_status = 'candidate') AS candidates, count(*) FILTER (WHERE curation_status = 'accepted') AS accepted, min(year) AS year_min, max(year) AS year_max, round_even(avg(year), 1) AS year_mean FROM p GROUP BY 1),
a AS (SELECT cluster, CAST(l_suppkey AS VARCHAR) AS v, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN p ON k = l_orderkey GROUP BY 1, 2), ra AS (SELECT cluster, string_agg(v, ',' ORDER BY n DESC, v) AS authors FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, v) AS r FROM a) WHERE r <= 5 GROUP BY 1),
w AS (SELECT cluster, p_brand AS v, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN p ON k = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), rw AS (SELECT cluster, string_agg(v, ',' ORDER BY n DESC, v) AS words FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, v) AS r FROM w) WHERE r <= 5 GROUP BY 1)
SELECT * FROM base LEFT JOIN ra USING (cluster) LEFT JOIN rw USING (cluster)""")
def cluster_table(spark, d):
    corpus = star.papers(spark, d)
    groups = corpus.select(F.col("id").alias("node"), (F.col("id").cast("long") % 11).alias("community"))
    t = aggregates.cluster_table(corpus, groups)
    return t.select("cluster", "size", "seeds", "candidates", "accepted", "year_min", "year_max", "year_mean", F.array_join("top_authors", ",").alias("authors"), F.array_join("top_keywords", ",").alias("words"))


@query(f"WITH {edges_cte('cocitation')} SELECT src, dst, weight, p.p_name AS src_title, q.p_name AS dst_title FROM edges JOIN part p ON p.p_partkey = src JOIN part q ON q.p_partkey = dst ORDER BY weight DESC, src, dst LIMIT 25")
def top_pairs(spark, d):
    named = star.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return aggregates.top_pairs(networks.project(star.cocitation(spark, d)), named, 25)


@query("WITH n AS (SELECT o_custkey % 13 AS key, l_suppkey AS value, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT * FROM (SELECT key, value, n, CAST(row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS INTEGER) AS rank FROM n) WHERE rank <= 5")
def top_per_cluster(spark, d):
    o = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("paper"), (F.col("o_custkey") % 13).alias("key"))
    return aggregates.top_values(star.lines(spark, d).join(o, "paper").select("key", F.col("supplier").alias("value")), "key", "value", 5)


# Scent --------------------------------------------------------------------------------------

OUTSIDE = "own AS (SELECT p_partkey AS part FROM part WHERE p_partkey % 3 = 0)"


def _citing(spark, d) -> DataFrame:
    """Orders that cite parts, in a corpus that holds every third part under its own id."""
    cites = star.papers(spark, d).select("id", "references_id").withColumn("id", F.concat(F.lit("o"), "id"))
    held = star.table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("id"))
    return conform(cites.unionByName(held, allowMissingColumns=True).withColumn("is_seed", ~F.startswith("id", F.lit("o"))))


@query(f"WITH {REFS}, {OUTSIDE} SELECT CAST(part AS VARCHAR) AS id, count(*) AS scent FROM refs WHERE part NOT IN (SELECT part FROM own) GROUP BY 1")
def backward_scent(spark, d):
    return scent.backward_scent(_citing(spark, d))


@query(f"WITH {REFS}, {OUTSIDE} SELECT 'o' || paper AS id, count(*) AS scent FROM refs JOIN own USING (part) JOIN orders ON o_orderkey = paper GROUP BY 1")
def forward_scent(spark, d):
    held = conform(star.table(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").cast("string").alias("source_id")))
    return scent.forward_scent(held, star.papers(spark, d).select(F.concat(F.lit("o"), "id").alias("id"), "references_id"))


@query(f"WITH {REFS}, {OUTSIDE}, s AS (SELECT 'p' || part AS id, count(*) AS scent FROM refs WHERE part NOT IN (SELECT part FROM own) GROUP BY 1 UNION ALL SELECT 'o' || paper, count(*) FROM refs JOIN own USING (part) JOIN orders ON o_orderkey = paper GROUP BY 1) SELECT id, CAST(sum(scent) AS BIGINT) AS scent FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def combined_ranking_topk(spark, d):
    back = backward_scent(spark, d).withColumn("id", F.concat(F.lit("p"), "id"))
    return scent.ranked(scent.combined(back, forward_scent(spark, d)), 50)


@query(f"WITH {REFS}, {OUTSIDE} SELECT (SELECT count(DISTINCT part) FROM refs WHERE part NOT IN (SELECT part FROM own)) AS backward, CAST(0 AS BIGINT) AS forward, (SELECT count(*) FROM own) AS seeds, false AS has_cited_by")
def growth_preview(spark, d):
    return scent.growth_preview(_citing(spark, d))


@query("WITH c AS (SELECT DISTINCT l_partkey AS t, CAST(l_orderkey AS VARCHAR) AS o FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY o) AS n FROM c) SELECT CAST(t AS VARCHAR) AS target, string_agg(o, ',' ORDER BY o) AS citers FROM r WHERE n <= 10 GROUP BY 1")
def citers_capped(spark, d):
    targets = star.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("target"))
    return scent.citing_batch(star.papers(spark, d).select("id", "references_id"), targets, 10).withColumn("citers", F.array_join("citers", ","))


@query(f"WITH {REFS} SELECT CAST(paper AS VARCHAR) AS id, string_agg(CASE WHEN part % 4 = 0 THEN '-' ELSE '10.1/' || part END, ',' ORDER BY CAST(part AS VARCHAR)) AS dois FROM refs GROUP BY 1")
def refs_doi_lookup(spark, d):
    lookup = star.table(spark, d, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string")).alias("doi"))
    return scent.references_doi(star.papers(spark, d), lookup).select("id", F.array_join("references_doi", ",", "-").alias("dois"))


# Identity, merge, curation --------------------------------------------------------------------

_ID_SQL = "CASE WHEN k % 3 = 0 THEN 'doi:' || left(sha256('10.9/ab' || k), 16) WHEN k % 3 = 1 THEN 'src:' || left(sha256('W' || k), 16) ELSE 'tt:' || left(sha256('order ' || k || '|' || CASE WHEN k % 2 = 0 THEN CAST(year AS VARCHAR) ELSE 'None' END), 16) END"


@query(f"WITH {HEADS} SELECT k, {_ID_SQL} AS id FROM heads")
def compute_id(spark, d):
    k = F.col("id").cast("long")
    h = star.heads(spark, d).select(
        k.alias("k"), F.when(k % 3 == 0, F.concat(F.lit("https://doi.org/10.9/AB"), "id")).alias("doi"), F.when(k % 3 == 1, F.concat(F.lit("W"), "id")).alias("source_id"),
        F.concat(F.lit("  Order "), "id", F.lit("\t")).alias("title"), F.when(k % 2 == 0, F.col("year")).alias("year"),
    )
    return h.select("k", identity.compute_id(F.col("doi"), F.col("source_id"), F.col("title"), F.col("year")).alias("id"))


def _two_corpora(spark, d) -> tuple[DataFrame, DataFrame]:
    """Papers up to two thirds of the keys, and from one third on with newer years, titles and statuses."""
    p = star.papers(spark, d).withColumn("k", F.col("id").cast("long"))
    seq = (F.col("k") + 1).alias("_seq")
    a = p.where("k % 3 <> 2").select(*[c for c in p.columns if c != "k"], seq)
    b = p.where("k % 3 <> 0").withColumn("year", F.when(F.col("k") % 2 == 0, F.col("year") + 1)).withColumn("title", F.concat("title", F.lit(" bis"))).withColumn("is_seed", F.lit(False))
    b = b.withColumn("keywords_id", F.array(F.lit("x"), F.lit("Brand#1"))).withColumn("curation_status", F.lit("candidate"))
    return a, b.select(*[c for c in p.columns if c != "k"], seq)


@query(f"WITH {HEADS} SELECT id, CASE WHEN k % 3 = 0 THEN year WHEN k % 2 = 0 THEN year + 1 WHEN k % 3 = 2 THEN NULL ELSE year END AS year, 'Order ' || id || CASE WHEN k % 3 = 0 THEN '' ELSE ' bis' END AS title, CASE WHEN k % 3 = 0 THEN is_seed ELSE false END AS is_seed FROM heads")
def corpus_merge_scalar(spark, d):
    return merging.merge(*_two_corpora(spark, d)).select("id", "year", "title", "is_seed")


@query(f"""WITH {HEADS}, w AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id, p_brand AS v FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 3 <> 2 UNION SELECT id, unnest(['x', 'Brand#1']) FROM heads WHERE k % 3 <> 0)
SELECT id, string_agg(v, ',' ORDER BY v) AS words FROM w GROUP BY 1 UNION ALL SELECT id, NULL FROM heads WHERE id NOT IN (SELECT id FROM w)""")
def corpus_merge_lists(spark, d):
    return merging.merge(*_two_corpora(spark, d)).select("id", F.array_join("keywords_id", ",").alias("words"))


@query(f"WITH {HEADS} SELECT id, CASE WHEN k % 3 = 2 THEN 'candidate' ELSE curation_status END AS status FROM heads")
def merge_by_priority(spark, d):
    return merging.merge(*_two_corpora(spark, d)).select("id", F.col("curation_status").alias("status"))


@query(f"WITH {HEADS}, a AS (SELECT id, k + 1 AS seq FROM heads WHERE k % 3 <> 2), m AS (SELECT max(seq) AS m FROM a) SELECT id, seq FROM a UNION ALL SELECT id, k + 1 + m FROM heads, m WHERE k % 3 = 2")
def first_appearance_seq(spark, d):
    return merging.merge(*_two_corpora(spark, d)).select("id", F.col("_seq").alias("seq"))


_DECISIONS = "dec AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'accepted' ELSE 'rejected' END AS action, ts, event_id FROM events WHERE event_type IN ('purchase', 'error'))"


@query(f"""WITH {_DECISIONS}, e AS (SELECT *, event_id % 2 AS side FROM dec), s AS (SELECT user_id, side, max(ts) AS t, arg_max(action, ts) AS st FROM e GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN a.st WHEN a.user_id IS NULL THEN b.st WHEN a.t > b.t THEN a.st ELSE b.st END AS status FROM (SELECT * FROM s WHERE side = 0) a FULL JOIN (SELECT * FROM s WHERE side = 1) b USING (user_id)""")
def merge_curation_status(spark, d):
    """Two decision logs of the same papers: each side's status is its last decision, the later side wins."""
    e = star.table(spark, d, "events").where("event_type in ('purchase', 'error')")
    action = F.when(F.col("event_type") == "purchase", "accepted").otherwise("rejected")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    e = e.select("user_id", (F.col("event_id") % 2).alias("side"), "ts", action.alias("action"), prov.event(action, decided_at=at).alias("event"))
    sides = e.groupBy("user_id", "side").agg(F.max_by("action", "ts").alias("st"), F.collect_list("event").alias("ev"))
    a, b = (sides.where(F.col("side") == k).select("user_id", F.col("st").alias(f"s{k}"), F.col("ev").alias(f"e{k}")) for k in (0, 1))
    return a.join(b, "user_id", "full_outer").select("user_id", prov.merged_status(F.col("s0"), F.col("s1"), F.col("e0"), F.col("e1")).alias("status"))


@query(f"WITH {HEADS} SELECT id FROM heads WHERE k % 3 = 2")
def insert_new_anti(spark, d):
    a, b = _two_corpora(spark, d)
    return b.join(a, "id", "left_anti").select("id")


@query(f"WITH {HEADS}, q AS (SELECT DISTINCT CASE user_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'https://doi.org/10.5/A' || user_id ELSE 'W' || user_id END AS ident, user_id FROM events) SELECT ident, h.id FROM q LEFT JOIN heads h ON h.k = user_id")
def resolve_ident(spark, d):
    corpus = conform(star.heads(spark, d).withColumn("doi", F.concat(F.lit("10.5/a"), "id")).withColumn("source_id", F.concat(F.lit("W"), "id")))
    u = F.col("user_id")
    q = star.table(spark, d, "events").select(F.when(u % 3 == 0, u.cast("string")).when(u % 3 == 1, F.concat(F.lit("https://doi.org/10.5/A"), u.cast("string"))).otherwise(F.concat(F.lit("W"), u.cast("string"))).alias("ident"))
    return merging.resolve(corpus, q)


@query(f"WITH {HEADS} SELECT id, CASE WHEN k % 10 = 0 THEN 'accepted' WHEN k % 10 = 1 THEN 'rejected' ELSE curation_status END AS status, CASE WHEN k % 10 < 2 THEN 1 ELSE 0 END AS events FROM heads")
def apply_curation(spark, d):
    k = F.col("id").cast("long") % 10
    corpus = conform(star.heads(spark, d))
    chosen = star.heads(spark, d).where(k < 2).select("id", F.when(k == 0, "accepted").otherwise("rejected").alias("decision"))
    out = merging.curate(corpus, chosen, "me", "2024-01-01T00:00:00")
    return out.select("id", F.col("curation_status").alias("status"), F.coalesce(F.size(prov.parse(F.col("provenance"))), F.lit(0)).alias("events"))


@query("SELECT user_id, event_type AS engine, arg_max(event_id, event_id) AS id FROM events GROUP BY 1, 2")
def external_ids_latest(spark, d):
    e = star.table(spark, d, "events").select(F.col("user_id"), F.col("event_type").alias("engine"), F.col("event_id").alias("id"), F.col("event_id").alias("written"))
    return merging.latest_by(e, ["user_id", "engine"], "written").select("user_id", "engine", "id")


@query("SELECT arg_max(event_type, ts) AS state, max(ts) AS at FROM events")
def loop_state_latest(spark, d):
    return star.table(spark, d, "events").agg(F.max_by("event_type", "ts").alias("state"), F.max("ts").alias("at"))


@query("SELECT DISTINCT user_id AS ref_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view' AND event_id < 50) UNION SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND event_id < 50")
def append_unseen_refs(spark, d):
    e = star.table(spark, d, "events").select(F.col("user_id").alias("ref_id"), "event_type", "event_id")
    return merging.unseen(e.where("event_type = 'view' and event_id < 50").select("ref_id").distinct(), e.select("ref_id"), "ref_id")


# Views and filters --------------------------------------------------------------------------


@query(f"WITH {HEADS} SELECT id, year, is_seed, curation_status FROM heads WHERE is_seed")
def view_seeds(spark, d):
    return filters.view(star.heads(spark, d), "seed")


@query(f"WITH {HEADS} SELECT id, year, is_seed, curation_status FROM heads WHERE curation_status = 'candidate'")
def view_candidates(spark, d):
    return filters.view(star.heads(spark, d), "candidate")


@query(f"WITH {HEADS} SELECT id, year, is_seed, curation_status FROM heads WHERE is_seed OR curation_status = 'accepted'")
def scope_accepted(spark, d):
    return filters.scoped(star.heads(spark, d), "accepted")


@query(f"WITH {HEADS} SELECT id, year, is_seed, curation_status FROM heads WHERE curation_status = 'candidate' AND NOT is_seed")
def dump_scope_candidates(spark, d):
    return filters.dump_scope(star.heads(spark, d), "candidates")


@query(f"WITH {HEADS} SELECT id FROM heads WHERE year >= 1997 AND year <= 1999")
def filter_year(spark, d):
    rows = star.heads(spark, d)
    return rows.where(filters.passes(filters.FilterCriterion("year", "gte", 1997)) & filters.passes(filters.FilterCriterion("year", "lte", 1999))).select("id")


@query("SELECT doc_id FROM documents WHERE lower(lang) IN ('en', 'es')")
def filter_language(spark, d):
    docs = star.table(spark, d, "documents").select("doc_id", F.col("lang").alias("language"))
    return docs.where(filters.passes(filters.FilterCriterion("language", "in", ["EN", "es"]))).select("doc_id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL')")
def filter_type(spark, d):
    return star.cited_parts(spark, d).where(filters.passes(filters.FilterCriterion("type", "not_in", ["ECONOMY", "SMALL"]))).select("id")


@query("SELECT CAST(l_partkey AS VARCHAR) AS id FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 30")
def filter_min_citations(spark, d):
    return star.cited_parts(spark, d).where(filters.passes(filters.FilterCriterion("min_citations", "gte", 30))).select("id")


@query(f"""WITH {HEADS}, f AS (SELECT *, CASE WHEN curation_status <> 'candidate' THEN NULL WHEN year < 1997 THEN 0 WHEN year > 2000 THEN 1 END AS failed FROM heads),
n AS (SELECT count(*) FILTER (WHERE curation_status <> 'rejected') AS a, count(*) FILTER (WHERE failed = 0) AS x, count(*) FILTER (WHERE failed = 1) AS y FROM f)
SELECT 'year gte 1997' AS name, a AS count_before, a - x AS count_after FROM n UNION ALL SELECT 'year lte 2000', a - x, a - x - y FROM n""")
def prisma_flow_counts(spark, d):
    _, steps = filters.apply_filters(conform(star.heads(spark, d)), filters.standard_criteria(min_year=1997, max_year=2000), "2024-01-01T00:00:00")
    return spark.createDataFrame([(s.name, s.count_before, s.count_after) for s in steps], "name string, count_before long, count_after long")


@query(f"WITH {HEADS} SELECT id, CASE WHEN curation_status = 'candidate' AND (year < 1997 OR year > 2000) THEN 'rejected' ELSE curation_status END AS status, CASE WHEN curation_status <> 'candidate' THEN NULL WHEN year < 1997 THEN 'year gte 1997' WHEN year > 2000 THEN 'year lte 2000' END AS reason FROM heads")
def prisma_rejections(spark, d):
    out, _ = filters.apply_filters(conform(star.heads(spark, d)), filters.standard_criteria(min_year=1997, max_year=2000), "2024-01-01T00:00:00")
    return out.select("id", F.col("curation_status").alias("status"), F.get(prov.parse(F.col("provenance")), F.lit(0))["source"].alias("reason"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title FROM part WHERE contains(lower(p_name), 'ring') AND p_size <= 25")
def list_papers_title(spark, d):
    return filters.papers_like(star.cited_parts(spark, d), query="RING", is_seed=True).select("id", "title")


@query(f"""WITH {HEADS}, a AS (SELECT l_orderkey AS k, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ' | ' ORDER BY CAST(l_suppkey AS VARCHAR)) AS a, string_agg(DISTINCT p_brand, ' | ' ORDER BY p_brand) AS w FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT id, 'Order ' || id AS title, CAST(year AS VARCHAR) AS year, coalesce(a, '') AS authors, coalesce(w, '') AS keywords, 'False' AS is_seed, 'undecided' AS decision FROM heads LEFT JOIN a USING (k) WHERE curation_status = 'candidate' AND NOT is_seed""")
def curation_dump_rows(spark, d):
    return curation_rows(star.papers(spark, d)).select("id", "title", "year", "authors", "keywords", "is_seed", "decision")


# Aggregates and reads -----------------------------------------------------------------------


@query(f"WITH {HEADS} SELECT curation_status AS key, count(*) AS n FROM heads GROUP BY 1")
def stats_by_status(spark, d):
    return aggregates.stats_by(star.heads(spark, d), "curation_status")


@query(f"WITH {HEADS} SELECT year AS key, count(*) AS n FROM heads GROUP BY 1")
def stats_by_year(spark, d):
    return aggregates.stats_by(star.heads(spark, d), "year")


@query(f"WITH {HEADS} SELECT is_seed AS key, count(*) AS n FROM heads GROUP BY 1")
def stats_by_seed(spark, d):
    return aggregates.stats_by(star.heads(spark, d), "is_seed")


@query(f"""WITH {HEADS}, i AS (SELECT count(DISTINCT s_nationkey)::DOUBLE AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey),
a AS (SELECT count(*)::DOUBLE AS v FROM (SELECT l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2)), n AS (SELECT count(*)::DOUBLE AS v FROM heads)
SELECT 'min_volume' AS measure, v AS value, 200.0::DOUBLE AS threshold, v >= 200 AS passed FROM n UNION ALL SELECT 'min_doi_refs_pct', 0, 0.9, false UNION ALL SELECT 'min_countries', v, 5, v >= 5 FROM i UNION ALL SELECT 'min_recurrent_authors', v, 10, v >= 10 FROM a UNION ALL SELECT 'overall', NULL, NULL, false""")
def quality_report(spark, d):
    return aggregates.quality_report(star.papers(spark, d))


@query(f"WITH {HEADS} SELECT bool_or(curation_status IN ('accepted', 'rejected')) AS curated, false AS saturated, count(*) AS papers FROM heads")
def maturity(spark, d):
    return aggregates.maturity(star.heads(spark, d))


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS paper_id, CAST(l_suppkey AS VARCHAR) AS author FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def materialize_author(spark, d):
    return networks.exploded(star.papers(spark, d), "authors_id", "author")


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS paper_id, p_brand AS keyword FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey")
def materialize_keyword(spark, d):
    return networks.exploded(star.papers(spark, d), "keywords_id", "keyword")


@query("SELECT p_brand AS value, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def document_frequency(spark, d):
    return aggregates.document_frequency(star.papers(spark, d), "keywords_id")


@query("SELECT split_part(p_name, ' ', 2) AS grp, arg_min(p_name, struct_pack(a := -n, b := p_name)) AS canonical FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1) GROUP BY 1")
def canonical_variant(spark, d):
    f = star.table(spark, d, "part").groupBy(F.col("p_name").alias("value")).agg(F.count("*").alias("n"))
    return f.groupBy(F.get(F.split("value", " "), F.lit(1)).alias("grp")).agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("canonical"))


@query(f"WITH {HEADS} SELECT id, CASE WHEN k % 4 = 3 THEN 'added' ELSE 'removed' END AS change FROM heads WHERE k % 4 IN (3, 0)")
def snapshot_diff(spark, d):
    h, k = star.heads(spark, d), F.col("id").cast("long") % 4
    return aggregates.snapshot_diff(h.where(k != 3), h.where(k != 0))


# Preprocessing ------------------------------------------------------------------------------


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN lang WHEN 2 THEN NULL ELSE lang END AS language FROM documents")
def normalize_language(spark, d):
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat(F.upper("lang"), F.lit("-US"))).when(k == 1, F.concat(F.lit(" "), "lang", F.lit("_419"))).when(k == 2, F.lit(" ")).otherwise(F.col("lang"))
    return star.table(spark, d, "documents").select("doc_id", text.normalize_language(raw).alias("language"))


@query("SELECT p_partkey AS id, lower(strip_accents(p_name)) AS name FROM part")
def normalize_names(spark, d):
    odd = F.array(F.concat(F.lit("  "), F.replace(F.upper("p_name"), F.lit("E"), F.lit("É")), F.lit("  ")))
    return star.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.get(text.normalize_list(odd), F.lit(0)).alias("name"))


@query("""WITH w AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN p_name LIKE 'red %' THEN 'colour_red' WHEN p_name LIKE 'blue %' THEN 'colour_blue' ELSE p_name END AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey) SELECT id, string_agg(v, ',' ORDER BY v) AS words FROM w GROUP BY 1""")
def thesaurus_map(spark, d):
    names = star.table(spark, d, "part").where(F.startswith("p_name", F.lit("red ")) | F.startswith("p_name", F.lit("blue ")))
    alias = F.get(text.normalize_list(F.array(F.upper("p_name"))), F.lit(0)).alias("alias")
    lookup = names.select(alias, F.concat(F.lit("colour_"), F.substring_index("p_name", " ", 1)).alias("canonical")).distinct()
    out = preprocess.apply_thesaurus(star.papers(spark, d), lookup).where("keywords_raw is not null")
    return out.select("id", F.array_join(F.array_sort("keywords_id"), ",").alias("words"))


def _inverted(batches):
    """(doc_id, ix) of texts, {word: positions}; a few texts at a time are held as words."""
    import pyarrow as pa

    for batch in batches:
        for k in range(0, batch.num_rows, ABSTRACTS_AT_ONCE):
            some, held = batch.slice(k, ABSTRACTS_AT_ONCE), []
            for told in some.column("text").to_pylist():
                places: dict[str, list[int]] = {}
                for i, w in enumerate(w for w in re.split(r"[ \t\n\x0b\f\r]+", told) if w):
                    places.setdefault(w, []).append(i)
                held.append(list(places.items()))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(held, pa.map_(pa.string(), pa.list_(pa.int32())))], ["doc_id", "ix"])


@query("SELECT doc_id, abstract FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS abstract FROM documents) WHERE abstract <> ''")
def abstract_rebuild(spark, d):
    """Whole texts turned into inverted indexes {word: positions}, where they are read, and back by the operator."""
    from citeloom.sources.works_json import abstract

    rows = star.table(spark, d, "documents").select("doc_id", "text").where(F.col("text").rlike(r"\S"))
    return rows.mapInArrow(_inverted, "doc_id long, ix map<string,array<int>>").select("doc_id", abstract(F.col("ix")).alias("abstract"))


# Without SQL --------------------------------------------------------------------------------


@query()
def louvain(spark, d):
    return communities.detect_communities(networks.project(star.cocitation(spark, d)), "louvain")


@query()
def label_propagation(spark, d):
    return graph.label_propagation(networks.project(star.cocitation(spark, d)))


@query()
def greedy_modularity(spark, d):
    return communities.detect_communities(networks.project(star.authors(spark, d)), "greedy_modularity")


@query()
def betweenness(spark, d):
    return paths.betweenness(networks.project(star.authors(spark, d)))


@query()
def fuzzy_keywords(spark, d):
    names = star.table(spark, d, "part").groupBy(F.col("p_name").alias("value")).agg(F.count("*").alias("n"))
    return preprocess.variant_clusters(names, 0.80)


@query()
def fuzzy_authors(spark, d):
    names = star.table(spark, d, "supplier").select(F.col("s_name").alias("value"), F.lit(1).cast("long").alias("n"))
    return preprocess.variant_clusters(names, preprocess.AUTHOR_THRESHOLD)
