"""The queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, decontaminate, fill_in_middle, importance_sampling, language_id, line_dedup, ngram_join, pii, quality_rules, secrets, substring_dedup, toxicity
from .common import fold_of, table

Query = Callable[[SparkSession, str], DataFrame]


def _folded(docs: DataFrame, folds: int, held: int) -> DataFrame:
    """``docs`` with ``held_out``; a null id is in no fold: it isn't held out, and nothing is learned from it."""
    return docs.withColumn("held_out", F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False)))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _folded(table(spark, sf_dir, "documents").select("doc_id", "text"), 5, 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold_of(F.col("doc_id"), 5) != 0)
    model = toxicity.fit(docs.where(fold_of(F.col("doc_id"), 5) != 0), labels)
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("kept_text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _folded(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), 4, 2)
    model = language_id.fit(docs.where(fold_of(F.col("doc_id"), 4) != 2))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan_documents(docs, dictionary=secrets.identifiers(docs)).drop("text")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digests = ["n_tokens", "ids_sha256", "decoded_sha256"]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN, digests).select("doc_id", *digests)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transform(table(spark, sf_dir, "documents"), output=False)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("kept_text")


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_language_id": op3_language_id,
        "op4_importance_resampling": op4_importance_resampling,
        "op5_quality_rules": op5_quality_rules,
        "op6_secret_scan": op6_secret_scan,
        "op7_decontamination": op7_decontamination,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_ngram_join": op9_ngram_join,
        "op10_pii": op10_pii,
        "op11_collocations": op11_collocations,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_line_dedup": op13_line_dedup,
    }


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COLLOCATIONS_SQL = rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 seqs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
 totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM seqs GROUP BY lang),
 grams AS (SELECT lang, size, array_to_string(w[pos:pos + size - 1], ' ') AS phrase
   FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS size FROM seqs) WHERE len(w) >= size)),
 f AS (SELECT lang, size, phrase, count(*) AS n, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 30),
 cand AS (SELECT * FROM f WHERE size > 1),
 cuts AS (SELECT c.lang, c.size, c.phrase, c.n AS a, k, array_to_string(c.w[1:k], ' ') AS head, array_to_string(c.w[k + 1:size], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c),
 scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.n AS l, y.n AS r, CAST(CAST(c.a AS HUGEINT) * 2000000 // (CAST(x.n AS HUGEINT) + y.n) AS BIGINT) AS score
   FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
 low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 inner_parts AS (SELECT lang, n, array_to_string(w[pos:pos + m - 1], ' ') AS phrase
   FROM (SELECT lang, n, w, m, unnest(range(1, size - m + 2)) AS pos FROM (SELECT lang, n, w, size, unnest(range(2, size)) AS m FROM cand WHERE size > 2))),
 most AS (SELECT lang, phrase, max(n) AS most FROM inner_parts GROUP BY lang, phrase),
 ranked AS (SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank
   FROM low LEFT JOIN most ON most.lang = low.lang AND most.phrase = low.phrase WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT))
 SELECT lang, rank, phrase, a, l, r, totals.n AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

FILL_IN_MIDDLE_SQL = r"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
 units AS (SELECT doc_id, t, regexp_extract_all(t, '[ 	-]*[^ 	-]+|[ 	-]+') AS u,
   CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM docs),
 cuts AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS i, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS j,
   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
 parts AS (SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:n], '') AS s FROM cuts)
 SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""

LINE_DEDUP_SQL = rf"""WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, 9223372036854775807) AS id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
 lines AS (SELECT row, doc_id, id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM docs),
 keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[ 	-]+', ''), '[ 	-]+$', ''), '{UPPER}', '{LOWER}') AS key FROM lines),
 seen AS (SELECT key, min(id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(id) <> max(id)),
 judged AS (SELECT k.*, coalesce(s.first <> k.id, false) AS gone FROM keyed k LEFT JOIN seen s ON s.key = k.key)
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY row, doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": COLLOCATIONS_SQL, "op12_fill_in_middle": FILL_IN_MIDDLE_SQL, "op13_line_dedup": LINE_DEDUP_SQL}
