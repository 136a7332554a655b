"""The paper table seen in a star schema: orders cite parts, suppliers sign them, brands are keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.schema import conform

#: Order lines that one task turns into papers, on average.
LINES_OF_A_TASK = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper, part, supplier) of each order line."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))


def coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(F.col("paper").alias("node"), F.col("part").alias("grp"))


def cocitation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(F.col("part").alias("node"), F.col("paper").alias("grp"))


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(F.col("supplier").alias("node"), F.col("paper").alias("grp"))


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").cast("long").alias("node"))
    return lines(spark, sf_dir).join(s, "supplier").select("node", F.col("paper").alias("grp"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("node"))
    return lines(spark, sf_dir).join(p, "part").select("node", F.col("paper").alias("grp"))


def _status(priority):
    return F.when(priority == "1-URGENT", "accepted").when(priority == "5-LOW", "rejected").otherwise("candidate")


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, year, is_seed, curation_status) of each paper, without lists."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "F").alias("is_seed"), _status(F.col("o_orderpriority")).alias("curation_status"))


def parts_for(rows: DataFrame) -> int:
    """Partitions for a shuffle of rows, so that a task's share doesn't grow with the table."""
    return rows.count() // LINES_OF_A_TASK + 1


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as papers of 23 columns: one aggregation over the lines, joined to the orders.

    Both sides are dealt by the order's number to a number of partitions that follows the lines.  Lines are sent
    there as numbers and hold their parts' and suppliers' attributes only where they are aggregated.
    """
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name", "p_brand")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), "s_nationkey")
    listed = lambda c, name: F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(name)
    held = lines(spark, sf_dir)
    parts = parts_for(held)
    lists = held.join(part, "part").join(supplier, "supplier").repartition(parts, "paper").groupBy("paper").agg(
        listed("part", "references_id"), listed("supplier", "authors_id"), listed("s_nationkey", "institutions_id"), listed("p_brand", "keywords_id"), listed("p_name", "keywords_raw")
    )
    h = heads(spark, sf_dir).withColumn("title", F.concat(F.lit("Order "), "id")).withColumn("k", F.col("id").cast("long"))
    return conform(h.repartition(parts, "k").join(lists, F.col("k") == F.col("paper"), "left"))


def cited_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as papers, cited by the orders that list them; small parts are the seeds."""
    cited = lines(spark, sf_dir).groupBy("part").agg(F.array_sort(F.collect_set(F.col("paper").cast("string"))).alias("cited_by_id"))
    p = table(spark, sf_dir, "part").join(cited, F.col("p_partkey") == F.col("part"), "left")
    return conform(p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), (F.col("p_size") <= 25).alias("is_seed"), F.lit("candidate").alias("curation_status"), "cited_by_id", F.lit(2000).alias("year"), F.array("p_type").alias("research_areas")))


__all__ = ["authors", "cited_parts", "cocitation", "coupling", "heads", "institutions", "keywords", "lines", "papers", "table"]
