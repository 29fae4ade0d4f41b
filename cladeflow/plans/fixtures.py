"""Classification tables derived from the driver's: an order is a virus, a line a protein, a brand a model, a part type a class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = "C[0-9]+"
TIES = ("l_partkey", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def target_name() -> F.Column:
    return F.concat(F.lit("C"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        target_name().alias("target_name"), F.col("p_brand").alias("query_name"), (F.col("l_discount") / 50).alias("sequence_e_value"), F.sqrt("l_extendedprice").alias("sequence_score"), *TIES
    )


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(target_name().alias("protein_name")).agg((F.max("l_quantity") / 1000).alias("k_base_size"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    own = parts.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), (1 + F.sum("p_size") % 5).cast("int").alias("class_cat"))
    brand = parts.groupBy("p_brand").agg(F.count("*").alias("m"))
    return own.join(brand, "p_brand").select(F.col("p_brand").alias("model_name"), F.col("p_type").alias("class_name"), (F.lit(100.0) * F.col("n") / F.col("m")).alias("class_percent"), "class_cat")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((20 * F.sqrt("o_totalprice")).alias("virus_hit_score"))


SQL = """hits AS (SELECT 'C' || l_orderkey || '_' || l_linenumber AS target_name, p_brand AS query_name, l_discount / 50 AS sequence_e_value,
  sqrt(l_extendedprice) AS sequence_score, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey),
proteins AS (SELECT 'C' || l_orderkey || '_' || l_linenumber AS protein_name, max(l_quantity) / 1000 AS k_base_size FROM lineitem GROUP BY l_orderkey, l_linenumber),
classes AS (SELECT p_brand AS model_name, p_type AS class_name, 100.0::DOUBLE * n / m AS class_percent, class_cat FROM
  (SELECT p_brand, p_type, count(*) AS n, (1 + sum(p_size) % 5)::INTEGER AS class_cat FROM part GROUP BY ALL) JOIN (SELECT p_brand, count(*) AS m FROM part GROUP BY ALL) USING (p_brand)),
samples AS (SELECT 20 * sqrt(o_totalprice) AS x FROM orders),
named AS (SELECT regexp_extract(target_name, '^C[0-9]+') AS virus_name, * FROM hits WHERE sequence_e_value <= 0.001),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY virus_name, target_name ORDER BY sequence_score DESC, l_partkey, l_suppkey, query_name) AS r FROM named) WHERE r = 1),
aggregated AS (SELECT virus_name, query_name AS model_name, sum(sequence_score / k_base_size) AS protein_hit_score FROM best JOIN proteins ON target_name = protein_name GROUP BY ALL),
scored AS (SELECT virus_name, class_name, sum(protein_hit_score * class_percent / 100 * ((5 - class_cat) / 4::DOUBLE)) AS class_score FROM aggregated JOIN classes USING (model_name) GROUP BY ALL),
totals AS (SELECT *, sum(class_score) OVER (PARTITION BY virus_name) AS total FROM scored),
asked AS (SELECT DISTINCT round(total, 6) AS x FROM totals),
counted AS (SELECT x, sum(n) AS n FROM (SELECT x, 1 AS n FROM samples UNION ALL SELECT x, 0 FROM asked) GROUP BY x),
ranks AS (SELECT x, (sum(n) OVER (ORDER BY x) - n / 2.0::DOUBLE) / sum(n) OVER () AS confidence FROM counted)"""
