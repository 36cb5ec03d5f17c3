"""Networks, label matrices, score matrices and features derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.operators.windows import with_totals


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge (src, dst, w) in both directions."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def supplier_part_edges(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Both directions of the supplier-part network; the weight counts line items."""
    return both_ways(
        read(spark, sf_dir, "lineitem")
        .where("l_suppkey IS NOT NULL AND l_partkey IS NOT NULL")
        .where(where)
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.count("*").cast("double").alias("w"))
        .select(
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"),
            F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
            "w",
        )
    )


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User x event type as (gene, label, n, y, p): y marks counts above the type's mean, p is the scaled sum of values."""
    events = read(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    types = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]
    wide = events.groupBy(F.col("user_id").alias("gene")).pivot("event_type", types).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    zero = F.lit(0.0)
    cells = F.array(
        *[
            F.struct(
                F.lit(t).alias("label"),
                F.coalesce(F.col(f"`{t}_n`").cast("double"), zero).alias("n"),
                F.coalesce(F.round(F.col(f"`{t}_v`"), 2), zero).alias("v"),
            )
            for t in types
        ]
    )
    long = wide.select("gene", F.explode(cells).alias("c")).select("gene", "c.*")
    return with_totals(long, _mean=F.avg("n"), _most=F.max("v")).select(
        "gene",
        "label",
        "n",
        (F.col("n") > F.col("_mean")).cast("double").alias("y"),
        F.round(F.col("v") / F.col("_most"), 6).alias("p"),
    )


def brand_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as genes, brands as labels: (gene, label, y)."""
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("gene"), F.col("p_brand").alias("label"), F.lit(1.0).alias("y")
    )


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, x): the embeddings as arrays of doubles."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("x"))
