"""Tab-separated networks, matrices and id lists, and their way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _line() -> Column:
    """What orders the lines of several files: the file, the part of it that a task read, and the line within that."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """Edges (src, dst, w) in both directions of a file of three columns, or of a folder of them; a pair given again counts as given last.

    Files follow each other by name. Weights that are no numbers are 0.
    """
    from labelweave.operators.network import symmetric

    lines = spark.read.csv(path, sep="\t", schema="src string, dst string, weight string")
    numbered = lines.select("src", "dst", F.expr("coalesce(try_cast(weight AS double), 0.0)").alias("w"), _line().alias("line"))
    return symmetric(numbered.where("src IS NOT NULL AND dst IS NOT NULL"), "line")


def read_matrix(spark: SparkSession, path: str, header: bool = True, row_names: bool = True) -> DataFrame:
    """A matrix as cells (row, col, value), with `position`, the order of the rows. Cells that are no numbers are 0.

    Without a header columns are named c0, c1, …; without row names rows are numbered.
    """
    wide = spark.read.csv(path, sep="\t", header=header)
    names = [f"c{k}" for k in range(len(wide.columns) - row_names)] if not header else wide.columns[int(row_names) :]
    wide = wide.toDF(*(["_row"] * row_names), *[f"v{k}" for k in range(len(names))])
    position = F.monotonically_increasing_id()
    wide = wide.withColumn("position", position)
    row = F.col("_row") if row_names else F.col("position").cast("string")
    cells = F.array(*[F.struct(F.lit(n).alias("col"), F.expr(f"coalesce(try_cast(v{k} AS double), 0.0)").alias("value")) for k, n in enumerate(names)])
    return wide.select(row.alias("row"), "position", F.explode(cells).alias("c")).select("row", "position", "c.col", "c.value")


def read_ids(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(gene, position): the first field of every line."""
    lines = spark.read.text(path).select(F.split("value", "\t")[0].alias("gene"), F.monotonically_increasing_id().alias("position"))
    return lines.where("position > 0") if header else lines


def write_matrix(cells: DataFrame, path: str, row: str = "row", col: str = "col", value: str = "value", row_names: bool = True) -> None:
    """Cells as a tab-separated matrix with six decimals, columns in the order of their names."""
    columns = [r[0] for r in cells.select(col).distinct().orderBy(col).collect()]
    wide = cells.groupBy(row).pivot(col, columns).agg(F.first(value)).orderBy(row)
    numbers = [F.format_string("%.6f", F.coalesce(F.col(f"`{c}`"), F.lit(0.0))).alias(str(c)) for c in columns]
    wide.select(*([row] if row_names else []), *numbers).write.option("header", row_names).csv(path, sep="\t", mode="overwrite")


def write_network(edges: DataFrame, path: str) -> None:
    """Each edge once, with a positive weight in six decimals."""
    edges.where("src < dst AND w > 0").select("src", "dst", F.format_string("%.6f", "w")).write.csv(path, sep="\t", mode="overwrite")
