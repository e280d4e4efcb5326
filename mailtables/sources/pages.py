"""Pages of a sorted table by a directory of its files' ranks."""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.paging import in_order


def write_ranked(df: DataFrame, path: str, order: list, files: int = None) -> None:
    """Write ``df`` sorted by ``[(column, ascending), ...]`` and, beside it, the directory of its files.

    The order is made once, when the table is written: ranges of rows, each a sorted file. The directory has a row
    for each file: its place among the files, how many rows lie before it and how many it holds. Ties that the order
    leaves are broken by a hash of the row, so that pages never overlap.
    """
    sort = [in_order(c, up) for c, up in order] + [F.col("_row_hash")]
    df = df.withColumn("_row_hash", F.xxhash64(*df.columns))
    ranged = df.repartitionByRange(files, *sort) if files else df.repartitionByRange(*sort)
    ranged = ranged.sortWithinPartitions(*sort).withColumn("_range", F.spark_partition_id())
    ranged.write.partitionBy("_range").parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    sizes = stored.groupBy("_range").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes.select("_range", before.alias("before"), "rows").coalesce(1).write.parquet(f"{path}/ranks")


def ranked_page(spark: SparkSession, path: str, order: list, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the order, from the files that hold them and no others."""
    ranks = spark.read.parquet(f"{path}/ranks")
    held = ranks.filter((F.col("before") < offset + limit) & (F.col("before") + F.col("rows") > offset)).orderBy("_range").collect()
    rows = spark.read.parquet(f"{path}/rows")
    if not held:
        return rows.drop("_range", "_row_hash").limit(0)
    part = rows.filter(F.col("_range").isin([r["_range"] for r in held]))
    sort = [in_order(c, up) for c, up in order] + [F.col("_row_hash")]
    return part.orderBy(*sort).offset(offset - held[0].before).limit(limit).drop("_range", "_row_hash")
