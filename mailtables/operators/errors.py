"""The error channel: a row that fails a check keeps the stage and the reason, and every row is accounted for."""

from pyspark.sql import Column, DataFrame, functions as F

FAILURE = "_failure"


def check(df: DataFrame, stage: str, rules: dict) -> DataFrame:
    """Mark the rows for which a rule of ``stage`` holds; ``rules`` maps reasons to conditions.

    A row that has failed an earlier stage keeps that failure. Put ``passing`` around what an expensive
    step reads, so that it does no work for failed rows.
    """
    found = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), reason) for reason, rule in rules.items()]))
    failure = F.when(F.size(found) > 0, F.struct(F.lit(stage).alias("stage"), F.array_join(found, "; ").alias("reason")))
    return df.withColumn(FAILURE, F.coalesce(FAILURE, failure) if FAILURE in df.columns else failure)


def passing(value: Column) -> Column:
    return F.when(F.col(FAILURE).isNull(), value)


def good_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(FAILURE).isNull()).drop(FAILURE)


def dead_letters(df: DataFrame, *columns: str) -> DataFrame:
    """``columns``, ``stage`` and ``reason`` of the rows that failed."""
    return df.filter(F.col(FAILURE).isNotNull()).select(*columns, f"{FAILURE}.stage", f"{FAILURE}.reason")


def accounting(arrived: DataFrame, stored: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: how many rows came in, were stored and failed, and whether that adds up."""
    counts = [d.agg(F.count("*").alias(n)).withColumn("_one", F.lit(1)) for n, d in (("arrived", arrived), ("stored", stored), ("failed", dead))]
    row = counts[0].join(counts[1], "_one").join(counts[2], "_one").drop("_one")
    return row.withColumn("balanced", F.col("arrived") == F.col("stored") + F.col("failed"))
