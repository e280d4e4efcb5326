"""Keeps a stage of expensive columns from being computed twice."""

from pyspark.sql import DataFrame, functions as F


def pin(df: DataFrame, *cols: str) -> DataFrame:
    """Fix the computed columns ``cols``: later filters read them instead of recomputing them.

    The optimizer moves a filter below the projections it refers to by repeating their
    expressions, which for a chain of regular expressions costs a second (or tenth) run of the
    whole chain. It does not move filters below a generator, and a one-element ``inline`` is a
    generator that costs one struct per row and stays inside whole-stage code generation.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    return df.select(*kept, F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in cols]))))
