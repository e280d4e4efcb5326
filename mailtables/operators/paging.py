"""Pages at any distance from the start of an order, without sorting everything into one place."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def in_order(name: str, up: bool) -> Column:
    """NULL comes first upwards and last downwards."""
    return F.col(name).asc_nulls_first() if up else F.col(name).desc_nulls_last()


def not_before(order: list, row) -> Column:
    """Rows that are not in front of ``row`` in the order."""
    tied, behind = F.lit(True), []
    for name, up in order:
        value, at = F.col(name), F.lit(row[name])
        if row[name] is None:
            later, same = (value.isNotNull() if up else F.lit(False)), value.isNull()
        else:
            later = (value > at) if up else (value < at) | value.isNull()
            same = value == at
        behind.append(tied & F.coalesce(later, F.lit(False)))
        tied = tied & F.coalesce(same, F.lit(False))
    return reduce(lambda a, b: a | b, behind) | tied


def ordered_page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """``limit`` rows behind ``offset`` rows, by ``[(column, ascending), ...]``.

    One way for every offset and type of column: one job sorts the order columns alone into ranges and
    returns the size and the first row of each (a row for each shuffle partition). The page starts in
    the range where the sizes add up to the offset, so only rows from that range's first one on are
    read for it, and a task sends at most a range's rows and the page to the final sort.
    """
    sort = [in_order(c, up) for c, up in order]
    names = list(dict.fromkeys(c for c, _ in order))
    ranges = df.select(*names).repartitionByRange(*sort).sortWithinPartitions(*sort)
    # A range is read in its order, so the first row met is its smallest.
    sizes = ranges.groupBy(F.spark_partition_id().alias("part")).agg(
        F.count("*").alias("rows"), F.first(F.struct(*names)).alias("start")
    )
    before, start = 0, None
    for part in sizes.orderBy("part").collect():
        if before + part.rows > offset:
            start = part.start
            break
        before += part.rows
    if start is None:
        return df.limit(0)
    return df.filter(not_before(order, start)).orderBy(*sort).offset(offset - before).limit(limit)
