"""Shuffles on a key that stay balanced when one key holds a large part of the rows."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import shared_dir

# Some hundred megabytes of mails.
ROWS_PER_TASK = 50_000
# Parts of a key that one window sums.
FAN = 1000
# Keys that are broadcast; some megabytes.
FEW_KEYS = 100_000


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order``; ties fall to the larger row hash.

    An aggregate instead of a window: every map task keeps one row per key, so a key with a third
    of the rows sends one row per task through the shuffle.
    """
    payload = [c for c in df.columns if c != key]
    rank = F.struct(*order, F.xxhash64(*payload).alias("_tie"))
    best = F.max_by(F.struct(*payload), rank).alias("_row")
    return df.groupBy(key).agg(best).select(key, "_row.*").select(*df.columns)


def latest_of_repeated(df: DataFrame, key: str, *order: str, few: int = FEW_KEYS) -> DataFrame:
    """``latest_per_key`` in which only the rows of keys that repeat are shuffled.

    Keys are counted first, by themselves, in a job that runs at once. If more than ``few`` repeat, their list is not broadcast
    and all rows are shuffled.
    """
    repeated = df.groupBy(F.col(key).alias("_key")).count().filter("count > 1").select("_key")
    found = repeated.count()
    if not found:
        return df
    if found > few:
        return latest_per_key(df, key, *order)
    same, repeated = F.col(key).eqNullSafe(F.col("_key")), F.broadcast(repeated)
    return df.join(repeated, same, "left_anti").unionByName(latest_per_key(df.join(repeated, same, "left_semi"), key, *order))


def one_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """One row of each key, the one with the largest hash if there are several."""
    payload = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*payload), F.xxhash64(*payload)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def join_unique(left: DataFrame, right: DataFrame, key: str, keys: DataFrame = None,
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Left join to one row per key of ``right``, splitting the hot keys of ``left``.

    Keys with more than ``rows_per_task`` rows (there are at most ``rows / rows_per_task`` of
    them, so the list is broadcast and the rows are not shuffled for it) get several salts: their rows on the left are
    spread by input partition, their row on the right is copied once per salt. ``keys`` may name
    a cheaper table with the same keys to count, such as the scan ``left`` was computed from.
    If ``right`` repeats a key, one of its rows is picked by an aggregate on the join keys, so
    that ``right`` is shuffled once.
    """
    hot = (
        (keys if keys is not None else left).groupBy(key).count()
        .filter(F.col("count") > rows_per_task)
        .select(F.col(key).alias("_hot"), F.ceil(F.col("count") / rows_per_task).cast("int").alias("_salts"))
    )
    is_hot = F.col(key) == F.col("_hot")
    salted_left = (
        left.withColumn("_part", F.spark_partition_id())
        .join(F.broadcast(hot), is_hot, "left")
        .withColumn("_salt", F.coalesce(F.col("_part") % F.col("_salts"), F.lit(0)))
        .drop("_hot", "_salts", "_part")
    )
    salted_right = (
        right.join(F.broadcast(hot), is_hot, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_hot", "_salts")
    )
    return salted_left.join(one_per_key(salted_right, key, "_salt"), [key, "_salt"], "left").drop("_salt")


def rows_before(counts: DataFrame, key: str, parts: int, fan: int = FAN) -> DataFrame:
    """``key, _part, _before``: of each key the rows in earlier parts, from ``key, _part, count``.

    A key in at most ``fan`` parts is summed by one window. With more parts, blocks of ``fan`` of them are
    summed in the same way, level above level, so no window has more than ``fan`` rows of a key.
    """
    block = F.floor(F.col("_part") / fan).cast("long") if parts > fan else F.lit(0).cast("long")
    counts = counts.withColumn("_block", block)
    inside = W.partitionBy(key, "_block").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    summed = counts.withColumn("_before", F.coalesce(F.sum("count").over(inside), F.lit(0)))
    if parts > fan:
        blocks = counts.groupBy(key, F.col("_block").alias("_part")).agg(F.sum("count").alias("count"))
        above = rows_before(blocks, key, -(-parts // fan), fan).toDF("_key", "_above_part", "_above")
        summed = summed.join(above, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_above_part")))
        summed = summed.withColumn("_before", F.col("_before") + F.col("_above"))
    return summed.select(key, "_part", "_before")


def number_per_key(df: DataFrame, key: str, order: str, out: str, start: DataFrame = None,
                   rows_per_task: int = ROWS_PER_TASK, fan: int = FAN) -> DataFrame:
    """1, 2, 3, ... within each key by ``order`` (then row hash), without one task per key.

    ``start`` may hold ``(key, start)``, a number to continue from. Keys with at most ``rows_per_task`` rows are numbered by one
    window, whole rows being shuffled once. The others, of which there are at most ``rows / rows_per_task``, go through
    ``number_hot_keys``; the list of them is written to the shared folder once.
    """
    spark = df.sparkSession
    payload = [c for c in df.columns if c != key]
    path = shared_dir(spark, "hot-keys")
    df.groupBy(F.col(key).alias("_hot")).count().filter(F.col("count") > rows_per_task).write.parquet(path)
    hot = spark.read.parquet(path)
    is_hot = F.col(key).eqNullSafe(F.col("_hot"))
    some = not hot.isEmpty()
    cold = df.join(F.broadcast(hot), is_hot, "left_anti") if some else df
    cold = cold.withColumn("_tie", F.xxhash64(*payload))
    parts = max(-(-cold.count() // rows_per_task), int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.row_number().over(W.partitionBy(key).orderBy(order, "_tie"))
    numbered = cold.repartition(parts, key).withColumn(out, place.cast("long")).drop("_tie")
    if start is not None:
        known = start.select(F.col(key).alias("_key"), F.col("start").alias("_start"))
        joined = numbered.join(known, F.col(key).eqNullSafe(F.col("_key")), "left")
        numbered = joined.withColumn(out, (F.col(out) + F.coalesce("_start", F.lit(0))).cast("long")).drop("_key", "_start")
    numbered = numbered.select(*df.columns, out)
    if not some:
        return numbered
    rest = df.join(F.broadcast(hot), is_hot, "left_semi")
    return numbered.unionByName(number_hot_keys(rest, key, order, out, start, rows_per_task, fan))


def number_hot_keys(df: DataFrame, key: str, order: str, out: str, start: DataFrame = None,
                    rows_per_task: int = ROWS_PER_TASK, fan: int = FAN) -> DataFrame:
    """The numbers of keys that are too large for one task.

    Rows are put into ranges of key, order and hash of about ``rows_per_task`` rows, as many ranges as that takes, and
    written to the shared folder once; a key with a third of the rows fills a third of the ranges, even if its rows are
    equal. Numbers run inside a range and are moved up by the rows that its key has in earlier ranges.
    """
    payload = [c for c in df.columns if c != key]
    df = df.withColumn("_tie", F.xxhash64(*payload)).withColumn("_equal", F.monotonically_increasing_id())
    parts = max(-(-df.count() // rows_per_task), 1)
    sort = [F.col(key), F.col(order), F.col("_tie"), F.col("_equal")]
    path = shared_dir(df.sparkSession, "numbering")
    df.repartitionByRange(parts, *sort).withColumn("_part", F.spark_partition_id().cast("long")).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    local = W.partitionBy("_part", key).orderBy(order, "_tie", "_equal")
    offsets = rows_before(rows.groupBy(key, "_part").count(), key, parts, fan)
    if start is not None:
        known = start.select(F.col(key).alias("_key"), F.col("start").alias("_start"))
        offsets = offsets.join(known, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
        offsets = offsets.withColumn("_before", F.col("_before") + F.coalesce("_start", F.lit(0))).drop("_start")
    offsets = offsets.toDF("_key", "_in", "_before")
    numbered = rows.withColumn(out, F.row_number().over(local))
    joined = numbered.join(offsets, (F.col("_part") == F.col("_in")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(out, (F.col(out) + F.col("_before")).cast("long")).select(*df.columns[:-2], out)
