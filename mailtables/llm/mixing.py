"""Token budgets for a tree of domains, languages and sources, and the documents that fill them."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

BUCKETS = 4096
LEVELS = ("domain", "lang", "source")


def share(level: DataFrame, parents: list, child: str, granted: str = "granted") -> DataFrame:
    """Split every parent's ``granted`` tokens over its children by ``weight``, none above its ``limit``.

    Children are taken from the one that fills up first. One that would get more than its limit gets
    the limit, and what it leaves goes to its siblings by their weights; the last parts are rounded
    down. So a shortage stays among siblings as long as they can take it, and reaches the ancestors
    only through the limits, which are the sums of what lies below.
    """
    by = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(1))
    order = by.orderBy(F.col("limit") / F.col("weight"), child)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    return (
        level.withColumn("_left", F.col(granted) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(after))
        # The quotient and the rest apart, so that no product leaves the 64 bits.
        .withColumn("_part", F.expr("(_left div _weights) * weight + ((_left % _weights) * weight) div _weights"))
        .withColumn("_open", F.col("_part") < F.col("limit"))
        # From the first child that stays below its limit on, all share one rate.
        .withColumn("_rate", F.first(F.when(F.col("_open"), F.struct("_left", "_weights")), ignorenulls=True).over(
            order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("budget", F.when(F.col("_rate").isNull(), F.col("limit")).otherwise(F.least("limit", F.expr(
            "(_rate._left div _rate._weights) * weight + ((_rate._left % _rate._weights) * weight) div _rate._weights"))))
        .drop("_left", "_weights", "_part", "_open", "_rate")
    )


def budgets(leaves: DataFrame, weights: dict, permille: int, epochs: int) -> DataFrame:
    """``domain, lang, source, budget`` of every leaf; ``leaves`` has ``tokens`` by leaf.

    ``weights`` maps a level to ``{value: positive whole number}``, 1 for values not named.
    """
    tree = leaves.withColumn("limit", F.col("tokens") * epochs)

    def weight(level):
        known = [w for v, x in sorted(weights.get(level, {}).items()) for w in (F.lit(v), F.lit(x).cast("long"))]
        return F.coalesce(F.create_map(*known)[F.col(level)], F.lit(1).cast("long")) if known else F.lit(1).cast("long")

    above = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = tree.groupBy(*path).agg(F.sum("limit").alias("limit")).withColumn("weight", weight(level))
        if above is None:
            everything = W.partitionBy(F.lit(1))  # a row for each domain
            asked = F.expr(f"(_all div 1000) * {permille} + ((_all % 1000) * {permille}) div 1000")
            nodes = nodes.withColumn("_all", F.sum("limit").over(everything))
            nodes = nodes.withColumn("_all", F.expr(f"_all div {epochs}"))
            nodes = nodes.withColumn("granted", F.least(asked, F.col("_all") * epochs)).drop("_all")
        else:
            keys = [nodes[c].eqNullSafe(above[f"_{c}"]) for c in path[:-1]]
            nodes = nodes.join(above, keys and _all(keys)).drop(*[f"_{c}" for c in path[:-1]])
        # Some hundred rows; stored, so that no level plans those above it anew.
        nodes = stored(share(nodes, path[:-1], level), f"budgets-{level}")
        above = nodes.select(*[F.col(c).alias(f"_{c}") for c in path], F.col("budget").alias("granted"))
    return nodes.select(*LEVELS, "budget")


def _all(conditions):
    joined = conditions[0]
    for c in conditions[1:]:
        joined = joined & c
    return joined


def mix(df: DataFrame, key: str, tokens: Column, domain: Column, weights: dict, permille: int,
        epochs: int = 2, seed: int = 0, whole: bool = False) -> DataFrame:
    """Documents that fill the budgets: ``_row`` (all columns), ``epoch, domain, taken`` and ``_n`` (tokens).

    The total is ``permille`` thousandths of all tokens, at most ``epochs`` times them. Each leaf orders
    its documents anew in every epoch, by the MD5 of seed, epoch and key; whole epochs are taken while
    they fit and of the last one the prefix that fills the budget exactly, cutting the last document
    (``taken`` of its tokens; ``whole=True`` keeps it uncut).

    Built-in functions only. Every leaf is cut into 4,096 hash buckets whose sums come from a
    partial aggregate; buckets are taken or left as a whole, and only the one bucket in which the
    budget ends is put in order. So a source with a third of all rows orders about 1/4096 of them in a task.

    NULL in a level column is a leaf of its own; NULL keys and repeated rows are ordered by the hash of
    the key, then of the row, and rows without tokens take part while the budget lasts. An empty table
    gives an empty one.
    """
    n = F.coalesce(tokens, F.lit(0)).cast("long")
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{key}`").alias("_key"),
        domain.alias("domain"), F.col("lang"), F.col("source"), n.alias("_n"),
    )
    path = list(LEVELS)
    same = lambda a, b: _all([a[c].eqNullSafe(b[c]) for c in path])
    leaves = stored(rows.groupBy(*path).agg(F.sum("_n").alias("tokens")), "leaves")
    plan = budgets(leaves, weights, permille, epochs)
    plan = plan.join(leaves.toDF("_d", "_l", "_s", "tokens"), _all(
        [F.col("domain").eqNullSafe(F.col("_d")), F.col("lang").eqNullSafe(F.col("_l")), F.col("source").eqNullSafe(F.col("_s"))]
    )).drop("_d", "_l", "_s")
    plan = plan.withColumn("_whole", F.expr("case when tokens = 0 then 0 else budget div tokens end"))
    plan = plan.withColumn("_rest", F.col("budget") - F.col("_whole") * F.col("tokens"))
    last = [F.col(c).alias(f"_{c}") for c in path] + ["_whole", "_rest"]
    plan = stored(plan.select(*last), "plan")
    here = _all([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in path])
    text_of = F.coalesce(F.col("_key").cast("string"), F.lit("null key"))
    hashed = lambda epoch: F.md5(F.concat_ws(" ", F.lit(str(seed)), epoch.cast("string"), text_of).cast("binary"))
    planned = rows.join(plan, here).drop(*[f"_{c}" for c in path])
    planned = planned.withColumn("_hash", hashed(F.col("_whole")))
    planned = planned.withColumn("_bucket", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"))
    # The bucket of each leaf in which its cut epoch ends.
    sums = planned.groupBy(*path, "_whole", "_rest", "_bucket").agg(F.sum("_n").alias("_sum"))
    running = W.partitionBy(*path).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = (
        sums.withColumn("_before", F.coalesce(F.sum("_sum").over(running), F.lit(0)))
        .filter("_before <= _rest and _rest < _before + _sum")
        .select(*[F.col(c).alias(f"_{c}") for c in path], F.col("_bucket").alias("_last"), F.col("_before").alias("_base"))
    )
    planned = planned.join(stored(ends, "ends"), here, "left").drop(*[f"_{c}" for c in path])
    full = planned.filter("_whole > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("_whole") - 1)).alias("epoch")
    ).withColumn("taken", F.col("_n"))
    below = planned.filter("_whole < %d and _rest > 0 and (_last is null or _bucket < _last)" % epochs)
    below = below.withColumns({"epoch": F.col("_whole"), "taken": F.col("_n")})
    order = W.partitionBy(*path).orderBy("_hash", F.xxhash64("_row")).rowsBetween(W.unboundedPreceding, -1)
    cut = (
        planned.filter("_rest > 0 and _bucket = _last")
        .withColumn("epoch", F.col("_whole"))
        .withColumn("start", F.col("_base") + F.coalesce(F.sum("_n").over(order), F.lit(0)))
        .filter("start < _rest")
        .withColumn("taken", F.col("_n") if whole else F.least("_n", F.col("_rest") - F.col("start")))
    )
    picked = [F.col("_row"), F.col("epoch").cast("int").alias("epoch"), "domain", "taken", "_n"]
    return full.select(*picked).unionByName(below.select(*picked)).unionByName(cut.select(*picked))
