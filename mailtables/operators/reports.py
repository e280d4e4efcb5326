"""Table-scale reports. Each aggregates to one narrow row first and unpivots that."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import patterns as P
from ..functions.text import split_lines, trim_ws
from .cleaning import STAGES


def some_line(lines, regex):
    return F.exists(lines, lambda line: line.rlike(regex))


def pattern_hits(df: DataFrame) -> DataFrame:
    """Mails hit by each pattern, on the text the pattern is applied to.

    ``df`` comes from ``clean_text_stages``. One pass with one sum per pattern: nothing is
    exploded and a single row per task goes through the shuffle.
    """
    lines = F.transform(split_lines(F.col("tail_text")), trim_ws)
    signed = F.col("signature_text")
    body_lines = F.filter(F.transform(split_lines(signed), trim_ws), lambda x: x != "")
    tests = []
    low = F.col("_low")
    for name, literal, regex in P.THREAD_MARKERS:
        tests.append(("thread", name, low.contains(literal) & F.col("html_text").rlike(f"(?im){regex}")))
    for name, literal, regex in P.DISCLAIMERS:
        tests.append(("disclaimer", name, low.contains(literal) & F.col("quote_text").rlike(f"(?im){regex}")))
    for name, regex in P.SIGNATURE_STRONG:
        tests.append(("signature", name, some_line(F.col("_lines"), f"(?i){regex}")))
    for name, regex in P.SIGNATURE_WEAK:
        tests.append(("signature", name, some_line(F.col("_lines"), regex)))
    for name, regex in P.GREETINGS:
        tests.append(("greeting", name, some_line(F.slice("_body", 1, P.GREETING_LINES), f"(?i){regex}")))
    last = F.slice("_body", F.greatest(F.array_size("_body") - P.CLOSING_LINES, F.lit(0)) + 1, F.lit(P.CLOSING_LINES))
    for name, regex in P.CLOSINGS:
        tests.append(("closing", name, some_line(last, f"(?i){regex}")))
    df = df.withColumn("_low", F.lower("html_text")).withColumn("_lines", lines).withColumn("_body", body_lines)
    sums = [F.count_if(test).alias(f"n{i}") for i, (_, _, test) in enumerate(tests)]
    records = [
        F.struct(F.lit(stage).alias("stage"), F.lit(name).alias("pattern"), F.col(f"n{i}").alias("mails"))
        for i, (stage, name, _) in enumerate(tests)
    ]
    return df.agg(*sums).select(F.inline(F.array(*records)))


def stage_removals(df: DataFrame) -> DataFrame:
    """Mails changed and characters removed by each cleaning stage."""
    pairs = list(zip(STAGES, STAGES[1:]))
    sums = []
    for before, after in pairs:
        sums.append(F.count_if(F.col(before) != F.col(after)).alias(f"{after}_n"))
        sums.append(F.sum(F.length(before) - F.length(after)).alias(f"{after}_c"))
    records = [
        F.struct(
            F.lit(after.removesuffix("_text")).alias("stage"),
            F.col(f"{after}_n").alias("mails_changed"),
            F.col(f"{after}_c").alias("chars_removed"),
        )
        for _, after in pairs
    ]
    return df.agg(*sums).select(F.inline(F.array(*records)))


def token_usage_report(df: DataFrame) -> DataFrame:
    """Tokens by model call, and in total (``level`` 1)."""
    return (
        df.select(F.inline("stage_tokens"))
        .rollup("stage")
        .agg(
            F.grouping("stage").cast("int").alias("level"),
            F.count_if(F.col("input") + F.col("output") > 0).alias("calls"),
            F.sum("input").alias("input_tokens"),
            F.sum("output").alias("output_tokens"),
            F.sum(F.col("input") + F.col("output")).alias("total_tokens"),
        )
    )


def domain_check(df: DataFrame) -> DataFrame:
    """Values outside the declared domains, with their counts."""
    domains = [
        ("category", F.col("classification.category"), P.CATEGORIES),
        ("priority", F.col("classification.priority"), P.PRIORITIES),
        ("sentiment", F.col("classification.sentiment"), P.SENTIMENTS),
        ("next_best_action", F.col("next_best_action"), P.ACTIONS),
    ]
    found = F.array_compact(
        F.array(
            *[
                F.when(value.isNotNull() & ~value.isin(allowed), F.struct(F.lit(name).alias("field"), value.alias("value")))
                for name, value, allowed in domains
            ]
        )
    )
    return df.select(F.inline(found)).groupBy("field", "value").agg(F.count("*").alias("mails"))


def check_constraints(df: DataFrame, table: str) -> DataFrame:
    """NOT NULL and UNIQUE violations of a result table: ``(rule, key, rows)``."""
    required = {"emails_cleaned": ["req_id"], "emails_reprocess": ["req_id", "process_label"]}[table]
    missing = [
        df.filter(F.col(c).isNull())
        .agg(F.count("*").alias("rows"))
        .filter("rows > 0")
        .select(F.lit(f"{c} is null").alias("rule"), F.lit(None).cast("string").alias("key"), "rows")
        for c in required
    ]
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    repeated = (
        df.filter(present).groupBy(*required).agg(F.count("*").alias("rows")).filter("rows > 1")
        .select(
            F.lit(f"unique {', '.join(required)}").alias("rule"),
            F.concat_ws("/", *[F.col(c).cast("string") for c in required]).alias("key"),
            "rows",
        )
    )
    return reduce(DataFrame.unionByName, missing, repeated)


def run_report(df: DataFrame) -> DataFrame:
    """One row per target table: rows stored, translated, under review."""
    return df.groupBy("table").agg(
        F.count("*").alias("total"),
        F.count_if("was_translated").alias("translated"),
        F.count_if("requires_human_review").alias("under_review"),
        F.count("summary").alias("with_summary"),
    )


def run_rows(df: DataFrame) -> DataFrame:
    """The per-mail part of the run report; rows of the cleaned table have no label."""
    label = F.col("process_label") if "process_label" in df.columns else F.lit(None).cast("string")
    return df.select(
        "req_id", "was_translated", label.alias("process_label"), "summary", "requires_human_review", "review_reason"
    )
