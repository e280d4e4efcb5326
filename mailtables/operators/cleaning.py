"""Cleaning of mail text: reply threads, quotes, disclaimers, signatures, segments.

Every step is a projection: no shuffle, no Python worker. A step reads one text column and adds
another; the intermediate columns are separate projections so that a text that is used many
times in the next step is computed once.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CleanerConfig
from ..functions import patterns as P
from ..functions.html import html_to_text
from ..functions.stages import pin
from ..functions.text import (
    any_match,
    empty_to_null,
    join_lines,
    left_chars,
    remove_first,
    split_lines,
    text_before,
    trim_ws,
)

DEFAULTS = CleanerConfig()
# The guard for short texts and the length of the preview.
SHORT_TEXT = 10
SHORT_WARNING = "Content too short or empty after HTML cleaning"
PREVIEW = 150


def with_lower(df: DataFrame, src: str, lowered) -> DataFrame:
    """Add ``_lower`` for the literal tests, from ``src`` unless an earlier step has it already."""
    return df.withColumn("_lower", F.col(lowered) if lowered else F.lower(src))


def cut_thread(df: DataFrame, src: str, out: str, lowered: str = None) -> DataFrame:
    """Keep the newest message. Only the first match of a marker counts, and only behind position 50."""
    lower, text = F.col("_lower"), F.col(src)
    positions = F.array(
        *[F.when(lower.contains(literal), F.length(text_before(text, regex))) for _, literal, regex in P.THREAD_MARKERS]
    )
    # A text without a match is its own length long, which is no cut.
    cut = F.array_min(F.filter(positions, lambda p: p > P.THREAD_MIN_POSITION))
    newest = trim_ws(left_chars(text, F.coalesce(cut, F.length(text))))
    # Most texts have no line that starts with the mark; a trimmed text stays as it is then.
    unquoted = trim_ws(F.regexp_replace("_newest", r"(?m)\n>+\s*$", ""))
    unquoted = F.when(F.col("_newest").contains("\n>"), unquoted).otherwise(F.col("_newest"))
    df = with_lower(df, src, lowered).withColumn("_newest", newest)
    return df.withColumn(out, unquoted).drop("_lower", "_newest")


def strip_quotes(df: DataFrame, src: str, out: str) -> DataFrame:
    """Remove the leading run of ``>`` of every line, once."""
    text = F.col(src)
    stripped = F.regexp_replace(text, r"(?m)^>+[^\S\n]*", "")
    return df.withColumn(out, F.when(text.contains(">"), stripped).otherwise(text))


def strip_disclaimers(df: DataFrame, src: str, out: str, lowered: str = None) -> DataFrame:
    """Remove the first match of each disclaimer, in order.

    ``lowered`` may name the lower-case form of any earlier stage: the steps in between only
    remove text at line starts, whole lines or the end, so they never create a literal.
    """
    df = with_lower(df, src, lowered).withColumn(out, F.col(src))
    for _, literal, regex in P.DISCLAIMERS:
        # A removal never adds text, so the literal test on the input text stays valid.
        removed = F.when(F.col("_lower").contains(literal), remove_first(F.col(out), regex))
        df = df.withColumn(out, removed.otherwise(F.col(out)))
    return df.drop("_lower")


def trim_disclaimer_tail(df: DataFrame, src: str, out: str) -> DataFrame:
    """Drop blank lines, then cut at the first disclaimer-like line among the last three."""
    lines, size = F.col("_lines"), F.array_size("_lines")

    def suspicious(line):
        low = F.lower(line)
        short = F.length(low) < P.TAIL_SHORT_LINE
        return (
            (low.contains("confidential") & short)
            | (low.contains("disclaimer") & short)
            | (low.contains("virus") & low.contains("scan"))
        )

    start = F.greatest(size - P.TAIL_LINES, F.lit(0))
    hit = F.array_position(F.transform(F.slice(lines, start + 1, F.lit(P.TAIL_LINES)), suspicious), True)
    keep = F.when(hit > 0, start + hit.cast("int") - 1).otherwise(size)
    trimmed = F.filter(F.transform(split_lines(F.col(src)), trim_ws), lambda line: line != "")
    return (
        df.withColumn("_lines", trimmed)
        .withColumn("_keep", keep)
        .withColumn(out, join_lines(F.slice("_lines", F.lit(1), F.col("_keep"))))
        .drop("_lines", "_keep")
    )


def weak_score(line) -> Column:
    """Number of weak patterns that match; one test of all of them settles most lines."""
    score = F.lit(0)
    for _, regex in P.SIGNATURE_WEAK:
        score = score + line.rlike(regex).cast("int")
    some = "|".join(f"(?:{regex})" for _, regex in P.SIGNATURE_WEAK)
    return F.when(line.rlike(rf"\A(?:{some})"), score).otherwise(0)


def cut_signature(df: DataFrame, src: str, out: str, config: CleanerConfig = DEFAULTS) -> DataFrame:
    """Cut at a delimiter line, at a device line, or where enough weak signs add up."""
    text, lines, size = F.col(src), F.col("_lines"), F.array_size("_lines")
    scan_from = F.floor(size * 3 / 5).cast("int")

    def first_lines(n):
        return join_lines(F.slice(lines, F.lit(1), n))

    def run(acc, score):
        total = acc["total"] + score
        at = acc["at"] + 1
        reached = F.when((acc["hit"] == 0) & (total >= P.SIGNATURE_SCORE), at).otherwise(acc["hit"])
        return F.struct(total.alias("total"), at.alias("at"), reached.alias("hit"))

    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("at"), F.lit(0).alias("hit"))
    delimiter = F.array_position(F.transform("_trimmed", lambda x: x.rlike(P.SIGNATURE_DELIMITER)), True)
    df = (
        df.withColumn("_lines", split_lines(text))
        .withColumn("_trimmed", F.transform("_lines", trim_ws))
        .withColumn("_delimiter", delimiter.cast("int"))
        .withColumn("_from", scan_from)
        .withColumn("_tail", F.slice("_trimmed", F.col("_from") + 1, size))
        .withColumn("_scores", F.transform("_tail", weak_score))
        .withColumn("_strong", F.array_position(F.transform("_tail", lambda x: any_match(x, P.SIGNATURE_STRONG)), True).cast("int"))
        .withColumn("_first", F.array_position(F.transform("_scores", lambda x: x > 0), True).cast("int"))
        .withColumn("_reached", F.aggregate("_scores", zero, run, lambda acc: acc["hit"]))
    )
    strong, reached = F.col("_strong"), F.col("_reached")
    before_weak = first_lines(F.col("_from") + F.col("_first") - 1)
    cut = (
        F.when(F.length(text) < config.min_content * 2, text)
        .when(F.col("_delimiter") - 1 > P.SIGNATURE_DELIMITER_MIN_LINE, trim_ws(first_lines(F.col("_delimiter") - 1)))
        .when((strong > 0) & ((reached == 0) | (strong <= reached)), trim_ws(first_lines(F.col("_from") + strong - 1)))
        .when((reached > 0) & (F.length(before_weak) >= config.min_content), trim_ws(before_weak))
        .otherwise(text)
    )
    return df.withColumn(out, cut).drop(
        "_lines", "_trimmed", "_delimiter", "_from", "_tail", "_scores", "_strong", "_first", "_reached"
    )


def truncate_text(df: DataFrame, src: str, out: str, config: CleanerConfig = DEFAULTS) -> DataFrame:
    trimmed = F.col("_trimmed")
    if not config.max_length:
        return df.withColumn(out, trim_ws(F.col(src)))
    short = F.concat(left_chars(trimmed, config.max_length), F.lit("..."))
    return (
        df.withColumn("_trimmed", trim_ws(F.col(src)))
        .withColumn(out, F.when(F.length(trimmed) > config.max_length, short).otherwise(trimmed))
        .drop("_trimmed")
    )


def segment_mail(df: DataFrame, src: str) -> DataFrame:
    """Add ``pretext``, ``core`` (before the fallback to the whole text) and ``posttext``."""
    lines, size = F.col("_lines"), F.array_size("_lines")
    head = F.transform(F.slice(lines, 1, P.GREETING_LINES), lambda x: any_match(trim_ws(x), P.GREETINGS))
    tail_from = F.greatest(size - P.CLOSING_LINES, F.lit(0))
    tail = F.transform(
        F.slice(lines, tail_from + 1, F.lit(P.CLOSING_LINES)), lambda x: any_match(trim_ws(x), P.CLOSINGS)
    )
    last = F.array_position(F.reverse(tail), True).cast("int")
    # Lines in front of the closing; all lines when there is none.
    ahead = F.when(last > 0, tail_from + F.array_size(tail) - last).otherwise(size)
    greeting = F.array_position(head, True).cast("int")
    return (
        df.withColumn("_lines", F.filter(split_lines(F.col(src)), lambda x: trim_ws(x) != ""))
        .withColumn("_ahead", ahead)
        .withColumn("_greeting", greeting)
        .withColumn("_pre", F.when(F.col("_ahead") - F.col("_greeting") < 2, 0).otherwise(F.col("_greeting")))
        .withColumn("pretext", join_lines(F.slice(lines, F.lit(1), F.col("_pre"))))
        .withColumn(
            "core",
            trim_ws(join_lines(F.slice(lines, F.col("_pre") + 1, F.greatest(F.col("_ahead") - F.col("_pre"), F.lit(0))))),
        )
        .withColumn("posttext", join_lines(F.slice(lines, F.col("_ahead") + 1, size - F.col("_ahead"))))
        .drop("_lines", "_ahead", "_greeting", "_pre")
    )


def compression_ratio(original, cleaned) -> Column:
    """``(1 - cleaned/original) * 100`` with two decimals, in whole hundredths."""
    hundredths = F.expr(
        f"(20000 * abs(cast({original} as bigint) - {cleaned}) + {original}) div (2 * {original})"
    )
    text = F.concat(
        F.when(F.col(cleaned) > F.col(original), F.lit("-")).otherwise(F.lit("")),
        F.floor(hundredths / 100).cast("string"),
        F.lit("."),
        F.lpad((hundredths % 100).cast("string"), 2, "0"),
        F.lit("%"),
    )
    return F.when(F.col(original) > 0, text).otherwise(F.lit("0%"))


def clean_text_stages(df: DataFrame, src: str, config: CleanerConfig = DEFAULTS) -> DataFrame:
    """HTML in ``src`` through every removal; keeps one column per stage for reporting."""
    df = html_to_text(df, src, "html_text", config).withColumn("_low", F.lower("html_text"))
    df = cut_thread(df, "html_text", "thread_text", "_low")
    if config.remove_quotes:
        df = strip_quotes(df, "thread_text", "quote_text")
    else:
        df = df.withColumn("quote_text", F.col("thread_text"))
    df = strip_disclaimers(df, "quote_text", "notice_text", "_low").drop("_low")
    df = trim_disclaimer_tail(df, "notice_text", "tail_text")
    return cut_signature(df, "tail_text", "signature_text", config)


STAGES = ["html_text", "thread_text", "quote_text", "notice_text", "tail_text", "signature_text"]
CLEAN_COLUMNS = [
    "pretext", "core", "posttext", "clean_text", "preview", "original_length", "cleaned_length",
    "compression_ratio", "warning",
]


def clean_body(df: DataFrame, src: str = "body_html", config: CleanerConfig = DEFAULTS) -> DataFrame:
    """Add ``clean_text``, ``too_short`` (nothing was cleaned) and ``original_length``."""
    df = truncate_text(clean_text_stages(df, src, config), "signature_text", "_full", config)
    df = df.withColumns(
        {
            "too_short": F.length("html_text") < SHORT_TEXT,
            "clean_text": F.when(F.length("html_text") < SHORT_TEXT, F.col("html_text")).otherwise(F.col("_full")),
            "original_length": F.coalesce(F.length(src), F.lit(0)).cast("long"),
        }
    )
    return pin(df.drop("_full", *STAGES), "clean_text", "too_short", "original_length")


def describe_mail(df: DataFrame) -> DataFrame:
    """The other :data:`CLEAN_COLUMNS`, from the columns of :func:`clean_body`."""
    short = F.col("too_short")
    df = segment_mail(df, "clean_text")
    filled = F.coalesce(empty_to_null(F.col("core")), F.col("clean_text"))
    df = df.withColumns(
        {
            "pretext": F.when(short, "").otherwise(F.col("pretext")),
            "core": F.when(short, "").otherwise(filled),
            "posttext": F.when(short, "").otherwise(F.col("posttext")),
            "cleaned_length": F.when(short, 0).otherwise(F.length("clean_text")).cast("long"),
            "warning": F.when(short, SHORT_WARNING),
        }
    )
    more = F.when(F.length("core") > PREVIEW, "...").otherwise("")
    ratio = compression_ratio("original_length", "cleaned_length")
    return df.withColumns(
        {
            "preview": F.concat(left_chars(F.col("core"), PREVIEW), more),
            "compression_ratio": F.when(short, "100.00%").otherwise(ratio),
        }
    ).drop("too_short")


def clean_emails(df: DataFrame, src: str = "body_html", config: CleanerConfig = DEFAULTS) -> DataFrame:
    """Add :data:`CLEAN_COLUMNS` to a table with HTML (or plain text) in ``src``."""
    return pin(describe_mail(clean_body(df, src, config)), *CLEAN_COLUMNS)
