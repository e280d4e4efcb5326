"""Reading landed mails: scans, JSON page envelopes, pages, single lookups."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.paging import ordered_page

TICKETS = "Tickets"


def spread(df: DataFrame, tasks: int = None) -> DataFrame:
    """Deal the rows over ``tasks`` if the caller asks for it; else the scan's own splits stay.

    Only for a table of fewer files than cores, as cleaning is bound by CPU; it shuffles every row.
    """
    return df.repartition(int(tasks)) if tasks else df


def scan_emails(spark: SparkSession, path: str, type_filter: str = TICKETS, fmt: str = "parquet") -> DataFrame:
    return only_type(spark.read.format(fmt).load(path), type_filter)


def only_type(df: DataFrame, type_filter: str = TICKETS) -> DataFrame:
    return df.filter(F.col("type") == type_filter)


def page_elements(df: DataFrame, payload: str, listing: bool) -> DataFrame:
    """A row for each element of a page's list, or one with a ``problem`` for a page that cannot be read.

    The ingest form reads ``Data``; the listing form reads ``Items`` or a bare array. A page of proper
    JSON without a list gives no rows.
    """
    page = F.try_parse_json(payload)
    found = F.try_variant_get(page, "$.Items" if listing else "$.Data", "array<variant>")
    if listing:
        found = F.coalesce(found, F.try_variant_get(page, "$", "array<variant>"))
    broken = F.when(F.col(payload).isNull(), "empty page").when(page.isNull(), "page is no JSON")
    # One NULL element carries the page's own problem.
    listed = F.when(broken.isNotNull(), F.array(F.lit(None).cast("variant"))).otherwise(found)
    rows = df.withColumn("_broken", broken).select("*", F.posexplode(listed).alias("position", "mail"))
    schema = F.schema_of_variant("mail")
    number = F.try_variant_get("mail", "$.RecId", "string")
    rec_id = F.expr("try_cast(trim(try_variant_get(mail, '$.RecId', 'string')) as bigint)")
    problem = F.coalesce(
        "_broken", F.when(F.is_variant_null("mail"), "null element"), F.when(~schema.startswith("OBJECT"), "element is no object"),
        F.when(number.isNotNull() & rec_id.isNull(), "RecId is no number"),
    )
    return rows.withColumn("problem", problem).withColumn("rec_id", rec_id).drop("_broken")


def unnest_envelope(df: DataFrame, payload: str = "payload", listing: bool = False) -> DataFrame:
    """The mails of landed JSON pages; numeric text counts as a number. Other columns of the page are kept.

    What is no mail goes to ``envelope_dead_letters``: both together hold every element of every page.
    """
    others = [c for c in df.columns if c != payload]

    def text(name):
        return F.try_variant_get("mail", f"$.{name}", "string")

    return page_elements(df, payload, listing).filter("problem is null").select(
        *others, "rec_id", text("Subject").alias("subject"), text("Comments").alias("body_html"),
        text("Type").alias("type"), text("CreatedDateTime").alias("created"),
    )


def envelope_dead_letters(df: DataFrame, payload: str = "payload", listing: bool = False) -> DataFrame:
    """Pages and elements that give no mail: the page's other columns, ``position``, ``problem`` and the text."""
    others = [c for c in df.columns if c != payload]
    bad = page_elements(df, payload, listing).filter("problem is not null")
    text = F.when(F.col("mail").isNull(), F.col(payload)).otherwise(F.to_json("mail"))
    return bad.select(*others, F.when(F.col("mail").isNotNull(), F.col("position")).alias("position"), "problem", text.alias("raw"))


def page_totals(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``total`` of each page: its count field (a number or numeric text), else the length of a bare array, else 0."""
    page = F.try_parse_json(payload)
    counted = F.expr(f"try_cast(trim(try_variant_get(try_parse_json({payload}), '$.TotalCount', 'string')) as bigint)")
    length = F.array_size(F.try_variant_get(page, "$", "array<variant>"))
    return df.withColumn("total", F.coalesce(F.nullif(counted, F.lit(0)), length, F.lit(0)).cast("long"))


def page_emails(df: DataFrame, page: int = 1, size: int = 10, order_by: str = "created_ts",
                direction: int = 0, key: str = "rec_id") -> DataFrame:
    """One page, newest first for direction 0; ties by key."""
    page, size = page or 1, size or 10
    return ordered_page(df, [(order_by, direction != 0), (key, True)], max(page - 1, 0) * size, size)


def lookup_source(df: DataFrame, rec_id: int) -> DataFrame:
    return only_type(df).filter(F.col("rec_id") == rec_id)


def isolate_bad_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mails that can be stored, and the dead letters with a ``problem``."""
    good = df.filter(F.col("rec_id").isNotNull())
    bad = df.filter(F.col("rec_id").isNull()).withColumn("problem", F.lit("missing rec_id"))
    return good, bad
