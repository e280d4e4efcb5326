"""Arabic routing and the translation step, as projections around a table of replies."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import empty_to_null, trim_ws

ARABIC = r"[؀-ۿ]"

EMAIL_TEMPLATE = (
    "Translate this e-mail from Arabic to professional English. Keep every heading, list and"
    " line break, and answer with the translation only: the subject on the first line, then the"
    " body.\nSubject: {{SUBJECT}}\nBody: {{BODY}}"
)
TEXT_TEMPLATE = (
    "Translate this text from Arabic to English, completely and without a summary.\n"
    "Text:\n{{BODY}}\n"
)


def is_arabic(col) -> Column:
    return F.coalesce(F.col(col).rlike(ARABIC), F.lit(False))


def needs_translation(subject="subject", body="body") -> Column:
    return is_arabic(subject) | is_arabic(body)


def route_languages(df: DataFrame) -> DataFrame:
    """Add ``has_arabic`` and ``language`` (also ``ar`` when the translation fails later)."""
    return df.withColumn("has_arabic", needs_translation()).withColumn(
        "language", F.when(F.col("has_arabic"), "ar").otherwise("en")
    )


def fill(template: str, **values) -> Column:
    """Put each value into the first ``{{NAME}}`` of a template; values are taken literally."""
    pieces, rest = [], template
    for name in sorted(values, key=lambda n: template.find("{{%s}}" % n)):
        before, found, after = rest.partition("{{%s}}" % name)
        if found:
            pieces += [F.lit(before), F.coalesce(values[name], F.lit(""))]
            rest = after
    return F.concat(*pieces, F.lit(rest))


def translation_prompts(df: DataFrame, key: str = "rec_id", template: str = EMAIL_TEMPLATE) -> DataFrame:
    """One prompt per mail with Arabic in subject or body; no row for the others."""
    prompt = trim_ws(fill(template, SUBJECT=F.col("subject"), BODY=F.col("body")))
    return df.filter(needs_translation()).select(key, F.lit("translation").alias("kind"), prompt.alias("prompt"))


def text_translation_prompts(df: DataFrame, *keys: str, text: str = "text", template: str = TEXT_TEMPLATE) -> DataFrame:
    prompt = fill(template, BODY=F.col(text))
    return df.filter(is_arabic(text)).select(*keys, F.lit("text").alias("kind"), prompt.alias("prompt"))


def apply_email_translation(df: DataFrame) -> DataFrame:
    """Use ``translation_text``: first line is the subject, the rest the body.

    Replaces ``subject`` and ``body`` where translated; keeps the originals as
    ``original_subject`` and ``original_body``. No reply means no translation.
    """
    reply = F.col("translation_text")
    first = F.regexp_extract(reply, r"\A([^\n]*)", 1)
    rest = trim_ws(F.regexp_replace(reply, r"\A[^\n]*\n?", ""))
    translated = F.col("was_translated")
    df = (
        route_languages(df)
        .withColumn("was_translated", F.col("has_arabic") & reply.isNotNull())
        .withColumn("original_subject", F.col("subject"))
        .withColumn("original_body", F.col("body"))
        .withColumn("subject", F.when(translated, F.coalesce(empty_to_null(first), F.col("subject"))).otherwise(F.col("subject")))
        .withColumn("body", F.when(translated, F.coalesce(empty_to_null(rest), F.col("body"))).otherwise(F.col("body")))
    )
    content = F.to_json(F.struct("subject", "body"))
    return df.withColumn("translated_content", F.when(translated, content)).drop("has_arabic")


def apply_text_translation(df: DataFrame, text: str = "text") -> DataFrame:
    """The one-text form: the trimmed reply replaces an Arabic text."""
    reply = F.col("translation_text")
    return (
        df.withColumn("language", F.when(is_arabic(text), "ar").otherwise("en"))
        .withColumn("was_translated", (F.col("language") == "ar") & reply.isNotNull())
        .withColumn(text, F.when(F.col("was_translated"), trim_ws(reply)).otherwise(F.col(text)))
        .drop("translation_text")
    )
