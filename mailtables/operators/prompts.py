"""Prompt tables for the analysis, summary and planning calls.

A template is a parameter; the defaults ask for the reply layout that ``operators.analysis``
reads. Prompts are filtered before any model is called, so no call is made for a mail that does
not need it.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import ACTIONS, CATEGORIES, PRIORITIES, SENTIMENTS
from ..functions.stages import pin
from . import analysis as A
from .translation import fill

ANALYSIS_TEMPLATE = f"""Read the e-mail below and answer with one JSON object and nothing else.
Members of the object:
"classification": {{"category": one of {', '.join(CATEGORIES)}; "priority": one of {', '.join(PRIORITIES)}; "sentiment": one of {', '.join(SENTIMENTS)}; "confidence": 0 to 1}}
"structured_data": every fact found, as name: {{"value": text, "confidence": 0 to 1}}, plus one "confidence": 0 to 1
"action_items": list of {{"action": text, "confidence": 0 to 1}}
"summary": one or two sentences
"confidence_scores": {{"overall", "classification", "structured_data", "action_items": 0 to 1}}

{{{{EMAIL}}}}
"""

SUMMARY_TEMPLATE = """Sum up this e-mail in one or two sentences: what is asked for, deadlines,
account numbers and other details that matter.

{{EMAIL}}
"""

ACTION_TEMPLATE = f"""Choose the next action for a support mail, given how it was classified.
Allowed actions: {', '.join(ACTIONS)}
{{{{CONTEXT}}}}
Answer with {{"action": text, "confidence": 0 to 1, "reasoning": text}}
"""


def format_email_text(subject="subject", body="body") -> Column:
    return F.concat(
        F.lit("Subject: "), F.coalesce(F.col(subject), F.lit("")),
        F.lit("\n\nBody:\n"), F.coalesce(F.col(body), F.lit("")),
    )


def prompt_rows(df: DataFrame, kind: str, prompt: Column) -> DataFrame:
    return df.select("rec_id", F.lit(kind).alias("kind"), prompt.alias("prompt"))


def analysis_prompts(df: DataFrame, template: str = ANALYSIS_TEMPLATE) -> DataFrame:
    return prompt_rows(df, "analysis", fill(template, EMAIL=format_email_text()))


def summary_prompts(df: DataFrame, template: str = SUMMARY_TEMPLATE) -> DataFrame:
    """Mails whose reply has no summary or a low overall confidence."""
    called = f"raw IS NOT NULL AND {A.needs_summary()} AND NOT {A.scores_missing()}"
    return prompt_rows(A.parse_analysis(df).filter(called), "summary", fill(template, EMAIL=format_email_text()))


def action_prompts(df: DataFrame, template: str = ACTION_TEMPLATE) -> DataFrame:
    """Mails that need no review, with the corrected classification and key/values, all members included."""
    df = A.with_fallback(A.review_flags(A.normalise_analysis(A.parse_analysis(df))))
    df = pin(df, "requires_human_review").filter("NOT requires_human_review")
    context = F.expr("to_json(named_struct('classification', classification_object, 'structured_data', structured_object))")
    return prompt_rows(df, "action", fill(template, CONTEXT=context))
