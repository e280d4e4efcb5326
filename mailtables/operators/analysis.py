"""Model replies to typed analyses: parsing, normalising, review rules, next action, tokens.

All projections over a table that already holds the replies (see ``plans.pipeline`` for the
join). Column names: ``subject``, ``body``, ``analysis_text``, ``summary_text``, ``action_text``,
``latency_ms`` and the token columns of ``sum_tokens``. The rules are SQL text built from
``functions.json``; each step adds its columns in one projection.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import json as J
from ..functions.patterns import WHITE_SPACE
from ..functions.stages import pin

# Defaults, thresholds and texts of the results.
DEFAULT_CONFIDENCE = "0.7D"
LOW_CONFIDENCE = "0.7D"
LOW_FOR_OTHER = "0.8D"
LOW_FOR_MEDIUM = "0.75D"
FALLBACK_CONFIDENCE = "0.5D"
ESCALATE = "Escalate to agent"
NO_REASONING = "Default escalation due to parsing error"
PLAN_FAILED = "Fallback due to processing error"
REVIEW_REQUIRED = "Human review required"
ANALYSIS_FAILED = "Analysis failed - requires manual review"
PIPELINE_FAILED = "Processing error occurred"
REVIEW_PREFIX = "Requires review: "
LOW_OVERALL = "low overall confidence"
LOW_CLASSIFICATION = "low classification confidence"
UNCERTAIN_CATEGORY = "uncertain category classification"
UNCERTAIN_PRIORITY = "uncertain priority classification"
NO_ITEMS = "no action items despite high confidence"
ANALYSIS_FAILED_SUMMARY = "Email analysis failed. "
PIPELINE_FAILED_SUMMARY = "Email processing failed. "
FALLBACK_LABELS = {"category": "other", "priority": "medium", "sentiment": "neutral"}
SENTENCE_LABELS = {"category": "general inquiry", "priority": "medium", "sentiment": "neutral"}

SCORES = ["overall", "classification", "structured_data", "action_items"]
OPEN = ["classification_object", "structured_object", "action_objects"]
PARTS = ["classification", "structured_data", "action_items", "summary", "confidence_scores"]
LABELS = ["category", "priority", "sentiment", "confidence"]
RAW = (
    ["raw"] + [f"raw_{n}" for n in PARTS] + [f"raw_{n}" for n in LABELS]
    + [f"raw_score_{n}" for n in SCORES] + ["raw_structured_confidence"]
)
WS = "".join(f"\\u{ord(c):04x}" for c in WHITE_SPACE)
PAIRS_TYPE = "array<struct<key:string,value:string,confidence:double>>"
ITEMS_TYPE = "array<struct<action:string,confidence:double>>"


def add(df: DataFrame, **columns: str) -> DataFrame:
    """SQL columns side by side; none of them reads another one of the same call."""
    return df.withColumns({name: F.expr(sql) for name, sql in columns.items()})


def trimmed(sql: str) -> str:
    return f"trim(BOTH '{WS}' FROM {sql})"


def sentence(body: str) -> str:
    """Text before the first sentence end; the first 100 characters when that is empty."""
    return trimmed(rf"coalesce(nullif(regexp_extract({body}, r'\A([^.!?]*)', 1), ''), left({body}, 100))")


def clamp_confidence(value: str) -> str:
    """Only a JSON number counts, held in 0..1; anything else is the default."""
    return (
        f"CASE WHEN {J.kind(value)} = 'NUMBER' THEN least(1D, greatest(0D, {J.as_double(value)}))"
        f" ELSE {DEFAULT_CONFIDENCE} END"
    )


def plain_confidence(value: str) -> str:
    """A falsy value or one that is no number is the default; numeric text counts."""
    return f"coalesce(CASE WHEN {J.truthy(value)} THEN {J.to_number(value)} END, {DEFAULT_CONFIDENCE})"


def clamp_score(value: str) -> str:
    return f"least(1D, greatest(0D, {plain_confidence(value)}))"


def parse_analysis(df: DataFrame) -> DataFrame:
    """Add the :data:`RAW` columns, VARIANT members of the reply."""
    df = add(df, _listed=J.json_list("analysis_text"))
    df = add(df, raw=J.only_element("_listed")).drop("_listed")
    df = add(df, **{f"raw_{n}": J.member("raw", n) for n in PARTS})
    df = add(
        df,
        raw_structured_confidence=J.member("raw_structured_data", "confidence"),
        **{f"raw_{n}": J.member("raw_classification", n) for n in LABELS},
        **{f"raw_score_{n}": J.member("raw_confidence_scores", n) for n in SCORES},
    )
    return pin(df, *RAW)


def as_variant(value: str) -> str:
    return f"CAST({value} AS VARIANT)"


def normalise_analysis(df: DataFrame) -> DataFrame:
    """Typed parts of the reply, with the default confidences, and the same parts with all members.

    Key/values become a list sorted by key; their scalar ``confidence`` is kept apart. :data:`OPEN` holds VARIANT
    objects: what the reply has, with corrected confidences laid over it.
    """
    item_conf, pair_conf = J.member("x", "confidence"), J.member("e.value", "confidence", "double")
    pair_value = (
        f"CASE WHEN {J.kind('e.value')} = 'OBJECT' THEN {J.member('e.value', 'value', 'string')}"
        f" ELSE {J.as_text('e.value')} END"
    )
    entries = (
        "filter(map_entries(try_variant_get(raw_structured_data, '$', 'map<string,variant>')), e -> e.key != 'confidence')"
    )
    pairs = f"transform({entries}, e -> named_struct('key', e.key, 'value', {pair_value}, 'confidence', {pair_conf}))"
    items = (
        f"transform({J.elements('raw_action_items')}, x -> CASE WHEN {J.truthy('x')} THEN"
        f" named_struct('action', {J.member('x', 'action', 'string')}, 'confidence', {clamp_confidence(item_conf)}) END)"
    )
    labels = ", ".join(f"'{n}', {J.as_text(f'raw_{n}')}" for n in LABELS if n != "confidence")
    scores = ", ".join(f"'{n}', {clamp_score(f'raw_score_{n}')}" for n in SCORES)
    df = add(df, _spread=J.spread("raw_structured_data"))
    object_conf = f"CASE WHEN {J.truthy('raw_structured_confidence')} THEN raw_structured_confidence ELSE {as_variant(DEFAULT_CONFIDENCE)} END"
    item = J.overlaid("x", "confidence", as_variant(clamp_confidence(item_conf)))
    fixed = J.overlaid("raw_classification", "confidence", as_variant(clamp_confidence("raw_confidence")))
    df = add(
        df,
        classification_object=f"CASE WHEN {J.truthy('raw_classification')} AND {J.kind('raw_classification')} != 'OBJECT'"
        f" THEN raw_classification ELSE {fixed} END",
        structured_object=J.overlaid("_spread", "confidence", object_conf),
        action_objects=f"coalesce(transform({J.elements('raw_action_items')}, x -> CASE WHEN {J.kind('x')} = 'OBJECT' THEN {item}"
        " ELSE x END), CAST(array() AS array<variant>))",
    ).drop("_spread")
    return add(
        df,
        classification=f"named_struct({labels}, 'confidence', {clamp_confidence('raw_confidence')})",
        structured_data=f"coalesce(array_sort({pairs}), CAST(array() AS {PAIRS_TYPE}))",
        structured_confidence=plain_confidence("raw_structured_confidence"),
        action_items=f"coalesce({items}, CAST(array() AS {ITEMS_TYPE}))",
        confidence_scores=f"named_struct({scores})",
    )


def needs_summary() -> str:
    """The second model call: no summary, or a low overall confidence."""
    low = f"coalesce({J.to_number('raw_score_overall')} < {LOW_CONFIDENCE}, false)"
    return f"(NOT {J.truthy('raw_summary')} OR {low})"


def scores_missing() -> str:
    """A summary without a score object breaks the reading of the reply."""
    return f"({J.truthy('raw_summary')} AND coalesce({J.kind('raw_confidence_scores')}, 'VOID') = 'VOID')"


def analysis_failed() -> str:
    """Conditions under which the whole analysis is replaced by the fixed fallback."""
    return " OR ".join(
        [
            "raw IS NULL",
            scores_missing(),
            f"({J.truthy('raw_action_items')} AND {J.kind('raw_action_items')} != 'ARRAY')",
            J.truthy_primitive("raw_classification"),
            f"coalesce(exists({J.elements('raw_action_items')}, x -> {J.truthy_primitive('x')}), false)",
            f"({needs_summary()} AND summary_text IS NULL)",
        ]
    )


def js_number_text(number: str) -> str:
    """A double the way JavaScript prints it."""
    plain = rf"regexp_replace(regexp_replace(CAST(CAST({number} AS DECIMAL(38,18)) AS STRING), r'(\.\d*?)0+$', '$1'), r'\.$', '')"
    scientific = rf"regexp_replace(regexp_replace(CAST({number} AS STRING), r'(\.0)?E(\d)', 'e+$2'), r'(\.0)?E-', 'e-')"
    return (
        f"CASE WHEN {number} = 0 THEN '0' WHEN abs({number}) >= 1e-6D AND abs({number}) < 1e19D THEN {plain}"
        f" ELSE {scientific} END"
    )


def js_text(value: str) -> str:
    """A JSON scalar inside a sentence."""
    return (
        f"CASE {J.kind(value)} WHEN 'VOID' THEN 'null' WHEN 'NUMBER' THEN {js_number_text(J.as_double(value))}"
        f" ELSE {J.as_text(value)} END"
    )


def review_reasons() -> str:
    """The fired review rules in order, on the raw values; a missing value never fires."""
    overall, confidence = J.to_number("raw_score_overall"), J.to_number("raw_confidence")
    no_items = f"(NOT {J.truthy('raw_action_items')} OR array_size({J.elements('raw_action_items')}) = 0)"
    rules = [
        (f"{overall} < {LOW_CONFIDENCE}", f"concat('{LOW_OVERALL} (', {js_text('raw_score_overall')}, ')')"),
        (f"{confidence} < {LOW_CONFIDENCE}", f"concat('{LOW_CLASSIFICATION} (', {js_text('raw_confidence')}, ')')"),
        (
            f"{J.as_text('raw_category')} = 'other' AND {confidence} < {LOW_FOR_OTHER}",
            f"'{UNCERTAIN_CATEGORY}'",
        ),
        (
            f"{J.as_text('raw_priority')} = 'medium' AND {confidence} < {LOW_FOR_MEDIUM}",
            f"'{UNCERTAIN_PRIORITY}'",
        ),
        (
            f"{no_items} AND {J.to_number('raw_score_action_items')} > {LOW_CONFIDENCE}",
            f"'{NO_ITEMS}'",
        ),
    ]
    return f"array_compact(array({', '.join(f'CASE WHEN {test} THEN {reason} END' for test, reason in rules)}))"


def review_flags(df: DataFrame) -> DataFrame:
    return add(
        add(df, _reasons=review_reasons()),
        requires_human_review="size(_reasons) > 0",
        review_reason=f"CASE WHEN size(_reasons) > 0 THEN concat('{REVIEW_PREFIX}', array_join(_reasons, ', ')) END",
    ).drop("_reasons")


def resolve_summary() -> str:
    """Parsed summary, else the summary reply, else a sentence built from the classification."""
    unquoted = f"translate({trimmed('summary_text')}, '\\'\"`', '')"
    reply = rf"regexp_replace({unquoted}, r'(?i)\A\s*Summary:\s*', '')"
    picked = f"CASE WHEN {needs_summary()} THEN {reply} ELSE {J.as_text('raw_summary')} END"

    category, priority, sentiment = (
        f"coalesce({J.truthy_text(f'raw_{name}')}, '{default}')" for name, default in SENTENCE_LABELS.items()
    )
    built = (
        f"concat('Email about ', {category}, ' (', {priority}, ' priority, ', {sentiment}, ' sentiment). ',"
        f" {sentence('body')})"
    )
    return f"coalesce(nullif({picked}, ''), {built})"


def with_fallback(df: DataFrame) -> DataFrame:
    """Replace failed analyses; ``failure`` is NULL, ``analysis`` or ``pipeline`` (no body to quote)."""
    quoted = """'Original subject: "', coalesce(subject, ''), '". '"""
    half = FALLBACK_CONFIDENCE
    labels = ", ".join(f"'{name}', '{value}'" for name, value in FALLBACK_LABELS.items())
    fixed = {
        "classification": f"named_struct({labels}, 'confidence', {half})",
        "structured_data": f"CAST(array() AS {PAIRS_TYPE})",
        "structured_confidence": half,
        "action_items": f"CAST(array() AS {ITEMS_TYPE})",
        "confidence_scores": f"named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, {half}' for n in SCORES)})",
        "classification_object": f"to_variant_object(named_struct({labels}, 'confidence', {half}))",
        "structured_object": f"to_variant_object(named_struct('confidence', {half}))",
        "action_objects": "CAST(array() AS array<variant>)",
    }
    df = add(df, _failed=analysis_failed(), summary=resolve_summary(), _summarised=needs_summary())
    # A summary that needs the body sentence cannot be built without a body.
    df = add(
        df,
        failure="CASE WHEN body IS NULL AND (_failed OR summary IS NULL) THEN 'pipeline' WHEN _failed THEN 'analysis' END",
    )
    kept = {name: f"CASE WHEN failure IS NULL THEN {name} ELSE {sql} END" for name, sql in fixed.items()}
    return add(
        df,
        summary=f"CASE failure WHEN 'pipeline' THEN concat('{PIPELINE_FAILED_SUMMARY}', {quoted}, 'Requires manual review.')"
        f""" WHEN 'analysis' THEN concat('{ANALYSIS_FAILED_SUMMARY}', {quoted}, 'First sentence: "', {sentence('body')}, '"')"""
        " ELSE summary END",
        requires_human_review="failure IS NOT NULL OR requires_human_review",
        review_reason=f"CASE failure WHEN 'pipeline' THEN '{PIPELINE_FAILED}' WHEN 'analysis' THEN '{ANALYSIS_FAILED}' ELSE review_reason END",
        **kept,
    ).drop("_failed")


def plan_next_action(df: DataFrame) -> DataFrame:
    """Next action from the planner reply; mails under review are escalated without a call."""

    def choose(reviewed, unparsed, parsed):
        return f"CASE WHEN requires_human_review THEN {reviewed} WHEN _plan IS NULL THEN {unparsed} ELSE {parsed} END"

    action, reasoning = J.truthy_text(J.member("_plan", "action")), J.truthy_text(J.member("_plan", "reasoning"))
    score = clamp_score(J.member("_plan", "confidence"))
    df = add(df, _listed=J.json_list("action_text"))
    df = add(df, _plan=J.only_element("_listed")).drop("_listed")
    return add(
        df,
        next_best_action=choose(f"'{ESCALATE}'", f"'{ESCALATE}'", f"coalesce({action}, '{ESCALATE}')"),
        action_confidence=f"CASE WHEN failure = 'pipeline' THEN {FALLBACK_CONFIDENCE} ELSE"
        f" {choose(DEFAULT_CONFIDENCE, DEFAULT_CONFIDENCE, score)} END",
        action_reasoning=choose(
            f"coalesce(review_reason, '{REVIEW_REQUIRED}')", f"'{PLAN_FAILED}'", f"coalesce({reasoning}, '{NO_REASONING}')"
        ),
        _planned="NOT requires_human_review AND _plan IS NOT NULL",
    ).drop("_plan")


# Model calls with the prefix of their token columns and the condition under which they count.
STAGES = [
    ("translation", "translation_", "was_translated"),
    ("analysis", "", "failure IS NULL"),
    ("summary", "summary_", "failure IS NULL AND _summarised"),
    ("planning", "plan_", "_planned"),
]
BILLED = ["analysis", "planning"]


def sum_tokens(df: DataFrame) -> DataFrame:
    """Tokens by model call, and the sum of analysis plus planning (the other two are left out).

    Token columns are ``in_tokens`` and ``out_tokens`` behind the prefix of the call; a call
    without such columns counts 0.
    """

    def used(name, condition):
        return f"if({condition}, coalesce(CAST({name} AS BIGINT), 0L), 0L)" if name in df.columns else "0L"

    parts = {
        stage: (used(f"{prefix}in_tokens", condition), used(f"{prefix}out_tokens", condition))
        for stage, prefix, condition in STAGES
        if condition in df.columns or condition != "was_translated"
    }
    rows = ", ".join(f"named_struct('stage', '{n}', 'input', {i}, 'output', {o})" for n, (i, o) in parts.items())
    got, made = (" + ".join(parts[stage][k] for stage in BILLED) for k in (0, 1))
    return add(
        df,
        stage_tokens=f"array({rows})",
        token_usage=f"named_struct('input', {got}, 'output', {made}, 'total', {got} + {made})",
    )


def analysis_json() -> Column:
    """The whole result as one JSON object."""
    names = [
        "confidence_scores", "summary", "requires_human_review", "review_reason",
        "next_best_action", "action_confidence", "action_reasoning", "processing_time_ms",
    ]
    usage = "named_struct('inputTokens', token_usage.input, 'outputTokens', token_usage.output, 'totalTokens', token_usage.total)"
    members = ", ".join(f"'{n}', {n}" for n in names)
    return F.expr(
        "to_json(named_struct('classification', classification_object, 'structured_data', structured_object,"
        f" 'action_items', action_objects, {members}, 'tokenUsage', {usage}))"
    )


def analyse(df: DataFrame) -> DataFrame:
    """All of the above on a table with subject, body and the replies."""
    df = review_flags(normalise_analysis(parse_analysis(df)))
    df = sum_tokens(plan_next_action(with_fallback(df)))
    return add(df, processing_time_ms="CAST(coalesce(latency_ms, 0) AS INT)").drop(*RAW, "_planned", "_summarised")
