"""Reply parsing and rules as SQL over JSON functions."""

from mailtables.operators import prompts as PR, translation as T

from . import duck as D
from .duck import q

NUMBER = q(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
TOKENS = [f"{p}{s}_tokens" for p in ('', 'plan_', 'summary_', 'translation_') for s in ('in', 'out')]
PRIMITIVE = "('VARCHAR', 'BOOLEAN', 'UBIGINT', 'BIGINT', 'DOUBLE')"


def text(x):
    return f"({x} ->> '$')"


def number(x):
    t = text(x)
    return (
        f"case json_type({x}) when 'NULL' then 0.0 when 'ARRAY' then null when 'OBJECT' then null"
        f" when 'BOOLEAN' then case when {t} = 'true' then 1.0 else 0.0 end"
        f" else case when trim({t}) = '' then 0.0 when regexp_matches({t}, {NUMBER}) then cast(trim({t}) as double) end end"
    )


def is_number(x):
    return f"coalesce(json_type({x}) in ('UBIGINT', 'BIGINT', 'DOUBLE'), false)"


def truthy(x):
    t = text(x)
    return (
        f"coalesce(case json_type({x}) when 'NULL' then false when 'ARRAY' then true when 'OBJECT' then true"
        f" when 'BOOLEAN' then {t} = 'true' when 'VARCHAR' then {t} <> '' else cast({t} as double) <> 0 end, false)"
    )


def clamp_confidence(x):
    return f"case when {is_number(x)} then least(1.0, greatest(0.0, cast({text(x)} as double))) else 0.7 end"


def clamp_score(x):
    return f"case when {truthy(x)} then coalesce(least(1.0, greatest(0.0, {number(x)})), 0.7) else 0.7 end"


def shown(x):
    """A scalar as JavaScript prints it."""
    plain = f"regexp_replace(cast(cast({text(x)} as double) as varchar), '\\.0$', '')"
    return f"case when json_type({x}) = 'NULL' then 'null' when {is_number(x)} then {plain} else {text(x)} end"


def raw_json(column):
    bare = f"regexp_replace({column}, '```json\\s*|```', '', 'g')"
    return f"try_cast(nullif(regexp_extract({bare}, '\\{{[\\s\\S]*\\}}'), '') as json)"


def raw_ctes(src):
    return [
        ("raw0", f"select *, {raw_json('analysis_text')} as raw from {src}"),
        (
            "raw1",
            "select *, raw -> 'classification' as cls, raw -> 'structured_data' as sd, raw -> 'action_items' as ai,"
            " raw -> 'summary' as sm, raw -> 'confidence_scores' as cs from raw0",
        ),
        (
            "raw2",
            "select *, cls -> 'category' as cat, cls -> 'priority' as pri, cls -> 'sentiment' as sen, cls -> 'confidence' as con,"
            " cs -> 'overall' as ova from raw1",
        ),
    ]


PAIRS = (
    "array_to_string(list_transform(list_sort(list_filter(json_keys(sd), lambda k: k <> 'confidence')),"
    " lambda k: k || '=' || coalesce(sd -> k ->> 'value', '?') || '@' || coalesce(cast(cast(sd -> k ->> 'confidence' as double) as varchar), '?')), ';')"
)
ITEMS = (
    "array_to_string(list_transform(case when json_type(ai) = 'ARRAY' then json_extract(ai, '$[*]') end,"
    f" lambda a: coalesce(a ->> 'action', '?') || '@' || cast({clamp_confidence('(a -> ' + chr(39) + 'confidence' + chr(39) + ')')} as varchar)), ';')"
)
SCORES = ["overall", "classification", "structured_data", "action_items"]


def score(name):
    return clamp_score(f"(cs -> '{name}')")


def flat(source="raw2"):
    structured = "(sd -> 'confidence')"
    cols = [
        "*",
        f"{text('cat')} as category", f"{text('pri')} as priority", f"{text('sen')} as sentiment",
        f"{clamp_confidence('con')} as class_confidence",
        f"coalesce({PAIRS}, '') as structured_data",
        f"case when {truthy(structured)} then coalesce({number(structured)}, 0.7) else 0.7 end as structured_confidence",
        f"coalesce({ITEMS}, '') as action_items",
        *[f"{score(n)} as score_{n}" for n in SCORES],
    ]
    return ("flat", f"select {', '.join(cols)} from {source}")


FLAT = ["category", "priority", "sentiment", "class_confidence", "structured_data", "structured_confidence", "action_items"] + [
    f"score_{n}" for n in SCORES
]


def in_order(x, depth=4):
    """JSON text with the members of every object in alphabetical order."""
    if not depth:
        return f"{x}::varchar"
    k, i = f"k{depth}", f"i{depth}"
    return (
        f"case json_type({x}) when 'OBJECT' then '{{' || array_to_string(list_transform(list_sort(json_keys({x})), lambda {k}: to_json({k})::varchar || ':'"
        f" || {in_order(f'({x} -> {k})', depth - 1)}), ',') || '}}' when 'ARRAY' then '[' || array_to_string(list_transform(range(0, json_array_length({x})::bigint),"
        f" lambda {i}: {in_order(f'({x} -> {i}::int)', depth - 1)}), ',') || ']' else {x}::varchar end"
    )


def set_confidence(x, value):
    return f"json_merge_patch({x}, json_object('confidence', {value}))"


def open_ctes(src="raw2"):
    """The parts of a reply with all their members, as JSON text."""
    conf = "(sd -> 'confidence')"
    kept = f"case when json_type(sd) = 'OBJECT' and {truthy(conf)} then {conf} else '0.7'::json end"
    listed = "list_transform(range(0, json_array_length(sd)::bigint), lambda i: '\"' || i || '\":' || (sd -> i::int)::varchar)"
    chars = f"list_transform(range(0, length({text('sd')})), lambda i: '\"' || i || '\":' || to_json(substr({text('sd')}, i + 1, 1))::varchar)"
    spread = (
        f"case json_type(sd) when 'OBJECT' then sd when 'ARRAY' then ('{{' || array_to_string({listed}, ',') || '}}')::json"
        f" when 'VARCHAR' then ('{{' || array_to_string({chars}, ',') || '}}')::json else '{{}}'::json end"
    )
    item = f"case when json_type(a) = 'OBJECT' then {set_confidence('a', clamp_confidence('(a -> ' + chr(39) + 'confidence' + chr(39) + ')'))} else a end"
    items = f"case when json_type(ai) = 'ARRAY' then list_transform(json_extract(ai, '$[*]'), lambda a: {item}) end"
    cls_open = (
        f"case when json_type(cls) = 'OBJECT' then {set_confidence('cls', clamp_confidence('con'))} when {truthy('cls')} then cls"
        " else json_object('confidence', 0.7::double) end"
    )
    return [
        ("open0", f"select *, {cls_open} as cls_open, {set_confidence(f'({spread})', kept)} as sd_open, {items} as ai_open from {src}"),
        (
            "opened",
            f"select *, {in_order('cls_open')} as classification_object, {in_order('sd_open')} as structured_object,"
            f" '[' || coalesce(array_to_string(list_transform(ai_open, lambda a: {in_order('a')}), ','), '') || ']' as action_objects from open0",
        ),
    ]


OPEN = ["classification_object", "structured_object", "action_objects"]


def review_ctes(src):
    con, ova = number("con"), number("ova")
    items = number("(cs -> 'action_items')")
    no_items = f"(not {truthy('ai')} or coalesce(json_array_length(ai) = 0 and json_type(ai) = 'ARRAY', false))"
    rules = [
        f"case when {ova} < 0.7 then 'low overall confidence (' || {shown('ova')} || ')' end",
        f"case when {con} < 0.7 then 'low classification confidence (' || {shown('con')} || ')' end",
        f"case when {text('cat')} = 'other' and {con} < 0.8 then 'uncertain category classification' end",
        f"case when {text('pri')} = 'medium' and {con} < 0.75 then 'uncertain priority classification' end",
        f"case when {no_items} and {items} > 0.7 then 'no action items despite high confidence' end",
    ]
    return [
        ("reasons", f"select *, list_filter([{', '.join(rules)}], lambda r: r is not null) as rs from {src}"),
        (
            "reviewed",
            "select * exclude rs, len(rs) > 0 as requires_human_review, case when len(rs) > 0 then 'Requires review: ' || array_to_string(rs, ', ') end as review_reason from reasons",
        ),
    ]


NEEDS_SUMMARY = f"(not {truthy('sm')} or coalesce({number('ova')} < 0.7, false))"


def sentence(body):
    return D.trim(f"coalesce(nullif(regexp_extract({body}, '\\A([^.!?]*)', 1), ''), substr({body}, 1, 100))")


def input_ctes(responses=D.RESPONSES):
    """Cleaned mails with replies, translation applied."""
    arabic = r"[\x{0600}-\x{06FF}]"
    has = f"(coalesce(regexp_matches(subject, {q(arabic)}), false) or coalesce(regexp_matches(clean_text, {q(arabic)}), false))"
    return [
        *D.clean_ctes(),
        responses,
        (
            "joined0",
            f"select clean.*, {', '.join(c.split(' as ')[-1] for c in ['analysis_text', 'summary_text', 'action_text', 'translation_text', 'latency_ms', *TOKENS])},"
            f" {has} as has_arabic from clean left join responses using (rec_id) where rec_id is not null",
        ),
        (
            "joined1",
            "select * exclude subject, subject as original_subject, has_arabic and translation_text is not null as was_translated,"
            " case when has_arabic then 'ar' else 'en' end as language,"
            " string_split(translation_text, chr(10)) as tl from joined0",
        ),
        (
            "inp",
            "select * exclude tl,"
            " case when was_translated then coalesce(nullif(tl[1], ''), original_subject) else original_subject end as subject,"
            f" case when was_translated then coalesce(nullif({D.trim('array_to_string(tl[2:], chr(10))')}, ''), clean_text) else clean_text end as body from joined1",
        ),
    ]


CONTENT = "case when was_translated then case when subject is null then json_object('body', body) else json_object('subject', subject, 'body', body) end end"


def analysis_ctes(responses=D.RESPONSES, inputs=None):
    prim = "json_type({0}) in " + PRIMITIVE
    primitive_item = "list_filter(case when json_type(ai) = 'ARRAY' then json_extract(ai, '$[*]') end, lambda a: " + f"{truthy('a')} and " + prim.format("a") + ")"
    failed = (
        "raw is null"
        f" or ({truthy('sm')} and coalesce(json_type(cs), 'NULL') = 'NULL')"
        f" or ({truthy('ai')} and json_type(ai) <> 'ARRAY')"
        f" or ({truthy('cls')} and {prim.format('cls')})"
        f" or coalesce(len({primitive_item}) > 0, false)"
        f" or ({NEEDS_SUMMARY} and summary_text is null)"
    )
    cleaned = f"regexp_replace(regexp_replace({D.trim('summary_text')}, '[\"''`]', '', 'g'), '(?i)\\A\\s*Summary:\\s*', '')"

    def named(x, default):
        return f"case when {truthy(x)} then {text(x)} else '{default}' end"

    built = (
        f"'Email about ' || {named('cat', 'general inquiry')} || ' (' || {named('pri', 'medium')} || ' priority, ' || {named('sen', 'neutral')}"
        f" || ' sentiment). ' || {sentence('body')}"
    )
    subject = "'Original subject: \"' || coalesce(subject, '') || '\". '"
    fixed = {
        "category": "'other'", "priority": "'medium'", "sentiment": "'neutral'", "class_confidence": "0.5",
        "structured_data": "''", "structured_confidence": "0.5", "action_items": "''",
        **{f"score_{n}": "0.5" for n in SCORES},
        "classification_object": """'{"category":"other","confidence":0.5,"priority":"medium","sentiment":"neutral"}'""",
        "structured_object": """'{"confidence":0.5}'""", "action_objects": "'[]'",
    }
    plan_conf, action, reasoning = "(plan -> 'confidence')", "(plan -> 'action')", "(plan -> 'reasoning')"
    return [
        *(inputs or input_ctes(responses)),
        *raw_ctes("inp"),
        *open_ctes("raw2"),
        flat("opened"),
        *review_ctes("flat"),
        (
            "judged",
            f"select *, ({failed}) as failed, coalesce(nullif(case when {NEEDS_SUMMARY} then {cleaned} else {text('sm')} end, ''), {built}) as summary0 from reviewed",
        ),
        (
            "failing",
            "select *, case when body is null and (failed or summary0 is null) then 'pipeline' when failed then 'analysis' end as failure from judged",
        ),
        (
            "final",
            f"select * exclude ({', '.join(FLAT + OPEN)}, requires_human_review, review_reason), "
            + ", ".join(f"case when failure is null then {c} else {fixed[c]} end as {c}" for c in FLAT + OPEN)
            + f", case failure when 'pipeline' then 'Email processing failed. ' || {subject} || 'Requires manual review.'"
            f" when 'analysis' then 'Email analysis failed. ' || {subject} || 'First sentence: \"' || {sentence('body')} || '\"' else summary0 end as summary,"
            " failure is not null or requires_human_review as requires_human_review,"
            " case failure when 'pipeline' then 'Processing error occurred' when 'analysis' then 'Analysis failed - requires manual review' else review_reason end as review_reason,"
            f" {raw_json('action_text')} as plan from failing",
        ),
        (
            "acted",
            "select *,"
            f" case when requires_human_review or plan is null then 'Escalate to agent' else case when {truthy(action)} then {text(action)} else 'Escalate to agent' end end as next_best_action,"
            f" case when failure = 'pipeline' then 0.5 when requires_human_review or plan is null then 0.7 else {clamp_score(plan_conf)} end as action_confidence,"
            " case when requires_human_review then coalesce(review_reason, 'Human review required') when plan is null then 'Fallback due to processing error'"
            f" else case when {truthy(reasoning)} then {text(reasoning)} else 'Default escalation due to parsing error' end end as action_reasoning,"
            f" {NEEDS_SUMMARY} and failure is null as summarised, not requires_human_review and plan is not null as planned from final",
        ),
        (
            "counted",
            "select *,"
            + ", ".join(
                f" case when {test} then coalesce({prefix}{side}_tokens, 0) else 0 end as {stage}_{side}"
                for stage, prefix, test in [
                    ("translation", "translation_", "was_translated"), ("analysis", "", "failure is null"),
                    ("summary", "summary_", "summarised"), ("planning", "plan_", "planned"),
                ]
                for side in ("in", "out")
            )
            + " from acted",
        ),
    ]


def fill(template, **values):
    """``template`` with columns put in, as a concatenation."""
    parts, rest = [], template
    for name in sorted(values, key=lambda n: template.find("{{%s}}" % n)):
        head, _, rest = rest.partition("{{%s}}" % name)
        parts += [q(head), f"coalesce({values[name]}, '')"]
    return " || ".join(parts + [q(rest)])


MAIL_TEXT = "('Subject: ' || coalesce(subject, '') || chr(10) || chr(10) || 'Body:' || chr(10) || coalesce(body, ''))"
EMAIL_PROMPT = D.trim(fill(T.EMAIL_TEMPLATE, SUBJECT="subject", BODY="body"))
TEXT_PROMPT = fill(T.TEXT_TEMPLATE, BODY="text")
ANALYSIS_PROMPT = fill(PR.ANALYSIS_TEMPLATE, EMAIL=MAIL_TEXT)
SUMMARY_PROMPT = fill(PR.SUMMARY_TEMPLATE, EMAIL=MAIL_TEXT)
