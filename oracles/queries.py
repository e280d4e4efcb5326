"""The checking SQL of every registered query that SQL can express."""

from mailtables.functions import patterns as P
from mailtables.operators import prompts as PR
from mailtables.plans import fixture as X

from . import duck as D, replies as R
from .duck import q, with_

SQL = {}

CLEAN = D.clean_ctes()


def upto(name):
    """The cleaning steps up to one of them."""
    names = [n for n, _ in CLEAN]
    return CLEAN[: names.index(name) + 1]


def only_text():
    """Mail bodies as plain text, without the HTML step."""
    text = D.line_ends("replace(body_html, chr(13) || chr(10), chr(10))")
    return [D.mails(), ("texts", f"select doc_id, rec_id, {text} as t from emails where body_html is not null")]


def rebased(start, src, last, rename):
    """Cleaning steps ``start``..``last`` reading column ``src`` of ``texts`` in place of ``rename``."""
    names = [n for n, _ in CLEAN]
    steps = CLEAN[names.index(start) : names.index(last) + 1]
    base = (rename[0], f"select doc_id, rec_id, {src} as {rename[1]} from texts")
    return [base, *steps]


SQL["thread_cut"] = with_(*only_text()) + f" select rec_id, {D.thread_expr('t')} as thread_text from texts"
SQL["quotes_stripped"] = with_(*only_text()) + f" select rec_id, {D.quotes_expr('t')} as quote_text from texts"
SQL["disclaimers_stripped"] = (
    with_(*only_text(), *rebased("notices", "t", "tails", ("quotes", "quote_text")))
    + " select rec_id, notice_text, tail_text from tails"
)
SQL["signature_cut"] = (
    with_(*only_text(), *rebased("nl", "t", "signed", ("notices", "notice_text")))
    + " select rec_id, signature_text from signed"
)
SQL["segments"] = (
    with_(*only_text(), ("full_text", "select doc_id, rec_id, t as whole from texts"), *[c for c in CLEAN if c[0] in ("gl", "bounds", "ranges", "parts")])
    + " select rec_id, coalesce(pre, '') as pretext, coalesce(mid, '') as core, coalesce(post, '') as posttext from texts left join parts using (doc_id)"
)
SQL["clean_emails"] = with_(*CLEAN) + " select rec_id, pretext, core, posttext, clean_text from clean"
SQL["clean_metrics"] = (
    with_(*CLEAN) + " select rec_id, preview, original_length, cleaned_length, compression_ratio, warning from clean"
)
SQL["html_text"] = with_(*D.html_ctes("pages", "html")) + " select page_id, url, html_text from html"
SQL["html_hidden"] = (
    with_(("hidden", f"select {', '.join(X.HIDDEN)} from documents"), *D.html_ctes("hidden", "html", hidden="doc_id")).replace("with ", "with recursive ", 1)
    + " select doc_id, html_text from html"
)
SQL["html_strip_fallback"] = "select page_id, " + D.trim(
    D.subs(
        D.normal("html"),
        [
            (r"(?i)<style[^>]*>[\s\S]*?</style>", ""),
            (r"(?i)<script[^>]*>[\s\S]*?</script>", ""),
            (r"<[^>]+>", " "),
            (r"(?i)&[a-z]+;", " "),
            (r"\s+", " "),
        ],
    )
) + " as html_text from pages"


def pattern_hits():
    rows = []
    for name, _, regex in P.THREAD_MARKERS:
        rows.append(("thread", name, D.matches("html_text", f"(?im){regex}"), "signed"))
    for name, _, regex in P.DISCLAIMERS:
        rows.append(("disclaimer", name, D.matches("quote_text", f"(?im){regex}"), "signed"))
    for name, regex in P.SIGNATURE_STRONG:
        rows.append(("signature", name, D.matches("line", f"(?i){regex}"), "sl"))
    for name, regex in P.SIGNATURE_WEAK:
        rows.append(("signature", name, D.matches("line", regex), "sl"))
    for name, regex in P.GREETINGS:
        rows.append(("greeting", name, "i <= 3 and " + D.matches("line", f"(?i){regex}"), "fl"))
    for name, regex in P.CLOSINGS:
        rows.append(("closing", name, "i > n - 5 and " + D.matches("line", f"(?i){regex}"), "fl"))
    selects = [
        f"select {q(stage)} as stage, {q(name)} as pattern, count(distinct doc_id) as mails from {src} where {test}"
        for stage, name, test, src in rows
    ]
    return with_(*upto("signed"), D.line_table("fl", "signed", "signature_text")) + " " + " union all ".join(selects)


SQL["pattern_hits"] = pattern_hits()

STAGES = ["html_text", "thread_text", "quote_text", "notice_text", "tail_text", "signature_text"]
SQL["stage_removals"] = with_(*upto("signed")) + " " + " union all ".join(
    f"select {q(after.removesuffix('_text'))} as stage, count(*) filter ({before} <> {after}) as mails_changed,"
    f" cast(sum(length({before}) - length({after})) as bigint) as chars_removed from signed"
    for before, after in zip(STAGES, STAGES[1:])
)

# ---- sources ---------------------------------------------------------------------------------

EMAILS = D.mails()
SQL["scan_tickets_page"] = (
    with_(EMAILS)
    + " select rec_id, subject, type, cast(created_ts as varchar) as created_ts from emails where type = 'Tickets'"
    " order by emails.created_ts desc, rec_id asc nulls first limit 10 offset 10"
)
SQL["lookup_source"] = with_(EMAILS) + " select rec_id, subject, body_html from emails where rec_id = 42 and type = 'Tickets'"

PAGES = ("envelopes", f"select {', '.join(X.ENVELOPES)} from documents")
MAIL_COLUMNS = (
    "cast(m ->> 'RecId' as bigint) as rec_id, m ->> 'Subject' as subject, m ->> 'Comments' as body_html,"
    " m ->> 'Type' as type, m ->> 'CreatedDateTime' as created"
)
DATA, ITEMS = "json_extract(j, '$.Data[*]')", "case when json_type(j) = 'ARRAY' then json_extract(j, '$[*]') else json_extract(j, '$.Items[*]') end"


def elements(found):
    """Every element of the pages' lists, with what is wrong with it."""
    return [
        PAGES,
        ("read", "select page_no, payload, case when json_valid(payload) then cast(payload as json) end as j from envelopes"),
        ("lists", f"select page_no, {found} as l from read"),
        ("listed", "select page_no, unnest(l) as m, unnest(range(0, len(l))) as position from lists"),
        ("elements", "select page_no, position, m, case when json_type(m) = 'NULL' then 'null element'"
         " when json_type(m) <> 'OBJECT' then 'element is no object'"
         " when m ->> 'RecId' is not null and try_cast(trim(m ->> 'RecId') as bigint) is null then 'RecId is no number' end as problem from listed"),
    ]


MAIL_COLUMNS = MAIL_COLUMNS.replace("cast(m ->> 'RecId' as bigint)", "cast(trim(m ->> 'RecId') as bigint)")
SQL["envelope_unnest"] = with_(*elements(DATA)) + f" select page_no, {MAIL_COLUMNS} from elements where problem is null"
SQL["envelope_listing"] = with_(*elements(ITEMS)) + f" select page_no, {MAIL_COLUMNS} from elements where problem is null"
SQL["envelope_dead_letters"] = with_(*elements(DATA)) + (
    " select page_no, position, problem from elements where problem is not null union all select page_no, null,"
    " case when payload is null then 'empty page' else 'page is no JSON' end from read where j is null"
)
SQL["envelope_totals"] = (
    with_(*elements(DATA)) + " select page_no, cast(coalesce(nullif(try_cast(trim(j ->> 'TotalCount') as bigint), 0),"
    " case when json_type(j) = 'ARRAY' then json_array_length(j) end, 0) as bigint) as total from read"
)
SQL["dead_letters"] = (
    with_(EMAILS) + " select case when rec_id is null then 'missing rec_id' else 'none' end as problem, count(*) as mails from emails group by 1"
)

# ---- translation -----------------------------------------------------------------------------

ARABIC = q(r"[\x{0600}-\x{06FF}]")


def arabic(x):
    return f"coalesce(regexp_matches({x}, {ARABIC}), false)"


PLAIN = ("plain", f"select *, body_html as body, {arabic('subject')} or {arabic('body_html')} as has_arabic from emails")
MESSAGES = ("messages", f"select {', '.join(X.MESSAGES)} from conversations")

SQL["arabic_routing"] = (
    with_(EMAILS, PLAIN) + " select rec_id, subject, has_arabic, case when has_arabic then 'ar' else 'en' end as language from plain"
)
SQL["translation_prompts"] = (
    with_(EMAILS, PLAIN) + f" select rec_id, 'translation' as kind, {R.EMAIL_PROMPT} as prompt from plain where has_arabic"
)
SQL["text_translation_prompts"] = (
    with_(MESSAGES) + f" select conv_id, turn, 'text' as kind, {R.TEXT_PROMPT} as prompt from messages where {arabic('text')}"
)
SQL["translation_applied"] = (
    with_(*R.input_ctes()) + f" select rec_id, subject, body, language, was_translated, {R.CONTENT} as translated_content from inp"
)
DONE = f"{arabic('text')} and translation_text is not null"
SQL["text_translation_applied"] = (
    with_(MESSAGES) + f" select conv_id, turn, case when {DONE} then {D.trim('translation_text')} else text end as text,"
    f" case when {arabic('text')} then 'ar' else 'en' end as language, {DONE} as was_translated from messages"
)

# ---- prompts and replies ---------------------------------------------------------------------

SQL["analysis_prompts"] = with_(EMAILS, PLAIN) + f" select rec_id, 'analysis' as kind, {R.ANALYSIS_PROMPT} as prompt from plain"
SQL["summary_prompts"] = (
    with_(*R.input_ctes(), *R.raw_ctes("inp"))
    + f" select rec_id, 'summary' as kind, {R.SUMMARY_PROMPT} as prompt from raw2 where raw is not null and {R.NEEDS_SUMMARY}"
    f" and not ({R.truthy('sm')} and coalesce(json_type(cs), 'NULL') = 'NULL')"
)
CONTEXT = """'{"classification":' || classification_object || ',"structured_data":' || structured_object || '}'"""
SQL["action_prompts"] = (
    with_(*R.analysis_ctes())
    + f" select rec_id, 'action' as kind, {R.fill(PR.ACTION_TEMPLATE, CONTEXT=CONTEXT)} as prompt from acted where not requires_human_review"
)
SQL["analysis_parsed"] = (
    with_(D.RESPONSES, *R.raw_ctes("responses"), R.flat("raw2"))
    + f" select rec_id, raw is not null as parsed, {', '.join(R.FLAT)} from flat"
)
SQL["analysis_members"] = (
    with_(("responses", f"select {', '.join(X.OPEN_RESPONSES)} from documents"), *R.raw_ctes("responses"), *R.open_ctes("raw2"))
    + f" select rec_id, {', '.join(R.OPEN)} from opened"
)
SQL["review_flags"] = (
    with_(D.RESPONSES, *R.raw_ctes("responses"), *R.review_ctes("raw2")) + " select rec_id, requires_human_review, review_reason from reviewed"
)
ANALYSED = with_(*R.analysis_ctes())
SQL["analysis_summary"] = ANALYSED + " select rec_id, summary from acted"
SQL["analysis_fallback"] = ANALYSED + f" select rec_id, failure, requires_human_review, review_reason, {', '.join(R.FLAT)} from acted"
SQL["next_action"] = ANALYSED + " select rec_id, next_best_action, action_confidence, action_reasoning from acted"
def result_member(name, value, optional=False):
    text = f"',\"{name}\":' || {value}"
    return f"coalesce({text}, '')" if optional else text


RESULT_JSON = " || ".join(
    [
        """'{"classification":' || classification_object || ',"structured_data":' || structured_object || ',"action_items":' || action_objects""",
        "',\"confidence_scores\":' || json_object(" + ", ".join(f"'{n}', score_{n}::double" for n in R.SCORES) + ")::varchar",
        result_member("summary", "to_json(summary)::varchar"),
        result_member("requires_human_review", "requires_human_review::varchar"),
        result_member("review_reason", "to_json(review_reason)::varchar", True),
        result_member("next_best_action", "to_json(next_best_action)::varchar"),
        result_member("action_confidence", "to_json(action_confidence::double)::varchar"),
        result_member("action_reasoning", "to_json(action_reasoning)::varchar"),
        result_member("processing_time_ms", "coalesce(latency_ms, 0)::varchar"),
        "',\"tokenUsage\":' || json_object('inputTokens', analysis_in + planning_in, 'outputTokens', analysis_out + planning_out,"
        " 'totalTokens', analysis_in + planning_in + analysis_out + planning_out)::varchar || '}'",
    ]
)
SQL["analysis_result"] = ANALYSED + f" select rec_id as req_id, {RESULT_JSON} as analysis_result from counted"
CALLS = " union all ".join(
    f"select '{stage}' as stage, {stage}_in as i, {stage}_out as o from counted" for stage in ("translation", "analysis", "summary", "planning")
)
SQL["token_usage"] = ANALYSED + (
    " select stage, cast(grouping(stage) as integer) as level, count(*) filter (i + o > 0) as calls, cast(sum(i) as bigint) as input_tokens,"
    f" cast(sum(o) as bigint) as output_tokens, cast(sum(i + o) as bigint) as total_tokens from ({CALLS}) group by rollup (stage)"
)


def domain_violations():
    fields = [("category", P.CATEGORIES), ("priority", P.PRIORITIES), ("sentiment", P.SENTIMENTS), ("next_best_action", P.ACTIONS)]
    return ANALYSED + " " + " union all ".join(
        f"select '{field}' as field, {field} as value, count(*) as mails from acted where {field} not in ({', '.join(q(v) for v in allowed)}) group by {field}"
        for field, allowed in fields
    )


SQL["domain_violations"] = domain_violations()

# ---- tables and pipelines --------------------------------------------------------------------

DELIVERIES = [
    (
        "first_delivery",
        "select doc_id as req_id, lang as pretext, text as core, source as posttext, text as clean_text, lang = 'en' as translated,"
        " case when n_chars % 3 = 0 then '' else lang end as summary, case when n_chars % 4 <> 0 then n_chars % 4 = 1 end as requires_human_review,"
        " case when n_chars % 4 = 1 then 'why' else '' end as review_reason, case when n_chars % 5 <> 0 then n_chars end as processing_time_ms,"
        " n_chars as arrival from documents",
    ),
    (
        "deliveries",
        "select * from first_delivery union all select * replace ('second' as summary, arrival + 1 as arrival) from first_delivery where arrival > 1000",
    ),
    (
        "defaulted",
        "select req_id, pretext, core, posttext, clean_text, translated, nullif(summary, '') as summary,"
        " coalesce(requires_human_review, false) as requires_human_review, nullif(review_reason, '') as review_reason,"
        " cast(coalesce(processing_time_ms, 0) as integer) as processing_time_ms, arrival from deliveries",
    ),
]
CURRENT = [
    (
        "current_rows",
        "select doc_id as req_id, source as core from documents where lang in ('de', 'fr')"
        " union all select conv_id + 100000000, cast(count(*) as varchar) from conversations group by conv_id",
    ),
]
TABLE = ["pretext", "core", "posttext", "clean_text", "translated", "summary", "requires_human_review", "review_reason", "processing_time_ms"]
SNAPSHOT = [
    *DELIVERIES,
    *CURRENT,
    ("newest", "select * from (select *, row_number() over (partition by req_id order by arrival desc) as rn from defaulted) where rn = 1"),
    (
        "snapshot",
        "select coalesce(o.req_id, n.req_id) as req_id, "
        + ", ".join(f"case when n.req_id is not null then n.{c} else {'o.core' if c == 'core' else 'null'} end as {c}" for c in TABLE)
        + ", case when o.req_id is not null then '2025-01-01 00:00:00' else '2025-03-01 12:00:00' end as created_at"
        " from current_rows o full join newest n on o.req_id = n.req_id",
    ),
]
SQL["upsert_snapshot"] = with_(*SNAPSHOT) + f" select req_id, {', '.join(TABLE)}, created_at from snapshot"
SQL["list_cleaned"] = (
    with_(*SNAPSHOT) + " select req_id, summary, created_at from snapshot order by created_at desc, req_id limit 5 offset 5"
)
SQL["review_queue"] = with_(*SNAPSHOT) + " select req_id, review_reason, created_at from snapshot where requires_human_review"
LABELS = [
    *DELIVERIES,
    ("past", "select conv_id as req_id, count(*) as done from conversations group by conv_id"),
    (
        "numbered",
        "select *, row_number() over (partition by req_id order by arrival) + coalesce(done, 0) as process_number,"
        " '2025-03-01 12:00:00' as created_at from defaulted left join past using (req_id)",
    ),
    ("labelled", "select *, 'process' || process_number as process_label from numbered"),
]
SQL["reprocess_labels"] = with_(*LABELS) + f" select process_label, process_number, req_id, {', '.join(TABLE)}, created_at from labelled"
SQL["history_by_req"] = (
    with_(*LABELS) + " select process_number, req_id, process_label, pretext, core, created_at from labelled where req_id = 10"
)
SQL["constraint_violations"] = with_(
    *DELIVERIES, ("keys", "select case when arrival % 97 <> 0 then req_id end as req_id from deliveries")
) + (
    " select 'req_id is null' as rule, cast(null as varchar) as key, count(*) as rows from keys where req_id is null having count(*) > 0"
    " union all select 'unique req_id', cast(req_id as varchar), count(*) from keys where req_id is not null group by req_id having count(*) > 1"
)

ORIGINAL = "case when original_subject is null then json_object('body', clean_text) else json_object('subject', original_subject, 'body', clean_text) end"
STORED = (
    "select rec_id as req_id, pretext, core, posttext, clean_text, was_translated as translated, summary, requires_human_review, review_reason,"
    f" cast(coalesce(latency_ms, 0) as integer) as processing_time_ms, cast({ORIGINAL} as varchar) as original_email,"
    f" cast({R.CONTENT} as varchar) as translated_content, next_best_action, cast(analysis_in + analysis_out + planning_in + planning_out as varchar) as total_tokens,"
    " cast(created_ts as varchar) as arrival from counted"
)
SQL["pipeline_rows"] = ANALYSED + " " + STORED
SQL["run_report"] = ANALYSED + (
    " select case when type = 'Tickets' then 'emails_cleaned' else 'emails_reprocess' end as \"table\", count(*) as total,"
    " count(*) filter (was_translated) as translated, count(*) filter (requires_human_review) as under_review, count(summary) as with_summary"
    " from acted group by 1"
)
SQL["ingest_batch"] = with_(*R.analysis_ctes(), *CURRENT, ("tickets", "select * from acted where type = 'Tickets'")) + (
    " select coalesce(o.req_id, n.rec_id) as req_id, case when n.rec_id is not null then n.core else o.core end as core, n.summary,"
    " n.requires_human_review, case when o.req_id is not null then '2025-01-01 00:00:00' else '2025-03-01 12:00:00' end as created_at"
    " from current_rows o full join tickets n on o.req_id = n.rec_id"
)
SQL["reprocess_batch"] = with_(*R.analysis_ctes(), ("past", "select conv_id as rec_id, count(*) as done from conversations group by conv_id")) + (
    " select rec_id as req_id, 'process' || (done + 1) as process_label, core, summary, review_reason, '2025-03-01 12:00:00' as created_at"
    " from acted join past using (rec_id) where type = 'Tickets'"
)
SQL["run_rows"] = with_(*LABELS) + (
    " select req_id, translated as was_translated, process_label, summary, requires_human_review, review_reason from labelled"
)
SQL["ingest_given"] = ANALYSED + (
    " select rec_id as req_id, 'emails_reprocess' as \"table\", core, summary, cast(coalesce(latency_ms, 0) as integer) as processing_time_ms from acted"
)
SQL["infer_batches"] = (
    "select doc_id as rec_id, case when p like '%src3%' then null else replace(p, ' ', '_') end as reply,"
    " case when p like '%src3%' then null else length(p) end as in_tokens, p like '%src3%' as failed"
    " from (select doc_id, source || '|' || text as p from documents)"
)

# ---- streams ---------------------------------------------------------------------------------

SQL["stream_clean"] = with_(*CLEAN) + " select rec_id, core, clean_text from clean"
SQL["stream_upsert"] = (
    "select doc_id as req_id, case when lang = 'en' then source else text end as core, false as requires_human_review,"
    " '2025-03-01 12:00:00' as created_at from documents"
)
SQL["deep_page"] = (
    with_(D.mails()) + " select rec_id, subject, type from emails where rec_id is not null"
    " order by subject desc nulls last, rec_id limit 20 offset 80"
)
SQL["stream_dedup"] = "select event_id as rec_id, event_type from events"

# ---- stores and further streams ------------------------------------------------------------------

SQL["ranked_page"] = SQL["deep_page"]
# The earlier table is itself an upsert, which fills in the defaults.
SQL["upsert_buckets"] = (
    "select * replace (coalesce(translated, false) as translated, coalesce(requires_human_review, false) as requires_human_review,"
    f" coalesce(processing_time_ms, 0) as processing_time_ms) from ({SQL['upsert_snapshot']})"
)
SQL["reply_log"] = (
    "select doc_id as rec_id, lang as kind, source || ' ' || (n_chars % 10) as reply, length(source || '|' || (n_chars % 10)) as in_tokens,"
    " null::varchar as error from documents"
)
SQL["provider_totals"] = (
    "with requests as (select distinct lang as kind, source || '|' || (n_chars % 10) as prompt from documents)"
    " select kind, count(*) + count(*) filter (contains(prompt, 'src3')) as calls, count(*) as requests,"
    " count(*) filter (contains(prompt, 'src3')) as failed, sum(length(prompt))::bigint as input_tokens, 3 * count(*) as output_tokens"
    " from requests group by kind"
)
SQL["stream_dedup_bounded"] = SQL["stream_dedup"]
SQL["stream_upsert_levels"] = (
    "select doc_id as req_id, '5 ' || text as core, false as requires_human_review, '2025-03-01 12:00:00' as created_at from documents"
)


def answers(table, where, label, extra=()):
    responses = ("responses", f"{D.RESPONSES[1]} where doc_id % 10 <> 3 and doc_id % 6 {where}")
    return with_(*R.analysis_ctes(responses), *extra) + (
        f" select '{table}' as \"table\", {label} as process_label, rec_id as req_id, core, summary, requires_human_review, review_reason from acted"
    )


SQL["stream_answers"] = (
    f"select * from ({answers('emails_cleaned', '<> 0', 'null')}) union all select * from ("
    + answers(
        "emails_reprocess", "= 0", "'process' || (coalesce(done, 0) + 1)",
        [("past", "select conv_id as rec_id, count(*) as done from conversations group by conv_id")],
    )
    + " left join past using (rec_id) where rec_id in (select rec_id from responses))"
)

FAILURES = [
    D.mails(),
    ("landed", f"select {', '.join(X.LANDED)} from documents"),
    *D.clean_ctes()[1:],
    (
        "marked",
        "select doc_id, landed_id, array_to_string(list_filter([case when landed_id is null then 'missing rec_id' end,"
        " case when landed_id like 'no.%' then 'rec_id is no number' end, case when created = 'soon' then 'created is no time' end],"
        " lambda r: r is not null), '; ') as scan, case when length(body_html) > 20000 then 'body is too long' end as long,"
        " case when latency in ('slow', '99999999999', '-5') then 'latency is no time span' end as slow,"
        " case when clean_text = '' then 'nothing to store' end as bare from landed join clean using (doc_id)",
    ),
    (
        "failures",
        "select landed_id as rec_id, case when scan <> '' then 'scan' when long is not null then 'clean' when slow is not null then 'reply' else 'store' end as stage,"
        " coalesce(nullif(scan, ''), long, slow, bare) as reason from marked where scan <> '' or coalesce(long, slow, bare) is not null",
    ),
]
SQL["ingest_failures"] = with_(*FAILURES) + (
    " select case when stage = 'store' then trim(rec_id) else rec_id end as rec_id, stage, reason from failures"
)
SQL["ingest_accounting"] = with_(*FAILURES) + (
    " select (select count(*) from landed) as arrived, (select count(*) from landed) - count(*) as stored, count(*) as failed, true as balanced from failures"
)
SQL["routed_tables"] = (
    with_(*DELIVERIES) + " select case when pretext = 'de' then 'emails_reprocess' else 'emails_cleaned' end as \"table\", req_id, core from deliveries"
)
PLAIN_INPUT = [
    D.mails(), D.RESPONSES,
    ("inp", "select emails.*, body_html as body, false as was_translated, responses.* exclude (rec_id) from emails left join responses using (rec_id) where rec_id is not null"),
]
SQL["null_bodies"] = with_(*R.analysis_ctes(inputs=PLAIN_INPUT)) + (
    " select rec_id, failure, summary, review_reason, action_confidence, action_reasoning from acted"
)
SQL["history_violations"] = with_(*LABELS, (
    "listed", "select req_id, case when req_id % 5 <> 0 then process_label end as process_label from labelled"
    " union all select req_id, process_label from labelled where req_id % 3 = 0",
)) + (
    " select 'process_label is null' as rule, null::varchar as key, count(*) as rows from listed where process_label is null having count(*) > 0"
    " union all select 'unique req_id, process_label', req_id || '/' || process_label, count(*) from listed where process_label is not null"
    " group by req_id, process_label having count(*) > 1"
)
