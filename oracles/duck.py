"""SQL pieces for the checking engine, written apart from the Spark code.

Only the fixed values (patterns, texts) and the portable select lists of the composed tables are
shared. Regular expressions run without the literal pre-tests of the Spark side, and the line
logic is ``unnest`` plus windows where Spark uses array functions.
"""

from html.entities import name2codepoint

from mailtables.functions import patterns as P
from mailtables.plans import fixture as X

NL = "chr(10)"


def q(text):
    return "'" + text.replace("'", "''") + "'"


WS = q(P.WHITE_SPACE)


def trim(x):
    return f"trim({x}, {WS})"


def sub(x, regex, new, flags="g"):
    return f"regexp_replace({x}, {q(regex)}, {q(new)}, {q(flags)})"


def subs(x, pairs):
    for regex, new in pairs:
        x = sub(x, regex, new)
    return x


def first_only(x, regex):
    return f"regexp_replace({x}, {q(rf'\A([\s\S]*?)(?im:{regex})')}, {q(chr(92) + '1')})"


def before(x, regex):
    return f"regexp_extract({x}, {q(rf'\A([\s\S]*?)(?im:{regex})')}, 1)"


def matches(x, regex):
    return f"regexp_matches({x}, {q(regex)})"


def with_(*ctes):
    return "with " + ",\n".join(f"{name} as ({body})" for name, body in ctes)


def mails(source="documents"):
    cols = ", ".join(X.EMAILS)
    return (
        "emails",
        f"select * exclude created_minute, timestamp '2024-01-01 00:00:00' + to_minutes(created_minute) as created_ts"
        f" from (select doc_id, {cols} from {source})",
    )


RESPONSES = ("responses", f"select {', '.join(X.RESPONSES)} from documents")

# ---- HTML ------------------------------------------------------------------------------------

ENTITY = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"
NAMES = {n: chr(c) for n, c in sorted(name2codepoint.items())} | {"apos": "'"}


def normal(x):
    return line_ends(f"replace(coalesce({x}, ''), chr(13) || chr(10), chr(10))")


def line_ends(x):
    """One character each: other line ends become a line feed, the no-break space a blank."""
    return f"translate({x}, chr(13) || chr(133) || chr(8232) || chr(8233) || chr(160), repeat(chr(10), 4) || ' ')"


def hidden_ctes(src, column, key):
    """As a recursive CTE: the stack has the innermost element first, ``base`` counts the elements around a hidden one."""
    tag = q(r"""</?[a-zA-Z](?:[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>|[^>]*>)""")
    cited = q(r"""(?i)^<blockquote\b[^>]*\stype\s*=\s*["']?cite\b""")

    def among(x, names):
        return f"coalesce({x} in ({', '.join(q(n) for n in names)}), false)"

    def popped(s):
        return "case when " + " or ".join(f"({among('name', a)} and {among(s + '[1]', b)})" for a, b in P.CLOSED_BY) + f" then {s}[2:] else {s} end"

    steps = [
        ("tags0", f"select {key}, string_split_regex({column}, {tag}) as texts, regexp_extract_all({column}, {tag}) as tags from {src}"),
        ("tags1", f"select {key}, generate_subscripts(tags, 1) as i, unnest(tags) as tag, unnest(texts[2:]) as after from tags0"),
        (
            "tags",
            f"select *, starts_with(tag, '</') as closes, ends_with(tag, '/>') as ends, {among('name', P.SKIPPED_ELEMENTS)} or regexp_matches(tag, {cited}) as skipped"
            r" from (select *, lower(regexp_extract(tag, '^</?([a-zA-Z][^\s/>]*)', 1)) as name from tags1)",
        ),
    ]
    turn = f"""
      select {key}, i, tag, after, name, closes, ends, skipped, base, raw, stack, list_position(stack, name) as place, {popped('stack')} as s1,
        raw <> '' and not (closes and name = raw) as in_text
      from (select t.*, w.stack, w.base, w.raw from walk w join tags t on t.{key} = w.{key} and t.i = w.i + 1)"""
    turn = f"select *, {popped('s1')} as s2 from ({turn})"
    turn = f"select *, {popped('s2')} as s3 from ({turn})"
    turn = f"""select *, case when in_text then stack when closes and place > 0 then stack[place + 1:] when closes then stack else s3 end as rest,
        not in_text and not closes and not {among('name', P.VOID_ELEMENTS)} as opens,
        ends and (list_has_any(stack, ['svg', 'math']) or name in ('svg', 'math')) as alone from ({turn})"""
    turn = f"""select *, base >= 0 and len(rest) <= base as ended, opens and not alone as stays,
        opens and alone and skipped as single from ({turn})"""
    turn = f"""select *, ended and closes and len(rest) = base as own, ended or base < 0 as outside from ({turn})"""
    turn = f"""select {key}, i, case when stays then list_prepend(name, rest) else rest end as stack,
        case when stays and skipped and outside then len(rest) when outside then -1 else base end as base,
        case when stays and name in ('script', 'style') then name when in_text then raw else '' end as raw,
        case when own then case when name = 'blockquote' then chr(10) else '' end
          when not outside or (stays and skipped) or (single and outside) then '' else tag end
        || case when not outside or (stays and skipped and outside) then '' else after end as shown from ({turn})"""
    return [
        *steps,
        ("walk", f"select {key}, 0::bigint as i, []::varchar[] as stack, -1::bigint as base, '' as raw, texts[1] as shown from tags0 union all {turn}"),
        ("seen", f"select {key}, string_agg(shown, '' order by i) as {column} from walk group by {key}"),
    ]


def html_ctes(src, column, out="html_text", keep="*", hidden=None):
    """``hidden`` names the key of mails whose hidden elements may be in any disorder."""
    # The markup that goes first, hidden elements, and the clean-up of the plain text, each in this order.
    noise = [
        (r"(?is)<o:p>\s*</o:p>", ""),
        (r"(?is)<v:.*?>\s*</v:.*?>", ""),
        (r"(?is)<!--\[if.*?endif\]-->", ""),
        (r"(?is)<style[^>]*>.*?</style>", ""),
        (r"(?is)<script[^>]*>.*?</script>", ""),
        (r"""(?is)<img[^>]*width=["']?1["']?[^>]*height=["']?1["']?[^>]*>""", ""),
        (r"""(?is)<img[^>]*height=["']?1["']?[^>]*width=["']?1["']?[^>]*>""", ""),
    ]
    early = [("(?i)" + name, char) for name, char in P.EARLY_ENTITIES]
    skipped = [(r"(?s)<!--.*?-->", "")]
    skipped += [(rf"(?is)<{e}\b[^>]*>.*?</{e}\s*>", "") for e in P.SKIPPED_ELEMENTS]
    skipped += [(r"""(?is)<blockquote\b[^>]*\stype\s*=\s*["']?cite\b[^>]*>.*?</blockquote[^>]*>""", "\n")]
    rest = r"""\b(?:[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>|[^>]*>)"""
    line, gap, br = "\ufdd0", "\ufdd1", "\ufdd2"
    layout = [
        ("(?i)<br" + rest, br),
        ("(?i)<li" + rest, line + "* "),
        (r"(?i)</t[dh]\s*>", " "),
        (rf"(?i)</?(?:{'|'.join(P.LINE_ELEMENTS)})" + rest, line),
        (rf"(?i)</?(?:{'|'.join(P.PARAGRAPH_ELEMENTS)})" + rest, gap),
        (r"(?i)</?(?:[a-z]" + rest[2:] + "|[!?][^>]*>)", ""),
        (rf"\s{{0,40}}{br}\s*", br),
        (rf"{line}[\s{line}]*{gap}", gap),
        (rf"\s{{0,40}}{gap}[\s{line}{gap}]*", "\n\n"),
        (rf"\s{{0,40}}{line}[\s{line}]*", "\n"),
        (br, "\n"),
    ]
    polish = [
        (r"[\x{200B}-\x{200D}\x{FEFF}]", ""),
        (r"[ \t]+", " "),
        (r"\n\s*\n\s*\n+", "\n\n"),
        (r"\.{3,}", "."),
        (r"!{3,}", "!"),
        (r"\?{3,}", "?"),
        (r"(?im)^\s*[\[(]?cid:.*?[\])]?\s*$", ""),
        (r"(?i)\[image:.*?\]", ""),
        (r"(?i)\[Image removed by sender\]", ""),
        (r"(?i)\[cid:.*?\]", ""),
    ]
    names = f"map([{', '.join(q(n) for n in NAMES)}], [{', '.join(q(c) for c in NAMES.values())}])"
    e = "e"
    windows = {n: c for n in range(128, 160) if (c := bytes([n]).decode("cp1252", "ignore"))}
    shown = f"map([{', '.join(map(str, windows))}], [{', '.join(q(c) for c in windows.values())}])"
    point = (
        f"case when lower({e}) like '&#x%' then cast('0x' || substr({e}, 4, length({e}) - 4) as integer)"
        f" else cast(substr({e}, 3, length({e}) - 3) as integer) end"
    )
    char = f"case when {e} like '&#%' then coalesce({shown}[{point}], chr({point})) else coalesce({names}[substr({e}, 2, length({e}) - 2)], {e}) end"
    start = [("h1", f"select {keep}, {subs(subs(subs(subs(normal(column), noise), early), skipped), layout)} as _t from {src}")]
    if hidden:
        start = [
            ("h0", f"select {hidden}, {subs(subs(subs(normal(column), noise), early), skipped[:1])} as _m from {src}"),
            *hidden_ctes("h0", "_m", hidden),
            ("h1", f"select {hidden}, {subs('_m', layout)} as _t from seen"),
        ]
    return [
        *start,
        ("h2", f"select *, string_split_regex(_t, {q(ENTITY)}) as _p, list_transform(regexp_extract_all(_t, {q(ENTITY)}), lambda e: {char}) as _e from h1"),
        ("h3", "select * exclude (_p, _e, _t), " + line_ends("array_to_string(list_transform(range(1, len(_p) + 1), lambda i: _p[i] || coalesce(_e[i], '')), '')") + " as _t from h2"),
        ("h4", f"select * exclude (_t), {subs('_t', polish)} as _t from h3"),
        ("html", f"select * exclude (_t), {trim(f'array_to_string(list_transform(string_split(_t, {NL}), lambda x: {trim("x")}), {NL})')} as {out} from h4"),
    ]


# ---- cleaning --------------------------------------------------------------------------------


def thread_expr(x):
    cuts = []
    for _, _, regex in P.THREAD_MARKERS:
        pos = f"length({before(x, regex)})"
        cuts.append(f"case when {pos} > 50 then {pos} end")
    cut = f"substr({x}, 1, list_min([length({x}), {', '.join(cuts)}]))"
    return trim(sub(trim(cut), r"(?m)\n>+\s*$", ""))


def quotes_expr(x):
    lines = f"list_transform(string_split({x}, {NL}), lambda l: regexp_replace(l, '^>+\\s*', ''))"
    return f"array_to_string({lines}, {NL})"


def disclaimer_expr(x):
    for _, _, regex in P.DISCLAIMERS:
        x = first_only(x, regex)
    return x


def line_table(name, src, column):
    """doc_id, i, line (trimmed, never blank), raw, n = number of lines."""
    return (
        name,
        f"select doc_id, row_number() over (partition by doc_id order by j) as i, {trim('raw')} as line, raw, count(*) over (partition by doc_id) as n"
        f" from (select doc_id, generate_subscripts(ls, 1) as j, unnest(ls) as raw from"
        f" (select doc_id, string_split({column}, {NL}) as ls from {src}))"
        f" where {trim('raw')} <> ''",
    )


def joined(line="line", order="i"):
    return f"string_agg({line}, {NL} order by {order})"


def clean_ctes():
    """emails -> html -> ... -> clean, with one column per stage."""
    low = "lower(line)"
    odd = (
        f"(contains({low}, 'confidential') and length(line) < 100) or (contains({low}, 'disclaimer') and length(line) < 100)"
        f" or (contains({low}, 'virus') and contains({low}, 'scan'))"
    )
    weak = " + ".join(f"cast({matches('line', regex)} as integer)" for _, regex in P.SIGNATURE_WEAK)
    strong = " or ".join(matches("line", f"(?i){regex}") for _, regex in P.SIGNATURE_STRONG)
    greet = " or ".join(matches("line", f"(?i){regex}") for _, regex in P.GREETINGS)
    close = " or ".join(matches("line", f"(?i){regex}") for _, regex in P.CLOSINGS)
    return [
        mails(),
        *html_ctes("emails", "body_html"),
        ("threads", f"select *, {thread_expr('html_text')} as thread_text from html"),
        ("quotes", f"select *, {quotes_expr('thread_text')} as quote_text from threads"),
        ("notices", f"select *, {disclaimer_expr('quote_text')} as notice_text from quotes"),
        line_table("nl", "notices", "notice_text"),
        ("nlcut", f"select doc_id, min(i) filter (i > n - 3 and ({odd})) as cut from nl group by doc_id"),
        ("ntext", f"select doc_id, {joined()} as tail from nl join nlcut using (doc_id) where cut is null or i < cut group by doc_id"),
        ("tails", "select notices.*, coalesce(tail, '') as tail_text from notices left join ntext using (doc_id)"),
        line_table("sl", "tails", "tail_text"),
        (
            "scored",
            f"select *, i > (3 * n) // 5 as scanned, regexp_matches(line, '^(--|——+)$') as delim, {weak} as score, ({strong}) as strong from sl",
        ),
        (
            "running",
            "select *, sum(case when scanned then score else 0 end) over (partition by doc_id order by i) as total from scored",
        ),
        (
            "marks",
            "select doc_id, min(i) filter (delim) as d, min(i) filter (scanned and strong) as s,"
            " min(i) filter (scanned and score > 0) as f, min(i) filter (scanned and total >= 3) as b from running group by doc_id",
        ),
        (
            "before_weak",
            f"select doc_id, {joined()} as head from sl join marks using (doc_id) where i < f group by doc_id",
        ),
        (
            "cuts",
            "select tails.doc_id, case when length(tail_text) < 100 then null when d - 1 > 5 then d"
            " when s is not null and (b is null or s <= b) then s"
            " when b is not null and length(coalesce(head, '')) >= 50 then f end as cut"
            " from tails left join marks using (doc_id) left join before_weak using (doc_id)",
        ),
        ("stext", f"select doc_id, {joined()} as kept from sl join cuts using (doc_id) where cut is null or i < cut group by doc_id"),
        ("signed", "select tails.*, coalesce(kept, '') as signature_text from tails left join stext using (doc_id)"),
        ("full_text", "select *, case when length(signature_text) > 10000 then substr(signature_text, 1, 10000) || '...' else signature_text end as whole from signed"),
        line_table("gl", "full_text", "whole"),
        (
            "bounds",
            f"select doc_id, n, min(i) filter (i <= 3 and ({greet})) as g, max(i) filter (i > n - 5 and ({close})) as c from gl group by doc_id, n",
        ),
        (
            "ranges",
            "select doc_id, case when coalesce(c, n + 1) - 1 - coalesce(g, 0) < 2 then 0 else coalesce(g, 0) end as p, coalesce(c, n + 1) as c from bounds",
        ),
        (
            "parts",
            f"select doc_id, {joined('raw')} filter (i <= p) as pre, {trim(joined('raw') + ' filter (i > p and i < c)')} as mid, {joined('raw')} filter (i >= c) as post"
            " from gl join ranges using (doc_id) group by doc_id",
        ),
        (
            "clean0",
            "select full_text.*, length(html_text) < 10 as short, coalesce(pre, '') as pre, coalesce(mid, whole) as mid, coalesce(post, '') as post,"
            " coalesce(length(body_html), 0) as original_length from full_text left join parts using (doc_id)",
        ),
        (
            "clean1",
            "select *, case when short then '' else pre end as pretext, case when short then '' else mid end as core,"
            " case when short then '' else post end as posttext, case when short then html_text else whole end as clean_text,"
            " case when short then 0 else length(whole) end as cleaned_length from clean0",
        ),
        (
            "clean",
            "select *, substr(core, 1, 150) || case when length(core) > 150 then '...' else '' end as preview,"
            " case when short then '100.00%' when original_length = 0 then '0%' else"
            " case when cleaned_length > original_length then '-' else '' end"
            " || cast(((20000 * abs(original_length - cleaned_length) + original_length) // (2 * original_length)) // 100 as varchar) || '.'"
            " || lpad(cast(((20000 * abs(original_length - cleaned_length) + original_length) // (2 * original_length)) % 100 as varchar), 2, '0') || '%' end as compression_ratio,"
            " case when short then 'Content too short or empty after HTML cleaning' end as warning from clean1",
        ),
    ]
