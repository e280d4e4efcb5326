"""Golden rows and brute force for the text steps."""

import random
import re

import pytest

from mailtables.config import CleanerConfig
from mailtables.functions import patterns as P
from mailtables.functions.html import html_to_text, strip_html
from mailtables.operators import cleaning as C

LONG = "This opening line is long enough to be kept by every rule."


def thread(df):
    return C.cut_thread(df, "t", "o")


def test_thread_first_match_counts(one):
    early = "Hi\n>> early\n" + LONG + "\n" + LONG + "\n>> late\nrest"
    late = LONG + "\n>> late\nrest"
    assert one([early, late, "", LONG], thread, "o") == [early, LONG, "", LONG]


def test_thread_drops_bare_quote_lines(one):
    assert one([LONG + "\n>\nnext\n>>"], thread, "o") == [LONG + "\nnext"]


@pytest.mark.parametrize(
    "marker",
    [
        "__________", "----------Original Message----------", "From: a\nSent: b\nTo: c", "From: a\nDate: b\nSubject: c",
        "On 1/2/24, x wrote:", "On Mon, Jan 5, 2024 John wrote:", "On a day like this one Ann wrote:",
        "sent from my iphone", "Get Outlook for iOS", ">>", "--- Forwarded message ---", "Begin forwarded message:",
    ],
)
def test_thread_markers(one, marker):
    assert one([f"{LONG}\n{marker}\nold"], thread, "o") == [LONG]


def test_thread_against_a_loop(one):
    rng = random.Random(7)
    pieces = ["word ", "\n", ">> q", ">", "__________", "On Mon, Jan 5, 2024 Jo wrote:", "Sent from my iPad", "long text " * 4, "\nFrom: a\nSent: b\nTo: c", "é😀"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", "\n"]) for _ in range(rng.randint(1, 14))) for _ in range(300)]

    def loop(text):
        cut = len(text)
        for _, _, regex in P.THREAD_MARKERS:
            found = re.search(regex, text, re.I | re.M)
            if found and 50 < found.start() < cut:
                cut = found.start()
        return re.sub(r"\n>+\s*$", "", text[:cut].strip(), flags=re.M).strip()

    assert one(texts, thread, "o") == [loop(t) for t in texts]


def test_quotes(one):
    texts = ["> hi\n>>  x\n > kept", "> > twice", "a > b"]
    assert one(texts, lambda d: C.strip_quotes(d, "t", "o"), "o") == ["hi\nx\n > kept", "> twice", "a > b"]


def test_disclaimers_remove_the_first_line_only(one):
    text = "a\nIf you have time\nb\nIf you have more\nc"
    assert one([text], lambda d: C.strip_disclaimers(d, "t", "o"), "o") == ["a\n\nb\nIf you have more\nc"]


def test_disclaimers_against_a_loop(one):
    rng = random.Random(3)
    pieces = [
        "body text", "-----x notice y", "===== disclaimer", "***** confidential", "This email and any attachments are confidential now",
        "CONFIDENTIALITY NOTICE x", "DISCLAIMER: y", "If you received this email in error", "  This email has been scanned by us", "Scanned for viruses",
        "confidential", "virus scan", "x" * 900, "",
    ]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(300)]

    def loop(text):
        for name, _, regex in P.DISCLAIMERS:
            text = re.sub(regex.replace(r"\z", r"\Z"), "", text, count=1, flags=re.I | re.M)
        lines = [line.strip() for line in text.split("\n") if line.strip()]
        for i in range(max(0, len(lines) - 3), len(lines)):
            low = lines[i].lower()
            if (("confidential" in low or "disclaimer" in low) and len(low) < 100) or ("virus" in low and "scan" in low):
                return "\n".join(lines[:i])
        return "\n".join(lines)

    def both(df):
        return C.trim_disclaimer_tail(C.strip_disclaimers(df, "t", "a"), "a", "o")

    assert one(texts, both, "o") == [loop(t) for t in texts]


def test_short_mail_can_become_empty(one):
    text = "confidential\nsecond\nthird"
    assert one([text], lambda d: C.trim_disclaimer_tail(d, "t", "o"), "o") == [""]


def signature(df):
    return C.cut_signature(df, "t", "o")


def signature_loop(text, least=50):
    lines = text.split("\n")
    if len(text) < 2 * least:
        return text
    delimiter = next((i for i, x in enumerate(lines) if re.fullmatch(r"--|—{2,}", x.strip())), -1)
    if delimiter > 5:
        return "\n".join(lines[:delimiter]).strip()
    start, total = None, 0
    for i in range(len(lines) * 3 // 5, len(lines)):
        line = lines[i].strip()
        if any(re.search(r, line, re.I) for _, r in P.SIGNATURE_STRONG):
            return "\n".join(lines[:i]).strip()
        hits = sum(bool(re.search(r.replace(r"\z", r"\Z"), line)) for _, r in P.SIGNATURE_WEAK)
        if hits:
            total += hits
            start = i if start is None else start
        if total >= 3:
            break
    head = "\n".join(lines[:start])
    return head.strip() if total >= 3 and len(head) >= least else text


def test_signature_against_a_loop(one):
    rng = random.Random(5)
    pieces = [
        "plain words in a line of text", "short", "Best regards", "Thanks", "Director of x", "a@b.example", "+1 555 123 4567", "https://x.example",
        "Sent from my iPad", "--", "———", "  Regards,  ", "", "2024-01-05",
    ]
    texts = ["\n".join(rng.choice(pieces) if rng.random() < 0.6 else pieces[0] for _ in range(rng.randint(1, 16))) for _ in range(500)]
    expected = [signature_loop(t) for t in texts]
    assert one(texts, signature, "o") == expected
    assert 50 < sum(a != b for a, b in zip(texts, expected)) < 450


def test_two_weak_signs_are_not_enough(one):
    body = "\n".join([LONG] * 6)
    texts = [body + "\nThanks\na@b.example", body + "\nThanks\na@b.example\nhttps://x.example"]
    assert one(texts, signature, "o") == [texts[0], body]


def test_segments(one):
    texts = ["Hi Bob\nline one\nline two\nThanks\nme", "Hi Bob\nonly\nThanks", "Bestseller list\nThanks all\nbye", "a\n\n  b  "]
    got = [one(texts, lambda d: C.segment_mail(d, "t"), c) for c in ("pretext", "core", "posttext")]
    assert list(zip(*got)) == [
        ("Hi Bob", "line one\nline two", "Thanks\nme"),
        ("", "Hi Bob\nonly", "Thanks"),
        ("", "Bestseller list", "Thanks all\nbye"),
        ("", "a\n  b", ""),
    ]


def clean(df):
    return C.clean_emails(df, "t")


def test_short_guard_and_empty(one):
    texts = [None, "", "hi", "<p>hello</p>"]
    assert one(texts, clean, "clean_text") == ["", "", "hi", "hello"]
    assert one(texts, clean, "core") == ["", "", "", ""]
    assert one(texts, clean, "compression_ratio") == ["100.00%"] * 4
    assert one(texts, clean, "warning") == [C.SHORT_WARNING] * 4


def test_truncation_counts_characters(one):
    text = "😀" + "x" * 10_000
    cut = one([text], lambda d: C.truncate_text(d, "t", "o"), "o")[0]
    assert len(cut) == 10_003 and cut.startswith("😀x") and cut.endswith("x...")


def test_ratio(one, spark):
    rows = spark.createDataFrame([(1, 100, 50), (2, 3, 1), (3, 100, 130), (4, 0, 0), (5, 8, 7)], "i int, o long, c long")
    got = [r[0] for r in rows.select("i", C.compression_ratio("o", "c").alias("r")).orderBy("i").select("r").collect()]
    assert got == ["50.00%", "66.67%", "-30.00%", "0%", "12.50%"]


def test_line_ends_and_blanks(one):
    texts = ["Hello there Bob\r\n\r\nline two\rline three", "zero​width﻿ text here"]
    assert one(texts, clean, "clean_text") == ["Hello there Bob\nline two\nline three", "zerowidth text here"]


def html(df):
    return html_to_text(df, "t", "o")


@pytest.mark.parametrize("shape", [
    "<div>{}</div><div>From: a</div>\r\n<div>Sent: b</div><div>To: c</div><div>old</div>",
    "<div>{}<br>From: a<br>\r\nSent: b<br/>To: c<br>old</div>",
    "<table><tr><td>{}</td></tr><tr><td>From: a</td></tr> <tr><td>Sent: b</td></tr><tr><td>To: c</td></tr></table>",
    "<p>{}</p><p class='x>y'>From: a<br>Sent: b<br>To: c<br>Subject: d</p><p>old</p>",
])
def test_reply_chains_of_html_mails_are_cut(one, shape):
    words = "The invoice that you sent us last week names the wrong account."
    assert one([shape.format(words)], clean, "clean_text") == [words]


def test_composed_mails_mix_every_shape_with_every_furniture():
    """HTML shapes meet every header, signature and disclaimer in the smallest table."""
    ids = range(200)
    for shape in (3, 5):
        mine = [i for i in ids if i % 8 == shape]
        for of, n in ((lambda i: i // 8 % 6, 6), (lambda i: i % 11, 11), (lambda i: i % 13, 13)):
            assert {of(i) for i in mine} == set(range(n))


def test_html(one):
    cases = {
        "<p>a</p><p>b</p>": "a\n\nb",
        "x<br>y<br/>z": "x\ny\nz",
        "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>": "a b\nc",
        "<div>a</div>\n <div>b</div><div><br></div><div>c</div>": "a\nb\n\nc",
        "<div>x<p>a</p><p>b</p></div>y": "x\n\na\n\nb\n\ny",
        "<b title=\"x>y\">bold</b> <br class='a>b'>next": "bold\nnext",
        "a&#133;b&#146;c&#x85;": "a\u2026b\u2019c\u2026",
        "a\u0085b\u2028c": "a\nb\nc",
        "<ul><li>one</li><li>two</li></ul>": "* one\n* two",
        "<a href='http://x'>text</a>": "text",
        "&amp;lt;b&amp;gt;": "<b>",
        "&lt;b&gt;bold&lt;/b&gt;": "bold",
        "&#8212; &#x41; &eacute; &unknown; &#38;#65;": "— A é &unknown; &#65;",
        "<style>p{}</style><script>1<2</script><head><title>t</title></head>body": "body",
        "5 < 6 and 7 > 3": "5 < 6 and 7 > 3",
        "wow!!!! really???? yes... ok.. no!!": "wow! really? yes. ok.. no!!",
        "a\n[cid:x]\ncid:y\n[image: z]b": "a\n\n\nb",
        "<blockquote type='cite'>a<blockquote>b</blockquote>c</blockquote>d": "d",
        "<blockquote>kept</blockquote>": "kept",
        "<blockquote><blockquote type=cite>x</blockquote>y</blockquote>": "y",
        "<img width=1 height=1>t<nav>menu</nav>": "t",
    }
    assert dict(zip(cases, one(list(cases), html, "o"))) == cases


@pytest.mark.parametrize(
    "markup, text",
    [
        ('<div>new <blockquote type="cite">old</div><p>still mine</p>', "new\n\nstill mine"),
        ("<nav>one<nav>two</nav>three</nav>ok", "ok"),
        ("<html><head><title>t</title><body>mine</body>", "mine"),
        ("kept<canvas>gone <b>to the end", "kept"),
        ("<ul><li>a<iframe>x</li><li>b</ul>", "* a\n* b"),
        ("<div><noscript>m<div>d</noscript>kept</div>t", "kept\nt"),
        ("a<svg><path/></svg>b<svg/>c", "abc"),
        ('<nav title="</nav>">x</nav>y', "y"),
        ("a</nav></blockquote>b", "a\n\nb"),
        ("<blockquote type=cite>a<blockquote>b</blockquote>c</blockquote>d", "d"),
        ("<blockquote>mine</blockquote>", "mine"),
        ("x<script>if (a < b) { '</nav>' }", "x"),
        ("<nav>" * 300 + "deep" + "</nav>" * 299 + "gone</nav>ok", "ok"),
    ],
)
def test_hidden_elements_end_as_a_browser_ends_them(one, markup, text):
    assert one([markup], html, "o") == [text]


def test_html_options(one):
    keep = CleanerConfig(preserve_links=True)
    texts = ["see <a href='http://x/'>this</a>", "<a href='http://x/'>http://x/</a>"]
    assert one(texts, lambda d: html_to_text(d, "t", "o", keep), "o") == ["see this [http://x/]", "http://x/"]
    strip = CleanerConfig(strip_only=True)
    assert one(["<p>a</p>&nbsp;<b>b</b>\n c"], lambda d: html_to_text(d, "t", "o", strip), "o") == ["a b c"]


def test_strip_html_is_null_safe(one):
    assert one([None], lambda d: d.withColumn("o", strip_html(d["t"])), "o") == [""]


def test_options_reach_the_steps(one):
    text = "> " + LONG + "\n> second line"
    kept = one([text], lambda d: C.clean_emails(d, "t", CleanerConfig(remove_quotes=False, max_length=20)), "clean_text")
    assert kept == ["> " + LONG[:18] + "..."]


def test_golden_mail(one):
    body = (
        "<p>Hello Team,</p><p>I cannot open my account. Could you help me with the reset?</p><p>My number is 42.</p>"
        "<p>Best regards,<br>Ann</p><p>--</p><p>Ann Smith</p><p>This email is confidential.</p>"
    )
    assert one([body], clean, "pretext") == ["Hello Team,"]
    assert one([body], clean, "core") == ["I cannot open my account. Could you help me with the reset?\nMy number is 42."]
    assert one([body], clean, "posttext") == ["Best regards,\nAnn\n--\nAnn Smith"]
