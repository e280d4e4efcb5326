"""Fixed values that define the cleaning results: patterns, word lists and entity names.

Each text pattern is ``(name, literal, regex)``. ``literal`` is a lower-case string that every
match of the regex contains (in lower case); a cheap substring test on it spares the regex on
most mails. It never decides a result on its own.
"""

from html.entities import name2codepoint

# Reply-thread markers. Flags i and m.
THREAD_MARKERS = [
    ("rule_line", "__________", r"^_{10,}\s*$"),
    ("original_message", "original message", r"^-{10,}\s*Original Message\s*-{10,}"),
    ("from_sent_to", "sent:", r"^From:\s+[^\n]+\nSent:\s+[^\n]+\nTo:\s+[^\n]+"),
    ("from_date_subject", "subject:", r"^From:\s+[^\n]+\nDate:\s+[^\n]+\nSubject:\s+[^\n]+"),
    ("on_numeric_date", "wrote:", r"^On\s+\d{1,2}/\d{1,2}/\d{2,4}.+wrote:\s*$"),
    ("on_weekday", "wrote:", r"^On\s+[A-Z][a-z]{2},\s+[A-Z][a-z]{2}\s+\d{1,2},.+wrote:\s*$"),
    ("on_anything", "wrote:", r"^On\s+.{10,100}wrote:\s*$"),
    ("sent_from_phone", "sent from my ", r"^Sent from my (iPhone|iPad|Android|Mobile)"),
    ("get_outlook", "get outlook for ", r"^Get Outlook for (iOS|Android)"),
    ("nested_quote", ">>", r"^>{2,}"),
    ("forwarded", "forwarded message", r"^-{3,}\s*Forwarded message\s*-{3,}"),
    ("begin_forwarded", "begin forwarded message:", r"^Begin forwarded message:"),
]
THREAD_MIN_POSITION = 50

# Disclaimers, each removed once, in this order. Flags i and m. (The rule lines ask
# for exactly five characters, as the rest of the run is covered by what follows: a pattern that
# takes the whole run needs quadratic time on a long one.)
DISCLAIMERS = [
    ("dash_block", "-----", r"^-{5}.*?(confidential|disclaimer|notice)[\s\S]{0,800}?$"),
    ("equals_block", "=====", r"^={5}.*?(confidential|disclaimer|notice)[\s\S]{0,800}?$"),
    ("star_block", "*****", r"^\*{5}.*?(confidential|disclaimer|notice)[\s\S]{0,800}?$"),
    (
        "confidential_mail",
        "confidential",
        r"^This (email|e-mail|message)(\s+and any attachments?)?\s+(is|are)\s+confidential[\s\S]{0,500}?$",
    ),
    ("confidentiality_notice", "confidentiality notice", r"^CONFIDENTIALITY NOTICE[\s\S]{0,500}?$"),
    ("disclaimer_label", "disclaimer:", r"^DISCLAIMER:[\s\S]{0,500}?$"),
    (
        "if_you",
        "if you ",
        r"^If you (have |are not the intended recipient|received this (email|message) in error)[\s\S]{0,300}?$",
    ),
    ("virus_scanned", "this email has been ", r"\n\s*This email has been (scanned|checked)[\s\S]*\z"),
    ("scanned_by", "scanned ", r"\n\s*Scanned (by|for) (virus(es)?|malware)[\s\S]*\z"),
]
TAIL_LINES = 3
TAIL_SHORT_LINE = 100

# Signature lines, tested on one trimmed line. Flag i unless noted.
SIGNATURE_STRONG = [
    ("sent_from_device", r"^Sent from my (iPhone|iPad|Android|BlackBerry|Windows Phone)"),
    ("outlook_mobile", r"^Get Outlook for (iOS|Android)"),
    ("windows_mail", r"^Sent from Mail for Windows"),
]
SIGNATURE_WEAK = [
    ("regards_wishes", r"(?i)^(Best|Kind|Warm|With)\s+(regards|wishes)"),
    ("thanks", r"(?i)^Thanks?,?\z"),
    ("thank_you", r"(?i)^Thank you,?\z"),
    ("regards", r"(?i)^Regards,?\z"),
    ("cheers", r"(?i)^Cheers,?\z"),
    ("sincerely", r"(?i)^Sincerely,?\z"),
    ("phone", r"^\+?\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}\z"),
    ("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"),
    ("url", r"(?i)^https?://"),
    (
        "title",
        r"(?i)^(CEO|CTO|CFO|COO|Director|Manager|Engineer|Developer|Specialist|Analyst|Consultant)",
    ),
]
SIGNATURE_DELIMITER = r"^(--|—{2,})\z"
SIGNATURE_DELIMITER_MIN_LINE = 5
SIGNATURE_SCORE = 3

# Greetings and closings, tested on one trimmed line. Flag i.
GREETINGS = [
    ("salutation", r"^(Hi|Hello|Hey|Dear)\s+[A-Z]"),
    ("good_day", r"^Good\s+(morning|afternoon|evening)"),
    ("to_whom", r"^To whom it may concern"),
]
CLOSINGS = [
    (
        "sign_off",
        r"^(Thanks?|Thank you|Regards|Best regards|Kind regards|Best|Sincerely|Cheers|Cordially)",
    ),
    ("looking_forward", r"^(Looking forward|Talk soon|Speak soon)"),
]
GREETING_LINES = 3
CLOSING_LINES = 5

# Text that is replaced before the markup is read, in this order.
EARLY_ENTITIES = [
    ("&nbsp;", " "),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
    ("&bull;", "•"),
    ("&trade;", "™"),
    ("&copy;", "©"),
    ("&reg;", "®"),
]

# Elements whose content is dropped.
SKIPPED_ELEMENTS = ["style", "script", "head", "nav", "iframe", "noscript", "svg", "canvas"]

# Elements without an end tag, with plain text inside, with self-closing tags inside, and
# (opening tags, elements whose end they imply).
VOID_ELEMENTS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
]
RAW_ELEMENTS = ["script", "style"]
FOREIGN_ELEMENTS = ["svg", "math"]
CLOSED_BY = [
    (["body"], ["head"]),
    (["li"], ["li"]),
    (["dd", "dt"], ["dd", "dt"]),
    (["td", "th"], ["td", "th"]),
    (["tr"], ["td", "th", "tr"]),
    (["tbody", "tfoot", "thead"], ["td", "th", "tr", "tbody", "thead"]),
    (["option", "optgroup"], ["option"]),
    (
        [
            "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure",
            "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre",
            "section", "table", "ul",
        ],
        ["p"],
    ),
]

# Elements that start and end on a line of their own, and those set apart by an empty line.
LINE_ELEMENTS = [
    "article", "aside", "body", "center", "dd", "details", "dialog", "div", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "header", "html", "li", "main", "section", "tbody",
    "tfoot", "thead", "tr",
]
PARAGRAPH_ELEMENTS = [
    "address", "blockquote", "dl", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "ol", "p", "pre",
    "table", "title", "ul",
]

# The named references of HTML 4, from the standard library.
NAMED_ENTITIES = {name: chr(point) for name, point in sorted(name2codepoint.items())} | {"apos": "'"}

# White space as JavaScript's trim() sees it.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Domains of the analysis fields.
CATEGORIES = [
    "billing", "technical_support", "account_management", "product_inquiry", "complaint",
    "feedback", "other",
]
PRIORITIES = ["low", "medium", "high", "urgent"]
SENTIMENTS = ["positive", "neutral", "negative", "frustrated"]
ACTIONS = [
    "Create new ticket", "Update existing ticket", "Send acknowledgment email",
    "Escalate to agent", "Auto-respond with solution", "Request missing info",
]
