"""HTML to text as a chain of native column expressions."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CleanerConfig
from .patterns import EARLY_ENTITIES, LINE_ELEMENTS, NAMED_ENTITIES, PARAGRAPH_ELEMENTS
from .skipped import TAG_REST, drop_skipped
from .stages import pin
from .text import join_lines, normalise, plain_breaks, split_lines, trim_ws

ENTITY = r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"

# Office markup, conditional comments, style and script blocks, one-pixel images. Like every list of steps here:
# literals one of which each match of the regex contains, the regex and what it becomes.
NOISE = [
    (["<o:", "<O:"], r"(?is)<o:p>\s*</o:p>", ""),
    (["<v:", "<V:"], r"(?is)<v:.*?>\s*</v:.*?>", ""),
    (["<!--["], r"(?is)<!--\[if.*?endif\]-->", ""),
    (["<s", "<S"], r"(?is)<style[^>]*>.*?</style>", ""),
    (["<s", "<S"], r"(?is)<script[^>]*>.*?</script>", ""),
    (["<i", "<I"], r"(?is)<img[^>]*width=[\"']?1[\"']?[^>]*height=[\"']?1[\"']?[^>]*>", ""),
    (["<i", "<I"], r"(?is)<img[^>]*height=[\"']?1[\"']?[^>]*width=[\"']?1[\"']?[^>]*>", ""),
]
ENTITIES = [([name[:2], name[:2].upper()], f"(?i){name}", char) for name, char in EARLY_ENTITIES]

COMMENT = (["<!--"], r"(?s)<!--.*?-->", "")

LINK_START = r"(?is)<a\b[^>]*?\shref\s*=\s*[\"']([^\"']*)[\"'][^>]*>"
LINKS = [
    # The text is the address itself.
    (LINK_START + r"\s*\1\s*</a\s*>", "$1"),
    (LINK_START + r"(.*?)</a\s*>", "$2 [$1]"),
]

LINE_BREAK = ["<b", "<B"], r"(?i)<br" + TAG_REST
LIST_ITEM = ["<l", "<L"], r"(?i)<li" + TAG_REST
CELL_END = ["</t", "</T"], r"(?i)</t[dh]\s*>"
LINE_EDGE = ["<"], rf"(?i)</?(?:{'|'.join(LINE_ELEMENTS)})" + TAG_REST
PARAGRAPH_EDGE = ["<"], rf"(?i)</?(?:{'|'.join(PARAGRAPH_ELEMENTS)})" + TAG_REST
TABLE_PART = ["<"], r"(?i)</?(?:tr|tbody|thead|tfoot)" + TAG_REST
ANY_TAG = ["<"], r"(?i)</?(?:[a-z]" + TAG_REST.removeprefix(r"\b") + r"|[!?][^>]*>)"
# Marks that no text holds (noncharacters), for edges of lines and paragraphs and for explicit breaks.
EDGE, GAP, BREAK = "\ufdd0", "\ufdd1", "\ufdd2"
# Edges that touch give one line end, or one empty line where a paragraph is among them; blanks between
# tags mean nothing. The bound in front keeps long runs of blanks cheap.
MARKS_TO_BREAKS = [
    ([BREAK], rf"\s{{0,40}}{BREAK}\s*", BREAK),
    ([GAP], rf"{EDGE}[\s{EDGE}]*{GAP}", GAP),
    ([GAP], rf"\s{{0,40}}{GAP}[\s{EDGE}{GAP}]*", "\n\n"),
    ([EDGE], rf"\s{{0,40}}{EDGE}[\s{EDGE}]*", "\n"),
    ([BREAK], BREAK, "\n"),
]

# Clean-up of the plain text, in this order: regexes behind literals one of which every match
# of them contains.
POLISH = [
    (["\u200b", "\u200c", "\u200d", "\ufeff"], [(r"[\x{200B}-\x{200D}\x{FEFF}]", "")]),
    (["  ", "\t"], [(r"[ \t]{2,}|\t", " ")]),
    (["\n\n", "\n ", "\n\t", "\n\x0b", "\n\f", "\n\r"], [(r"\n\s*\n\s*\n+", "\n\n")]),
    (["...", "!!!", "???"], [(r"([.!?])\1{2,}", "$1")]),
    ([f"{c}{i}{d}:" for c in "cC" for i in "iI" for d in "dD"], [(r"(?im)^\s*[\[(]?cid:.*?[\])]?\s*$", "")]),
    (
        ["]"],
        [(r"(?i)\[image:.*?\]", ""), (r"(?i)\[Image removed by sender\]", ""), (r"(?i)\[cid:.*?\]", "")],
    ),
]


def replace_all(col, pairs) -> Column:
    for regex, replacement in pairs:
        col = F.regexp_replace(col, regex, replacement)
    return col


def holds(col, literals) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(x) for x in literals])


def replace_each(df: DataFrame, name: str, steps, only: Column = None) -> DataFrame:
    """``steps`` on the column ``name``, one projection each: a text without any of a step's literals is passed on as it is."""
    for literals, regex, replacement in steps:
        col = F.col(name)
        possible = holds(col, literals) if only is None else only & holds(col, literals)
        df = df.withColumn(name, F.when(possible, F.regexp_replace(col, regex, replacement)).otherwise(col))
    return df


def decode_entities(col) -> Column:
    """Decode numeric and named references in one pass, so nothing is decoded twice."""
    names = F.map_from_arrays(
        F.array(*[F.lit(k) for k in NAMED_ENTITIES]),
        F.array(*[F.lit(v) for v in NAMED_ENTITIES.values()]),
    )

    # What browsers show for the numbers 128 to 159: the Windows character of that byte.
    windows = {n: c for n in range(128, 160) if (c := bytes([n]).decode("cp1252", "ignore"))}
    shown = F.create_map(*[F.lit(x) for pair in windows.items() for x in pair])

    def code_point(point):
        valid = ((point > 0) & (point < 0xD800)) | ((point > 0xDFFF) & (point <= 0x10FFFF))
        char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "utf-32")
        return F.coalesce(F.try_element_at(shown, point.cast("int")), F.when(valid, char).otherwise(F.lit("�")))

    def decode(entity):
        name = F.regexp_extract(entity, ENTITY, 1)
        hexadecimal = F.conv(F.substring(name, 3, 6), 16, 10).cast("long")
        return (
            F.when(F.lower(name).startswith("#x"), code_point(hexadecimal))
            .when(name.startswith("#"), code_point(F.substring(name, 2, 7).cast("long")))
            .otherwise(F.coalesce(F.try_element_at(names, name), entity))
        )

    found = F.transform(F.regexp_extract_all(col, F.lit(ENTITY), F.lit(0)), decode)
    pieces = F.zip_with(
        F.split(col, ENTITY, -1), found, lambda text, char: F.concat(text, F.coalesce(char, F.lit("")))
    )
    return F.when(col.contains("&"), F.array_join(pieces, "")).otherwise(col)


def markup_to_text(df: DataFrame, src: str, out: str, config: CleanerConfig) -> DataFrame:
    """Turn tags into line breaks and blanks; ``src`` has no skipped elements any more."""
    col = F.col(src)
    marked = col.contains("<")
    df = df.withColumn(out, F.when(marked, replace_all(col, LINKS)).otherwise(col) if config.preserve_links else col)
    steps = [(*LINE_BREAK, BREAK), (*LIST_ITEM, EDGE + "* ")]
    steps += [(*CELL_END, " ")] if config.preserve_tables else [(*TABLE_PART, "")]
    df = replace_each(df, out, [*steps, (*LINE_EDGE, EDGE), (*PARAGRAPH_EDGE, GAP), (*ANY_TAG, "")])
    return replace_each(df, out, MARKS_TO_BREAKS, only=marked)


def html_to_text(df: DataFrame, src: str, out: str, config: CleanerConfig = CleanerConfig()) -> DataFrame:
    """Add ``out``, the text of the HTML in ``src``; NULL becomes ''."""
    if config.strip_only:
        return df.withColumn(out, strip_html(F.col(src)))
    plain = F.col("_plain")
    df = df.withColumn("_markup", normalise(F.coalesce(F.col(src), F.lit(""))))
    df = replace_each(df, "_markup", [*NOISE, *ENTITIES, COMMENT]).withColumn("_markup", drop_skipped(F.col("_markup")))
    df = markup_to_text(df, "_markup", "_plain", config).withColumn("_plain", decode_entities(plain))
    df = df.withColumn("_plain", plain_breaks(F.replace(plain, F.lit("\u00a0"), F.lit(" "))))
    for literals, steps in POLISH:
        df = df.withColumn("_plain", F.when(holds(plain, literals), replace_all(plain, steps)).otherwise(plain))
    lines = F.transform(split_lines(plain), trim_ws)
    return pin(df.withColumn(out, trim_ws(join_lines(lines))).drop("_markup", "_plain"), out)


def strip_html(col) -> Column:
    """The plain tag stripper: no layout, every tag and named reference becomes a blank."""
    steps = [
        (r"(?i)<style[^>]*>[\s\S]*?</style>", ""),
        (r"(?i)<script[^>]*>[\s\S]*?</script>", ""),
        (r"<[^>]+>", " "),
        (r"(?i)&[a-z]+;", " "),
        (r"\s+", " "),
    ]
    return trim_ws(replace_all(normalise(F.coalesce(col, F.lit(""))), steps))
