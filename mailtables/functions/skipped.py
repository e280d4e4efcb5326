"""Removes elements whose content is not shown, with the nesting a browser would see: a stack machine over the tags."""

from functools import reduce

from pyspark.sql import Column, functions as F

from .patterns import CLOSED_BY, FOREIGN_ELEMENTS, RAW_ELEMENTS, SKIPPED_ELEMENTS, VOID_ELEMENTS

# The rest of a tag; a ">" inside quotation marks does not end it.
TAG_REST = r"""\b(?:[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>|[^>]*>)"""
TAG = r"</?[a-zA-Z]" + TAG_REST.removeprefix(r"\b")
TAG_NAME = r"\A</?([a-zA-Z][^\s/>]*)"
CITED = r"(?i)\A<blockquote\b[^>]*\stype\s*=\s*[\"']?cite\b"
HOLDS_SKIPPED = rf"(?i)<(?:{'|'.join(SKIPPED_ELEMENTS)}|blockquote\b[^>]*\stype\s*=\s*[\"']?cite)\b"
START = (
    "named_struct('i', 0, 'stack', cast(array() as array<string>), 'base', -1, 'begin', 0, 'raw', '',"
    " 'drops', cast(array() as array<struct<begin: int, end: int, whole: boolean, cited: boolean>>))"
)


def one_of(col: Column, names) -> Column:
    return col.isin(*names)


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def read_tag(tag: Column) -> Column:
    def described(name):
        implied = reduce(
            lambda case, pair: case.when(one_of(name, pair[0]), F.array(*map(F.lit, pair[1]))), CLOSED_BY[1:],
            F.when(one_of(name, CLOSED_BY[0][0]), F.array(*map(F.lit, CLOSED_BY[0][1]))),
        )
        return F.struct(
            name.alias("name"), tag.startswith("</").alias("closes"), tag.endswith("/>").alias("ends"),
            (one_of(name, SKIPPED_ELEMENTS) | tag.rlike(CITED)).alias("skipped"),
            one_of(name, VOID_ELEMENTS).alias("void"), one_of(name, RAW_ELEMENTS).alias("raw"), implied.alias("implied"),
        )

    return let(F.lower(F.regexp_extract(tag, TAG_NAME, 1)), described)


def closed_by(tag: Column, stack: Column) -> Column:
    """``stack`` without its top element if the opening ``tag`` implies its end."""
    ends = F.coalesce(F.array_contains(tag["implied"], F.get(stack, F.lit(0))), F.lit(False))
    return F.when(ends, F.slice(stack, F.lit(2), F.size(stack))).otherwise(stack)


def step(state: Column, tag: Column) -> Column:
    """One tag further. ``base`` is the number of elements around the one that is being skipped, -1 if none is."""
    name, stack = tag["name"], state["stack"]
    # Inside a script or style only its own end counts.
    text = (state["raw"] != "") & ~(tag["closes"] & (name == state["raw"]))
    at = F.array_position(stack, name).cast("int")

    def left(implied):
        return (
            F.when(text, stack)
            .when(tag["closes"] & (at > 0), F.slice(stack, at + 1, F.size(stack)))
            .when(tag["closes"], stack)
            .otherwise(closed_by(tag, implied))
        )

    def moved(left):
        foreign = F.arrays_overlap(F.concat(stack, F.array(name)), F.array(*map(F.lit, FOREIGN_ELEMENTS)))
        opens = ~text & ~tag["closes"] & ~tag["void"]
        ended = (state["base"] >= 0) & (F.size(left) <= state["base"])
        return F.struct(
            left.alias("left"), (opens & ~(tag["ends"] & foreign)).alias("stays"),
            (opens & tag["ends"] & foreign & tag["skipped"]).alias("single"), text.alias("text"), ended.alias("ended"),
            (ended & tag["closes"] & (F.size(left) == state["base"])).alias("own"), (ended | (state["base"] < 0)).alias("outside"),
        )

    def result(m):
        i, none = state["i"], F.slice(state["drops"], 1, 0)
        begins = m["stays"] & tag["skipped"] & m["outside"]
        ended = F.when(m["ended"], F.array(drop(state["begin"], i, m["own"], m["own"] & (name == "blockquote"))))
        alone = F.when(m["single"] & m["outside"], F.array(drop(i, i, F.lit(True), F.lit(False))))
        drops = F.when(m["ended"] | m["single"], F.concat(state["drops"], ended.otherwise(none), alone.otherwise(none)))
        return F.struct(
            (i + 1).alias("i"),
            F.when(m["stays"], F.concat(F.array(name), m["left"])).otherwise(m["left"]).alias("stack"),
            F.when(begins, F.size(m["left"])).when(m["outside"], -1).otherwise(state["base"]).alias("base"),
            F.when(begins, i).otherwise(state["begin"]).alias("begin"),
            F.when(m["stays"] & tag["raw"], name).when(m["text"], state["raw"]).otherwise("").alias("raw"),
            drops.otherwise(state["drops"]).alias("drops"),
        )

    once = let(closed_by(tag, stack), lambda one: let(closed_by(tag, one), lambda two: let(left(two), moved)))
    return let(once, result)


def drop(begin, end, whole, cited) -> Column:
    return F.struct(begin.alias("begin"), end.alias("end"), whole.alias("whole"), cited.alias("cited"))


def drop_skipped(col: Column) -> Column:
    """``col`` without ``SKIPPED_ELEMENTS`` and cited quotes, each with everything in it.

    An element ends at its own end tag, at the end of an element around it, at an opening tag that implies its end, or with the
    text. End tags without an open element are passed over. The state is a stack of open elements and a list of
    places to drop, so the text itself is copied once, at the end.
    """
    tags = F.regexp_extract_all(col, F.lit(TAG), F.lit(0))
    texts = F.split(col, TAG, -1)

    def finish(state):
        rest = F.array(drop(state["begin"], state["i"], F.lit(False), F.lit(False)))
        return F.when(state["base"] >= 0, F.concat(state["drops"], rest)).otherwise(state["drops"])

    def kept(drops):
        def part(tag, i):
            held = F.filter(drops, lambda d: (d["begin"] <= i) & (i <= d["end"]))
            in_tag = F.exists(held, lambda d: (i < d["end"]) | d["whole"])
            mark = F.when(F.exists(held, lambda d: (i == d["end"]) & d["cited"]), "\n").when(in_tag, "").otherwise(tag)
            return F.struct(mark.alias("mark"), F.exists(held, lambda d: i < d["end"]).alias("hides"))

        shown = F.zip_with(F.transform(tags, part), F.slice(texts, F.lit(2), F.size(texts)), lambda p, text: F.concat(
            p["mark"], F.when(p["hides"], "").otherwise(text)))
        return F.array_join(shown, "")

    drops = F.aggregate(F.transform(tags, read_tag), F.expr(START), step, finish)
    cleaned = F.concat(F.get(texts, F.lit(0)), let(drops, kept))
    return F.when(col.contains("<") & col.rlike(HOLDS_SKIPPED), cleaned).otherwise(col)
