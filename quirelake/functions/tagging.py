"""Tagged XML: placeholders coalesced, numbered, written, verified and put back; all on arrays inside one row."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = "array<struct<kind:string,content:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def coalesce_segments(segments: Column) -> Column:
    """Neighbouring placeholders become one, but one that is a lone line break stays by itself; empty ones go.

    `math` counts as placeholder. Text segments stay apart; they simply follow each other in the XML. Linear: whether a
    segment joins the one before depends on these two alone, so the places where islands begin are listed and the
    segments between two of them put together."""

    def joins(before: Column, own: Column) -> Column:
        return (before["kind"] != "text") & (own["kind"] != "text") & (before["content"] != "\n") & (own["content"] != "\n")

    def merged(own: Column, begin: Column, end: Column) -> Column:
        part = F.slice(own, begin, end - begin)
        kind = F.when(part[0]["kind"] == "text", "text").otherwise("placeholder")
        return F.struct(kind.alias("kind"), F.array_join(F.transform(part, lambda s: s["content"]), "").alias("content"))

    def islands(own: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(own))
        begins = F.filter(places, lambda i: (i == 1) | ~joins(F.element_at(own, F.greatest(i - 1, F.lit(1))), F.element_at(own, i)))
        ends = lambda starts: F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(own) + 1))
        return let(begins, lambda starts: F.zip_with(starts, ends(starts), lambda x, y: merged(own, x, y)))

    full = F.filter(segments, lambda s: s["content"] != "")
    return let(full, lambda own: F.when(F.size(own) > 0, islands(own)).otherwise(F.array().cast(SEGMENTS)))


def number_placeholders(segments: Column) -> Column:
    """kind, content, id: placeholders numbered from 1 in order; text has no id. The placeholders are numbered among
    themselves and put back among the text by place."""
    placed = F.transform(segments, lambda s, i: F.struct(i.alias("place"), s["kind"].alias("kind"), s["content"].alias("content")))
    own = lambda s, number: F.struct(s["place"].alias("place"), s["kind"].alias("kind"), s["content"].alias("content"), number.cast("int").alias("id"))

    def numbered(every: Column) -> Column:
        marks = F.transform(F.filter(every, lambda s: s["kind"] != "text"), lambda s, k: own(s, k + 1))
        texts = F.transform(F.filter(every, lambda s: s["kind"] == "text"), lambda s: own(s, F.lit(None)))
        return F.transform(F.array_sort(F.concat(marks, texts)), lambda s: F.struct(s["kind"].alias("kind"), s["content"].alias("content"), s["id"].alias("id")))

    return let(placed, numbered)


def escape(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for sign, entity in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def build_xml(numbered: Column) -> Column:
    """<document><TEXT>...</TEXT></document> of numbered segments."""
    parts = F.transform(
        numbered,
        lambda s: F.when(s["kind"] == "text", escape(s["content"])).otherwise(
            F.concat(F.lit('<PH id="'), s["id"].cast("string"), F.lit('">'), escape(s["content"]), F.lit("</PH>"))
        ),
    )
    return F.concat(F.lit("<document><TEXT>"), F.array_join(parts, ""), F.lit("</TEXT></document>"))


def placeholder_map(numbered: Column) -> Column:
    """id -> content of the placeholders."""
    own = F.filter(numbered, lambda s: s["kind"] != "text")
    return F.map_from_entries(F.transform(own, lambda s: F.struct(s["id"].cast("string"), s["content"])))


def only_placeholders(numbered: Column) -> Column:
    return ~F.exists(numbered, lambda s: s["kind"] == "text")


def found_ids(xml: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(xml, F.lit('<PH[^>]*?id="([0-9]+)"'), F.lit(1)))


def _by_number(ids: Column) -> Column:
    return F.transform(F.array_sort(F.transform(ids, lambda i: i.cast("int"))), lambda i: i.cast("string"))


def missing_and_extra(xml: Column, expected: Column) -> tuple[Column, Column]:
    """Ids that are expected but not found, and found but not expected, as sets, by number.

    expected: id -> content. Placeholders of white space only may go; extra ids that are known ones are fine."""
    needed = F.map_keys(F.map_filter(expected, lambda _, content: ~content.rlike(r"^\s*$")))
    found = found_ids(xml)
    return _by_number(F.array_except(needed, found)), _by_number(F.array_except(found, F.map_keys(expected)))


def rebuild(xml: str, placeholders: dict[str, str] | None = None) -> str:
    """The text of a tagged XML with its placeholders put back.

    An unknown id keeps the inline text; other elements are left out, but not what follows them; a document without
    <TEXT> gives ''. XML that cannot be parsed raises ParseError."""
    root = ElementTree.fromstring(xml)
    text = root.find("TEXT") if root.tag != "TEXT" else root
    if text is None:
        return ""
    out = [text.text or ""]
    for child in text:
        if child.tag == "PH":
            inline = "".join(child.itertext())
            out.append((placeholders or {}).get(child.get("id", ""), inline))
        out.append(child.tail or "")
    return "".join(out)


def restore(xml: Column, placeholders: Column) -> Column:
    """`rebuild` as an expression, for XML that `build_xml` wrote: pieces between tags, and ids looked up."""
    body = F.regexp_extract(xml, r"(?s)<TEXT>(.*)</TEXT>", 1)
    pieces = F.regexp_extract_all(body, F.lit(r'(?s)<PH id="[0-9]+">.*?</PH>|[^<]+'), F.lit(0))

    def back(piece: Column, known: Column) -> Column:
        number = F.regexp_extract(piece, r'^<PH id="([0-9]+)">', 1)
        inline = unescape(F.regexp_extract(piece, r"(?s)^<PH[^>]*>(.*)</PH>$", 1))
        return F.when(number != "", F.coalesce(F.try_element_at(known, number), inline)).otherwise(unescape(piece))

    # the map is repeated beside the pieces, so that it is made once a row and not once a piece
    return F.array_join(F.zip_with(pieces, F.array_repeat(placeholders, F.size(pieces)), back), "")
