"""HTML to text as column expressions: nothing leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.core import let
from tessera.functions.text import strip_ws

# Named entities that are decoded; the ampersand comes last.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·", "bull": "•",
    "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«",
    "raquo": "»", "euro": "€", "pound": "£", "sect": "§", "deg": "°", "amp": "&",
}
DROPPED = (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?is)<title.*?</title>", r"(?s)<!--.*?-->")
BLOCK_TAGS = r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|article|section|nav|footer|header|body|html|head|h[1-6])(?:[ /][^>]*)?>"
MARK, TITLE_END = "\x01", "\x02"


def decode_entities(text: Column) -> Column:
    """Decimal entities and the named ones above as characters."""
    decoded = lambda whole: F.transform(F.split(whole, "&#", -1), lambda part, i: F.when((i > 0) & part.rlike("^[0-9]{1,7};"), F.concat(
        F.decode(F.unhex(F.lpad(F.hex(F.regexp_extract(part, "^([0-9]+);", 1).cast("bigint")), 8, "0")), "UTF-32"),
        F.regexp_replace(part, "^[0-9]+;", ""))).when(i > 0, F.concat(F.lit("&#"), part)).otherwise(part))
    numbered = let(text, lambda t: F.when(F.contains(t, F.lit("&#")), F.array_join(decoded(t), "")).otherwise(t))
    return reduce(lambda c, e: F.replace(c, F.lit(f"&{e[0]};"), F.lit(e[1])), ENTITIES.items(), numbered)


def drop_hidden(html: Column) -> Column:
    return reduce(lambda c, pattern: F.regexp_replace(c, pattern, ""), DROPPED, html)


def visible_text(html: Column) -> Column:
    """Text of markup: block tags end a line, other tags vanish, blank lines and runs of spaces shrink."""
    lines = F.regexp_replace(html, BLOCK_TAGS, "\n")
    plain = decode_entities(F.regexp_replace(lines, r"<[^>]*>", ""))
    return strip_ws(F.regexp_replace(F.regexp_replace(plain, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"))


def section_pieces(html: Column, levels: tuple[str, ...]) -> Column:
    """Markup cut at its headers: an array of (level, title, content); text before any header has no level."""
    marked = drop_hidden(html)
    for i, tag in enumerate(levels):
        marked = F.regexp_replace(
            marked, f"(?is)<{tag}(?: [^>]*)?>(.*?)</{tag}>", f"{MARK}{i}$1{TITLE_END}")
    return F.transform(F.split(marked, MARK, -1), lambda piece, i: F.struct(
        F.when(i > 0, F.left(piece, F.lit(1)).try_cast("int")).alias("level"),
        F.when(i > 0, visible_text(F.substring_index(
            F.right(piece, F.char_length(piece) - 1), TITLE_END, 1))).alias("title"),
        visible_text(F.when(i > 0, F.substring_index(piece, TITLE_END, -1)).otherwise(piece)).alias("content")))


def sections_of(pieces: Column, levels: tuple[str, ...]) -> Column:
    """Array of (sec_no, one header per level, content) from an array column of pieces.

    A header of a higher level clears the headers below it. All of it happens inside the row, so no
    shuffle is needed.
    """
    def header_at(i: Column, level: int) -> Column:
        above = F.slice(pieces, F.lit(1), i + 1)
        # The last header of this level or a higher one decides; a higher one clears this level.
        last = F.try_element_at(F.filter(above, lambda p: p["level"] <= level), F.lit(-1))
        return F.coalesce(F.when(last["level"] == level, last["title"]), F.lit(""))

    return F.transform(pieces, lambda piece, i: F.struct(
        i.alias("sec_no"), *[header_at(i, n).alias(f"header_{n + 1}") for n in range(len(levels))],
        piece["content"].alias("content")))
