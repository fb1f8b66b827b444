"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that Python's str.strip() removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"[\p{L}\p{N}_]+"
CITATION = r"(?i)\[arxiv:([\p{L}\p{N}_.\-/]+?)\]"


def strip_ws(text: Column) -> Column:
    """White space off both ends, as Python's ``strip``."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def title_text(title: Column, text: Column, title_chars: int = 512, text_chars: int = 2048) -> tuple[Column, Column]:
    """Short title, and title and text joined by a dash with stray dashes and spaces taken off."""
    whole = F.coalesce(title, F.lit(""))
    short = F.left(strip_ws(whole), F.lit(title_chars))
    joined = F.btrim(F.concat(whole, F.lit(" -- "), F.coalesce(text, F.lit(""))), F.lit(" -"))
    return short, F.left(joined, F.lit(text_chars))


def compose_prompt(template: str, **parts: Column) -> Column:
    """Fill ``{name}`` slots of a template with columns; a null part reads as empty text."""
    pieces: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            pieces.append(F.lit(head))
        if not brace:
            break
        name, closed, rest = tail.partition("}")
        if not closed or name not in parts:
            raise ValueError(f"template slot {{{name}}} has no column")
        pieces.append(F.coalesce(parts[name].cast("string"), F.lit("")))
    return F.concat(*pieces)


def truncate(text: Column, chars: int) -> Column:
    return F.left(text, F.lit(chars))


def tokenize_words(text: Column) -> Column:
    """Lower-case words; letters and digits of any script count."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def token_estimate(text: Column, kind: str = "chars") -> Column:
    """A quarter of the characters, at least one; or the number of words."""
    if kind == "chars":
        return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4).cast("int"))
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def content_id(text: Column) -> Column:
    return F.md5(text)


def extract_citations(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)))


def paper_id(url: Column) -> Column:
    """Last part of a paper address without its version."""
    return F.regexp_replace(F.regexp_extract(url, r"([^/]+)$", 1), r"v[0-9]+$", "")


def one_line(text: Column) -> Column:
    return F.regexp_replace(strip_ws(text), "\n", " ")


def elapsed_seconds(begin: Column, end: Column) -> Column:
    """Seconds with fraction between two timestamps."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(begin.cast("timestamp"))
    return micros / F.lit(1_000_000.0)


def vector_literal(vector: Column) -> Column:
    return F.concat(
        F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.6f", x)), ","), F.lit("]"))
