"""Tolerant comparison of extracted values with expected ones, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from tessera.functions.core import let
from tessera.functions.responses import kind_of
from tessera.functions.text import strip_ws

# Texts that count as "nothing was extracted".
EMPTY_MARKS = ("", "<UNKNOWN>", "null")


def normalize_field(text: Column) -> Column:
    plain = strip_ws(F.lower(text))
    for old, new in (("commercial ", ""), ("'", ""), ("  ", " ")):
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return plain


def parse_us_date(text: Column) -> Column:
    """Month, day and year at the start of a text; no calendar check. Null if there is no date."""
    shown = F.regexp_extract(strip_ws(text), r"^([0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4})", 1)

    def date(parts: Column) -> Column:
        number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
        year = number(2)
        century = F.when(year < 50, F.lit(2000)).when(year < 100, F.lit(1900)).otherwise(F.lit(0))
        return F.when(year.isNotNull(), F.struct(
            number(0).alias("month"), number(1).alias("day"), (year + century).alias("year")))

    return let(F.split(F.translate(shown, "/.", "--"), "-"), date)


def score_null(extracted: Column) -> Column:
    """Score where nothing was expected: 1 if nothing was extracted."""
    return F.when(extracted.isNull() | extracted.isin(*EMPTY_MARKS), F.lit(1.0)).otherwise(F.lit(0.0))


def _with_nulls(extracted: Column, expected: Column, scored: Column, text: bool = True) -> Column:
    nothing = score_null(extracted) if text else F.when(extracted.isNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(expected.isNull(), nothing).when(extracted.isNull(), F.lit(0.0)).otherwise(scored)


def score_text(extracted: Column, expected: Column) -> Column:
    """1 if equal after normalising, 0.8 if one holds the other, else 0."""
    e, x = normalize_field(expected), normalize_field(extracted)
    scored = F.when(e == x, F.lit(1.0)).when(F.contains(x, e) | F.contains(e, x), F.lit(0.8)).otherwise(F.lit(0.0))
    return _with_nulls(extracted, expected, scored)


def score_date(extracted: Column, expected: Column) -> Column:
    same = F.coalesce(parse_us_date(extracted) == parse_us_date(expected), F.lit(False))
    return _with_nulls(extracted, expected, F.when(same, F.lit(1.0)).otherwise(F.lit(0.0)))


def score_list(extracted: Column, expected: Column) -> Column:
    """Share of expected items found, less a small penalty for items too many."""
    def compare(both: Column) -> Column:
        e, x = both["e"], both["x"]
        hits = F.size(F.filter(e, lambda v: F.exists(x, lambda w: F.contains(w, v) | F.contains(v, w))))
        return let(hits, lambda n: F.greatest(F.lit(0.0), n / F.size(e) - F.least(
            F.lit(0.2), F.lit(0.05) * F.greatest(F.lit(0), F.size(x) - n))))

    sides = F.struct(F.transform(expected, normalize_field).alias("e"), F.transform(extracted, normalize_field).alias("x"))
    full = (F.when((F.size(expected) == 0) & (F.size(extracted) == 0), F.lit(1.0))
            .when((F.size(expected) == 0) | (F.size(extracted) == 0), F.lit(0.0))
            .otherwise(let(sides, compare)))
    return _with_nulls(extracted, expected, full, text=False)


def score_list_answer(answer: Column, expected: Column) -> Column:
    """``score_list`` for a variant answer: a value that is no list counts as an empty list, a null or missing one as no answer."""
    def judge(both: Column) -> Column:
        kind, value = both["kind"], both["value"]
        nothing = F.coalesce(kind == "null", F.lit(True))
        empty = nothing | ((kind == "string") & F.try_variant_get(value, "$", "string").isin(*EMPTY_MARKS))
        listed = F.when(kind == "array", F.try_variant_get(value, "$", "array<string>")).otherwise(F.array().cast("array<string>"))
        return (F.when(both["expected"].isNull(), F.when(empty, F.lit(1.0)).otherwise(F.lit(0.0)))
                .when(nothing, F.lit(0.0)).otherwise(score_list(listed, both["expected"])))

    return let(F.struct(kind_of(answer).alias("kind"), answer.alias("value"), expected.alias("expected")), judge)


SCORERS = {"text": score_text, "date": score_date, "list": score_list}


def score_extraction(joined: DataFrame, fields: dict[str, str], extracted: str = "extracted",
                     expected: str = "expected") -> DataFrame:
    """Score per field of two structs, and their mean as ``accuracy``.

    ``fields`` gives each field its kind: text, date or list. A list that was extracted is an array or a variant.
    """
    types = {f.name: f.dataType for f in joined.schema[extracted].dataType.fields}
    rules = {f: score_list_answer if kind == "list" and isinstance(types[f], VariantType) else SCORERS[kind] for f, kind in fields.items()}
    scores = {f: rule(F.col(f"{extracted}.{f}"), F.col(f"{expected}.{f}")) for f, rule in rules.items()}
    out = joined.select("*", *[c.alias(f"score_{f}") for f, c in scores.items()])
    total = sum((F.col(f"score_{f}") for f in fields), F.lit(0.0))
    return out.withColumn("accuracy", total / len(fields))


def normalize_value(text: Column) -> Column:
    """Lower case, stripped, without hyphens and spaces."""
    return F.translate(strip_ws(F.lower(text)), "- ", "")


def nonempty_score(text: Column) -> Column:
    return F.when(F.coalesce(strip_ws(text), F.lit("")) != "", F.lit(1.0)).otherwise(F.lit(0.0))


def list_lines(text: Column) -> Column:
    """Lines that start like a bullet or a numbered item, without the marker."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^[ \t]*(?:[-*]|[0-9]+[.)])[ \t]+"))
    return F.transform(lines, lambda s: strip_ws(F.regexp_replace(s, r"^[ \t]*(?:[-*]|[0-9]+[.)])[ \t]+", "")))


def is_listed(text: Column) -> Column:
    return F.size(list_lines(text)) > 0


def not_duplicative(text: Column) -> Column:
    """List items are all different; a text without list is judged by its lines."""
    plain = F.filter(F.split(text, "\n"), lambda s: s != "")
    return let(list_lines(text), lambda items: let(
        F.when(F.size(items) > 0, items).otherwise(plain), lambda shown: F.size(F.array_distinct(shown)) == F.size(shown)))


def length_list_metric(text: Column, target_len: int = 600, max_len_score: int = 3) -> Column:
    """Short texts with a list of different items score high; the range starts at 0."""
    length = F.greatest((F.lit(target_len) - F.char_length(text)) / F.lit(target_len / max_len_score), F.lit(0.0))
    verdicts = not_duplicative(text).cast("int") + is_listed(text).cast("int")
    return (verdicts + length) / F.lit(2.0 + max_len_score)
