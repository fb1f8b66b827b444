"""Personal data in text: detection, numbering, masking and matching, as column expressions.

Entities are arrays of structs inside the row of their document, so none of this needs a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.core import let
from tessera.functions.responses import kind_of, parsed_json
from tessera.functions.scoring import normalize_value
from tessera.functions.text import strip_ws

# Entity types an answer may use.
ENTITY_TYPES = ("PERSON", "SSN", "ADDRESS", "EMAIL", "PHONE", "CREDIT_CARD", "BANK_ACCOUNT", "DATE_OF_BIRTH", "OTHER")

# Labels of annotated text and the entity type each stands for.
LABEL_TYPES = {
    "name": "PERSON", "first_name": "PERSON", "last_name": "PERSON",
    "ssn": "SSN", "social_security_number": "SSN",
    "street_address": "ADDRESS", "address": "ADDRESS", "city": "ADDRESS", "state": "ADDRESS", "zip_code": "ADDRESS",
    "email": "EMAIL", "email_address": "EMAIL",
    "phone_number": "PHONE", "phone": "PHONE",
    "credit_card_number": "CREDIT_CARD", "credit_card": "CREDIT_CARD",
    "bank_routing_number": "BANK_ACCOUNT", "iban": "BANK_ACCOUNT", "account_number": "BANK_ACCOUNT",
    "bank_account": "BANK_ACCOUNT",
    "date_of_birth": "DATE_OF_BIRTH", "dob": "DATE_OF_BIRTH",
}
OTHER = "OTHER"


@dataclass(frozen=True)
class Detector:
    """Every match of a pattern is an entity. A number that must pass the Luhn check and does not gets ``fallback``.

    ``needs`` is a piece of text that every match holds: texts without it are not searched.
    """

    entity_type: str
    pattern: str
    group: int = 0
    luhn: bool = False
    fallback: str = OTHER
    needs: str = ""


DETECTORS = (
    Detector("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", needs="@"),
    Detector("CREDIT_CARD", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", luhn=True, fallback="BANK_ACCOUNT"),
    Detector("BANK_ACCOUNT", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"),
    Detector("PHONE", r"\+[0-9]{1,3} ?\([0-9]{3}\) [0-9]{3}-[0-9]{4}", needs=") "),
    Detector("SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", needs="-"),
    Detector("DATE_OF_BIRTH", r"(?i)(?:born on|date of birth:?|dob:?) ?([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|"
                              r"[a-z]+ [0-9]{1,2}, [0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})", group=1),
    Detector("PERSON", r"(?:Dr|Mr|Mrs|Ms|Prof)\. [A-Z][a-z]+(?: [A-Z][a-z]+)?", needs=". "),
    Detector("ADDRESS", r"[0-9]{1,5} [A-Z][a-z]+(?: [A-Z][a-z]+)? (?:Street|Avenue|Road|Terrace|Lane|Drive)"),
    Detector("OTHER", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9a-f]{40}"),
)


def luhn_ok(number: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), "")
    doubled = F.transform(digits, lambda d, i: let(
        d.try_cast("int") * (F.lit(1) + F.pmod(i, F.lit(2))), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def detect(text: Column, detectors: tuple[Detector, ...] = DETECTORS) -> Column:
    """Array of (pos, entity_type, original_value), every occurrence, in order of first appearance of the value."""
    found = []
    for d in detectors:
        values = F.regexp_extract_all(text, F.lit(d.pattern), F.lit(d.group))
        if d.needs:
            values = F.when(F.contains(text, F.lit(d.needs)), values).otherwise(F.array().cast("array<string>"))

        def entity(v: Column, d: Detector = d) -> Column:
            kind = F.when(luhn_ok(v), F.lit(d.entity_type)).otherwise(F.lit(d.fallback)) if d.luhn else F.lit(d.entity_type)
            return F.struct(F.instr(text, v).alias("pos"), kind.alias("entity_type"), v.alias("original_value"))

        found.append(_each(values, entity))
    return F.array_sort(F.concat(*found))


def _each(values: Column, make) -> Column:
    return F.transform(values, lambda v: make(v))


def with_salt_ids(entities: Column) -> Column:
    """Adds ``salt_id``: TYPE_001, TYPE_002 ... by first appearance in the type; a repeated value keeps its id."""
    def number(b: Column) -> Column:
        keys = b["keys"]

        def salted(e: Column) -> Column:
            at = F.array_position(keys, F.struct(e["entity_type"].alias("t"), e["original_value"].alias("v")))
            rank = F.size(F.filter(keys, lambda k, i: (i < at) & (k["t"] == e["entity_type"])))
            return F.struct(e["entity_type"].alias("entity_type"), e["original_value"].alias("original_value"),
                            F.format_string("%s_%03d", e["entity_type"], rank).alias("salt_id"))

        return F.transform(b["all"], salted)

    keys = F.array_distinct(F.transform(entities, lambda e: F.struct(
        e["entity_type"].alias("t"), e["original_value"].alias("v"))))
    return let(F.struct(entities.alias("all"), keys.alias("keys")), number)


def mask(text: Column, entities: Column) -> Column:
    """Text with each value replaced by its salt id, longest value first, one after the other.

    Replacement is sequential: a short value may also hit inside an id already written.
    """
    longest = F.array_sort(entities, lambda a, b: F.char_length(b["original_value"]) - F.char_length(a["original_value"]))
    return F.aggregate(longest, text, lambda t, e: F.replace(t, e["original_value"], e["salt_id"]))


def label_type(label: Column) -> Column:
    """Entity type of an annotation label, OTHER if unknown."""
    by_type: dict[str, list[str]] = {}
    for name, kind in LABEL_TYPES.items():
        by_type.setdefault(kind, []).append(name)

    def choose(clean: Column) -> Column:
        hits = [F.when(clean.isin(names), F.lit(kind)) for kind, names in by_type.items()]
        return F.coalesce(*hits, F.lit(OTHER))

    return let(strip_ws(F.lower(label)), choose)


#: Pieces of a Python literal: quoted texts, and what stands between them.
LITERAL_PIECE = r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"]++"""


def literal_as_json(shown: Column) -> Column:
    """A Python literal of lists, tuples, dicts, texts, numbers, None, True and False as JSON; null if its quotes do not match.

    Texts may hold escaped quotes and the escapes that JSON also has, and two-digit hex ones. Prefixed texts and texts side by side
    do not count as one text, so the result is no JSON.
    """
    backslash = "\x00"  # no literal holds it

    def text(piece: Column) -> Column:
        out = F.substring(piece, F.lit(2), F.char_length(piece) - 2)
        for old, new in (("\\\\", backslash), ("\\'", "'"), ('\\"', '"'), ('"', '\\"'), ("\t", "\\t")):
            out = F.replace(out, F.lit(old), F.lit(new))
        out = F.regexp_replace(out, F.lit(r"\\x([0-9A-Fa-f]{2})"), F.lit(r"\\u00$1"))
        return F.concat(F.lit('"'), F.replace(out, F.lit(backslash), F.lit("\\\\")), F.lit('"'))

    def between(piece: Column) -> Column:
        out = F.translate(piece, "()", "[]")
        for word, name in (("None", "null"), ("True", "true"), ("False", "false"), (r",(\s*[\]}])", "$1")):
            out = F.regexp_replace(out, F.lit(word if word.startswith(",") else rf"\b{word}\b"), F.lit(name))
        return out

    def joined(pieces: Column) -> Column:
        told = F.transform(pieces, lambda p: F.when(p.startswith("'") | p.startswith('"'), text(p)).otherwise(between(p)))
        return F.when((F.array_join(pieces, "") == shown) & ~F.contains(shown, F.lit(backslash)), F.array_join(told, ""))

    return let(F.regexp_extract_all(shown, F.lit(LITERAL_PIECE), F.lit(0)), joined)


SPAN_DDL = "label string, type string, text string, value string, start int, end int"


def truth(spans: Column, text: Column) -> Column:
    """Annotated spans (JSON, or a Python literal) to an array of (type, value).

    The label is in ``label`` or ``type``, the value in ``text`` or ``value`` or between ``start`` and
    ``end``; values of one character after stripping are dropped. Unreadable spans give no entities.
    """
    def as_objects(parsed: Column) -> Column:
        objects = F.filter(F.try_variant_get(parsed, "$", "array<variant>"), lambda v: kind_of(v) == "object")
        return F.transform(objects, lambda v: F.try_variant_get(v, "$", f"struct<{SPAN_DDL}>"))

    def entity(s: Column) -> Column:
        given = F.coalesce(s["text"], s["value"], F.lit(""))
        cut = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        value = F.when((given == "") & s["start"].isNotNull() & s["end"].isNotNull(), cut).otherwise(given)
        return F.struct(label_type(F.coalesce(s["label"], s["type"], F.lit(""))).alias("type"),
                        strip_ws(value).alias("value"))

    listed = lambda shown: let(parsed_json(shown), lambda v: F.when(v.isNotNull(), as_objects(v)))
    rows = F.coalesce(listed(spans), let(literal_as_json(spans), listed), F.from_json(F.lit("[]"), f"array<struct<{SPAN_DDL}>>"))
    return F.filter(F.transform(rows, entity), lambda e: F.char_length(e["value"]) > 1)


def match(predicted: Column, truths: Column) -> Column:
    """Struct (tp, fp, fn) of arrays of (type, value).

    In order, each prediction takes the first free truth of its type (or of type OTHER) whose
    normalised value holds it or is held by it.
    """
    plain = lambda es: F.transform(es, lambda e: F.struct(
        e["type"].alias("type"), normalize_value(e["value"]).alias("value")))

    def greedy(b: Column) -> Column:
        preds, golds = b["p"], b["g"]

        def first_free(state: Column, p: Column) -> Column:
            fits = F.filter(F.sequence(F.lit(0), F.size(golds) - 1), lambda j: let(F.get(golds, j), lambda g: (
                ~F.get(state["used"], j) & ((p["type"] == g["type"]) | (g["type"] == OTHER))
                & (F.contains(g["value"], p["value"]) | F.contains(p["value"], g["value"])))))
            return F.when(F.size(golds) > 0, F.get(fits, F.lit(0)))

        def step(state: Column, p: Column) -> Column:
            return let(F.struct(first_free(state, p).alias("j")), lambda at: F.struct(
                F.transform(state["used"], lambda u, i: u | F.coalesce(i == at["j"], F.lit(False))).alias("used"),
                (state["tp"] + F.when(at["j"].isNotNull(), 1).otherwise(0)).alias("tp"),
                (state["fp"] + F.when(at["j"].isNull(), 1).otherwise(0)).alias("fp")))

        start = F.struct(F.transform(golds, lambda g: F.lit(False)).alias("used"), F.lit(0).alias("tp"), F.lit(0).alias("fp"))
        return F.aggregate(preds, start, step, lambda s: F.struct(
            s["tp"].alias("tp"), s["fp"].alias("fp"), F.size(F.filter(s["used"], lambda u: ~u)).alias("fn")))

    return let(F.struct(plain(predicted).alias("p"), plain(truths).alias("g")), greedy)


def document_scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and f1; a document without predictions and truths scores 1."""
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide(tp, tp + fp), zero)
    r = F.coalesce(F.try_divide(tp, tp + fn), zero)
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), zero)
    empty = (tp + fp + fn) == 0
    one = lambda c: F.when(empty, F.lit(1.0)).otherwise(c)
    return {"precision": one(p), "recall": one(r), "f1": one(f1)}
