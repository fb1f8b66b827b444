"""Rules for model answers held as JSON text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.core import let
from tessera.functions.text import strip_ws


def clean_model_json(text: Column) -> Column:
    """Answer text without code fences and the ``json`` tag."""
    return strip_ws(F.replace(F.replace(text, F.lit("json\n"), F.lit("")), F.lit("```"), F.lit("")))


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value.

    ``try_parse_json`` alone reads the first value and forgives what follows. Text that goes on
    after its value cannot fit both an array and an object around it.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    in_object = F.try_parse_json(F.concat(F.lit('{"value": '), text, F.lit(', "end": 1}')))
    return in_array & F.coalesce(F.try_variant_get(in_object, "$.end", "int") == 1, F.lit(False))


def parsed_json(text: Column) -> Column:
    """Variant of a text that is JSON as a whole, else null."""
    return F.when(is_json(text), F.try_parse_json(text))


def parse_response(text: Column, ddl: str) -> tuple[Column, Column]:
    """(struct by schema or null, whether the text is JSON at all)."""
    ok = is_json(text)
    return F.when(ok, F.from_json(text, ddl)), ok


def elements_to_text(text: Column, path: str = "$.document.elements") -> Column:
    """Contents of the parsed elements, one per line."""
    elements = F.try_variant_get(parsed_json(text), path, "array<struct<content string, type string>>")
    return F.concat_ws("\n", F.transform(elements, lambda e: e["content"]))


def kind_of(value: Column) -> Column:
    """JSON kind of a variant: string, number, boolean, array, object, null; no value gives null."""
    return let(F.schema_of_variant(value), lambda name: (
        F.when(name == "STRING", F.lit("string")).when(name == "BOOLEAN", F.lit("boolean"))
        .when(name.startswith("ARRAY"), F.lit("array")).when(name.startswith("OBJECT"), F.lit("object"))
        .when(name == "VOID", F.lit("null")).when(name.isNotNull(), F.lit("number"))))


def as_list(text: Column, element_ddl: str) -> Column:
    """JSON text that holds a list or a single object, always as an array of structs.

    List members that are no objects are left out; text that is no JSON gives an empty array.
    """
    empty = F.from_json(F.lit("[]"), f"array<{element_ddl}>")

    def listed(parsed: Column) -> Column:
        kind = kind_of(parsed)
        members = F.filter(F.try_variant_get(parsed, "$", "array<variant>"), lambda v: kind_of(v) == "object")
        many = F.transform(members, lambda v: F.try_variant_get(v, "$", element_ddl))
        one = F.array(F.try_variant_get(parsed, "$", element_ddl))
        return F.when(kind == "array", many).when(kind == "object", one).otherwise(empty)

    return let(parsed_json(text), listed)


@dataclass(frozen=True)
class FieldRule:
    """What one key of an answer must look like."""

    name: str
    kind: str
    required: bool = True
    nullable: bool = False
    choices: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None


def validate_response(text: Column, rules: list[FieldRule], extra_allowed: bool = False) -> Column:
    """Violations as an array of ``problem:field``, empty if the answer fits its schema."""
    bound = F.struct(parsed_json(text).alias("parsed"), F.json_object_keys(text).alias("keys"))
    return let(bound, lambda b: _violations(b["parsed"], b["keys"], rules, extra_allowed))


def _violations(parsed: Column, keys: Column, rules: list[FieldRule], extra_allowed: bool) -> Column:
    found: list[Column] = []
    for rule in rules:
        path = f"$.{rule.name}"
        kind = kind_of(F.try_variant_get(parsed, path, "variant"))
        present = F.array_contains(keys, rule.name)
        tag = lambda problem, name=rule.name: F.lit(f"{problem}:{name}")
        if rule.required:
            found.append(F.when(~present, tag("missing")))
        allowed = [rule.kind, "null"] if rule.nullable else [rule.kind]
        found.append(F.when(present & ~F.coalesce(kind.isin(allowed), F.lit(False)), tag("type")))
        if rule.choices:
            value = F.try_variant_get(parsed, path, "string")
            found.append(F.when((kind == "string") & ~value.isin(*rule.choices), tag("choice")))
        if rule.low is not None or rule.high is not None:
            value = F.try_variant_get(parsed, path, "double")
            low = F.lit(float("-inf") if rule.low is None else rule.low)
            high = F.lit(float("inf") if rule.high is None else rule.high)
            found.append(F.when((kind == "number") & ~value.between(low, high), tag("range")))
    problems = F.array_compact(F.array(*found))
    if not extra_allowed:
        extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(r.name) for r in rules])))
        problems = F.concat(problems, F.transform(extra, lambda k: F.concat(F.lit("extra:"), k)))
    return F.when(F.coalesce(kind_of(parsed), F.lit("none")) != "object", F.array(F.lit("not_object"))).otherwise(problems)
