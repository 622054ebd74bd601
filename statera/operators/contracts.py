"""Contracts of JSON details compiled to columns: one expression for each (regime, record type), evaluated in the JVM.

Understood words: type (one or several), properties, required, additionalProperties (false or a schema), items, enum,
anyOf, minimum, maximum, minLength and references to definitions of the same contract.  A contract with any other word
is refused when it is compiled.  References that lead back to themselves are followed ``DEEPEST`` times; details that go
deeper breach the contract rather than pass unseen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = {"type", "properties", "required", "additionalProperties", "items", "enum", "anyOf", "minimum", "maximum", "minLength", "$ref", "$defs"}
DEEPEST = 3
_KINDS = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*"}
_NESTED = {"array": "array<variant>", "object": "map<string,variant>"}


def _none() -> Column:
    return F.lit(None).cast("string")


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def _is(value: Column, kind: str) -> Column:
    if kind in _NESTED:  # the shape of all that is inside is not asked for
        return F.try_variant_get(value, "$", _NESTED[kind]).isNotNull()
    shape = F.schema_of_variant(value)
    if kind == "integer":
        number = F.try_variant_get(value, "$", "decimal(38,9)")
        return (shape == "BIGINT") | (shape.rlike("^(DOUBLE|FLOAT|DECIMAL.*)$") & F.coalesce(number == F.floor(number), F.lit(False)))
    return shape.rlike(f"^({_KINDS[kind]})$")


def breach(schema: dict, value: Column, at: str = "$", defs: dict | None = None, deep: int = 0) -> Column:
    """The first breach of a contract by a variant, as its path and the word that is broken; null where there is none."""
    if strange := schema.keys() - WORDS:
        raise ValueError(f"contract words that are not understood: {sorted(strange)}")
    defs = schema.get("$defs", defs or {})
    if "$ref" in schema:
        if deep == DEEPEST:
            return F.lit(f"{at} depth")
        return breach(defs[schema["$ref"].removeprefix("#/$defs/")], value, at, defs, deep + 1)
    arms: list[Column] = []
    say = lambda wrong, word: arms.append(F.when(wrong, F.lit(f"{at} {word}")))
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fits = _is(value, kinds[0])
        for kind in kinds[1:]:
            fits = fits | _is(value, kind)
        say(~fits, "type")
    if "enum" in schema:
        say(~F.coalesce(F.try_variant_get(value, "$", "string").isin(*schema["enum"]), F.lit(False)), "enum")
    if "anyOf" in schema:
        wrong = F.lit(True)
        for other in schema["anyOf"]:
            wrong = wrong & breach(other, value, at, defs, deep).isNotNull()
        say(wrong, "anyOf")
    number = F.try_variant_get(value, "$", "double")
    if "minimum" in schema:
        say(_is(value, "number") & (number < schema["minimum"]), "minimum")
    if "maximum" in schema:
        say(_is(value, "number") & (number > schema["maximum"]), "maximum")
    if "minLength" in schema:
        say(_is(value, "string") & (F.char_length(F.try_variant_get(value, "$", "string")) < schema["minLength"]), "minLength")
    if schema.keys() & {"properties", "required", "additionalProperties"}:
        arms.append(F.when(_is(value, "object"), _with(F.try_variant_get(value, "$", "map<string,variant>"), lambda members: _members(schema, members, at, defs, deep))))
    if "items" in schema:
        items = F.when(_is(value, "array"), F.try_variant_get(value, "$", "array<variant>"))
        arms.append(F.get(F.filter(F.transform(items, lambda x: breach(schema["items"], x, f"{at}[]", defs, deep)), lambda b: b.isNotNull()), 0))
    return F.coalesce(*arms, _none())


def _judge(schema: dict, at: str, defs: dict | None = None, deep: int = 0) -> Callable[[Column], Column]:
    return lambda value: breach(schema, value, at, defs, deep)


def _document(schema: dict) -> Callable[[Column], Column]:
    return lambda value: F.when(value.isNull(), "$ json").otherwise(F.coalesce(breach(schema, value), F.lit("ok")))


def _members(schema: dict, members: Column, at: str, defs: dict, deep: int) -> Column:
    keys, known = F.map_keys(members), schema.get("properties", {})
    arms = []
    if schema.get("required"):
        lacking = F.array_except(F.array(*map(F.lit, schema["required"])), keys)
        arms.append(F.when(F.size(lacking) > 0, F.concat(F.lit(f"{at}."), F.get(lacking, 0), F.lit(" required"))))
    for key, inner in known.items():
        arms.append(F.when(F.map_contains_key(members, key), _with(F.try_element_at(members, F.lit(key)), _judge(inner, f"{at}.{key}", defs, deep))))
    more = schema.get("additionalProperties", True)
    if more is not True:
        extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, known)).cast("array<string>")))
        if more is False:
            arms.append(F.when(F.size(extra) > 0, F.concat(F.lit(f"{at}."), F.get(extra, 0), F.lit(" unknown"))))
        else:
            wrong = F.filter(F.transform(extra, lambda k: breach(more, F.try_element_at(members, k), f"{at}.*", defs, deep)), lambda b: b.isNotNull())
            arms.append(F.get(wrong, 0))
    return F.coalesce(*arms, _none())


def checked(contracts: dict[tuple[str, str], dict], regime: Column, record_type: Column, details: Column) -> Column:
    """The breach of the contract of a record's regime and type by its details (JSON text), or ok; without a contract, unregistered."""
    out = F.lit("unregistered")
    for (code, kind), schema in contracts.items():
        found = _with(F.try_parse_json(details), _document(schema))
        out = F.when((regime == code) & (record_type == kind), found).otherwise(out)
    return out
