"""Contracts of JSON documents: a nested schema compiled to one column with the path of the first error.

A schema is built from the classes below. first_error() turns it into expressions over a VARIANT, in the order in which
the schema is written: what a value must be, then its missing and unknown keys, then its fields, then its own rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import bound, filled


@dataclass(frozen=True)
class Text:
    """A text; one of some, filled (not blank), or of a pattern."""

    one_of: tuple[str, ...] = ()
    filled: bool = False
    pattern: str = ""


@dataclass(frozen=True)
class Number:
    """A number, whole or of any kind, between two bounds. A truth value is none."""

    whole: bool = False
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Flag:
    """true or false."""


@dataclass(frozen=True)
class Equals:
    """This number or text."""

    value: int | str


@dataclass(frozen=True)
class Optional:
    """A null, or a value of the schema."""

    of: object


@dataclass(frozen=True)
class Map:
    """An object of any keys, whose values fit the schema (None: any)."""

    of: object = None


@dataclass(frozen=True)
class Items:
    """An array of values that fit the schema, `least` or more; the named fields of the items are distinct."""

    of: object
    least: int = 0
    unique: tuple[str, ...] = ()


@dataclass(frozen=True)
class Record:
    """An object with these fields; optional ones may be missing, and others too if it is open. rules: (name, function of a
    getter by field name) pairs, each true where the record breaks the rule; a getter gives texts."""

    fields: dict[str, object]
    optional: dict[str, object] = field(default_factory=dict)
    open: bool = False
    rules: tuple[tuple[str, Callable[[Callable[[str], Column]], Column]], ...] = ()


def first_error(document: Column, schema: object) -> Column:
    """'path: what is wrong' of the first error of a JSON text; '' if there is none. A text that is no JSON, or a null, is
    '$: not JSON'."""
    parsed = F.try_parse_json(document)
    return bound(parsed, lambda v: F.when(v.isNull(), F.lit("$: not JSON")).otherwise(F.coalesce(_error(v, schema, F.lit("$")), F.lit(""))))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _error(v: Column, schema: object, path: Column) -> Column:
    """The first error below v, null without one."""
    says = lambda text: F.concat(path, F.lit(": "), text if isinstance(text, Column) else F.lit(text))
    when = lambda broken, text: F.when(F.coalesce(broken, F.lit(True)), says(text))
    kind = _kind(v)
    if isinstance(schema, Text):
        checks = [when(kind != "STRING", "not a text")]
        if schema.filled:
            checks.append(when(~filled(_as(v, "string")), "blank"))
        if schema.one_of:
            checks.append(when(~_as(v, "string").isin(*schema.one_of), "not one of " + ", ".join(repr(x) for x in schema.one_of)))
        if schema.pattern:
            checks.append(when(~_as(v, "string").rlike(schema.pattern), "not of its form"))
        return F.coalesce(*checks) if len(checks) > 1 else checks[0]
    if isinstance(schema, Number):
        n, text = _as(v, "double"), "not a whole number" if schema.whole else "not a number"
        checks = [when(~(kind == "BIGINT") if schema.whole else ~kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), text)]
        if schema.low is not None:
            checks.append(when(n < schema.low, f"less than {schema.low:g}"))
        if schema.high is not None:
            checks.append(when(n > schema.high, f"more than {schema.high:g}"))
        return F.coalesce(*checks) if len(checks) > 1 else checks[0]
    if isinstance(schema, Flag):
        return when(kind != "BOOLEAN", "not a truth value")
    if isinstance(schema, Equals):
        own = "STRING" if isinstance(schema.value, str) else "BIGINT"
        same = (kind == own) & (_as(v, "string") == str(schema.value))
        return when(~same, f"not {schema.value!r}")
    if isinstance(schema, Optional):
        return F.when(kind != "VOID", _error(v, schema.of, path))
    if isinstance(schema, Map):
        wrong = when(~F.startswith(kind, F.lit("OBJECT")), "not an object")
        if schema.of is None:
            return wrong
        one = lambda m: lambda k: _error(F.try_element_at(m, k), schema.of, F.concat(path, F.lit("."), k))
        own = lambda m: F.filter(F.transform(F.array_sort(F.map_keys(m)), one(m)), lambda e: e.isNotNull())
        return F.coalesce(wrong, bound(_as(v, "map<string,variant>"), lambda m: F.get(own(m), F.lit(0))))
    if isinstance(schema, Items):
        return F.coalesce(when(~F.startswith(kind, F.lit("ARRAY")), "not an array"), bound(_as(v, "array<variant>"), lambda items: _items_error(items, schema, path, when)))
    if isinstance(schema, Record):
        return F.coalesce(when(~F.startswith(kind, F.lit("OBJECT")), "not an object"), bound(_as(v, "map<string,variant>"), lambda m: _record_error(m, schema, path, when)))
    raise TypeError(f"no schema: {schema!r}")


def _items_error(items: Column, schema: Items, path: Column, when: Callable) -> Column:
    own = F.transform(items, lambda x, i: _error(x, schema.of, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
    checks = [when(F.size(items) < schema.least, f"fewer than {schema.least}"), F.get(F.filter(own, lambda e: e.isNotNull()), F.lit(0))]
    for name in schema.unique:
        values = F.transform(items, _texts_of(name))
        checks.append(when(F.size(F.array_distinct(values)) < F.size(values), f"repeated {name}"))
    return F.coalesce(*checks)


def _texts_of(name: str) -> Callable[[Column], Column]:
    return lambda x: F.try_variant_get(x, f"$.{name}", "string")


def _record_error(m: Column, schema: Record, path: Column, when: Callable) -> Column:
    names = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    keys = F.map_keys(m)
    missing = F.array_sort(F.array_except(names(schema.fields), keys))
    checks = [when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))]
    if not schema.open:
        unknown = F.array_sort(F.array_except(keys, names([*schema.fields, *schema.optional])))
        checks.append(when(F.size(unknown) > 0, F.concat(F.lit("unknown "), F.array_join(unknown, ", "))))
    for name, own in schema.fields.items():
        checks.append(_error(F.try_element_at(m, F.lit(name)), own, F.concat(path, F.lit(f".{name}"))))
    for name, own in schema.optional.items():
        checks.append(F.when(F.array_contains(keys, name), _error(F.try_element_at(m, F.lit(name)), own, F.concat(path, F.lit(f".{name}")))))
    text = lambda name: F.try_variant_get(F.try_element_at(m, F.lit(name)), "$", "string")
    checks += [F.when(F.coalesce(broken(text), F.lit(False)), F.concat(path, F.lit(f": {name}"))) for name, broken in schema.rules]
    return F.coalesce(*checks)
