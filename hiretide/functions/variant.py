"""Reading loosely typed JSON documents held as VARIANT columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiretide.functions import dates
from hiretide.functions.expr import bound, clean_list, no_strings, not_empty, present, squeeze

NUMERIC = r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def path(*keys: str | int) -> str:
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in keys)


def at(doc: Column, *keys: str | int) -> Column:
    """The value under a path; NULL when absent.  A JSON null stays a (typeless)
    value, so that an overlaid null hides what is below it."""
    return F.try_variant_get(doc, path(*keys), "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_string(value: Column) -> Column:
    return kind(value) == "STRING"


def _raw(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _text(v: Column) -> Column:
    return F.when(is_string(v), present(_raw(v)))


def text(value: Column) -> Column:
    """A JSON string that is not blank, stripped; anything else is NULL."""
    return bound(value, _text)


def first_of(shape: Callable[[Column], Column], values: list[Column]) -> Column:
    """First non-NULL ``shape(value)``; the shape is spelled out once for all."""
    if len(values) == 1:
        return bound(values[0], shape)
    return F.get(F.array_compact(F.transform(F.array(*values), shape)), F.lit(0))


def _scalar(v: Column) -> Column:
    flag = F.when(_raw(v) == "true", "True").otherwise("False")
    return F.when(kind(v) == "BOOLEAN", flag).otherwise(present(_raw(v)))


def scalar_text(value: Column) -> Column:
    """Any scalar as stripped text, NULL when blank."""
    return bound(value, _scalar)


def _truthy(v: Column) -> Column:
    return F.when(~(~is_string(v) & _raw(v).isin("0", "0.0", "false")), _scalar(v))


def truthy_text(value: Column) -> Column:
    """Scalar text, where the number zero and false count as missing."""
    return bound(value, _truthy)


def elements(value: Column) -> Column:
    """The elements of a JSON array, NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def objects(value: Column) -> Column:
    """The JSON objects of an array."""
    return F.filter(elements(value), lambda v: kind(v).startswith("OBJECT"))


def _listed(v: Column) -> Column:
    many = clean_list(F.transform(elements(v), _raw))
    return F.when(kind(v).startswith("ARRAY"), many).otherwise(F.array_compact(F.array(_scalar(v))))


def string_list(value: Column) -> Column:
    """A scalar or a list of scalars as stripped, non-blank strings."""
    return F.coalesce(bound(value, _listed), no_strings())


def named(value: Column, *keys: str) -> Column:
    """Stripped, non-blank strings under the first usable key of each object."""
    def one(item: Column) -> Column:
        return first_of(_truthy, [at(item, k) for k in keys])

    return F.coalesce(F.array_compact(F.transform(objects(value), one)), no_strings())


def _date(v: Column) -> Column:
    number = F.when(kind(v).rlike(NUMERIC), F.try_variant_get(v, "$", "double"))
    return F.coalesce(dates.epoch_timestamp(number), dates.listing_timestamp(F.when(is_string(v), _raw(v))))


def date(value: Column) -> Column:
    """T1 on a loosely typed value: number as epoch, string as written date."""
    return bound(value, _date)


def event_date(value: Column) -> Column:
    """T4 on a loosely typed value."""
    def parse(v: Column) -> Column:
        number = F.when(kind(v).rlike(NUMERIC), F.try_variant_get(v, "$", "double"))
        return F.coalesce(dates.epoch_timestamp(number), dates.event_timestamp(F.when(is_string(v), _raw(v))))

    return bound(value, parse)


def first_value(doc: Column, *keys: str) -> Column:
    """First value that is neither absent, null nor the empty string.  Keys are looked
    up one by one, up to the first that is filled."""
    def filled(key: str) -> Column:
        # absent and null read as NULL, and only an empty string reads as one
        return F.when(F.try_variant_get(doc, path(key), "string") != "", at(doc, key))

    return F.coalesce(*map(filled, keys))


def _line(value: Column) -> Column:
    """One line of text: an object gives its name, text or url; a list gives the
    first such text in it."""
    def flat(v: Column) -> Column:
        inner = F.coalesce(*[not_empty(squeeze(_raw(at(v, k)))) for k in ("name", "text", "url")])
        other = not_empty(squeeze(scalar_text(v)))
        return bound(kind(v), lambda k: F.when(k == "STRING", not_empty(squeeze(_raw(v)))).when(k.startswith("OBJECT"), inner).otherwise(other))

    # scalars and objects are wrapped, so that the reading is spelled out once
    many = F.coalesce(elements(value), F.array(value))
    return F.get(F.array_compact(F.transform(many, flat)), F.lit(0))


def first_strings(doc: Column, *groups: tuple[str, ...]) -> Column:
    """One text per key group, as an array: the first filled value of the group."""
    return F.transform(F.array(*[first_value(doc, *g) for g in groups]), _line)


def first_string(doc: Column, *keys: str) -> Column:
    return F.get(first_strings(doc, keys), F.lit(0))


class Doc:
    """A JSON object with optional overriding layers (first layer wins)."""

    def __init__(self, *layers: Column):
        self.layers = layers

    def __getitem__(self, key: str) -> Column:
        return F.coalesce(*[at(layer, key) for layer in self.layers])

    def under(self, *keys: str) -> Column:
        return F.coalesce(*[at(layer, *keys) for layer in self.layers])

    def text(self, *keys: str) -> Column:
        """First key holding a non-blank JSON string."""
        return first_of(_text, [self[k] for k in keys])

    def truthy(self, *keys: str) -> Column:
        return first_of(_truthy, [self[k] for k in keys])

    def body(self, *keys: str) -> Column:
        """First non-empty value, unstripped."""
        return F.coalesce(*[not_empty(_raw(self[k])) for k in keys])

    def strings(self, *keys: str) -> Column:
        """String list of the first key that gives a non-empty one."""
        lists = F.transform(F.array(*[self[k] for k in keys]), _listed)
        return F.coalesce(F.get(F.filter(lists, lambda x: F.size(x) > 0), F.lit(0)), no_strings())

    def all_strings(self, *keys: str) -> Column:
        lists = F.transform(F.array(*[self[k] for k in keys]), lambda v: F.coalesce(_listed(v), no_strings()))
        return F.flatten(lists)

    def date(self, *keys: str) -> Column:
        return first_of(_date, [self[k] for k in keys])

    def first_date(self, *keys: str) -> Column:
        """Date of the first truthy key only."""
        usable = F.filter(F.array(*[self[k] for k in keys]), lambda v: _truthy(v).isNotNull())
        return date(F.get(usable, F.lit(0)))
