"""Typed values out of a VARIANT of loosely typed JSON. A value that is missing, or null in JSON, counts as absent; a truth value reads as JSON writes it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelode.functions import coerce, lists
from framelode.functions import text as T


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID, BOOLEAN or a kind of number."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


def read_object(answer: Column) -> Column:
    """The JSON object that a model's answer holds, or null."""
    return F.get(F.filter(F.array(T.json_found(answer)), lambda value: kind(value) == "OBJECT"), F.lit(0))


def objects(value: Column, path: str) -> Column:
    """The objects of a list, as structs of their ``place`` in it and the ``item``; other items are left out, and what is no list has none."""
    items = F.coalesce(F.try_variant_get(value, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
    placed = F.transform(items, lambda x, i: F.struct(i.alias("place"), x.alias("item")))
    return F.filter(placed, lambda x: F.coalesce(kind(x["item"]) == "OBJECT", F.lit(False)))


def object_or_none(value: Column, path: str) -> Column:
    """The object at ``path``, null for anything else there."""
    found = at(value, path)
    return F.when(kind(found) == "OBJECT", found)


def raw_text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "string")


def text(value: Column, path: str, default: str = "") -> Column:
    """Trimmed, or the default for blank and absent."""
    return T.safe_text(raw_text(value, path), default)


def number(value: Column, path: str, default: float | None = 0.0) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{path}", "double"), F.lit(default).cast("double"))


def whole(value: Column, path: str) -> Column:
    """The whole part of a number or of a text that holds one, else null."""
    return F.try_variant_get(value, f"$.{path}", "double").try_cast("int")


def share(value: Column, path: str) -> Column:
    return coerce.unit_score(raw_text(value, path))


def flag(value: Column, path: str) -> Column:
    """Words for true and false; a number that is not zero is true, a text that holds one counts by the words alone."""
    told = raw_text(value, path)
    word = F.lower(F.trim(told))
    as_text = F.when(word.isin(*coerce.TRUE_WORDS), True).otherwise(False)
    return F.coalesce(F.when(kind(at(value, path)) == "STRING", as_text).otherwise(coerce.safe_bool(told)), F.lit(False))


def texts(value: Column, path: str) -> Column:
    """A list of trimmed texts; a single value is a list of one, an object counts by its text, name or label."""
    return lists.text_list(F.to_json(at(value, path)))


def filled(value: Column, path: str) -> Column:
    """Whether there is something: no blank text, zero, false or empty list."""
    told = raw_text(value, path)
    return F.coalesce(~told.isin("", "0", "false", "[]", "{}"), F.lit(False))
