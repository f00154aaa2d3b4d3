"""Lists and maps of loosely typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelode.functions import text as T

_STRINGS = "array<string>"


def text_list(value: Column) -> Column:
    """A JSON value as a list of trimmed texts that are not empty: a scalar is a list of one; an object counts by its text, name or label, the first
    that is filled, or else as it stands; null and what is no JSON give none."""
    plain = F.trim(value)
    listed = F.coalesce(F.from_json(plain, _STRINGS), F.array().cast(_STRINGS))
    single = F.when(plain.startswith('"'), F.from_json(F.concat(F.lit("["), plain, F.lit("]")), _STRINGS)).otherwise(F.array(plain))
    items = F.when(plain.startswith("["), listed).otherwise(single)
    fields = lambda x: [F.nullif(F.get_json_object(x, f"$.{name}"), F.lit("")) for name in ("text", "name", "label")]
    shown = F.transform(items, lambda x: F.trim(F.when(F.trim(x).startswith("{"), F.coalesce(*fields(x), x)).otherwise(x)))
    good = F.filter(shown, lambda x: x.isNotNull() & (x != ""))
    return F.when(value.isNull() | (plain == "null") | F.try_parse_json(plain).isNull(), F.array().cast(_STRINGS)).otherwise(good)


def whitelisted(ids: Column, roster: Column) -> Column:
    """Ids that the roster has or that are unknown_N; without a roster, all that are not blank."""
    some = F.coalesce(ids, F.array().cast(_STRINGS))
    known = F.coalesce(roster, F.array().cast(_STRINGS))
    return F.when(F.size(known) > 0, F.filter(some, lambda x: F.array_contains(known, x) | x.startswith("unknown_"))).otherwise(F.filter(some, lambda x: x.isNotNull() & (F.trim(x) != "")))


def first_filled(texts: Column) -> Column:
    """The first text that is not empty, or null."""
    return F.try_element_at(F.filter(texts, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(1))


def zipped(paths: Column, times: Column, scenes: Column) -> Column:
    """path, timestamp and scene of each path; 0.0 and -1 where the other lists are too short."""
    return F.transform(F.arrays_zip(paths.alias("path"), times.alias("timestamp"), scenes.alias("scene")), lambda x: F.struct(x["path"].alias("path"), F.coalesce(x["timestamp"], F.lit(0.0)).alias("timestamp"), F.coalesce(x["scene"], F.lit(-1)).alias("scene")))


def valid_entries(mapping: Column, known: Column) -> Column:
    """The entries whose value is not null and known."""
    return F.map_filter(mapping, lambda _, v: v.isNotNull() & F.array_contains(known, v))


def last_valid(texts: Column, n: int) -> Column:
    """The last n distinct texts that say something, in order."""
    good = F.array_distinct(F.transform(F.filter(texts, lambda x: ~T.is_placeholder(x)), lambda x: F.trim(x)))
    return F.slice(good, F.greatest(F.size(good) - (n - 1), F.lit(1)), F.lit(n))


def frame_route(paths: Column, single: Column) -> Column:
    """Which way a shot's frames go: "multi" with two existing paths or more, "single" with one, or with a single one beside them, else "none"."""
    n = F.size(F.filter(F.coalesce(paths, F.array().cast(_STRINGS)), lambda p: F.coalesce(p, F.lit("")) != ""))
    return F.when(n >= 2, "multi").when((n == 1) | (F.coalesce(single, F.lit("")) != ""), "single").otherwise("none")
