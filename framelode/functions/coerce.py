"""Loosely typed values to typed ones, null or a default where they can't be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for true and false.
TRUE_WORDS = ("true", "yes", "y", "1", "是", "有")
FALSE_WORDS = ("false", "no", "n", "0", "否", "无", "none", "null", "")
#: Media types by file extension.
MEDIA_TYPES = {
    "mp4": "video/mp4", "avi": "video/x-msvideo", "mov": "video/quicktime", "webm": "video/webm", "mkv": "video/x-matroska",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif",
    "wav": "audio/wav", "mp3": "audio/mpeg", "flac": "audio/flac", "ogg": "audio/ogg", "m4a": "audio/mp4",
}


def safe_float(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(value).try_cast("double"), F.lit(default))


def safe_int(value: Column) -> Column:
    """The whole part of a number, null for all else."""
    return F.trim(value).try_cast("double").try_cast("int")


def unit_score(value: Column, default: float = 0.0) -> Column:
    """A share of 0 to 1 from text: percent signs and numbers over 1 up to 100 count as percent."""
    text = F.trim(value)
    percent = text.endswith("%")
    number = F.trim(F.regexp_replace(text, "%$", "")).try_cast("double")
    scaled = F.when(percent | ((number > 1) & (number <= 100)), number / 100).otherwise(number)
    return F.when(scaled.isNull(), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def safe_bool(value: Column, default: bool = False) -> Column:
    """Words for true and false; a number is true unless it is zero; the default for all else."""
    text = F.lower(F.trim(value))
    number = text.try_cast("double")
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False).when(number.isNotNull(), number != 0).otherwise(default)


def frame_rate(ratio: Column, default: float = 30.0) -> Column:
    """Frames a second from "30000/1001"; the default for a zero or unreadable denominator."""
    both = F.split(ratio, "/")
    return F.coalesce(F.try_divide(F.try_element_at(both, F.lit(1)).try_cast("double"), F.try_element_at(both, F.lit(2)).try_cast("double")), F.lit(default))


def media_type(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in MEDIA_TYPES.items() for x in p]), ending), F.lit("application/octet-stream"))


def character_id(raw: Column, chunk_index: Column) -> Column:
    """An identifier in the scope of the whole: known ones stay, unknown_N is one of its chunk, all else is null."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    own = F.when(chunk_index >= 0, F.concat(F.lit("char_tmp_chunk_"), F.format_string("%04d", chunk_index), F.lit("_"), text)).otherwise(F.concat(F.lit("char_tmp_"), text))
    return F.when(text.startswith("char_") | text.startswith("entity_"), text).when(text.startswith("unknown_"), own)
