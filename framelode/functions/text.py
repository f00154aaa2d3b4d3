"""Words, keywords, term hits, identifiers and prefixes of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the query language sees it, the ideographic space included.
WHITE = r"[\s\x{3000}]+"
#: Characters stripped from both ends of a keyword.
KEYWORD_MARKS = "，。！？、：；\"\"''（）【】,.!?:;\"'()[]"
#: Texts that stand for no text, and the marks stripped before the comparison.
PLACEHOLDERS = ("无", "无变化", "无明显变化", "没有变化", "没有明显变化", "暂无", "暂无描述", "无法判断", "无法辨认", "不确定", "未知", "none", "null", "n/a", "na", "-", "--")
PLACEHOLDER_MARKS = " \t\r\n。.!！,，;；:："


def parts(text: Column) -> Column:
    """The runs between white space; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased words, repeated ones too."""
    return parts(F.lower(text))


def pairs_of(part: Column) -> Column:
    """All two-character substrings."""
    return F.when(F.length(part) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(part) - 1), lambda i: part.substr(i, F.lit(2))))


def beyond_ascii(part: Column) -> Column:
    return F.length(part) != F.octet_length(part)


def two_grams(text: Column) -> Column:
    """Two-character substrings of the parts that hold a character beyond ASCII, case kept."""
    return F.flatten(F.transform(F.filter(parts(text), beyond_ascii), pairs_of))


def keywords(text: Column, limit: int = 100) -> Column:
    """Words of two characters or more without outer marks, lower-cased, and the two-grams; distinct, in code point order, ``limit`` at most."""
    words = F.filter(F.transform(parts(text), lambda w: F.lower(F.btrim(w, F.lit(KEYWORD_MARKS)))), lambda w: F.length(w) >= 2)
    return F.slice(F.array_sort(F.array_distinct(F.concat(words, two_grams(text)))), 1, limit)


def query_terms(query: Column) -> Column:
    """The distinct words of a query and the two-grams of its words beyond ASCII."""
    return F.array_distinct(F.concat(tokens(query), two_grams(F.lower(query))))


def description_words(text: Column) -> Column:
    """The distinct words of a text with spaces, and all two-character substrings of one without; case stays."""
    some = F.coalesce(text, F.lit(""))
    pairs = F.when(F.length(some) > 2, pairs_of(some)).when(some != "", F.array(some)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(F.contains(some, F.lit(" ")), parts(some)).otherwise(pairs))


def hits(terms: Column, text: Column) -> Column:
    """How many of the terms, repeated ones each time, are substrings of the lower-cased text."""
    low = F.lower(text)
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def prefix(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def safe_text(text: Column, default: str = "") -> Column:
    """Trimmed text, or the default for null and blank."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))


def is_placeholder(text: Column) -> Column:
    stripped = F.lower(F.btrim(safe_text(text), F.lit(PLACEHOLDER_MARKS)))
    return (safe_text(text) == "") | stripped.isin(*PLACEHOLDERS)


def slug(name: Column, size: int = 30, default: str = "video") -> Column:
    """A name as an identifier: letters, digits and CJK, all else as single underscores."""
    clean = F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9\x{4e00}-\x{9fff}]", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.substring(F.lower(F.btrim(clean, F.lit("_"))), 1, size), F.lit("")), F.lit(default))


def short_hash(text: Column, digits: int = 8) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, digits)


def json_value(text: Column) -> Column:
    """A text that is one JSON value, as VARIANT, else null. Spark's own parser takes what follows the first value for nothing; as an item of a list with one more, it must end there.
    A lambda's variable, unlike a column that is named twice, is read once."""
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(",0]"))), "$", "array<variant>")
    return F.get(F.transform(F.filter(F.array(items), lambda x: F.size(x) == 2), lambda x: F.get(x, F.lit(0))), F.lit(0))


def _json_tries(text: Column) -> list[Column]:
    return [F.trim(F.regexp_extract(text, p, 1)) for p in (r"(?s)```json\s*(.*?)```", r"(?s)```\s*(.*?)```", r"(?s)(\[.*\])", r"(?s)(\{.*\})")] + [F.trim(text)]


def json_block(text: Column) -> Column:
    """The first of these that is JSON: a fenced block named json, any fenced block, the outermost list, the outermost object, the whole."""
    return F.coalesce(*[F.when(json_value(t).isNotNull(), t) for t in _json_tries(text)])


def json_found(text: Column) -> Column:
    """The same as VARIANT."""
    return F.coalesce(*map(json_value, _json_tries(text)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays; 0 for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
