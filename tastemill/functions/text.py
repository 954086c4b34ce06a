"""Scalar expressions of the engine, ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_GENRES = "(no genres listed)"


def title_year(title: Column) -> Column:
    """The year in parentheses that ends a title, else null."""
    found = F.regexp_extract(F.trim(title), r"\((\d{4})\)\s*$", 1)
    return F.nullif(found, F.lit("")).try_cast("int")


def split_genres(genres: Column) -> Column:
    """Trimmed, non-empty parts of a pipe list; empty for null, blank or the no-genre marker."""
    parts = F.filter(F.transform(F.split(genres, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    none = genres.isNull() | (F.trim(genres) == "") | (F.trim(genres) == NO_GENRES)
    return F.when(none, F.array().cast("array<string>")).otherwise(parts)


def normal_tag(tag: Column) -> Column:
    """Lower case, runs of Unicode white space as one space, stripped; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(tag, F.lit(""))), r"(?U)[\s\x1c-\x1f]+", " "))


def utc_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def slug(text: Column) -> Column:
    """Lower case; runs other than a-z and 0-9 become ``_``; ``unknown`` if nothing is left."""
    joined = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(joined, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def movie_token(movie: Column) -> Column:
    return F.concat(F.lit("movie:"), movie.cast("string"))


def genre_token(genre: Column) -> Column:
    return F.concat(F.lit("genre:"), slug(genre))


def tag_token(tag: Column) -> Column:
    return F.concat(F.lit("tag:"), slug(tag))


def family(token: Column) -> Column:
    """The text before the first colon, ``unknown`` without one."""
    return F.when(F.contains(token, F.lit(":")), F.substring_index(token, ":", 1)).otherwise("unknown")


def seed_genre_token(genre: Column) -> Column:
    """The recommender's own genre rule: spaces and hyphens become ``_``, all else stays."""
    return F.concat(F.lit("genre:"), F.regexp_replace(F.lower(F.trim(genre)), "[ -]", "_"))


def title_case(text: Column) -> Column:
    """A capital after each character that is no letter."""
    return F.array_join(F.transform(F.split(F.lower(text), "(?<=[^a-z])(?=[a-z])"), F.initcap), "")


def _value(token: Column) -> Column:
    return F.substr(token, F.instr(token, ":") + 1)


def decode_report(token: Column, title: Column) -> Column:
    """A token for a report: a mark for its family, the title or a title-cased value."""
    kind, value = family(token), _value(token)
    return (
        F.when(kind == "movie", F.concat(F.lit("[M] "), F.coalesce(title, F.concat(F.lit("Unknown("), value, F.lit(")")))))
        .when(kind == "genre", F.concat(F.lit("[G] "), title_case(value)))
        .when(kind == "tag", F.concat(F.lit("[T] "), title_case(value)))
        .otherwise(token)
    )


def decode_display(token: Column, title: Column) -> Column:
    """A token for the recommender: the title or the token itself; genres title-cased with spaces; tags as they are."""
    kind, value = family(token), _value(token)
    return (
        F.when(kind == "movie", F.coalesce(title, token))
        .when(kind == "genre", title_case(F.replace(value, F.lit("_"), F.lit(" "))))
        .when(kind == "tag", value)
        .otherwise(token)
    )


def join_sorted(texts: Column) -> Column:
    return F.array_join(F.array_sort(texts), " + ")


def join_display(texts: Column) -> Column:
    return F.when(F.size(texts) == 0, "[]").otherwise(F.array_join(texts, " + "))


def rule_text(antecedent: Column, consequent: Column) -> Column:
    return F.concat(antecedent, F.lit(" -> "), consequent)


def rule_type(antecedent: Column, consequent: Column) -> Column:
    """genre_only, movie_only or tag_only if all tokens are of one family, else cross_type."""
    kinds = F.array_distinct(F.transform(F.concat(antecedent, consequent), family))
    one = F.size(kinds) == 1
    out = F.lit("cross_type")
    for kind in ("genre", "movie", "tag"):
        out = F.when(one & (F.get(kinds, F.lit(0)) == kind), f"{kind}_only").otherwise(out)
    return out


def first_movie(tokens: Column) -> Column:
    return F.get(F.filter(tokens, lambda t: t.startswith("movie:")), F.lit(0))


def short_label(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


# The literals of a list cell.
_QUOTED = r"""'(?:[^'\\\n]++|\\.)*+'|"(?:[^"\\\n]++|\\.)*+\""""
_NUMBER = r"[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+|0|[1-9][0-9]*)"
_ITEM = rf"(?:{_QUOTED}|{_NUMBER}|True|False|None)"
_ITEMS = rf"{_ITEM}(?:\s*,\s*{_ITEM})*+"
_LIST = rf"^\[\s*(?:{_ITEMS}\s*,?)?\s*\]$"
_TUPLE = rf"^\(\s*(?:{_ITEM}\s*,\s*(?:{_ITEMS}\s*,?)?)?\s*\)$"
_SET = rf"^\{{\s*{_ITEMS}\s*,?\s*\}}$"


def _json_string(item: Column) -> Column:
    """A literal as a JSON string: quotes and escapes as JSON has them, other backslashes doubled."""
    inner = F.substring(item, F.lit(2), F.length(item) - 2)

    def part(x: Column) -> Column:
        x = F.replace(F.replace(x, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))
        x = F.regexp_replace(x, r"\\(?![nrtbfu])", r"\\\\")
        return F.replace(F.replace(x, F.lit('"'), F.lit('\\"')), F.lit("\t"), F.lit("\\t"))

    text = F.array_join(F.transform(F.split(inner, r"\\\\", -1), part), "\\\\")
    number = item.try_cast("double")
    plain = F.abs(number).between(1e-3, 1e7) | (number == 0)
    shown = F.when(item.contains(".") & plain, number.cast("string")).otherwise(F.regexp_replace(item, r"^\+", ""))
    return F.concat(F.lit('"'), F.when(F.left(item, F.lit(1)).isin("'", '"'), text).otherwise(shown), F.lit('"'))


def token_list(cell: Column) -> Column:
    """A list cell given as text: a list, tuple or set of quoted strings, numbers, True, False and None, as their texts; null and blank are empty.

    Any other text is one token, also a bracketed one that is no such literal: a dictionary, nested lists, ``('a')`` without a comma. A set keeps each
    token once, in the order of its text. Escapes that JSON lacks (``\\x``, ``\\v``, octal ones) stay as written.
    """
    raw = F.trim(F.regexp_replace(cell, r"^\s+|\s+$", ""))
    listed = F.regexp_like(raw, F.lit(_LIST)) | F.regexp_like(raw, F.lit(_TUPLE)) | F.regexp_like(raw, F.lit(_SET))
    items = F.transform(F.regexp_extract_all(raw, F.lit(_ITEM), F.lit(0)), _json_string)
    found = F.from_json(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")), "array<string>")
    found = F.when(raw.startswith("{"), F.array_distinct(found)).otherwise(found)
    none = F.array().cast("array<string>")
    bare = F.when(raw == "", none).otherwise(F.array(raw))
    return F.when(cell.isNull(), none).when(listed, F.coalesce(found, bare)).otherwise(bare)


def required_count(support: float, n: Column) -> Column:
    return F.ceil(F.lit(float(support)) * n)


def cut_point(low: Column, high: Column, fraction: float) -> Column:
    """The time at which ``1 - fraction`` of the span is over."""
    a, b = F.unix_micros(low), F.unix_micros(high)
    return F.timestamp_micros((a + (b - a) * F.lit(1.0 - fraction)).cast("bigint"))


def split_index(n: Column, fraction: float) -> Column:
    """How many of a user's n rows train: at least one and not all of two or more, none of one."""
    k = (F.lit(1.0 - fraction) * n).cast("bigint")
    return F.when(n >= 2, F.least(F.greatest(k, F.lit(1)), n - 1)).otherwise(k)
