"""Functions of tag arrays. A key may come more than once; the first one counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import TAGS


def no_tags() -> Column:
    return F.array().cast(TAGS)


def tag(key: Column | str, value: Column | str) -> Column:
    """A tag; a null value becomes an empty string."""
    key = F.lit(key) if isinstance(key, str) else key
    value = F.lit(value) if isinstance(value, str) else value
    return F.struct(key.alias("key"), F.coalesce(value, F.lit("")).alias("value"))


def get_tag(tags: Column, key: str) -> Column:
    return F.get(F.filter(tags, lambda t: t["key"] == key), F.lit(0))["value"]


def has_tag(tags: Column, key: str, value: str | None = None) -> Column:
    """Whether the key is there; with a value, whether its first value is that."""
    first = get_tag(tags, key)
    return F.coalesce(first.isNotNull() if value is None else first == value, F.lit(False))


def has_no_tags(tags: Column) -> Column:
    return F.coalesce(F.size(tags), F.lit(0)) <= 0


def tag_is_true(tags: Column, key: str) -> Column:
    return F.coalesce(F.lower(get_tag(tags, key)).isin("yes", "true", "1"), F.lit(False))


def tag_is_false(tags: Column, key: str) -> Column:
    return F.coalesce(F.lower(get_tag(tags, key)).isin("no", "false", "0"), F.lit(False))


def parse_tags(text: Column) -> Column:
    """k=v;k=v as tags: trailing empty pieces go, a piece without = has an empty value."""
    pieces = F.split(F.regexp_replace(text, ";+$", ""), ";")
    return F.transform(pieces, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, F.lit("=")) + 1)).otherwise("").alias("value")))


def add_tag(tags: Column, key: str, value: Column | str) -> Column:
    return F.concat(F.coalesce(tags, no_tags()), F.array(tag(key, value)).cast(TAGS))


def add_or_replace_tag(tags: Column, key: str, value: Column | str) -> Column:
    """The first tag with this key, in either case, takes the value and keeps its spelling; else the tag is appended."""
    value = F.lit(value) if isinstance(value, str) else value
    own = F.coalesce(tags, no_tags())
    place = F.array_position(F.transform(own, lambda t: F.lower(t["key"])), key.lower())
    changed = F.transform(own, lambda t, i: F.struct(t["key"].alias("key"), F.when(i + 1 == place, value).otherwise(t["value"]).alias("value")))
    return F.when(place > 0, changed).otherwise(add_tag(own, key, value))


def tag_text(t: Column) -> Column:
    return F.concat(t["key"], F.lit("="), t["value"])


def tags_equal(a: Column, b: Column) -> Column:
    """In order; none and null are the same."""
    return F.coalesce(a, no_tags()) == F.coalesce(b, no_tags())


def retain_keys(tags: Column, keys: list[str] | None) -> Column:
    """Only tags of the given keys; None keeps all."""
    return tags if keys is None else F.filter(tags, lambda t: t["key"].isin(keys))
