"""Text forms of numbers, times and entities."""

from __future__ import annotations

import enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tags import no_tags
from .tiles import degrees


class Timescale(enum.Enum):
    DAY = 86400
    HOUR = 3600
    MINUTE = 60

    def lower(self) -> str:
        return self.name.lower()


def tags_text(tags: Column) -> Column:
    """key=value; for each tag in order."""
    return F.array_join(F.transform(F.coalesce(tags, no_tags()), lambda t: F.concat(t["key"], F.lit("="), t["value"], F.lit(";"))), "")


def node_line() -> Column:
    return F.format_string("N %d %2.6f %3.6f %s", F.col("id"), degrees(F.col("fixed_lat")), degrees(F.col("fixed_lon")), tags_text(F.col("tags")))


def way_line() -> Column:
    return F.format_string("W %d %s", F.col("id"), tags_text(F.col("tags")))


def relation_line() -> Column:
    return F.format_string("R %d %s", F.col("id"), tags_text(F.col("tags")))


def speed_text(kph: Column) -> Column:
    return F.format_string("%1.1f kph", kph)


def human_count(n: Column) -> Column:
    """Over a thousand in thousands, over a million in millions."""
    return F.when(n > 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n > 1000, F.format_string("%dk", F.floor(n / 1000))).otherwise(n.cast("string"))


def epoch_text(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd HH:mm:ss")


def sequence_path(n: Column) -> Column:
    return F.format_string("%03d/%03d/%03d", F.floor(n / 1_000_000), F.pmod(F.floor(n / 1000), F.lit(1000)), F.pmod(n, F.lit(1000)))


def state_epoch(text: Column) -> Column:
    """The timestamp of a state file, whose colons are escaped, as epoch seconds."""
    return F.unix_timestamp(F.to_timestamp(F.replace(text, F.lit("\\:"), F.lit(":"))))


def member_text(m: Column) -> Column:
    return F.concat(m["type"], F.lit(" "), m["id"].cast("string"), F.when(F.coalesce(m["role"], F.lit("")) != "", F.concat(F.lit(" as "), m["role"])).otherwise(""))


def tag_list_text(tags: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(tags, no_tags()), lambda t: F.concat(t["key"], F.lit("="), t["value"])), ", "), F.lit("]"))


def node_text() -> Column:
    return F.concat(F.lit("[Node "), degrees(F.col("fixed_lat")).cast("string"), F.lit(" "), degrees(F.col("fixed_lon")).cast("string"), F.lit("]"))


def way_text() -> Column:
    return F.format_string("Way with %d tags and %d nodes", F.greatest(F.coalesce(F.size("tags"), F.lit(0)), F.lit(0)), F.size("nodes"))


def relation_text() -> Column:
    lines = F.array_join(F.transform("members", lambda m: F.concat(F.lit("  "), member_text(m), F.lit("\n"))), "")
    return F.concat(F.lit("relation with tags "), tag_list_text(F.col("tags")), F.lit("\n"), lines, F.lit("\n"))
