"""Names, labels and lenient values as they come from documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_name(name: Column) -> Column:
    """White space collapsed and words in title case; what map names are compared by."""
    return F.initcap(F.regexp_replace(F.trim(name), r"\s+", " "))


def event_stage(event_name: Column) -> Column:
    """The whole number after the word Stage; a name without one fails the job."""
    found = F.regexp_extract(F.coalesce(event_name, F.lit("")), r"Stage\s+(\d+)", 1)
    return F.when(found != "", F.try_to_number(found, F.lit("999999")).cast("int")).otherwise(F.raise_error(F.concat(F.lit("no stage in event name "), F.coalesce(event_name, F.lit("null")))).cast("int"))


def best_of(label: Column) -> Column:
    """The odd number in Bo<n>, or null."""
    n = F.regexp_extract(F.coalesce(label, F.lit("")), r"^\s*[Bb][Oo](\d+)\s*$", 1).try_cast("int")
    return F.when(n % 2 == 1, n)


def lenient_int(text: Column) -> Column:
    """A whole number, or null for any other text."""
    return F.trim(text).try_cast("int")


def lenient_float(text: Column) -> Column:
    """A number, a percent sign at its end ignored, or null for any other text."""
    return F.regexp_replace(F.trim(text), "%$", "").try_cast("double")


def match_id_of(url: Column) -> Column:
    """The first all-digit path segment of a match page, or null; event pages have none."""
    path = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    found = F.regexp_extract(path, r"^(?:https?://[^/]+)?/(\d+)(?:/|$)", 1)
    return F.when(found != "", found)


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two times, rounded down."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000)).cast("int")
