"""Dates as cameras write them, read as laxly as embedded metadata needs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STAMP = r"^(\d{4})([:-])(\d{2})\2(\d{2})(?:[ T](\d{2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$"
TOLERANCE = 36 * 3600


def offset_seconds(text: Column) -> Column:
    """Seconds of ``Z`` or ``±HH:MM`` with at most 14 hours and 59 minutes; null otherwise."""
    part = lambda i: F.regexp_extract(text, r"^([+-])(\d{2}):(\d{2})$", i)
    hours, minutes = part(2).try_cast("int"), part(3).try_cast("int")
    seconds = F.when(part(1) == "-", -1).otherwise(1) * (hours * 3600 + minutes * 60)
    return F.when(text == "Z", 0).when((hours <= 14) & (minutes <= 59), seconds)


def stamp(text: Column) -> Column:
    """(seconds, zoned, timed) of a date, null where it is malformed. Day 31 of a short month rolls over."""
    trimmed = F.trim(text)
    part = lambda i: F.regexp_extract(trimmed, _STAMP, i)
    year, month, day = (part(i).try_cast("int") for i in (1, 3, 4))
    timed = part(5) != ""
    hour, minute, second = (F.when(part(i) == "", 0).otherwise(part(i).try_cast("int")) for i in (5, 6, 7))
    zone = part(8)
    offset = F.when(zone == "", 0).otherwise(offset_seconds(zone))
    good = (year > 0) & month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 60) & offset.isNotNull()
    days = F.unix_date(F.date_add(F.make_date(year, F.when(month.between(1, 12), month).otherwise(1), F.lit(1)), day - 1)).cast("long")
    return F.when(good, F.struct((days * 86400 + hour * 3600 + minute * 60 + second - offset).alias("seconds"), (zone != "").alias("zoned"), timed.alias("timed")))


def signed_at(text: Column) -> Column:
    """Seconds since 1970 of an RFC 3339 time, null for anything else; a fraction is cut."""
    good = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    plain = F.regexp_replace(F.upper(F.translate(text, " ", "T")), r"\.\d+", "")
    return F.when(good, F.unix_seconds(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))))


def iso(value: Column) -> Column:
    """The stamp as text; only the date where it has no time."""
    whole = F.timestamp_seconds(value["seconds"])
    return F.when(value["timed"], F.concat(F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss"), F.when(value["zoned"], "Z").otherwise(""))).otherwise(F.date_format(whole, "yyyy-MM-dd"))


def before(a: Column, b: Column) -> Column:
    """Whether one stamp is before the other; only stamps that are both zoned or both not are compared."""
    return F.coalesce((a["zoned"] == b["zoned"]) & (a["seconds"] < b["seconds"]), F.lit(False))


def exif_before(a: Column, a_offset: Column, b: Column, b_offset: Column) -> Column:
    """As :func:`before`, with separately stored offsets, which count only if there are both."""
    both = a_offset.isNotNull() & b_offset.isNotNull()
    shift = lambda s, o: F.struct((s["seconds"] - F.when(both & ~s["zoned"], o).otherwise(0)).alias("seconds"), (s["zoned"] | both).alias("zoned"))
    return before(shift(a, a_offset), shift(b, b_offset))


def anomalies(modified: Column, digitized: Column, original: Column, xmp_created: Column, xmp_modified: Column, xmp_date: Column, offsets: tuple[Column, Column, Column]) -> Column:
    """Names of what is wrong among a file's dates, sorted. ``offsets`` are those of the first three, in seconds or null."""
    far = F.abs(original["seconds"] - xmp_date["seconds"]) > TOLERANCE
    return F.array_compact(F.array(
        F.when(far, "capture_dates_disagree"),
        F.when(exif_before(digitized, offsets[1], original, offsets[2]), "digitized_before_capture"),
        F.when(exif_before(modified, offsets[0], original, offsets[2]), "modified_before_capture"),
        F.when(before(xmp_modified, xmp_created), "xmp_modified_before_created"),
    ))
