"""Normalising timestamps of mixed formats, precisions and zones to UTC.

Values are tokenised into character-class shape masks inside the JVM. Each distinct mask is mapped to a
parser once per worker; a batch is then parsed mask by mask with vectorised extraction, and wall-clock
times are converted with numpy through the transition tables of :mod:`attesta.functions.zones`. The
batches are Arrow batches, nothing is shuffled but what distinct results need.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import zones

#: Usual offsets, in minutes, of short zone names.
SHORT_ZONES = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0,
    "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
    "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)} | {
    m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)
}
WEEKDAYS = {d: i for i, d in enumerate("mon tue wed thu fri sat sun".split())}

#: An hour offset beyond this is no offset.
MOST_OFFSET_HOURS = 14

_FRACTION = r"(?:[.,](?P<fraction>\d+))?"
_ZONE = r"(?:\s?(?P<sign>[+\-−])(?P<oh>\d{2}):?(?P<om>\d{2})?|\s?(?P<word>[A-Za-z]+))?(?:\[(?P<region>[^\]]*)\])?"
_CLOCK = r"(?P<hour>\d{2}):(?P<minute>\d{2})(?::(?P<second>\d{2})" + _FRACTION + ")?"
#: (mask pattern, extraction pattern). In a mask each digit is 9 and each letter a; letters of a region are kept out.
_SHAPES = [
    (r"9999([:/\-])99\1(?:99)[a ]99:99(:99([.,]9+)?)?.*", r"(?P<year>\d{4})(?P<sep>[:/\-])(?P<month>\d{2})(?P=sep)(?P<day>\d{2})[Tt ]" + _CLOCK + _ZONE),
    (r"99999999a9999.*", r"(?P<year>\d{4})(?P<month>\d{2})(?P<day>\d{2})[Tt](?P<hour>\d{2})(?P<minute>\d{2})(?:(?P<second>\d{2})" + _FRACTION + ")?" + _ZONE),
    (r"99\.99\.9999 99:99.*", r"(?P<day>\d{2})\.(?P<month>\d{2})\.(?P<year>\d{4}) " + _CLOCK + _ZONE),
    (r"(aaa, )?99? a+ 9999 99:99.*", r"(?:(?P<weekday>[A-Za-z]{3}), )?(?P<day>\d{1,2}) (?P<name>[A-Za-z]+) (?P<year>\d{4}) " + _CLOCK + _ZONE),
    (r"a+ 99?, 9999 99?:99.*", r"(?P<name>[A-Za-z]+) (?P<day>\d{1,2}), (?P<year>\d{4}) (?P<hour>\d{1,2}):(?P<minute>\d{2})(?::(?P<second>\d{2})" + _FRACTION + r")?(?: (?P<half>[AaPp][Mm]))?" + _ZONE),
    # Plain numbers since 1970: seconds, milliseconds, microseconds, nanoseconds.
    (r"9{9,10}([.,]9+)?|9{13}|9{16}|9{19}", r"(?P<number>\d+)" + _FRACTION),
]
_FIELDS = ("year", "month", "day", "hour", "minute", "second", "fraction", "sign", "oh", "om", "word", "region", "weekday", "name", "half", "number")


@dataclass(frozen=True)
class Parser:
    """What a mask is read with; ``fields`` are the groups that its pattern has."""

    pattern: re.Pattern[str]
    fields: tuple[str, ...]


@lru_cache(maxsize=None)
def _parser(pattern: str) -> Parser:
    compiled = re.compile(rf"\A{pattern}\Z", re.ASCII)
    return Parser(compiled, tuple(f for f in _FIELDS if f in compiled.groupindex))


@lru_cache(maxsize=1 << 16)
def parser_of(mask: str) -> Parser | None:
    """The parser of a shape mask, or None where no shape denotes a time of day."""
    return next((_parser(pattern) for shape, pattern in _SHAPES if re.fullmatch(shape, mask, re.DOTALL)), None)


def shape_mask(value: Column) -> Column:
    """Digits become 9, letters a; what stands in brackets goes."""
    letters = string.ascii_letters
    plain = F.translate(value, "012345678" + letters, "9" * 9 + "a" * len(letters))
    return F.regexp_replace(plain, r"\[[^\]]*\]", "[]")


def trimmed(value: Column) -> Column:
    """Without outer blanks, controls and NULs, as scanners leave them."""
    return F.regexp_replace(value, r"^[\s\x00]+|[\s\x00]+$", "")


def offset_minutes(texts: pd.Series) -> pd.Series:
    """Minutes east of UTC of separately stored offsets (``+02:00``, ``-0700``, ``GMT+5``, ``Z``, short names); NaN where unusable."""
    distinct = {t: _offset(t) for t in texts.dropna().unique()}
    return texts.map(distinct).astype("float64")


def _offset(text: str) -> float:
    text = text.strip(" \t\r\n\0").replace("−", "-")
    if text.upper() in SHORT_ZONES:
        return float(SHORT_ZONES[text.upper()])
    m = re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{1,2})(?::?(\d{2}))?", text, re.ASCII | re.IGNORECASE)
    if not m or int(m[2]) > MOST_OFFSET_HOURS or int(m[3] or 0) > 59:
        return np.nan
    minutes = int(m[2]) * 60 + int(m[3] or 0)
    return float(minutes if m[1] == "+" else -minutes) if minutes <= MOST_OFFSET_HOURS * 60 else np.nan


def _days(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the civil date exists."""
    ok = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1)
    first = (np.where(ok, year, 1970) - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (np.where(ok, month, 1) - 1)
    length = ((first + 1).astype("datetime64[D]") - first.astype("datetime64[D]")).astype(np.int64)
    return first.astype("datetime64[D]").astype(np.int64) + np.where(ok, day, 1) - 1, ok & (day <= length)


def _microseconds(fraction: pd.Series) -> np.ndarray:
    return fraction.fillna("").str.slice(0, 6).str.pad(6, "right", "0").astype(np.int64).to_numpy()


def _parse(values: pd.Series, parser: Parser, offsets: pd.Series, regions: pd.Series) -> np.ndarray:
    """Microseconds since 1970 of values of one shape, or the least integer where they denote no single instant."""
    none = np.iinfo(np.int64).min
    out = np.full(len(values), none, np.int64)
    got = values.str.extract(parser.pattern)
    matched = got["number" if "number" in parser.fields else "year"].notna()
    if "number" in parser.fields:
        got = got[matched]
        scale = got.number.str.len().map({9: 10**6, 10: 10**6, 13: 10**3, 16: 1, 19: 0}).to_numpy()
        number = got.number.astype(np.int64).to_numpy()
        whole = np.where(scale == 0, number // 1000, number * scale)
        out[matched.to_numpy()] = whole + _microseconds(got.fraction)
        return out

    column = lambda name: got[name] if name in got else pd.Series(None, got.index, dtype=object)
    number = lambda s: pd.to_numeric(s, errors="coerce").fillna(-1).astype(np.int64).to_numpy()
    month = number(column("name").str.lower().map(MONTHS)) if "name" in got else number(got["month"])
    days, good = _days(number(got["year"]), month, number(got["day"]))
    hour, minute, second = number(got["hour"]), number(got["minute"]), number(column("second").fillna("0"))
    good &= matched.to_numpy() & (hour <= 23) & (minute <= 59) & (second <= 59)
    half, word = column("half").str.upper(), column("word").str.upper()
    if half.notna().any():
        good &= half.isna().to_numpy() | ((hour >= 1) & (hour <= 12))
        hour = np.where(half.notna(), hour % 12 + 12 * (half == "PM"), hour)
    if "weekday" in got:
        named = column("weekday").str.lower()
        good &= named.isna().to_numpy() | (number(named.map(WEEKDAYS)) == (days + 3) % 7)
    wall = days * 86400 + hour * 3600 + minute * 60 + second

    # The value's own offset or zone counts first.
    hours, minutes = number(column("oh")), number(column("om").fillna("0"))
    own = np.where(column("sign").notna(), np.where(column("sign") == "+", 1, -1) * (hours * 60 + minutes), np.nan).astype("float64")
    own[(hours > MOST_OFFSET_HOURS) | (minutes > 59) | (hours * 60 + minutes > MOST_OFFSET_HOURS * 60)] = np.nan
    own = np.where(np.isnan(own), word.map(SHORT_ZONES).astype("float64"), own)
    # A word that is no zone makes the value malformed.
    good &= (word.isna() | word.isin(list(SHORT_ZONES))).to_numpy()
    region = column("region").where(column("region").isin(zones.names()))
    fixed = pd.Series(own, got.index)
    fixed = fixed.where(fixed.notna() | region.notna(), offsets)
    zone = region.where(fixed.isna() & region.notna(), regions.where(fixed.isna()))

    known = fixed.notna().to_numpy()
    utc = wall - np.where(known, fixed.fillna(0).to_numpy() * 60, 0).astype(np.int64)
    once = known.copy()
    for name, at in zone[~fixed.notna()].dropna().groupby(zone).groups.items():
        where = got.index.get_indexer(at)
        utc[where], found = zones.to_utc(wall[where], name)
        once[where] = found == 1
    good &= once
    out[good] = utc[good] * 1_000_000 + _microseconds(column("fraction"))[good]
    return out


def _convert(batches: Iterator[pd.DataFrame], version: str) -> Iterator[pd.DataFrame]:
    if zones.version() != version:
        raise RuntimeError(f"this worker's tz database is {zones.version()}, the driver's {version}")
    none = np.iinfo(np.int64).min
    low, high = -62135596800 * 10**6, 253402300800 * 10**6  # years 1 to 9999
    for batch in batches:
        offsets = offset_minutes(batch["offset"])
        regions = batch["zone"].where(batch["zone"].isin(zones.names()))
        micros = np.full(len(batch), none, np.int64)
        # Masks that one parser reads are read together: batches hold many masks, but few parsers.
        parsers = {mask: parser_of(mask) for mask in batch["mask"].unique()}
        order = {id(p): p for p in parsers.values() if p}
        reads = batch["mask"].map({mask: id(p) if p else 0 for mask, p in parsers.items()}).to_numpy()
        for key, parser in order.items():
            if len(rows := np.flatnonzero(reads == key)):
                part = lambda s: s.iloc[rows].reset_index(drop=True)  # noqa: B023, E731
                micros[rows] = _parse(part(batch["value"]), parser, part(offsets), part(regions))
        good = (micros != none) & (micros >= low) & (micros < high)
        text = np.datetime_as_string(micros[good].astype("datetime64[us]"), unit="us")
        yield pd.DataFrame({"id": batch["id"][good], "utc": pd.Series(text, batch.index[good]) + "Z"})


def normalize_timestamps(df: DataFrame, record: Column, value: Column, offset: Column, zone: Column, versioned: bool = False) -> DataFrame:
    """``id`` (the ``record``) and ``utc`` (``yyyy-MM-ddTHH:mm:ss.SSSSSSZ``) of each value that denotes exactly one instant.

    - Sources of the zone, in this order: the value itself (an offset, a short name, a bracketed region),
      ``offset``, ``zone`` (a tz database name). An unusable one is passed over.
    - Plain numbers are time since 1970 in UTC. A time without seconds is the start of its minute.
      Digits beyond microseconds are cut.
    - No row comes of a null, empty or malformed value, of one without a time of day or any usable zone, of a
      wall-clock time that its zone's clocks showed twice or never, nor of a null ``record``.
    - Repeated rows give one row; different values under one record give one row each. An empty table gives
      none. Further columns of ``df`` don't matter.
    - All workers use the driver's version of the tz database, or fail; ``versioned`` adds it as ``tz_version``.
    """
    rows = df.select(record.cast("long").alias("id"), trimmed(value).alias("value"), trimmed(offset).alias("offset"), trimmed(zone).alias("zone"))
    # The repeats go here, where the rows are small, and whatever can't be a time never reaches Python.
    rows = rows.where("id is not null and value rlike '[0-9]{4}'").distinct().withColumn("mask", shape_mask(F.col("value")))
    version = zones.version()
    found = rows.mapInPandas(lambda batches: _convert(batches, version), "id long, utc string").distinct()
    return found.withColumn("tz_version", F.lit(version)) if versioned else found


def capture_times(exif_dates: DataFrame) -> DataFrame:
    """``exif_id`` and the UTC form of its capture time, for records that denote one instant."""
    found = normalize_timestamps(exif_dates, F.col("exif_id"), F.col("captured_at"), F.col("offset_original"), F.col("zone_name"))
    return found.select(F.col("id").alias("exif_id"), "utc")
