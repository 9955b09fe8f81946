"""Zone transition tables of the installed tz database, for vectorised conversion of wall-clock times."""

from __future__ import annotations

import importlib.resources
import struct
import zoneinfo
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np

#: Rules are unrolled up to the first year, and, for times beyond it, up to the second; those later still are taken back by whole cycles.
LAST_YEAR, FAR_YEAR = 2120, 2560
#: The Gregorian calendar, weekdays included, repeats after 400 years, and with it a zone's closing rule.
CYCLE = 146_097 * 86_400


def version() -> str:
    """Version of the tz database in use, to be stored beside results."""
    for root in zoneinfo.TZPATH:
        try:
            with open(f"{root}/tzdata.zi") as file:
                return file.readline().rsplit(" ", 1)[-1].strip()
        except OSError:
            continue
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "system"


@lru_cache(maxsize=None)
def names() -> frozenset[str]:
    return frozenset(zoneinfo.available_timezones())


@lru_cache(maxsize=None)
def transitions(name: str, last_year: int = LAST_YEAR) -> tuple[np.ndarray, np.ndarray] | None:
    """(starts, offsets) in seconds: ``offsets[i]`` holds from ``starts[i]`` on (UTC), as far as the year. None: no such zone."""
    if name not in names():
        return None
    try:
        zone = zoneinfo.ZoneInfo(name)
        starts, offsets = _stored(name)
    except (OSError, ValueError, zoneinfo.ZoneInfoNotFoundError):
        return None
    # Beyond the last stored transition the zone's closing rule holds; it is unrolled here.
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    offset = lambda s: int((epoch + timedelta(seconds=s)).astimezone(zone).utcoffset().total_seconds())
    at = max(starts[-1] if len(starts) > 1 else 0, 0)
    end, step = int((last_year - 1970) * 365.2425 * 86400), 7 * 86400
    while at < end:
        if offset(at + step) != offset(at):
            low, high = at, at + step
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == offset(low) else (low, mid)
            starts.append(high)
            offsets.append(offset(high))
        at += step
    return np.array(starts, np.int64), np.array(offsets, np.int64)


def _stored(name: str) -> tuple[list[int], list[int]]:
    """The transitions stored in the zone's TZif file (RFC 8536), its 64-bit block."""
    data = None
    for root in zoneinfo.TZPATH:
        try:
            with open(f"{root}/{name}", "rb") as file:
                data = file.read()
            break
        except OSError:
            continue
    if data is None:
        data = importlib.resources.files("tzdata.zoneinfo").joinpath(*name.split("/")).read_bytes()

    def header(at: int) -> tuple[int, ...]:
        if data[at : at + 4] != b"TZif":
            raise ValueError(name)
        return struct.unpack(">6l", data[at + 20 : at + 44])

    isut, isstd, leap, times, types, chars = header(0)
    at = 44 + times * 5 + types * 6 + chars + leap * 8 + isstd + isut
    isut, isstd, leap, times, types, chars = header(at)
    at += 44
    starts = list(struct.unpack(f">{times}q", data[at : at + 8 * times]))
    kinds = data[at + 8 * times : at + 9 * times]
    at += 9 * times
    utc = [struct.unpack(">lbb", data[at + 6 * i : at + 6 * i + 6])[0] for i in range(types)]
    return [-(1 << 62), *starts], [utc[0], *[utc[k] for k in kinds]]


def to_utc(wall: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of wall-clock seconds, and how many instants showed that wall time (0, 1 or more)."""
    found = np.zeros(len(wall), np.int64)
    utc = np.zeros(len(wall), np.int64)
    seconds = lambda year: int((year - 1970) * 365.2425 * 86400)
    far = wall > seconds(LAST_YEAR - 1)
    if far.any():
        back = np.maximum(0, -((seconds(FAR_YEAR - 10) - wall) // CYCLE)) * CYCLE * far
        utc[~far], found[~far] = to_utc(wall[~far], name)
        there, found[far] = _to_utc(wall[far] - back[far], transitions(name, FAR_YEAR))
        utc[far] = there + back[far]
        return utc, found
    return _to_utc(wall, transitions(name))


def _to_utc(wall: np.ndarray, table: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    found = np.zeros(len(wall), np.int64)
    utc = np.zeros(len(wall), np.int64)
    if table is None:
        return utc, found
    starts, offsets = table
    ends = np.append(starts[1:], np.iinfo(np.int64).max)
    # Offsets are below a day and a half, so only the intervals that touch this span can apply.
    low = np.searchsorted(starts, wall - 129_600, "right") - 1
    high = np.searchsorted(starts, wall + 129_600, "right") - 1
    for k in range(int((high - low).max(initial=-1)) + 1):
        i = np.minimum(low + k, high)
        u = wall - offsets[i]
        # An interval that changes only the abbreviation leaves the offset: the instant is the same, once.
        new = (low + k <= high) & (u >= starts[i]) & (u < ends[i])
        utc = np.where(new, u, utc)
        found += new
    return utc, found
