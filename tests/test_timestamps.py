import datetime as dt
import random
import zoneinfo

import numpy as np

from attesta.functions import zones
from attesta.operators import timestamps
from attesta.operators.timestamps import capture_times, parser_of

SCHEMA = "exif_id long, captured_at string, offset_original string, zone_name string, zoned boolean, mask string, value string"


def utc(spark, data):
    df = spark.createDataFrame([(*r, True, "m", "v") for r in data], SCHEMA)
    return {r[0]: r[1] for r in capture_times(df).collect()}


def test_formats(spark):
    cases = {
        1: ("2009:03:01 23:25:51", "+01:00", None, "2009-03-01T22:25:51.000000Z"),
        2: ("2023-11-02T15:58:46", None, "Europe/Lisbon", "2023-11-02T15:58:46.000000Z"),
        3: ("03 Mar 2023 07:58:04", "+0100", None, "2023-03-03T06:58:04.000000Z"),
        4: ("05.09.2010 10:40:57", "GMT+10:00", None, "2010-09-05T00:40:57.000000Z"),
        5: ("20231030T180643Z", None, None, "2023-10-30T18:06:43.000000Z"),
        6: ("1736318962", None, "America/Los_Angeles", "2025-01-08T06:49:22.000000Z"),
        7: ("1521408611422", None, None, "2018-03-18T21:30:11.422000Z"),
        8: ("1461868402920043", None, None, "2016-04-28T18:33:22.920043Z"),
        9: ("Sun, 20 Sep 2015 20:49:15 +0100", None, None, "2015-09-20T19:49:15.000000Z"),
        10: ("January 12, 2009 2:58:32 AM CET", None, None, "2009-01-12T01:58:32.000000Z"),
        11: ("January 12, 2009 12:58:32 PM", "Z", None, "2009-01-12T12:58:32.000000Z"),
        12: ("2024:04:05 05:23:35.483662999", "−07:00\x00", None, "2024-04-05T12:23:35.483662Z"),
        13: ("2012-02-25T13:36", "+02:00", None, "2012-02-25T11:36:00.000000Z"),
        14: ("2016:06:14 16:39+05:45[Asia/Kathmandu]", "+01:00", None, "2016-06-14T10:54:00.000000Z"),
        15: ("2019-10-06T13:11:31 PDT", "+09:00", None, "2019-10-06T20:11:31.000000Z"),
        16: ("2015:06:01 10:00:00", "+99:00", "Asia/Tokyo", "2015-06-01T01:00:00.000000Z"),
        17: ("\t2012-01-13t10:00:00z ", None, None, "2012-01-13T10:00:00.000000Z"),
        18: ("1414900325.422", None, None, "2014-11-02T03:52:05.422000Z"),
    }
    got = utc(spark, [(k, v[0], v[1], v[2]) for k, v in cases.items()])
    assert got == {k: v[3] for k, v in cases.items()}


def test_what_denotes_no_instant(spark):
    values = ["2025:10:26", "2015-06", "2024", "unknown", "", None, "20xx:05:12 11:11:11", "    :  :     :  :  ", "2019:07:21 25:14:09", "2021:13:05 10:00:00", "2021-02-30T10:00:00", "0000:00:00 00:00:00", "Mon, 20 Sep 2015 20:49:15 +0100", "January 12, 2009 13:58:32 AM", "2015:06:01 10:00:00 ABC", "x" * 100_000]
    assert utc(spark, [(i, v, "+01:00", "Europe/Berlin") for i, v in enumerate(values)]) == {}
    assert utc(spark, [(1, "2015:06:01 10:00:00", "local", "Unknown/Zone"), (2, "2015:06:01 10:00:00", None, None), (None, "1736318962", None, None)]) == {}
    # Shown never, and shown twice; an offset settles both.
    assert utc(spark, [(1, "2012-03-25T02:18:55", None, "Europe/Berlin"), (2, "2015-10-25T02:30:00", "??", "Europe/Berlin")]) == {}
    assert utc(spark, [(2, "2015-10-25T02:30:00", "+01:00", "Europe/Berlin")]) == {2: "2015-10-25T01:30:00.000000Z"}


def test_empty_and_repeated(spark):
    assert utc(spark, []) == {}
    df = spark.createDataFrame([(1, "1736318962", None, None, True, "", "")] * 3, SCHEMA)
    assert capture_times(df).count() == 1


def test_zone_tables_agree_with_zoneinfo():
    rng = random.Random(1)
    for name in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kathmandu", "Africa/Casablanca", "America/Phoenix", "Pacific/Apia"):
        zone = zoneinfo.ZoneInfo(name)
        at = np.array([rng.randrange(-10**9, 3 * 10**9) for _ in range(500)])
        wall = np.array([int(a + (dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=int(a))).astimezone(zone).utcoffset().total_seconds()) for a in at])
        utc_, found = zones.to_utc(wall, name)
        assert (found >= 1).all() and (utc_[found == 1] == at[found == 1]).all()


def test_a_mask_has_one_parser():
    assert parser_of("9999:99:99 99:99:99") is parser_of("9999:99:99 99:99:99") is not None
    assert parser_of("9999:99-99 99:99:99") is None


def test_rules_hold_beyond_the_unrolled_years():
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    walls = [datetime(y, m, 15, 12) for y in (2119, 2125, 2399, 2555, 2961, 5000, 9990) for m in (1, 7)]
    epoch = datetime(1970, 1, 1)
    utc, times = zones.to_utc(np.array([int((w - epoch).total_seconds()) for w in walls]), "Europe/Berlin")
    assert (times == 1).all()
    assert [epoch.replace(tzinfo=timezone.utc) + timedelta(seconds=int(u)) for u in utc] == [w.replace(tzinfo=ZoneInfo("Europe/Berlin")).astimezone(timezone.utc) for w in walls]


def test_version_stands_beside_results(spark):
    df = spark.createDataFrame([(1, "2020-07-01T12:00:00", None, "Europe/Berlin")], "i long, v string, o string, z string")
    row = timestamps.normalize_timestamps(df, df.i, df.v, df.o, df.z, versioned=True).collect()[0]
    assert (row.utc, row.tz_version) == ("2020-07-01T10:00:00.000000Z", zones.version())
