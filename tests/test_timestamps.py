import datetime as dt

import pytest

from tidemark.operators import timestamps as T

SCHEMA = "id string, session_id string, v string, utc_ms string"


def ms(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp() * 1000)


CASES = [  # value, zone, day order, instant
    ("2025-07-01T12:00:00+02:00", None, None, ms(2025, 7, 1, 10)),
    (" 2025-07-01T12:00:00Z ", None, None, ms(2025, 7, 1, 12)),
    ("2025-07-01 12:00:00.999999-0330", None, None, ms(2025, 7, 1, 15, 30) + 999),
    ("2025-07-01T12:00:00−05:00", None, None, ms(2025, 7, 1, 17)),
    ("2025-07-01 12:00:00,250 UTC", None, None, ms(2025, 7, 1, 12) + 250),
    ("20250701T120000Z", None, None, ms(2025, 7, 1, 12)),
    ("20250701140000+0200", None, None, ms(2025, 7, 1, 12)),
    ("Tue, 01 Jul 2025 12:00:00 GMT", None, None, ms(2025, 7, 1, 12)),
    ("1751371200", None, None, ms(2025, 7, 1, 12)),
    ("1751371200123", None, None, ms(2025, 7, 1, 12) + 123),
    ("1751371200123999", None, None, ms(2025, 7, 1, 12) + 123),
    ("1751371200.9999", None, None, ms(2025, 7, 1, 12) + 999),
    ("2025-07-01 12:00", "Europe/Berlin", "dmy", ms(2025, 7, 1, 10)),
    ("2025-07-01", "Europe/Berlin", "dmy", ms(2025, 6, 30, 22)),
    ("01/07/2025 12:00:00", "Europe/Berlin", "dmy", ms(2025, 7, 1, 10)),
    ("07/01/2025 12:15:00 AM", "America/New_York", "mdy", ms(2025, 7, 1, 4, 15)),
    ("13/13/2025 12:00:00", "Europe/Berlin", "dmy", None),
    ("01/07/2025 12:00:00", None, None, None),
    ("2025-07-01 12:00:00", None, None, None),
    ("2025-07-01 12:00:00 Asia/Tokyo", None, None, ms(2025, 7, 1, 3)),
    ("2025-07-01 12:00:00 Mars/Olympus", "Europe/Berlin", "dmy", None),
    ("2025-07-01 12:00:00 CST", "Asia/Tokyo", "dmy", ms(2025, 7, 1, 3)),
    ("2025-10-26 02:30:00", "Europe/Berlin", "dmy", ms(2025, 10, 26, 0, 30)),
    ("2025-10-26 02:30:00 CEST", "Europe/Berlin", "dmy", ms(2025, 10, 26, 0, 30)),
    ("2025-10-26 02:30:00 CET", "Europe/Berlin", "dmy", ms(2025, 10, 26, 1, 30)),
    ("Sun Nov  2 01:30:00 EST 2025", "America/New_York", "mdy", ms(2025, 11, 2, 6, 30)),
    ("2025-11-02T01:30:00-05:00[America/New_York]", None, None, ms(2025, 11, 2, 6, 30)),
    ("2025-03-30 02:30:00", "Europe/Berlin", "dmy", None),
    ("2025-02-30T10:00:00+01:00", None, None, None),
    ("2025-07-01T25:00:00Z", None, None, None),
    ("2025-07-01T12:00:00+25:00", None, None, None),
    ("yesterday", "Europe/Berlin", "dmy", None),
    ("", "Europe/Berlin", "dmy", None),
    (None, "Europe/Berlin", "dmy", None),
]


def test_formats(spark):
    rows = [(str(i), f"s{i}", c[0], "mine") for i, c in enumerate(CASES)]
    zones = [(f"s{i}", c[1], c[2]) for i, c in enumerate(CASES) if c[1]]
    out = T.with_instants(spark.createDataFrame(rows, SCHEMA.replace("utc_ms", "_f")), "v", "id", spark.createDataFrame(zones, "session_id string, zone_name string, day_order string"))
    got = {r.id: r.utc_ms for r in out.collect()}
    assert [(c[0], got[str(i)]) for i, c in enumerate(CASES)] == [(c[0], c[3]) for c in CASES]
    assert out.columns == ["id", "session_id", "v", "_f", "utc_ms"]


def test_repeated_rows_and_empty_tables(spark):
    zones = spark.createDataFrame([], "session_id string, zone_name string, day_order string")
    twice = spark.createDataFrame([("1", None, "1751371200", "x")] * 2, SCHEMA.replace("utc_ms", "n"))
    assert T.with_instants(twice, "v", "id", zones).count() == 2
    assert T.with_instants(twice.limit(0), "v", "id", zones).count() == 0


@pytest.mark.parametrize("value, expected", [(1.7513712e9, ms(2025, 7, 1, 12)), (1.7513712e12 + 0.5, ms(2025, 7, 1, 12)), (1.7513712e15, ms(2025, 7, 1, 12)), (1.7513712e18, ms(2025, 7, 1, 12)), (0.0, None), (-1.0, None), (float("nan"), None), (float("inf"), None), (None, None)])
def test_numbers(spark, value, expected):
    assert T.number_instants(spark.createDataFrame([(value,)], "v double"), "v").first().utc_ms == expected


def test_clocks_take_any_record_of_a_session(spark):
    upserts = spark.createDataFrame([("a", None), ("a", "d1"), ("b", None)], "session_id string, device_name string")
    clocks = spark.createDataFrame([("d1", "Asia/Tokyo", "dmy")], "device_name string, zone_name string, day_order string")
    assert [(r.session_id, r.zone_name) for r in T.session_clocks(upserts, clocks).collect()] == [("a", "Asia/Tokyo")]
