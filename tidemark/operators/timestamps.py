"""Timestamps in many formats, precisions and zones -> one UTC instant.

Everything stays in the JVM: a value is first rewritten into ten fields separated by bars by the one pattern that fits
it, then the fields become a wall time (timestamp without zone) and, with an offset or a zone, an instant.
"""

from __future__ import annotations

import re
import zoneinfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Abbreviations of daylight saving time besides those that end in DT.
DAYLIGHT = ("BST", "CEST", "EEST", "WEST", "MEST", "MESZ", "IDT", "NDT")
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_OFFSET = r"[+-]\d{2}(?::?\d{2})?"
_NAMED = r"[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+"
_TIME = r"(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?"
_TAIL = rf"\s*(Z|z|{_OFFSET})?\s*(?:\[([A-Za-z0-9_/+-]+)\]|({_NAMED})|\(?([A-Za-z]{{1,5}})\)?)?"
PLAIN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|\+00:00)$"

# (kind, pattern, rewrite into year|month|day|hour|minute|second|fraction|offset|zone|abbreviation|half)
FORMATS = (
    ("iso", rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt ]\s*{_TIME})?{_TAIL}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9$10|$11|"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?\s*(Z|z|{_OFFSET})$", "$1|$2|$3|$4|$5|$6|$7|$8|||"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})[Tt ](\d{2})(\d{2})(\d{2})(?:[.,](\d+))?$", "$1|$2|$3|$4|$5|$6|$7||||"),
    ("slash", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_TIME}\s*([AaPp][Mm])?)?{_TAIL}$", "$3|$1|$2|$4|$5|$6|$7|$9|$10$11|$12|$8"),
    ("mail", rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[ -]([A-Za-z]{{3}})[a-z]*\.?[ -](\d{{4}})(?:\s+{_TIME})?{_TAIL}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9$10|$11|"),
    ("ctime", rf"^[A-Za-z]{{3,9}}\s+([A-Za-z]{{3}})[a-z]*\s+(\d{{1,2}})\s+{_TIME}\s+(?:({_OFFSET})\s+|([A-Za-z]{{2,5}})\s+)?(\d{{4}})$", "$9|$1|$2|$3|$4|$5|$6|$7||$8|"),
)
EPOCH = r"^\d{9,19}(?:\.\d+)?$"


def zone_names() -> list[str]:
    """Region names of the public zone database; others must not reach the JVM's conversion, which would fail."""
    return sorted(z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("SystemV", "posix", "right")))


def trimmed(value: Column) -> Column:
    return F.regexp_replace(F.btrim(value, F.lit(" \t\r\n")), "\u2212", "-")


def is_plain(value: Column) -> Column:
    return F.coalesce(value.rlike(PLAIN), F.lit(False))


def parse_fields(value: Column) -> Column:
    """The value's fields as an array of eleven strings, the first prefixed by the format's name; null if none fits."""
    v = trimmed(value)
    out = None
    for kind, pattern, rewrite in FORMATS:
        hit = F.concat(F.lit(kind + "|"), F.regexp_replace(v, pattern, rewrite))
        out = F.when(v.rlike(pattern), hit) if out is None else out.when(v.rlike(pattern), hit)
    return F.split(out, r"\|", 12)


def with_instants(df: DataFrame, value: str, key: str, sessions: DataFrame, session_key: str = "session_id", out: str = "utc_ms") -> DataFrame:
    """Adds `out`: the instant a timestamp text denotes, in whole milliseconds since 1970 UTC.

    df: rows with the text in `value`, a unique `key` and the session in `session_key`. sessions: session_id (unique),
    zone_name, day_order: the zone of the session's device, null where it is unknown.
    Null, empty, impossible and skipped wall times give null, as do values that need the device's zone where it is
    unknown. Wall times that occur twice mean the first, unless an offset or an abbreviation tells. Repeated rows are
    kept. The session join spreads rows that need no zone over all partitions, so one huge session stays a matter of
    AQE's skew split for the few rows that do.
    """
    # The caller's columns travel as one struct, so none of theirs can meet one of ours.
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != out))
    df = df.select(row.alias("_row"), F.col(value).alias("_value"), F.col(key).cast("string").alias("_key"), F.col(session_key).alias("_session"))
    v = trimmed(F.col("_value"))
    # Empty fields become null inside one lambda: eleven columns of their own would outgrow a generated method.
    fields = F.transform(parse_fields(F.col("_value")), lambda x: F.nullif(x, F.lit("")))
    one = df.withColumn("_f", fields).withColumn("_num", F.when(v.rlike(EPOCH), v))
    one = one.withColumn("_zero", F.expr(_sql("coalesce(upper(:zone) in ('UTC', 'GMT', 'Z', 'ETC/UTC', 'ETC/GMT'), false) or coalesce(upper(:ab) in ('UTC', 'GMT', 'Z'), false) or coalesce(upper(:off) = 'Z', false)")))
    one = one.withColumn("_need", F.expr(_sql("coalesce(:kind = 'slash' or (:kind is not null and not _zero and :off is null and :zone is null), false)")))
    # The names as one literal split up: a list of them in expressions would be repeated all over the plan.
    names = df.sparkSession.range(1).select(F.explode(F.split(F.lit(",".join([*zone_names(), "UTC"])), ",")).alias("_ok"))
    far = sessions.join(F.broadcast(names), F.col("zone_name") == F.col("_ok"), "left").select(F.col("session_id").alias("_sid"), F.col("_ok").alias("_dz"), F.col("day_order").alias("_do"))
    joinable = F.when(F.col("_need"), F.col("_session")).otherwise(F.concat(F.lit("\u0000"), F.col("_key")))
    two = one.withColumn("_sid", joinable).join(far, "_sid", "left")
    for name, sql in _STEPS:
        two = two.withColumn(name, F.expr(_sql(sql)))
    two = two.join(F.broadcast(names), F.expr(_sql(":zone")) == F.col("_ok"), "left")
    two = two.withColumn("_tz", F.expr(_sql("case when _omin is null then if(:zone is null, if(_f is null, null, _dz), _ok) end")))
    for name, sql in _STEPS_IN_ZONE:
        two = two.withColumn(name, F.expr(_sql(sql)))
    return two.select("_row.*", F.expr(_sql(_MILLIS)).alias(out))


_PLACES = ("kind", "y", "mo", "d", "h", "mi", "s", "fr", "off", "zone", "ab", "half")


def _sql(text: str) -> str:
    """:name stands for the field of that name."""
    return re.sub(r"(?<![:\w]):(\w+)", lambda m: f"_f[{_PLACES.index(m[1])}]", text)


_MONTH_AT = f"locate(lower(left(:mo, 3)), '{MONTHS}')"
_STEPS = (
    ("_month", f"case when :kind = 'slash' then case _do when 'dmy' then int(:d) when 'mdy' then int(:mo) end when :mo rlike '^[0-9]+$' then int(:mo) when {_MONTH_AT} % 3 = 1 then int(({_MONTH_AT} + 2) div 3) end"),
    ("_day", "case when :kind = 'slash' and _do = 'dmy' then int(:mo) else int(:d) end"),
    ("_hour", "case when :half is null then coalesce(int(:h), 0) when int(:h) between 1 and 12 then int(:h) % 12 + if(upper(:half) = 'PM', 12, 0) end"),
    ("_wall", "case when coalesce(int(:s), 0) < 60 then try_make_timestamp_ntz(int(:y), _month, _day, _hour, coalesce(int(:mi), 0), cast(concat(coalesce(:s, '0'), '.', left(coalesce(:fr, '0'), 6)) as decimal(16,6))) end"),
    ("_omin", "case when _zero then 0 when :off is not null then if(left(:off, 1) = '-', -1, 1) * (int(substr(:off, 2, 2)) * 60 + coalesce(int(nullif(right(replace(substr(:off, 4), ':', ''), 2), '')), 0)) end"),
    # An offset beyond 18 hours or with 60 minutes and more is none: the wall time is dropped with it.
    ("_wall", "case when _omin is null or (abs(_omin) <= 1080 and (_zero or length(:off) < 5 or int(right(:off, 2)) < 60)) then _wall end"),
)
_STEPS_IN_ZONE = (
    ("_u1", "case when _omin is not null then _wall - make_dt_interval(0, 0, _omin, 0) when _tz is not null then convert_timezone(_tz, 'UTC', _wall) end"),
    # Skipped by the clocks: converting back gives another wall time.
    ("_u1", "case when _tz is null or convert_timezone('UTC', _tz, _u1) = _wall then _u1 end"),
    # Shown twice, and the abbreviation is that of standard time: the second.
    ("_u1", f"case when _tz is not null and not (upper(:ab) like '%DT' or upper(:ab) in {DAYLIGHT}) and convert_timezone('UTC', _tz, _u1 + interval 1 hour) = _wall then _u1 + interval 1 hour else _u1 end"),
)
_WHOLE = "split_part(_num, '.', 1)"
_MILLIS = (
    f"case when length({_WHOLE}) <= 10 then bigint(floor(try_cast(_num as decimal(30,9)) * 1000)) when length({_WHOLE}) <= 13 then try_cast({_WHOLE} as bigint) "
    f"when length({_WHOLE}) <= 16 then try_cast({_WHOLE} as bigint) div 1000 when _num is not null then try_cast({_WHOLE} as bigint) div 1000000 "
    "else bigint(floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', _u1) / 1000D)) end"
)


def session_clocks(upserts: DataFrame, clocks: DataFrame) -> DataFrame:
    """session_id, device_name, zone_name, day_order; one row a session that has a device with a clock.

    A session's device is the one named in any of its records (the greatest name, should they differ).
    """
    device = upserts.groupBy("session_id").agg(F.max("device_name").alias("device_name"))
    return device.join(clocks.dropDuplicates(["device_name"]), "device_name").select("session_id", "device_name", "zone_name", "day_order")


def number_instants(df: DataFrame, value: str, out: str = "utc_ms") -> DataFrame:
    """Adds `out`: the instant of a number of seconds, milli-, micro- or nanoseconds since 1970, told by its magnitude.

    In whole milliseconds, further digits cut off. Null for null, NaN, infinite and meaningless (under 1e8) numbers.
    """
    v = F.col(value)
    return df.withColumn(
        out,
        F.when(v.isNull() | F.isnan(v) | (v < 1e8) | (v >= 9.2e18), None)
        .when(v < 1e11, F.floor(v * 1000).cast("bigint"))
        .when(v < 1e14, F.floor(v).cast("bigint"))
        .when(v < 1e17, F.expr(f"bigint(`{value}`) div 1000"))
        .otherwise(F.expr(f"bigint(`{value}`) div 1000000")),
    )


def zone_estimates(events: DataFrame, upserts: DataFrame, clocks: DataFrame, tolerance_s: int = 120) -> DataFrame:
    """For each device, the zone whose offset history best aligns its zoneless wall times with their arrival.

    Each zoneless ISO wall time is converted under every candidate zone (the few names in `clocks`, so the rows grow by
    a fixed factor); an instant after arrival (by more than tolerance_s) is a violation. Chosen is the zone with the
    fewest violations, then the least median delay, then by name. Devices without such rows do not appear.
    Columns: device_name, rows, estimated_zone, violations, median_delay_s, declared_zone.
    """
    wall = F.expr("try_cast(replace(btrim(ts), ',', '.') as timestamp_ntz)")
    zoneless = events.where(F.col("ts").rlike(r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s*$")).select("session_id", wall.alias("wall"), "received_at").where("wall is not null")
    device = upserts.groupBy("session_id").agg(F.max("device_name").alias("device_name")).where("device_name is not null")
    names = clocks.select(F.col("zone_name").alias("zone")).where(F.col("zone_name").isin([*zone_names(), "UTC"])).distinct()
    candidates = F.broadcast(names.agg(F.sort_array(F.collect_set("zone")).alias("zones")))  # fixed table of devices
    arrival = F.expr("timestampdiff(SECOND, timestamp'1970-01-01 00:00:00', received_at)")
    rows = zoneless.join(device, "session_id").join(candidates, F.lit(True)).withColumn("zone", F.explode("zones"))
    delay = arrival - F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', convert_timezone(zone, 'UTC', wall))")
    scored = rows.withColumn("delay", delay).groupBy("device_name", "zone").agg(
        F.count("*").alias("rows"), F.count_if(F.col("delay") < -tolerance_s).alias("violations"), F.expr("percentile_approx(abs(delay), 0.5, 10000)").alias("median_delay_s")
    )
    best = Window.partitionBy("device_name").orderBy("violations", "median_delay_s", "zone")
    picked = scored.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return picked.join(F.broadcast(clocks.dropDuplicates(["device_name"])), "device_name", "left").select(
        "device_name", "rows", F.col("zone").alias("estimated_zone"), "violations", "median_delay_s", F.col("zone_name").alias("declared_zone")
    )
