"""Time expressions.  Everything works on ``timestamp_ntz`` values and is
free of the session time zone (pure wall-clock arithmetic)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelflow.functions.numeric import _c


def day_start(ts) -> Column:
    """Midnight of the same day, as timestamp_ntz."""
    return _c(ts).cast("date").cast("timestamp_ntz")


def floor_hour(ts) -> Column:
    """Truncate to the hour without a zone round trip."""
    ts = _c(ts)
    return F.timestamp_add("HOUR", F.hour(ts), day_start(ts))


def round_to_15min(ts, carry_day: bool = False) -> Column:
    """Round to the nearest quarter hour on minutes of the day.

    Seconds are ignored, minutes of the day divided by 15 are rounded (a
    tie cannot occur since 15 is odd) and multiplied back.  A result of
    24:00 becomes 00:00 of the *same* date (the reference behaviour);
    ``carry_day=True`` moves it to the next day instead.
    """
    ts = _c(ts)
    minutes = F.hour(ts) * 60 + F.minute(ts)
    rounded = F.floor((minutes + 7) / 15).cast("int") * 15
    if not carry_day:
        rounded = F.pmod(rounded, F.lit(1440))
    return F.timestamp_add("MINUTE", rounded, day_start(ts))


def parse_ntz(text, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Text -> timestamp_ntz, zone-free; text that does not parse -> NULL.
    (``try_to_timestamp`` then a cast would pass through the session zone
    and move wall-clock times that fall in a daylight-saving gap, so it is
    used only as the validity test.)"""
    t = _c(text)
    ok = F.try_to_timestamp(t, F.lit(fmt)).isNotNull()
    return F.when(ok, F.to_timestamp_ntz(t, F.lit(fmt)))


def clock_text(text) -> Column:
    """Clock text as ``HH:mm:ss``: a one-digit hour is padded and missing
    seconds are zero; any other text is left as it is."""
    t = F.trim(_c(text))
    padded = F.when(t.rlike(r"^\d:"), F.concat(F.lit("0"), t)).otherwise(t)
    return F.when(padded.rlike(r"^\d{2}:\d{2}$"), F.concat(padded, F.lit(":00"))).otherwise(padded)


def round_time_text_to_15min(text) -> Column:
    """String form of the same rounding for raw ``HH:MM:SS`` text; text
    that does not parse is returned unchanged."""
    t = _c(text)
    parsed = parse_ntz(F.concat(F.lit("1970-01-01 "), clock_text(t)))
    rounded = round_to_15min(parsed)
    return F.when(parsed.isNull(), t).otherwise(F.date_format(rounded, "HH:mm:ss"))


def combine_date_time(date_text, time_text, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Date text + time text -> timestamp_ntz; bad values -> NULL."""
    clock = clock_text(time_text) if fmt.endswith(" HH:mm:ss") else _c(time_text)
    return parse_ntz(F.concat_ws(" ", _c(date_text), clock), fmt)


def weekday(ts) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts))


def is_weekend_day(ts) -> Column:
    return (weekday(ts) >= 5).cast("int")
