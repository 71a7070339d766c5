"""Calendar features and lenient date parsing.

Wall-clock values stay `timestamp_ntz`, so results do not depend on the session time zone.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.text import _col

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def parse_epoch(seconds: Column | str) -> Column:
    """Epoch seconds to UTC wall-clock time."""
    return F.expr(EPOCH) + F.make_dt_interval(secs=_col(seconds).cast("decimal(18,6)"))


def epoch_seconds(ts: Column | str) -> Column:
    """Whole epoch seconds of a wall-clock time read as UTC."""
    ts = _col(ts)
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01")).cast("long") * 86400
            + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts).cast("long"))


# Formats beyond ISO that feeds use, tried in this order, with and without a time of day. A
# leading weekday name is dropped before.
DAY_FORMATS = ["MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "MM/dd/yyyy",
               "M/d/yyyy", "yyyy/MM/dd", "yyyyMMdd"]
CLOCK_FORMATS = ["", " HH:mm:ss", " HH:mm", " h:mm a"]
# A zone name or offset after a time of day: the text names an instant, not a wall clock.
ZONED = r"\d:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})$"
ZONE = r"\s*(?:Z|UTC|GMT|([+-]\d{2}):?(\d{2}))$"


# What a field of a format can look like: at least the texts that the parser takes for it.
FIELD_SHAPES = {"yyyy": r"[+-]?\d+", "MMMM": r"\p{L}+", "MMM": r"\p{L}+", "a": r"\S+"}


def _shape(pattern: str) -> str:
    """Regular expression of the texts that a format can fit."""
    fields = re.findall(r"([A-Za-z])(\1*)|(.)", pattern)
    return "".join(other or FIELD_SHAPES.get(c + more, r"\d+") for c, more, other in fields)


# All clocks of a day are optional parts of one format, the longest first; the shape lets one of
# them in.
_CLOCKS = sorted(filter(None, CLOCK_FORMATS), key=len, reverse=True)
_FORMATS = [(f"^{_shape(day)}(?:{'|'.join(map(_shape, _CLOCKS))})?$",
             day + "".join(f"[{clock}]" for clock in _CLOCKS)) for day in DAY_FORMATS]


def _wall_clock(text: Column) -> Column:
    """Time as written, without its zone: ISO first, then the listed formats.

    A format is only tried on text of its shape, since a failed try costs as much as a hundred
    such tests. The formats stand in a lambda: its text is made once, and all that code stays
    out of the stage's one generated method, which the JVM does not compile beyond 8,000 bytes.
    """
    plain = F.regexp_replace(text, r"^[A-Za-z]{3,9},\s+", "")
    listed = F.transform(F.array(plain), lambda t: F.coalesce(*[
        F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(pattern))).cast("timestamp_ntz")
        for shape, pattern in _FORMATS]))
    return F.coalesce(text.try_cast("timestamp_ntz"), listed[0])


def parse_lenient(text: Column | str) -> Column:
    """UTC wall-clock time of a string; unparsable or missing text gives null.

    Accepts ISO dates and times and `DAY_FORMATS` with `CLOCK_FORMATS`. Text with a zone or an
    offset after its time is moved to UTC; all other text is taken as UTC already.
    """
    text = F.trim(_col(text))
    zoned = text.rlike(ZONED)
    clock = _wall_clock(F.when(zoned, F.regexp_replace(text, ZONE, "")).otherwise(text))
    hours = F.regexp_extract(text, ZONE, 1).try_cast("int")
    minutes = F.regexp_extract(text, ZONE, 2).try_cast("int")
    sign = F.when(F.startswith(F.regexp_extract(text, ZONE, 1), F.lit("-")), -1).otherwise(1)
    offset = F.when(zoned, F.make_dt_interval(hours=hours, mins=minutes * sign))
    return clock - F.coalesce(offset, F.make_dt_interval())


def date_key(ts: Column | str) -> Column:
    """Calendar date of a timestamp, date or ISO date string, null when invalid; pass text in
    other formats through `parse_lenient` first."""
    return F.to_date(_col(ts).try_cast("timestamp_ntz"))


def dated(df: DataFrame, time: str, output: str = "date") -> DataFrame:
    """Append the calendar date of a time column, which may be text in any known format."""
    stamp = parse_lenient(time) if dict(df.dtypes)[time] == "string" else F.col(time)
    return df.withColumn(output, date_key(stamp))


def unparsed(text: Column | str) -> Column:
    """Aggregate: how many non-empty texts `parse_lenient` cannot read."""
    text = _col(text)
    return F.count_if((F.trim(text) != "") & parse_lenient(text).isNull())


def day_of_week(ts: Column | str) -> Column:
    return F.weekday(_col(ts))


def market_session(ts: Column | str) -> Column:
    """0 before open (or unknown), 1 from 9:00 to 15:59, 2 from 16:00, on the raw clock."""
    hour = F.hour(_col(ts))
    return F.when(hour >= 16, F.lit(2)).when(hour >= 9, F.lit(1)).otherwise(F.lit(0))


def _wave(fn, value: Column, period: int) -> Column:
    return F.coalesce(fn(F.lit(2 * math.pi) * value / F.lit(float(period))), F.lit(0.0))


TEMPORAL_FEATURES = ["hour", "day_of_week", "is_weekend", "market_session",
                     "hour_sin", "hour_cos", "dow_sin", "dow_cos"]


def temporal_features(ts: Column | str) -> list[Column]:
    """The eight calendar columns; a null timestamp gives zeros everywhere."""
    ts = _col(ts)
    hour, dow = F.hour(ts), day_of_week(ts)
    zero = F.lit(0)
    return [
        F.coalesce(hour, zero).alias("hour"),
        F.coalesce(dow, zero).alias("day_of_week"),
        F.coalesce((dow >= 5).cast("int"), zero).alias("is_weekend"),
        market_session(ts).alias("market_session"),
        _wave(F.sin, hour, 24).alias("hour_sin"),
        _wave(F.cos, hour, 24).alias("hour_cos"),
        _wave(F.sin, dow, 7).alias("dow_sin"),
        _wave(F.cos, dow, 7).alias("dow_cos"),
    ]
