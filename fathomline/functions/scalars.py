"""Text, time and code columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.constants import SHIP_TYPES, TYPE_BASE, TYPE_BASE_OTHER


def null_if(value: Column, *texts: str) -> Column:
    return F.when(~value.isin(*texts), value)


def blank_to_null(value: Column) -> Column:
    return null_if(F.trim(value), "")


def sane(value: Column, unavailable: float, low: float | None = None, high: float | None = None) -> Column:
    """A measurement, or null where it is the unavailable marker or out of range."""
    number = value.try_cast("double")
    bad = F.abs(number - unavailable) < 1e-6
    if low is not None:
        bad = bad | (number < low)
    if high is not None:
        bad = bad | (number > high)
    return F.when(~bad, number)


def archive_number(value: Column) -> Column:
    """A number of the archive's text; its markers of a missing value are text as well."""
    text = F.trim(value)
    return null_if(text, "", "0.0", "511.0", "511", "360.0").try_cast("double")


def rounded(value: Column, places: int) -> Column:
    """Rounded as SQL rounds doubles: the product with a power of ten to the nearest whole, halves away from 0."""
    return F.round(value * 10.0**places) / 10.0**places


def one_decimal(value: Column) -> Column:
    """Text with one decimal, rounded by the exact value, halves to even (``%.1f`` rounds the shortest decimals half up)."""
    return F.call_function("format_number", value, F.lit("0.0"))


def ship_type_name(code: Column) -> Column:
    """Name of a ship-type code, else of its decade, else Other; Unknown without a code."""
    number = code.try_cast("int")
    out, decade = F.lit("Other"), F.floor(number / 10) * 10
    for value, name in reversed(SHIP_TYPES.items()):
        if value % 10 == 0:
            out = F.when(decade == value, name).otherwise(out)
    for value, name in reversed(SHIP_TYPES.items()):
        out = F.when(number == value, name).otherwise(out)
    return F.when(number.isNull(), "Unknown").otherwise(out)


def type_score(code: Column, length_m: Column) -> Column:
    name, base = ship_type_name(code), F.lit(TYPE_BASE_OTHER)
    for key, value in TYPE_BASE.items():
        base = F.when(name == key, value).otherwise(base)
    return base * (0.6 + 0.4 * F.least(F.lit(1.0), F.coalesce(length_m, F.lit(0.0)) / 250.0))


def display_name(name: Column, mmsi: Column) -> Column:
    return F.coalesce(null_if(name, ""), F.concat(F.lit("MMSI "), mmsi.cast("string")))


def parse_time(value: Column, *formats: str) -> Column:
    """Epoch seconds of the first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats]).cast("double")


def utc_text(ts: Column, pattern: str = "dd MMM yyyy, HH:mm 'UTC'") -> Column:
    return F.date_format(F.timestamp_seconds(ts), pattern)


def iso_text(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age_days(ts: Column, now: float) -> Column:
    return (F.lit(now) - ts) / 86400.0


def ago_text(ts: Column, now: float) -> Column:
    """How long ago in words: minutes, hours, then days."""
    seconds = F.lit(now) - ts
    part = lambda unit, name: F.concat(F.floor(seconds / unit + 0.5).cast("long").cast("string"), F.lit(f" {name} ago"))
    return F.when(ts.isNull(), "never").when(seconds < 90, "just now").when(seconds < 5400, part(60, "min")).when(seconds < 172800, part(3600, "h")).otherwise(part(86400, "d"))


#: The points of the compass.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def compass(degrees: Column) -> Column:
    return F.get(F.array(*map(F.lit, COMPASS)), F.pmod(F.floor(degrees / 22.5 + 0.5), F.lit(16)).cast("int"))


def csv_cell(value: Column) -> Column:
    """Text safe in a spreadsheet: a quote before what would start a formula."""
    text = value.cast("string")
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def escape_html(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def json_or(value: Column, schema: str, default: Column) -> Column:
    """A JSON text as a value; the default for null and broken text."""
    return F.coalesce(F.from_json(value, schema), default)
