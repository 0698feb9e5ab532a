"""Date and time expressions (DT rows of the survey); timestamps are UTC instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import strip

#: Fields of a raw row that may hold its date, in order of preference.
DATE_FIELDS = ["pubDate", "date", "time", "publishTime", "publishedAt", "timestamp"]
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?)?"
_ZONED = _ISO + r"(?:Z|[+-]\d{2}:?\d{2})$"


def parse_iso(c: Column) -> Column:
    """DT03/DT04: an ISO text as an instant, naive ones as UTC; null if it is none."""
    t = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$"), c)
    return F.try_to_timestamp(t)


def normal_date(c: Column) -> Column:
    """DT01: the instant of a number (seconds, or milliseconds above 1e10), ISO or RFC-2822 text.

    Naive texts are at +08:00.  Empty, zero and unreadable ones are null.
    """
    t = strip(c.cast("string"))
    number = F.when(t.rlike(r"^\d+(?:\.\d+)?$"), t.try_cast("double"))
    epoch = F.when(number > 0, F.timestamp_micros(F.round(F.when(number > 1e10, number / 1000).otherwise(number) * 1e6).cast("long")))
    zoned = F.when(t.rlike(_ZONED), F.try_to_timestamp(t))
    naive = F.when(t.rlike(_ISO + "$"), F.try_to_timestamp(t) - F.expr("INTERVAL 8 HOURS"))
    mail = F.regexp_replace(t, r"^[A-Za-z]{3},\s*", "")
    # zone names as offsets, for the readers below
    mail = F.regexp_replace(F.regexp_replace(mail, r"\s(?:GMT|UT|UTC|Z)$", " +0000"), r"\s([+-]\d{2}):(\d{2})$", " $1$2")
    rfc = F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx")))
    local = F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss")) - F.expr("INTERVAL 8 HOURS"))
    return F.coalesce(epoch, zoned, naive, rfc, local)


def first_date(*cs: Column) -> Column:
    """DT02: the first readable of several date fields."""
    # one lambda for all fields keeps the generated code small
    return F.get(F.filter(F.transform(F.array(*[c.cast("string") for c in cs]), normal_date), lambda t: t.isNotNull()), 0)


def iso_utc(c: Column) -> Column:
    """An instant as ISO text at UTC, with microseconds only if there are any."""
    return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def age_hours(report_date: Column, at: Column) -> Column:
    """DT06: hours from the instant to 08:00 UTC of the report date, 0 at least."""
    due = F.unix_micros(F.to_timestamp(report_date)) + 8 * 3_600_000_000
    return F.greatest(F.lit(0.0), (due - F.unix_micros(at)) / 3.6e9)


def outside_window(a: Column, b: Column, hours: int) -> Column:
    """FL13: over so many hours apart; a missing instant is inside."""
    return F.coalesce(F.abs(F.unix_micros(a) - F.unix_micros(b)) > hours * 3_600_000_000, F.lit(False))


def report_date(c: Column) -> Column:
    """DT05: the ISO date given, today if there is none."""
    return F.coalesce(F.to_date(F.nullif(c, F.lit("")), "yyyy-MM-dd"), F.current_date())
