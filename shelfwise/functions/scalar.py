"""Column helpers: logs, ages, calendar keys, buckets, smoothing, rounding."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.schema import COUNTRY_COLUMNS, COUNTRY_LIST, SERVICE_CODES

MICROS_PER_DAY = 86_400_000_000


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at(value) -> Column:
    """Naive timestamp literal.  Times carry no zone, so comparisons with a literal of the same
    type reach the Parquet scan as pushed filters."""
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz") if isinstance(value, str) else value


def micros(c) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def log1p0(c) -> Column:
    """log(1 + max(x, 0)), NULL read as 0."""
    return F.log1p(F.greatest(F.coalesce(col(c).cast("double"), F.lit(0.0)), F.lit(0.0)))


def whole_days(start, end) -> Column:
    """floor((end - start) / 1 day); unlike datediff it respects the time of day."""
    return F.floor((micros(at(end)) - micros(start)) / F.lit(MICROS_PER_DAY))


def whole_days0(start, end) -> Column:
    return F.greatest(whole_days(start, end), F.lit(0))


def frac_days(start, end) -> Column:
    return (micros(at(end)) - micros(start)) / F.lit(float(MICROS_PER_DAY))


def monday0(c) -> Column:
    """Weekday with Monday = 0."""
    return F.weekday(col(c))


def is_weekend(c) -> Column:
    return monday0(c) >= 5


def month_key(c) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def day_number(c, anchor) -> Column:
    """Whole calendar days since an anchor date at midnight."""
    return F.datediff(col(c), at(anchor))


def next_month(c) -> Column:
    return F.add_months(col(c), 1).cast("timestamp_ntz")


def ratio(num, den, floor: float) -> Column:
    """num / max(den, floor)."""
    return col(num) / F.greatest(col(den), F.lit(floor))


def smoothed(hits, total, s: float = 0.5) -> Column:
    """(hits + s) / (max(total, 1) + 2s)."""
    return (col(hits) + F.lit(s)) / (F.greatest(col(total), F.lit(1.0)) + F.lit(2 * s))


def smoothed_raw(hits, total, s: float = 0.5) -> Column:
    """(hits + s) / (total + 2s) without the floor on the total."""
    return (col(hits) + F.lit(s)) / (col(total) + F.lit(2 * s))


def decay(age_days, tau: float) -> Column:
    return F.exp(-col(age_days) / F.lit(tau))


def sigmoid_clipped(z, bound: float = 30.0) -> Column:
    clipped = F.greatest(F.least(col(z), F.lit(bound)), F.lit(-bound))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped))


def right_closed_bucket(value, edges, labels) -> Column:
    """labels[i] where i is the number of edges strictly below the value."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels[:-1]))):
        out = F.when(col(value) <= F.lit(edge), F.lit(label)).otherwise(out)
    return out


def country_indicators(c) -> list[Column]:
    """One 0/1 column per listed country plus "other" (also for NULL)."""
    known = F.coalesce(col(c).isin(COUNTRY_LIST), F.lit(False))
    cols = [
        F.coalesce((col(c) == F.lit(name)).cast("double"), F.lit(0.0)).alias(alias)
        for name, alias in zip(COUNTRY_LIST, COUNTRY_COLUMNS)
    ]
    cols.append((~known).cast("double").alias(COUNTRY_COLUMNS[-1]))
    return cols


def not_service(c, codes=SERVICE_CODES) -> Column:
    return ~F.trim(col(c)).isin(list(codes))


def is_cancelled(invoice) -> Column:
    return F.coalesce(F.upper(F.trim(col(invoice))).startswith("C"), F.lit(False))


def has_keyword(text, pattern: str) -> Column:
    return F.coalesce(F.upper(col(text)).rlike(pattern), F.lit(False))


def md5_key(*parts) -> Column:
    """Deterministic pseudo-random order key."""
    return F.md5(F.concat_ws("-", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def text_key(parts) -> Column:
    """Comma-joined id list."""
    return F.array_join(parts, ",")
