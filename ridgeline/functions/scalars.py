"""Scalar functions as Column expressions: times, bands, eras, fees, returns, outcome parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def iso_to_epoch(text: Column) -> Column:
    """Epoch seconds of an ISO-8601 string with Z or an offset (fraction cut off); null if it can't be read."""
    return F.floor(F.unix_micros(F.try_to_timestamp(text)) / 1_000_000).cast("long")


def wall_clock(epoch: Column, unit: str = "SECOND") -> Column:
    """US Eastern wall-clock time (zone-less) of an epoch count, whatever the session's zone."""
    utc = F.timestamp_add(unit, epoch, F.expr(EPOCH))
    return F.convert_timezone(F.lit("UTC"), F.lit(EASTERN), utc)


def from_wall_clock(eastern: Column, unit: str = "SECOND") -> Column:
    """Epoch count of a zone-less US Eastern time."""
    return F.timestamp_diff(unit, F.expr(EPOCH), F.convert_timezone(F.lit(EASTERN), F.lit("UTC"), eastern))


def eastern_days_before(epoch: Column, days: Column, unit: str = "SECOND") -> Column:
    """The same Eastern wall-clock time that many calendar days earlier."""
    return from_wall_clock(F.timestamp_add("DAY", -days, wall_clock(epoch, unit)), unit)


def eastern_day_start(epoch: Column, unit: str = "SECOND") -> Column:
    return from_wall_clock(F.date_trunc("day", wall_clock(epoch, unit)).cast("timestamp_ntz"), unit)


def utc_date(epoch: Column) -> Column:
    """UTC calendar date of epoch seconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86_400).cast("int"))


def month_key(epoch: Column) -> Column:
    return F.date_format(utc_date(epoch), "yyyy-MM")


def ordinal_month(epoch: Column) -> Column:
    day = utc_date(epoch)
    return F.year(day) * 12 + F.month(day) - 1


def price_band(p: Column) -> Column:
    """Ten-cent band of a price, upper end included, on rounded cents so that 1 - 0.70 falls where 0.30 does."""
    k = F.ceil(F.round(p * 10, 7)).cast("int")
    k = F.greatest(F.lit(1), F.least(F.lit(10), k))
    return F.concat(F.when(k == 1, F.lit(1)).otherwise((k - 1) * 10 + 1).cast("string"), F.lit("-"), F.when(k == 10, F.lit(99)).otherwise(k * 10).cast("string"), F.lit("c"))


def era(epoch: Column) -> Column:
    """Calendar-year eras, half-open; outside them or unknown: _unassigned."""
    y = F.year(utc_date(epoch))
    return F.when(y.between(1996, 2000), F.concat(F.lit("y"), y.cast("string"))).otherwise("_unassigned")


ERAS = ("y1996", "y1997", "y1998", "y1999", "y2000", "_unassigned")


def ceil_to_cent(dollars: Column) -> Column:
    return F.ceil(dollars * 100 - 1e-9) / 100


def order_fee(form: Column, rate: Column, count: Column, price: Column) -> Column:
    """Fee in dollars on one order: the order's total is rounded up to the cent. Null form: no schedule, hence null."""
    return (
        F.when(form == "quadratic", ceil_to_cent(rate * count * price * (1 - price)))
        .when(form == "flat_per_contract", ceil_to_cent(rate * count))
        .when(form == "none", F.lit(0.0))
    )


def gross_return(y: Column, p: Column) -> Column:
    return (y - p) / p


def net_return(y: Column, p: Column, fee: Column, count: Column) -> Column:
    return (y - p - fee / count) / p


def outcome_value(text: Column) -> Column:
    """1 or 0 from yes/no, true/false or a number (0.5 and more is 1); null from anything else."""
    word = F.lower(F.trim(text))
    number = word.try_cast("double")
    return (
        F.when(word.isin("yes", "true"), 1.0)
        .when(word.isin("no", "false"), 0.0)
        .when(number.isNotNull() & ~F.isnan(number), F.when(number >= 0.5, 1.0).otherwise(0.0))
    )


def first_listed_outcome(text: Column) -> Column:
    """1 or 0 from the first element of a list in text form, such as ['1', '0']; null where there is none."""
    first = F.get(F.from_json(text, "array<string>", {"allowSingleQuotes": "true"}), F.lit(0))
    return outcome_value(first)


def classify(rules: list[tuple[str, str]], *texts: Column) -> Column:
    """The category of the first rule (category, regex) that matches the texts; hyphens also count as blanks. Else null."""
    joined = F.lower(F.concat_ws(" ", *texts))
    both = F.concat_ws(" ", joined, F.replace(joined, F.lit("-"), F.lit(" ")))
    return F.coalesce(*(F.when(both.rlike(pattern), category) for category, pattern in rules))


def strict_sign(x: Column) -> Column:
    """-1, 0 or 1; zero is a class of its own."""
    return F.signum(x).cast("int")


def sign_flip(a: Column, b: Column) -> Column:
    """Both nonzero and of different signs; unknown is false."""
    return F.coalesce(strict_sign(a) * strict_sign(b) == -1, F.lit(False))
