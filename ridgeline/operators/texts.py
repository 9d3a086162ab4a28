"""Schedule documents to dated fee versions, as a text job."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def iso_date(stamp: Column) -> Column:
    """The ISO date in a text such as "July 8, 2024"; null without one."""
    pattern = rf"(?i)\b({'|'.join(MONTHS)})\s+(\d{{1,2}}),?\s+(\d{{4}})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(stamp, pattern, 1)))
    return F.when(month > 0, F.try_to_date(F.concat_ws("-", F.regexp_extract(stamp, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(stamp, pattern, 2), 2, "0"))).cast("string"))


def rate_value(text: Column) -> Column:
    """A rate written as a percentage or as a decimal."""
    number = F.regexp_extract(text, r"(\d*\.?\d+)", 1).try_cast("double")
    return F.when(text.contains("%"), number / 100).otherwise(number)


def fold_dashes(text: Column) -> Column:
    """Dashes and minus signs of all widths as hyphens."""
    return F.translate(text, "‐‑‒–—―−", "-------")


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Text in Unicode normal form C, for which Spark has no function of its own."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def versions(documents: DataFrame) -> DataFrame:
    """(file, capture, effective, taker_rate, maker_series) of documents (file, capture, text).

    The stamp follows "effective", the taker rate the word "taker", and charged series are the upper-case words of the maker section.
    """
    text = composed(fold_dashes(F.col("text")))
    section = F.regexp_extract(text, r"(?is)maker fees?(.*?)(?:\n\s*\n|\z)", 1)
    return documents.select(
        "file",
        "capture",
        iso_date(F.regexp_extract(text, r"(?is)effective(.{0,60})", 1)).alias("effective"),
        rate_value(F.regexp_extract(text, r"(?i)taker[^0-9.]*([0-9.]+\s*%?)", 1)).alias("taker_rate"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(section, F.lit(r"\b([A-Z][A-Z0-9]{2,})\b"), 1))).alias("maker_series"),
    )


def schedule_of(found: DataFrame) -> DataFrame:
    """One row for each effective date, from its earliest capture."""
    return found.where("effective is not null").groupBy("effective").agg(F.min_by(F.struct("file", "taker_rate", "maker_series"), F.struct("capture", "file")).alias("v")).select("effective", "v.*")


def bounds(a: Column, b: Column) -> tuple[Column, Column]:
    """What two membership lists agree on, and all that either names."""
    return F.array_sort(F.array_intersect(a, b)), F.array_sort(F.array_union(a, b))


def feed_number(text: Column) -> Column:
    """A number that the feed sends as text; blank or unreadable is null."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of alias fields that df has and that isn't null."""
    there = [feed_number(F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("double")
