"""Scalar functions, all built from JVM-side expressions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["bucket_revenue", "clean", "day_name", "days_between", "enum", "id_number", "iso_weekday", "money", "month_of", "padded_id", "per_unit", "ratio", "row_digest", "set_digest", "utc_date"]


def clean(c: Column | str) -> Column:
    """Text without white space at its ends (all white space, not only blanks)."""
    return F.btrim(c, F.lit(" \t\n\v\f\r"))


def enum(c: Column | str) -> Column:
    """A normalised category value: trimmed, lower case."""
    return F.lower(clean(c))


def money(c: Column | str, precision: int = 12, scale: int = 2) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal({precision},{scale})")


def per_unit(total: Column, count: Column) -> Column:
    """total / count as money, null where count is not positive."""
    return F.when(count > 0, money(F.try_divide(total, count), 14))


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b in double precision, rounded; null for a zero divisor."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def days_between(start: Column | str, end: Column | str) -> Column:
    """Whole days from start to end."""
    return F.datediff(end, start).cast("long")


def month_of(d: Column | str) -> Column:
    """First day of the month, as a date."""
    return F.trunc(d, "MM")


def iso_weekday(d: Column | str) -> Column:
    """1 for Monday to 7 for Sunday."""
    return (F.weekday(d) + 1).cast("long")


def day_name(d: Column | str) -> Column:
    names = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
    return F.element_at(F.array(*[F.lit(n) for n in names]), iso_weekday(d).cast("int"))


def padded_id(prefix: str, number: Column, width: int) -> Column:
    """``prefix-`` and a whole number of at least ``width`` digits; none is cut off."""
    digits = number.cast("long").cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), "0"))


def id_number(c: Column | str) -> Column:
    """The number that ends an id such as ORD-0000012; null if none does."""
    return F.regexp_extract(c, r"(\d+)$", 1).try_cast("long")


def utc_date(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("date")


# Upper bounds and labels of the lifetime-value buckets.
REVENUE_BUCKETS = ((0, "0. no revenue"), (50, "1. < 50"), (250, "2. 50-250"), (500, "3. 250-500"), (1000, "4. 500-1k"), (2500, "5. 1k-2.5k"), (5000, "6. 2.5k-5k"))
TOP_BUCKET = "7. 5k+"


def bucket_revenue(c: Column) -> Column:
    first, *rest = REVENUE_BUCKETS
    ladder = F.when(c <= first[0], first[1])
    for bound, label in rest:
        ladder = ladder.when(c < bound, label)
    return ladder.otherwise(TOP_BUCKET)


def row_digest(columns: Iterable[str]) -> Column:
    """sha256 of a row's values in canonical text form; nulls are told from texts."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("NULL")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def set_digest(digest: Column) -> Column:
    """An order-independent digest of many row digests that sums up in any order, so it needs no sort.

    Two 32-bit halves of each digest are added with the count; equal multisets agree.
    """
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint").cast("decimal(18,0)")
    return F.sha2(F.concat_ws(":", F.count(digest).cast("string"), *[F.coalesce(F.sum(part(at)), F.lit(0)).cast("string") for at in (1, 9, 17, 25)]), 256)


START_DEFAULT, END_DEFAULT = dt.date(2024, 1, 1), dt.date(2024, 12, 31)
