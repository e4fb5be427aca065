"""Date rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """First dd/MM/yyyy inside a text; an impossible date is null."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"(\d{2}/\d{2}/\d{4})", 1), F.lit("")), "dd/MM/yyyy")


def default_dates(posted: Column, expiry: Column, as_of: Column) -> tuple[Column, Column]:
    """Posted falls back to `as_of`, expiry to thirty days after posted."""
    start = F.coalesce(posted, as_of)
    return start, F.coalesce(expiry, F.date_add(start, 30))


def days_between(start: Column, end: Column) -> Column:
    """Day boundaries crossed from start to end."""
    return F.datediff(F.to_date(end), F.to_date(start))


def date_parts(d: Column) -> dict[str, Column]:
    return {
        "year": F.year(d),
        "month_no": F.month(d),
        "month": F.date_format(d, "MMMM"),
        "quarter_no": F.quarter(d),
        "quarter": F.concat(F.lit("Qtr "), F.quarter(d).cast("string")),
        "day": F.dayofmonth(d),
    }
