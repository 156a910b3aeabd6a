"""Expressions of claims preparation and code features.

Those used for a few columns are ``Column`` functions. Those used for dozens of
columns at once give SQL text, so that a wide projection is parsed in one call
instead of being put together by thousands of driver calls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Takes months and days with and without a leading zero.
DATE_FORMAT = "yyyy-M-d"
# Last date of the beneficiary data: age is taken here when there is no death date.
AGE_REFERENCE_DATE = "2009-12-01"
PREFIX_LENGTH = 2
# Prefix of a missing code: missing codes form a group of their own.
MISSING_PREFIX = "na"


def quoted(name: str) -> str:
    return f"`{name}`"


def named(expression: str, name: str) -> str:
    return f"{expression} AS {quoted(name)}"


def two_to_zero(flag: str) -> str:
    """1 = yes, 2 = no becomes 1 / 0; any other value stays."""
    return f"CASE WHEN {flag} = 2 THEN 0 ELSE {flag} END"


def renal_flag(indicator: Column) -> Column:
    """'Y' becomes 1, anything else must read as an integer."""
    return F.when(indicator == "Y", F.lit(1)).otherwise(indicator.cast("int"))


def strict_date(text: Column) -> Column:
    """Date from text; text in another form fails the job, with ANSI mode on or off."""
    parsed = F.try_to_date(text, DATE_FORMAT)
    message = F.concat(F.lit("not a year-month-day date: "), text.cast("string"))
    return F.when(text.isNotNull() & parsed.isNull(), F.raise_error(message).cast("date")).otherwise(
        parsed
    )


def lenient_date(text: Column) -> Column:
    """Date from text, NULL where the text is no date."""
    return F.try_to_date(text, DATE_FORMAT)


def age_years(born: Column, died: Column, reference_date: str = AGE_REFERENCE_DATE) -> Column:
    """Whole 365-day years at death, or at ``reference_date`` for the living."""
    until = F.coalesce(died, F.lit(reference_date).cast("date"))
    return F.round(F.datediff(until, born) / F.lit(365.0))


def stay_days(admitted: Column, discharged: Column) -> Column:
    """Length of stay with both end days counted."""
    return F.datediff(discharged, admitted) + F.lit(1)


def code_prefix(code: Column) -> Column:
    """First two characters; a missing code has prefix 'na', not NULL."""
    return F.coalesce(F.substring(code, 1, PREFIX_LENGTH), F.lit(MISSING_PREFIX))


def term_frequency(term_count: str, document_length: str) -> str:
    return f"try_divide(CAST({term_count} AS DOUBLE), CAST({document_length} AS DOUBLE))"


def inverse_document_frequency(documents: int, rows_with_term: str) -> str:
    """``log2(N / rows)``; rows are claim rows, so the value may be negative."""
    return f"log2(try_divide({documents}D, CAST({rows_with_term} AS DOUBLE)))"
