"""Column expressions: money, instants, flags, truncating ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_PREFIX = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"


def cents(money: Column) -> Column:
    """Integer cents of a money struct; a missing struct or amount gives 0."""
    return F.coalesce(money["amount"].cast("bigint"), F.lit(0).cast("bigint"))


def dollars(amount: Column, digits: int = 2) -> Column:
    """Cents to dollars, rounded half to even.

    Noise in the last bits of a double is rounded off first; otherwise it would decide which way an exact
    half cent goes.
    """
    return F.bround(F.round(amount, 4) / F.lit(100.0), digits)


def flag(condition: Column) -> Column:
    """Condition to 0/1; an unknown condition counts as 0."""
    return F.when(condition, 1).otherwise(0)


def number(text: Column) -> Column:
    """Text to double, null when it is not a number."""
    return text.try_cast("double")


def instant(text: Column) -> Column:
    """RFC 3339 text to a UTC timestamp; anything without a full date is null.

    The guard keeps bare times and years out, which the timestamp parser would otherwise complete
    from the current date.
    """
    return F.when(text.rlike(ISO_PREFIX), F.try_to_timestamp(text))


def iso_date(text: Column) -> Column:
    """YYYY-MM-DD text to a date, null when malformed."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(ISO_PREFIX + "$"), trimmed.try_cast("date"))


def whole(value: Column) -> Column:
    """Truncate a double toward zero."""
    return value.cast("bigint")


def mean_cents(total: Column, rows: Column) -> Column:
    """Truncated mean of integer cents."""
    return whole(total / rows)


def ratio_or_zero(numerator: Column, denominator: Column, scale: int = 1) -> Column:
    """numerator / denominator * scale truncated toward zero; an exact zero denominator gives 0."""
    quotient = numerator / denominator
    if scale != 1:
        quotient = quotient * F.lit(scale)
    return F.when(denominator != 0, whole(quotient)).otherwise(F.lit(0).cast("bigint"))


def zero_if_null(column: str, kind: str = "bigint") -> Column:
    return F.expr(f"coalesce({column}, cast(0 as {kind})) as {column}")


def count_if(condition: str, name: str) -> Column:
    """Rows that meet a SQL condition; 0 on no rows."""
    return F.expr(f"count_if({condition}) as {name}")


def sum_if(condition: str, amount: str, name: str) -> Column:
    """Sum of a bigint column over the rows that meet a SQL condition, 0 for the others."""
    return F.expr(f"sum(case when {condition} then {amount} else 0 end) as {name}")
