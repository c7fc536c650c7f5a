"""Number and probability expressions. NaN and infinity never count as values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.fields import PROBABILITY_COLUMNS

# Characters around or inside a spelled number that a cast does not skip by itself.
SKIPPED = "_\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Plain decimal spelling with white space around it and single underscores between
# digits; "1.0d", "0x1p3", "nan" and "inf" are no numbers, though a cast takes them.
_SPACE = rf"[\s{SKIPPED[1:]}]*+"
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
NUMBER_PATTERN = (
    rf"^{_SPACE}[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?{_SPACE}$"
)


def finite(value: Column) -> Column:
    """`value` as double, null for null, NaN and infinity."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def number_from_text(text: Column) -> Column:
    """The number spelled in `text`, null when it does not spell a finite one."""
    number = F.translate(text, SKIPPED, "").try_cast("double")
    return F.when(text.rlike(NUMBER_PATTERN) & (F.abs(number) < F.lit(float("inf"))), number)


def whole_number(value: Column, kind: str) -> Column:
    """A position given as a number (cut to its whole part) or as digits in a text; null for anything else."""
    if kind != "string":
        return value.try_cast("long")
    number = F.translate(value, SKIPPED, "").try_cast("long")
    return F.when(value.rlike(rf"^{_SPACE}[+-]?{_DIGITS}{_SPACE}$"), number)


def zero_if_missing(value: Column) -> Column:
    """Null and NaN become 0; infinity stays."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def probability_source(df: DataFrame) -> Column:
    """The first probability column the table has decides, even where it is null."""
    for name in PROBABILITY_COLUMNS:
        if name in df.columns:
            if dict(df.dtypes)[name] == "string":
                return number_from_text(F.col(name))
            return finite(F.col(name))
    return F.lit(None).cast("double")


def unit_probability(df: DataFrame, name: str) -> Column:
    """Column `name` as a probability, null outside [0, 1]."""
    is_text = dict(df.dtypes)[name] == "string"
    number = number_from_text(F.col(name)) if is_text else finite(F.col(name))
    return F.when(number.between(0.0, 1.0), number)
