"""String helpers whose results equal Python's on every Unicode space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters that count as white space.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# The same without the plain blank.
ODD_SPACE = r"[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip_u(x: Column) -> Column:
    """Remove leading and trailing white space of any kind.

    The look-behind lets the trailing match start only where a run starts, so
    long inner runs of blanks stay linear.
    """
    return F.regexp_replace(x, rf"\A{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")


def fold(x: Column) -> Column:
    """strip + lower: the key form used for names and numbers. Printable text that neither begins nor
    ends with a blank has nothing to strip; most values are such."""
    return F.lower(F.when(x.rlike(r"\A[!-~](?:[ -~]*[!-~])?\z"), x).otherwise(strip_u(x)))


def normalize(x: Column) -> Column:
    """strip, lower and collapse every run of white space to one blank."""
    return F.lower(F.regexp_replace(strip_u(x), rf"{SPACE}+", " "))


def fixed2(x: Column) -> Column:
    """Two decimals, half-even on the exact binary value, no grouping.

    `format_string('%.2f')` rounds half-up on the decimal text instead.
    """
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .otherwise(F.call_function("format_number", x, F.lit("0.00")))
    )


def let(value: Column, body) -> Column:
    """Bind `value` once for use in `body`, also inside array lambdas.

    Without it Catalyst may copy an expensive expression into a lambda and
    evaluate it once per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
