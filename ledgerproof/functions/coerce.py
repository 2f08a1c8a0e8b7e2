"""Strict, typed coercion of VARIANT values.

Each function returns NULL for a value that is not acceptable; `is_value`
tells a real NULL apart from a refused one. Nothing here aborts a job under
ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerproof.functions.text import let, strip_u

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPECIAL = r"(?i)^[+-]?(nan|inf|infinity)$"
_ISO_DATE = (
    r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([Tt _]00:00(:00([.,](0{1,6}|0{6}[0-9]+))?)?([Zz]|[+-][0-9]{2}:?[0-9]{2})?)?$"
)
_EPOCH = r"^[+-]?[0-9]+(\.0*)?$"
# Fixed value: larger epoch numbers count milliseconds.
_MILLIS_FROM = 20_000_000_000


def variant_at(raw: Column, path: str) -> Column:
    return F.try_variant_get(raw, path, "variant")


def variant_type(v: Column) -> Column:
    """VOID, STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, OBJECT<..> or ARRAY<..>."""
    return F.schema_of_variant(v)


def is_value(vtype: Column) -> Column:
    """True when something other than null or nothing was given."""
    return F.coalesce(vtype != "VOID", F.lit(False))


def is_numeric(vtype: Column) -> Column:
    return vtype.isin("BIGINT", "DOUBLE", "FLOAT") | vtype.startswith("DECIMAL")


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def number_from_text(s: Column) -> Column:
    """Read a float the lenient way: outer blanks and inner single `_` allowed."""

    def special(plain):
        low = F.lower(plain)
        return (
            F.when(low.endswith("nan"), F.lit(float("nan")))
            .when(low.startswith("-"), F.lit(float("-inf")))
            .otherwise(F.lit(float("inf")))
        )

    def read(t):
        grouped_ok = ~(t.startswith("_") | t.endswith("_") | t.contains("__"))
        return let(
            F.when(grouped_ok, F.replace(t, F.lit("_"), F.lit(""))),
            lambda plain: F.when(plain.rlike(_NUMBER), plain.try_cast("double")).when(
                plain.rlike(_SPECIAL), special(plain)
            ),
        )

    return let(strip_u(s), read)


def as_number(v: Column, vtype: Column) -> Column:
    return (
        F.when(is_numeric(vtype), F.try_variant_get(v, "$", "double"))
        .when(vtype == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
        .when(vtype == "STRING", number_from_text(text_of(v)))
    )


def as_text(v: Column, vtype: Column) -> Column:
    return F.when(vtype == "STRING", text_of(v))


def date_from_epoch(x: Column) -> Column:
    """A date when the number is exactly midnight UTC in seconds or millis."""

    def from_days(days):
        exact = days.between(-719_162, 2_932_896) & (days == F.floor(days))
        return F.when(exact, F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")))

    def days(n):
        millis = F.abs(n) > _MILLIS_FROM
        return F.when(millis, n / 86_400_000.0).otherwise(n / 86_400.0)

    return let(x, lambda n: let(days(n), from_days))


def date_from_text(s: Column) -> Column:
    """`s` is read three times, so that no lambda is needed; it should be cheap."""
    return F.when(s.rlike(_ISO_DATE), F.left(s, F.lit(10)).try_cast("date")).when(
        s.rlike(_EPOCH), date_from_epoch(s.try_cast("double"))
    )


def as_date(v: Column, vtype: Column) -> Column:
    return F.when(vtype == "STRING", date_from_text(text_of(v))).when(
        is_numeric(vtype), date_from_epoch(F.try_variant_get(v, "$", "double"))
    )


def shown(v: Column, vtype: Column) -> Column:
    """How a refused value is quoted in a message.

    Text in quotes, true/false capitalised, numbers and nested values as JSON.
    """
    s = text_of(v)
    quoted = F.when(
        s.contains("'") & ~s.contains('"'), F.concat(F.lit('"'), s, F.lit('"'))
    ).otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return (
        F.when(vtype == "STRING", quoted)
        .when(vtype == "BOOLEAN", F.initcap(s))
        .otherwise(F.to_json(v))
    )
