"""Numbers in market text: parsing, display, change and sign rules. All built-in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "—"  # shown for a value that is not there
_NO_VALUE = ("", "nan", "null", "none")


def parse_number(text: Column) -> Column:
    """number in text with thousands commas, sign kept; null where it is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def parse_int(text: Column) -> Column:
    """whole number in text with thousands commas; null where it is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def py_round(x: Column, decimals: int = 2) -> Column:
    """Round the exact binary value half to even, as stored values of the feeds are rounded."""
    return parse_number(F.format_number(x, decimals))


def _shown(text: Column, shown: Column) -> Column:
    value = text.cast("string")
    number = value.try_cast("double")
    return (
        F.when(value.isNull() | F.lower(value).isin(*_NO_VALUE) | F.isnan(number), MISSING)
        .when(number.isNull(), value)
        .otherwise(shown)
    )


def fmt_num(value: Column, decimals: int = 2) -> Column:
    """thousands and fixed decimals; missing values show a dash, other text shows itself."""
    return _shown(value, F.format_number(value.cast("string").try_cast("double"), decimals))


def fmt_pct(value: Column, decimals: int = 2) -> Column:
    """signed percentage, without thousands."""
    number = value.cast("string").try_cast("double")
    digits = F.replace(F.format_number(F.abs(number), decimals), F.lit(","), F.lit(""))
    # the sign is the number's own, also where it rounds to zero; a plain zero is positive
    return _shown(value, F.concat(F.when(number < 0, "-").otherwise("+"), digits, F.lit("%")))


def fmt_lots(shares: Column) -> Column:
    """shares as lots of a thousand."""
    return F.coalesce(F.format_number(shares / F.lit(1000.0), 0), F.lit(MISSING))


def fmt_net_lots(shares: Column) -> Column:
    """lots with a plus sign from zero up."""
    return F.coalesce(F.concat(F.when(shares >= 0, "+").otherwise(""), F.format_number(shares / F.lit(1000.0), 0)), F.lit(MISSING))


def fmt_broker_price(price: Column) -> Column:
    """six significant digits without trailing zeros; with an exponent below 0.0001 and from a million up, as ``%g`` shows them.

    The number is formatted once, with an exponent; its digits are then moved as text.
    Numbers too small for a full mantissa (below 2.3e-308) show only the digits that tell them apart.
    """
    number = price.cast("double")
    shown = F.call_function("format_number", number, F.lit("0.#####E00"))  # exact binary value, half to even
    mantissa = F.substring_index(shown, "E", 1)
    power = F.substring_index(shown, "E", -1).try_cast("int")  # none in what is no finite number
    digits = F.regexp_replace(mantissa, "[-.]", "")
    fraction = F.substring(digits, power + 2, F.lit(6))
    body = (
        F.when(power.isNull(), F.when(F.isnan(number), "nan").when(number.isNotNull(), "inf"))
        .when(power.between(0, 5), F.concat(F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.when(fraction != "", F.lit(".")).otherwise(""), fraction))
        .when(power.between(-4, -1), F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .otherwise(F.concat(F.ltrim(mantissa, F.lit("-")), F.when(power >= 0, "e+").otherwise("e"), F.substring_index(shown, "E", -1)))
    )
    # the sign stands apart, so that ``shown`` is needed twice whatever the size and is worked out once
    return F.coalesce(F.concat(F.when(F.startswith(shown, F.lit("-")), "-").otherwise(""), body), F.lit(MISSING))


def change(price: Column, previous: Column) -> Column:
    """struct(change, change_pct), both rounded to cents; a zero previous price gives 0 %."""
    diff = price - previous
    pct = F.when(previous != 0, diff / previous * 100).when(previous == 0, F.lit(0.0))
    return F.struct(py_round(diff).alias("change"), py_round(pct).alias("change_pct"))


def reconcile_sign(diff: Column, pct: Column) -> Column:
    """struct(change, change_pct) with one sign: a falling percentage turns the change, a rising one is turned by it."""
    return F.struct(
        F.when((pct < 0) & (diff > 0), -diff).otherwise(diff).alias("change"),
        F.when((pct > 0) & (diff < 0), -pct).otherwise(pct).alias("change_pct"),
    )


def surprise(actual: Column, forecast: Column) -> Column:
    """beat, miss or inline; pending while one is missing, inline where one is no number."""
    a, f = (F.regexp_replace(c, "[^0-9.-]", "").try_cast("double") for c in (actual, forecast))
    missing = F.coalesce(actual, F.lit("")).eqNullSafe("") | F.coalesce(forecast, F.lit("")).eqNullSafe("")
    return (
        F.when(missing, "pending")
        .when(a.isNull() | f.isNull() | (F.abs(a - f) < 0.001), "inline")
        .when(a > f, "beat")
        .otherwise("miss")
    )


def direction(value: Column) -> Column:
    """rise, fall or flat of a number."""
    return F.when(value > 0, "rise").when(value < 0, "fall").otherwise("flat")


def text_direction(text: Column) -> Column:
    """rise, fall or flat of signed text."""
    return F.when(F.contains(text, F.lit("+")), "rise").when(F.contains(text, F.lit("-")), "fall").otherwise("flat")
