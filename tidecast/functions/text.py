"""Small text expressions: number display, run labels, history verdicts, capped lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecast import fixed


def decimals(v: Column, digits: int) -> Column:
    """A fixed number of decimals, rounded on the exact binary value."""
    return F.replace(F.format_number(v, digits), F.lit(","), F.lit(""))


def _scientific(v: Column) -> Column:
    """Six significant digits, no trailing zeros, two-digit exponent."""
    exponent = F.floor(F.log10(F.abs(v)))
    mantissa = v / F.pow(F.lit(10.0), exponent.cast("double"))
    carried = F.abs(F.round(mantissa, 5)) >= 10
    mantissa = F.when(carried, mantissa / 10).otherwise(mantissa)
    exponent = F.when(carried, exponent + 1).otherwise(exponent)
    digits = F.regexp_replace(F.format_string("%.5f", mantissa), r"[.]?0+$", "")
    sign = F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+"))
    return F.concat(
        digits, F.lit("e"), sign, F.format_string("%02d", F.abs(exponent).cast("long"))
    )


def display_value(v: Column, percent: Column | None = None) -> Column:
    """A number at a precision that fits its size; a percent column gets its sign back."""
    a = F.abs(v)
    text = (
        F.when(v == 0, F.lit("0"))
        .when((a >= 1e15) | (a < 1e-4), _scientific(v))
        .when(a < 1, decimals(v, 6))
        .when(a < 100, decimals(v, 3))
        .otherwise(decimals(v, 2))
    )
    if percent is None:
        return text
    return F.when(percent, F.concat(text, F.lit("%"))).otherwise(text)


def run_label(model: Column, window: Column) -> Column:
    return F.concat_ws("@", model, window)


def enough_history(days: Column) -> Column:
    return days >= fixed.IMPORT_MIN_DAYS


def history_verdict(days: Column) -> Column:
    return (
        F.when(days < fixed.IMPORT_MIN_DAYS, F.lit("too short"))
        .when(days >= fixed.IMPORT_BEST_DAYS, F.lit("two years"))
        .when(days >= fixed.IMPORT_GOOD_DAYS, F.lit("one year"))
        .otherwise(F.lit("enough"))
    )


def first_names(names: Column) -> Column:
    """The first few names, then how many more there are."""
    n = fixed.SHOWN_NAMES
    more = F.format_string("and %d more", F.size(names) - n)
    return F.when(F.size(names) <= n, names).otherwise(
        F.concat(F.slice(names, 1, n), F.array(more))
    )
