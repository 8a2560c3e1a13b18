"""Column expressions that read one cell: number, no-data, percent, date.

Everything here is a Spark expression, so a scan of any size stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast import fixed


CONTROLS = r"[\x00-\x1f\x7f]"
_DECORATION = fixed.CURRENCY_SYMBOLS + "%" + fixed.SPACES


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time per row."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(fixed.SPACES))


def trimmed(c: Column) -> Column:
    """Strip white space of every width from both ends."""
    return _trim(c)


def without_controls(c: Column) -> Column:
    """Drop control characters (below U+0020, and U+007F)."""
    return F.regexp_replace(c, CONTROLS, "")


def _bare(c: Column) -> Column:
    return F.btrim(_trim(c), F.lit("()"))


def is_negative(c: Column) -> Column:
    """True when the cell is written in accounting style, ``(12.50)``."""
    t = _trim(c)
    return t.startswith("(") & t.endswith(")")


def is_percent(c: Column) -> Column:
    return _bare(c).endswith("%")


def plain_number_text(c: Column) -> Column:
    """The cell without decoration, its decimal separator settled as a point.

    The separator that comes last is the decimal one. Commas alone are a decimal
    comma unless exactly three characters follow the last of them.
    """
    return _settle_separator(F.translate(_bare(c), _DECORATION, ""))


def _settle_separator(s: Column) -> Column:
    comma_last = s.rlike(r"[.][^.]*,[^.]*$")
    comma_only = (~s.contains(".")) & s.contains(",") & ~s.rlike(r",[^,]{3}$")
    as_point = F.regexp_replace(F.replace(s, F.lit("."), F.lit("")), r"^([^,]*),", "$1.")
    no_commas = F.replace(s, F.lit(","), F.lit(""))
    return (
        F.when(~s.contains(","), s).when(comma_last | comma_only, as_point).otherwise(no_commas)
    )


def is_no_data(c: Column) -> Column:
    return F.lower(plain_number_text(c)).isin(fixed.NO_DATA)


def _read(text: Column, negative: Column, plain: Column | None = None) -> Column:
    is_number = text.rlike(fixed.NUMBER)
    if plain is not None:
        is_number = plain | is_number
    parsed = F.when(is_number, text.try_cast("double"))
    finite = F.when(F.abs(parsed) < F.lit(float("inf")), parsed)
    signed = F.when(negative, -finite).otherwise(finite)
    return F.when(F.lower(text).isin(fixed.NO_DATA), F.lit(0.0)).otherwise(signed)


def number(c: Column) -> Column:
    """The cell as DOUBLE: 0 for no data, NULL for anything that is not a finite number.

    Each step is computed once per cell; over wide scans use ``with_numbers``.
    """
    return once(
        F.translate(_bare(c), _DECORATION, ""),
        lambda s: once(_settle_separator(s), lambda p: _read(p, is_negative(c))),
    )


def with_numbers(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """Add ``<name>``, ``<name>_percent`` and ``<name>_no_data`` for each named cell.

    Says the same as ``number``, ``is_percent`` and ``is_no_data``, but in steps that are
    columns of their own, so that a wide scan evaluates every pattern once per cell.
    """
    names = list(cells)
    df = df.withColumns({f"_{n}_t": _trim(c) for n, c in cells.items()})
    df = df.withColumns(
        {f"_{n}_b": F.btrim(F.col(f"_{n}_t"), F.lit("()")) for n in names}
    )
    # Most cells are bare numbers already and skip the rest.
    df = df.withColumns({f"_{n}_n": F.col(f"_{n}_b").rlike(fixed.PLAIN_NUMBER) for n in names})
    df = df.withColumns(
        {
            f"_{n}_s": F.when(F.col(f"_{n}_n"), F.col(f"_{n}_b")).otherwise(
                F.translate(f"_{n}_b", _DECORATION, "")
            )
            for n in names
        }
    )
    df = df.withColumns(
        {
            f"_{n}_p": F.when(F.col(f"_{n}_n"), F.col(f"_{n}_s")).otherwise(
                _settle_separator(F.col(f"_{n}_s"))
            )
            for n in names
        }
    )
    out = {}
    for n in names:
        t = F.col(f"_{n}_t")
        plain = F.col(f"_{n}_n")
        out[n] = _read(F.col(f"_{n}_p"), t.startswith("(") & t.endswith(")"), plain)
        out[f"{n}_percent"] = F.col(f"_{n}_b").endswith("%")
        out[f"{n}_no_data"] = F.lower(f"_{n}_p").isin(fixed.NO_DATA)
    steps = [f"_{n}_{k}" for n in names for k in "tbnsp"]
    return df.withColumns(out).drop(*steps)


# Date formats that mean one thing, as (pattern, year, month, day) groups.
_MONTHS = "(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_CLOCK = r"([01]?[0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.,][0-9]+)?"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_ISO_SLASH = r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$"
_ISO_TIME = rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} +{_CLOCK}$"
_ISO_OFFSET = (
    rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_CLOCK}(Z|[+-]([01][0-9]|2[0-4]):[0-5][0-9])$"
)
_DAY_MONTH_NAME = rf"^([0-9]{{1,2}}) +{_MONTHS} +([0-9]{{4}})$"
_MONTH_NAME_DAY = rf"^{_MONTHS} +([0-9]{{1,2}}), +([0-9]{{4}})$"
_NUMERIC = r"^[0-9]{2}([/.-])[0-9]{2}\1[0-9]{4}$"


def _month_number(name: Column) -> Column:
    return (F.position(F.lower(name), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def plain_day(t: Column) -> Column:
    """The date of a trimmed cell in a layout that can be read one way only, else NULL.

    A time of day or a zone offset is dropped: the day is the one written.
    """
    text = (
        F.when(t.rlike(_ISO) | t.rlike(_ISO_TIME) | t.rlike(_ISO_OFFSET), F.substring(t, 1, 10))
        .when(t.rlike(_ISO_SLASH), F.replace(t, F.lit("/"), F.lit("-")))
        .when(
            t.rlike(_DAY_MONTH_NAME),
            _iso(
                F.regexp_extract(t, _DAY_MONTH_NAME, 3),
                _month_number(F.regexp_extract(t, _DAY_MONTH_NAME, 2)).cast("int").cast("string"),
                F.regexp_extract(t, _DAY_MONTH_NAME, 1),
            ),
        )
        .when(
            t.rlike(_MONTH_NAME_DAY),
            _iso(
                F.regexp_extract(t, _MONTH_NAME_DAY, 3),
                _month_number(F.regexp_extract(t, _MONTH_NAME_DAY, 1)).cast("int").cast("string"),
                F.regexp_extract(t, _MONTH_NAME_DAY, 2),
            ),
        )
    )
    return text.try_cast("date")


def _numeric_day(t: Column, day_at: int, month_at: int) -> Column:
    parts = [F.substring(t, 7, 4), F.substring(t, month_at, 2), F.substring(t, day_at, 2)]
    return F.when(t.rlike(_NUMERIC), F.concat_ws("-", *parts)).try_cast("date")


def day_first(t: Column) -> Column:
    return _numeric_day(t, 1, 4)


def month_first(t: Column) -> Column:
    return _numeric_day(t, 4, 1)


def any_day(t: Column) -> Column:
    """True when the trimmed cell is a date in any layout."""
    return F.coalesce(plain_day(t), day_first(t), month_first(t)).isNotNull()


def day_in_order(t: Column, order: Column) -> Column:
    """The date of a trimmed cell under a source's order (``plain``, ``day``, ``month``)."""
    return F.coalesce(
        F.when(order == "day", day_first(t)).when(order == "month", month_first(t)),
        plain_day(t),
    )
