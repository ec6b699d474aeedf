"""Scalar functions of Postgres, Oracle, Redshift and T-SQL as Spark columns.

Each helper takes and returns columns and uses built-in expressions only. ``call`` finds
the helper by dialect and SQL name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from millrace.operators.expressions import cast_to


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _arg(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


# --- conditionals ------------------------------------------------------------------


def coalesce(*columns) -> Column:
    """COALESCE, NVL, two-argument ISNULL: the first value that is not null."""
    return F.coalesce(*[_col(c) for c in columns])


def nvl2(column, if_set, if_null) -> Column:
    return F.nvl2(_col(column), _arg(if_set), _arg(if_null))


def decode(column, *rest) -> Column:
    """DECODE(x, key, value, …[, default]); a null key matches a null value."""
    pairs, default = rest, None
    if len(rest) % 2:
        pairs, default = rest[:-1], rest[-1]
    out = None
    for key, value in zip(pairs[::2], pairs[1::2]):
        hit = _col(column).eqNullSafe(_arg(key))
        out = F.when(hit, _arg(value)) if out is None else out.when(hit, _arg(value))
    return out.otherwise(_arg(default))


def nullif(left, right) -> Column:
    return F.nullif(_col(left), _arg(right))


def greatest(*columns) -> Column:
    return F.greatest(*[_col(c) for c in columns])


def least(*columns) -> Column:
    return F.least(*[_col(c) for c in columns])


# --- text --------------------------------------------------------------------------


def substr(column, start: int, length: int | None = None) -> Column:
    """SUBSTR with positions from 1."""
    if length is None:
        return F.substr(_col(column), F.lit(start))
    return F.substr(_col(column), F.lit(start), F.lit(length))


def len_(column) -> Column:
    """LEN: characters without the blanks at the end."""
    return F.length(F.rtrim(_col(column)))


def charindex(needle, column, start: int = 1) -> Column:
    """CHARINDEX(needle, text[, start]): first position from ``start`` on, or 0."""
    return F.position(_arg(needle), _col(column), F.lit(start))


def stuff(column, start: int, length: int, text: str) -> Column:
    """STUFF: replace ``length`` characters from ``start`` by ``text``."""
    return F.overlay(_col(column), F.lit(text), F.lit(start), F.lit(length))


def regexp_replace(column, pattern: str, replacement: str, flags: str = "") -> Column:
    """Postgres REGEXP_REPLACE: the first match only, all with flag ``g``; ``i`` ignores case."""
    java = re.sub(r"\$", r"\\$", replacement)
    shift = 0 if "g" in flags else 1
    java = re.sub(r"\\([1-9])", lambda m: f"${int(m.group(1)) + shift}", java)
    # the group in front moves the pattern's own back-references as well
    pattern = re.sub(r"(?<!\\)((?:\\\\)*)\\([1-9])", lambda m: f"{m.group(1)}\\{int(m.group(2)) + shift}", pattern)
    case = "(?i)" if "i" in flags else ""
    if shift == 0:
        return F.regexp_replace(_col(column), case + pattern, java)
    if java[:1].isdigit():
        java = "\\" + java  # keeps "$1" apart from a digit that follows
    return F.regexp_replace(_col(column), rf"{case}^([\s\S]*?)(?:{pattern})", "$1" + java)


def lpad(column, length: int, fill: str = " ") -> Column:
    return F.lpad(_col(column), length, fill)


def conv(column, from_base: int, to_base: int) -> Column:
    return F.conv(_col(column).cast("string"), from_base, to_base)


# --- numbers -----------------------------------------------------------------------


def round_(column, digits: int = 0, precision: int = 38, scale: int | None = None) -> Column:
    """ROUND half away from zero, on decimals so that a tie is a tie.

    Keeps 20 digits before the point, and at least the digits asked for behind it.
    """
    scale = max(18, min(digits + 1, 37)) if scale is None else scale
    return F.round(_col(column).cast(f"decimal({precision},{scale})"), digits)


def trunc_number(column, digits: int = 0) -> Column:
    """TRUNC(number[, digits]): towards zero."""
    factor = F.lit(10**digits)
    shifted = _col(column) * factor
    cut = F.when(shifted < 0, F.ceil(shifted)).otherwise(F.floor(shifted))
    return cut / factor


# --- dates -------------------------------------------------------------------------

# Date pattern elements of Oracle/Postgres and their Spark letters (fixed values).
DATE_ELEMENTS = {
    "YYYY": "yyyy",
    "HH24": "HH",
    "HH12": "hh",
    "MONTH": "MMMM",
    "MON": "MMM",
    "DAY": "EEEE",
    "DY": "EEE",
    "DDD": "DDD",
    "MM": "MM",
    "DD": "dd",
    "HH": "hh",
    "MI": "mm",
    "SS": "ss",
    "FF": "SSSSSS",
    "YY": "yy",
    "AM": "a",
    "PM": "a",
    "Q": "Q",
}
_ELEMENT = re.compile(
    '"([^"]*)"|' + "|".join(sorted(DATE_ELEMENTS, key=len, reverse=True)) + "|[A-Za-z]+",
    re.IGNORECASE,
)


def date_pattern(pattern: str) -> str:
    """Spark pattern for an Oracle/Postgres one; other letters become quoted text."""

    def letter(match: re.Match) -> str:
        if match.group(1) is not None:
            return f"'{match.group(1)}'"
        known = DATE_ELEMENTS.get(match.group(0).upper())
        return known if known else f"'{match.group(0)}'"

    return _ELEMENT.sub(letter, pattern)


def extract(part: str, column) -> Column:
    """EXTRACT(part FROM x) and DATEPART(part, x)."""
    return F.date_part(F.lit(part), _col(column))


def date_trunc(unit: str, column) -> Column:
    return F.date_trunc(unit, _col(column))


def trunc_date(column, pattern: str = "DD") -> Column:
    """Oracle TRUNC(date[, pattern]); the day if no pattern is given."""
    unit = {"DD": "day", "DDD": "day", "J": "day", "IW": "week", "D": "week", "HH": "hour",
            "HH24": "hour", "MI": "minute"}.get(pattern.upper(), pattern)
    return F.date_trunc(unit, _col(column))


def to_char_date(column, pattern: str) -> Column:
    return F.date_format(_col(column), date_pattern(pattern))


NUMBER_PATTERN = re.compile(r"[09.,$SGDLMI ]+", re.IGNORECASE)


def to_char_number(column, pattern: str, precision: int = 38, scale: int | None = None) -> Column:
    """TO_CHAR(number, '999,990.00') without the leading blanks, rounded to the pattern's decimals."""
    if scale is None:
        scale = len(re.findall("[09]", re.split("[.D]", pattern.upper())[1])) if re.search("[.D]", pattern.upper()) else 0
    return F.trim(F.to_char(_col(column).cast(f"decimal({precision},{scale})"), F.lit(pattern)))


def to_char(column, pattern: str) -> Column:
    """TO_CHAR of a number or of a date, as the pattern says."""
    digits = re.search("[09]", pattern) and NUMBER_PATTERN.fullmatch(pattern)
    return to_char_number(column, pattern) if digits else to_char_date(column, pattern)


def trunc(column, how: str | int = "DD") -> Column:
    """Oracle TRUNC: of a number if ``how`` is a number of digits, else of a date."""
    if isinstance(how, str):
        return trunc_date(column, how)
    x = _col(column).cast("decimal(38,18)")
    if how >= 0:  # towards zero: cut the digits of the decimal's text
        whole = F.regexp_extract(x.cast("string"), rf"^-?\d+(?:\.\d{{0,{how}}})?", 0) if how else F.regexp_extract(x.cast("string"), r"^-?\d+", 0)
        return whole.cast("decimal(38,18)")
    step = F.lit(10 ** -how).cast("decimal(38,0)")
    whole = F.regexp_extract(x.cast("string"), r"^-?\d+", 0).cast("decimal(38,0)")
    return (whole - whole % step).cast("decimal(38,18)")


def to_date(column, pattern: str) -> Column:
    return F.to_date(_col(column), date_pattern(pattern))


def to_timestamp(column, pattern: str) -> Column:
    return F.to_timestamp(_col(column), date_pattern(pattern))


def now(as_of: Column | None = None) -> Column:
    """SYSDATE, GETDATE(), NOW(); pass ``as_of`` where a rerun must give the same."""
    return F.current_timestamp() if as_of is None else as_of


def today(as_of: Column | None = None) -> Column:
    return F.current_date() if as_of is None else as_of.cast("date")


UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


def _unit(unit: str) -> str:
    name = unit.lower().rstrip("s")
    if name not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    return name


def dateadd(unit: str, amount, column) -> Column:
    """DATEADD(unit, n, x): any unit, a month end stays inside its month."""
    return F.timestamp_add(_unit(unit).upper(), _arg(amount), _col(column))


def datediff(unit: str, start, end) -> Column:
    """DATEDIFF(unit, start, end): unit boundaries crossed, not whole units elapsed."""
    start, end = _col(start), _col(end)
    name = _unit(unit)
    months = (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))
    days = F.date_diff(end.cast("date"), start.cast("date")).cast("bigint")
    hours = days * 24 + (F.hour(end) - F.hour(start))
    minutes = hours * 60 + (F.minute(end) - F.minute(start))
    if name == "year":
        return (F.year(end) - F.year(start)).cast("bigint")
    if name == "quarter":
        return ((F.year(end) - F.year(start)) * 4 + (F.quarter(end) - F.quarter(start))).cast("bigint")
    if name == "month":
        return months.cast("bigint")
    if name == "week":
        mondays = F.date_diff(F.date_trunc("week", end), F.date_trunc("week", start))
        return (mondays / 7).cast("bigint")
    if name == "day":
        return days
    if name == "hour":
        return hours
    if name == "minute":
        return minutes
    return minutes * 60 + (F.second(end) - F.second(start))


def convert(type_name: str, column) -> Column:
    """CONVERT(type, x)."""
    return cast_to(_col(column), type_name)


# --- lookup ------------------------------------------------------------------------

COMMON = {
    "coalesce": coalesce,
    "nullif": nullif,
    "greatest": greatest,
    "least": least,
    "substr": substr,
    "substring": substr,
    "lpad": lpad,
    "conv": conv,
    "round": round_,
    "extract": extract,
    "date_trunc": date_trunc,
    "now": now,
    "current_timestamp": now,
    "current_date": today,
    "to_date": to_date,
    "to_timestamp": to_timestamp,
}
DIALECTS = {
    "spark": {},
    "postgres": {"regexp_replace": regexp_replace, "to_char": to_char},
    "oracle": {
        "nvl": coalesce,
        "nvl2": nvl2,
        "decode": decode,
        "sysdate": now,
        "trunc": trunc,
        "to_char": to_char,
    },
    "redshift": {
        "nvl": coalesce,
        "isnull": coalesce,
        "dateadd": dateadd,
        "datediff": datediff,
        "datepart": extract,
        "getdate": now,
        "len": len_,
        "charindex": charindex,
        "stuff": stuff,
        "convert": convert,
    },
}


def call(dialect: str, name: str, *args) -> Column:
    """Apply the function ``name`` of a dialect; an unknown name goes to Spark as it is."""
    known = {**COMMON, **DIALECTS.get(dialect.lower(), {})}
    helper = known.get(name.lower())
    if helper is not None:
        return helper(*args)
    return F.call_function(name, *[a if isinstance(a, Column) else F.lit(a) for a in args])
