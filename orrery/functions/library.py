"""Functions of the expression language as Spark columns.

Where SQL servers answer null for a bad argument and ANSI Spark would raise, null is answered.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: %-specifiers of date formats and their Java patterns.
DATE_PATTERNS = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "i": "mm", "s": "ss", "S": "ss", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "p": "a", "j": "DDD", "T": "HH:mm:ss", "f": "SSSSSS"}
UNITS = ("MICROSECOND", "SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR")
#: Type names of casts.
CASTS = {"CHAR": "string", "SIGNED": "bigint", "UNSIGNED": "bigint", "DECIMAL": "decimal(10,2)", "DATE": "date", "DATETIME": "timestamp_ntz", "DOUBLE": "double"}
AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "average": F.avg, "avg": F.avg, "stddev": F.stddev_pop}


def java_pattern(spec: str) -> str:
    out, i = "", 0
    while i < len(spec):
        if spec[i] == "%" and i + 1 < len(spec):
            out += DATE_PATTERNS.get(spec[i + 1], spec[i + 1])
            i += 2
        else:
            out += f"'{spec[i]}'" if spec[i].isalpha() else spec[i]
            i += 1
    return out


def _none_null(function: Callable[..., Column]) -> Callable[..., Column]:
    """Null if any argument is, where Spark would skip nulls."""
    return lambda *a: F.when(reduce(lambda x, y: x | y, [c.isNull() for c in a]), None).otherwise(function(*a))


def _truncate(x: Column, digits: Column | None = None) -> Column:
    scale = F.pow(F.lit(10.0), digits if digits is not None else F.lit(0))
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def _week(d: Column) -> Column:
    """Weeks from Sunday on; days before the first Sunday are week 0."""
    return F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")


def _substring(s: Column, at: Column, size: Column | None = None) -> Column:
    return F.when(at == 0, F.lit("")).otherwise(F.substring(s, at, size if size is not None else F.length(s)))


def _regexp_replace(text: Column, pattern: Column, new: Column) -> Column:
    """References to groups are written \\1 in `new`; a dollar sign is one."""
    literal = F.replace(new, F.lit("$"), F.lit("\\$"))
    return F.call_function("regexp_replace", text, pattern, F.call_function("regexp_replace", literal, F.lit(r"\\(\d)"), F.lit(r"\$$1")))


def _clock(sign: int) -> Callable[[Column, Column], Column]:
    def shifted(d: Column, clock: Column) -> Column:
        p = F.split(clock, ":")
        return F.timestamp_add("SECOND", sign * (p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")), d)

    return shifted


FUNCTIONS: dict[str, Callable[..., Column]] = {
    # arithmetic
    "add:to:": lambda *a: reduce(lambda x, y: x + y, a), "from:subtract:": lambda a, b: a - b, "multiply:by:": lambda *a: reduce(lambda x, y: x * y, a),
    "divide:by:": F.try_divide, "modulus:by:": F.try_mod,
    "bitwiseAnd:with:": lambda a, b: a.bitwiseAND(b), "bitwiseOr:with:": lambda a, b: a.bitwiseOR(b), "bitwiseXor:with:": lambda a, b: a.bitwiseXOR(b),
    "leftshift:by:": lambda a, b: F.call_function("shiftleft", a.cast("bigint"), b.cast("int")),
    "rightshift:by:": lambda a, b: F.call_function("shiftrightunsigned", a.cast("bigint"), b.cast("int")),
    "sqrt:": lambda a: F.when(a >= 0, F.sqrt(a)), "ln:": F.ln, "log:": lambda a, b=None: F.ln(a) if b is None else F.try_divide(F.ln(b), F.ln(a)),
    "exp:": F.exp, "ceiling:": F.ceil, "abs:": F.abs, "floor:": F.floor, "round:": lambda a, n=None: F.call_function("round", a) if n is None else F.call_function("round", a, n),
    "trunc:": _truncate, "raise:toPower:": F.pow, "random": lambda: F.rand(), "greatest:": _none_null(F.greatest), "least:": _none_null(F.least),
    # text
    "uppercase:": F.upper, "lowercase:": F.lower, "concat:": lambda sep, *a: F.call_function("concat_ws", sep, *a), "substring:": _substring,
    "replace:": F.replace, "regexpReplace:": _regexp_replace, "length:": F.octet_length, "trim:": F.trim,
    "lpad:": lambda s, n, p: F.call_function("lpad", s, n, p), "rpad:": lambda s, n, p: F.call_function("rpad", s, n, p), "left:": F.left, "right:": F.right,
    "instr:": lambda s, x: F.call_function("instr", s, x), "reverse:": F.reverse, "repeat:": lambda s, n: F.call_function("repeat", s, n), "index:": lambda n, *a: F.get(F.array(*a), n - 1),
    # nulls and types
    "isNull:": F.isnull, "ifNull:": F.ifnull, "nullIf:": F.nullif, "coalesce:": F.coalesce, "uuid": lambda: F.expr("uuid()"),
    # dates
    "now": F.localtimestamp, "currentDate": F.current_date, "year:": F.year, "month:": F.month, "day:": F.dayofmonth, "hour:": F.hour, "minute:": F.minute, "second:": F.second,
    "week:": _week, "quarter:": F.quarter, "date:": F.to_date, "lastDay:": F.last_day, "dayOfWeek:": F.dayofweek, "dayOfYear:": F.dayofyear,
    "fromUnixTime:": F.timestamp_seconds, "unixTimestamp:": lambda d: F.unix_timestamp(d.cast("timestamp")), "addTime:": _clock(1), "subTime:": _clock(-1),
}
#: Functions with one argument that is a name rather than a value, and the place of that argument.
CONSTANT_FUNCTIONS: dict[str, tuple[Callable[..., Column], int]] = {
    "cast:": (lambda c, kind: c.try_cast(CASTS.get(str(kind).upper(), kind)), 1),
    "dateFormat:": (lambda d, spec: F.date_format(d, java_pattern(spec)), 1),
    "dateDiff:": (lambda unit, a, b: F.timestamp_diff(unit, a, b), 0),
    "dateAdd:": (lambda d, n, unit: F.timestamp_add(unit, n, d), 2),
    "dateSub:": (lambda d, n, unit: F.timestamp_add(unit, -n, d), 2),
}
#: Functions whose results change between calls; requests with them are not cached.
VOLATILE = {"random", "uuid", "now", "currentDate"}
