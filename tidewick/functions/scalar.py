"""Column functions of the formula language and the statistical gates.

Missing values are NULL, never NaN, and every function here is strict: NULL in
any argument gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GUARD = 1e-12
#: The window buckets.
BUCKETS = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)


def guarded_div(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), None).when(F.abs(b) < GUARD, 0.0).otherwise(F.try_divide(a, b))


def guarded_return(x: Column, before: Column) -> Column:
    return F.when(x.isNull() | before.isNull(), None).when(F.abs(before) < GUARD, 0.0).otherwise(F.try_divide(x, before) - F.lit(1.0))


def clipped(x: Column, lo: int, hi: int) -> Column:
    """greatest and least skip NULL, hence the test."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def truth(condition: Column) -> Column:
    return condition.cast("double")


def both(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), None).otherwise(truth((a != 0) & (b != 0)))


def either(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), None).otherwise(truth((a != 0) | (b != 0)))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def nearest_bucket(w: Column) -> Column:
    """The nearest window bucket; of two as near, the smaller."""
    out = F.lit(BUCKETS[-1])
    for lo, hi in reversed(list(zip(BUCKETS, BUCKETS[1:], strict=False))):
        out = F.when(w * 2 <= lo + hi, lo).otherwise(out)
    return out.cast("int")


#: Hart's rational approximation of the normal distribution function, lowest power first.
_NUMERATOR = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 3.52624965998911e-02)
_DENOMINATOR = (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-02)
#: Wichura's AS 241 for its inverse, lowest power first: centre, middle, tail.
_CENTRE = (
    (3.387132872796366608, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.1870074920579083, 5394.1960214247511077, 21213.794301586595867, 39307.89580009271061, 28729.085735721942674, 5226.495278852545925),
)
_MIDDLE = (
    (1.42343711074968357734, 4.6303378461565452959, 5.7694972214606914055, 3.64784832476320460504, 1.27045825245236838258, 0.24178072517745061177, 0.0227238449892691845833, 7.7454501427834140764e-4),
    (1.0, 2.05319162663775882187, 1.6763848301838038494, 0.68976733498510000455, 0.14810397642748007459, 0.0151986665636164571966, 5.475938084995344946e-4, 1.05075007164441684324e-9),
)
_TAIL = (
    (6.6579046435011037772, 5.4637849111641143699, 1.7848265399172913358, 0.29656057182850489123, 0.026532189526576123093, 0.0012426609473880784386, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.59983220655588793769, 0.13692988092273580531, 0.0148753612908506148525, 7.868691311456132591e-4, 1.8463183175100546818e-5, 1.4215117583164458887e-7, 2.04426310338993978564e-15),
)


def _poly(c, x: str) -> str:
    out = repr(float(c[-1])) + "D"
    for v in c[-2::-1]:
        out = f"({out} * {x} + {float(v)!r}D)"
    return out


def normal_cdf(x: str) -> str:
    """SQL text of the standard normal distribution function of x, within 1e-14."""
    z = f"abs({x})"
    inner = f"exp(-{z} * {z} / 2.0D) * {_poly(_NUMERATOR, z)} / {_poly(_DENOMINATOR, z)}"
    far = f"exp(-{z} * {z} / 2.0D) / ({z} + 1.0D / ({z} + 2.0D / ({z} + 3.0D / ({z} + 4.0D / ({z} + 0.65D))))) / 2.506628274631D"
    upper = f"CASE WHEN {z} > 37.0D THEN 0.0D WHEN {z} < 7.07106781186547D THEN {inner} ELSE {far} END"
    return f"(CASE WHEN {x} > 0.0D THEN 1.0D - ({upper}) ELSE ({upper}) END)"


def normal_quantile(p: str) -> str:
    """SQL text of the standard normal quantile of p in (0, 1)."""
    q = f"({p} - 0.5D)"
    r = f"(0.180625D - {q} * {q})"
    s = f"sqrt(-ln(CASE WHEN {p} < 0.5D THEN {p} ELSE 1.0D - {p} END))"
    centre = f"{q} * {_poly(_CENTRE[0], r)} / {_poly(_CENTRE[1], r)}"
    middle = f"{_poly(_MIDDLE[0], f'({s} - 1.6D)')} / {_poly(_MIDDLE[1], f'({s} - 1.6D)')}"
    tail = f"{_poly(_TAIL[0], f'({s} - 5.0D)')} / {_poly(_TAIL[1], f'({s} - 5.0D)')}"
    return f"(CASE WHEN abs({q}) <= 0.425D THEN {centre} ELSE (CASE WHEN {q} < 0.0D THEN -1.0D ELSE 1.0D END) * (CASE WHEN {s} <= 5.0D THEN {middle} ELSE {tail} END) END)"


def for_duckdb(sql: str) -> str:
    """The same text for DuckDB, which has no D suffix."""
    import re

    return re.sub(r"(\d(?:e[-+]?\d+)?)D\b", r"\1::DOUBLE", sql)
