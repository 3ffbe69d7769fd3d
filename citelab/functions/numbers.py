"""Rounding as it is done on the exact value of a binary number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO53 = 9007199254740992


def round_signed(c, digits: int) -> Column:
    """round() that keeps the sign of what becomes 0, as SQL's does on doubles: -0.000001 gives -0.0."""
    r = F.round(c, digits)
    return F.when((r == 0) & (F.col(c) < 0 if isinstance(c, str) else c < 0), F.lit(-0.0)).otherwise(r)


def round_exact(c, digits: int) -> Column:
    """A double rounded half-even to 0 to 12 digits, decided on its exact binary value, as Python's round() does: 2.675 lies below the tie and
    gives 2.67, 0.125 is one and gives 0.12. Numbers from 2**52 on, infinities and NaN stay as they are.

    The fraction is cut in two integers of 53 bits, which a multiplication by a power of two gives exactly; times ten to the digits they are
    compared with a half as decimals."""
    if not 0 <= digits <= 12:
        raise ValueError("0 to 12 digits")
    big, ten = "decimal(38,0)", F.lit(10**digits).cast("decimal(13,0)")
    two53, half = F.lit(_TWO53).cast("decimal(16,0)"), F.lit(_TWO53 // 2).cast(big)

    def cut(x: Column) -> Column:
        a = F.abs(x)
        first = (a - F.floor(a)) * float(_TWO53)
        second = (first - F.floor(first)) * float(_TWO53)
        return F.struct(x.alias("x"), F.floor(a).alias("whole"), F.floor(first).alias("high"), F.floor(second).alias("low"), (second == F.floor(second)).alias("all"))

    def scaled(p: Column) -> Column:
        over = p["low"].cast("decimal(16,0)") * ten
        total = ((p["high"].cast("decimal(16,0)") * ten).cast(big) + _div(over, two53)).cast(big)
        return F.struct(p["x"].alias("x"), p["whole"].alias("whole"), _div(total, two53).alias("units"), (total % two53).cast(big).alias("rest"), (p["all"] & (over % two53 == 0)).alias("exact"))

    def rounded(p: Column) -> Column:
        odd = (p["units"] + (p["whole"] if digits == 0 else F.lit(0))) % 2 == 1
        up = (p["rest"] > half) | ((p["rest"] == half) & (~p["exact"] | odd))
        return F.struct(p["x"].alias("x"), p["whole"].alias("whole"), (p["units"] + up.cast("long")).alias("units"))

    def value(p: Column) -> Column:
        full = p["units"] >= 10**digits
        whole = p["whole"] + (p["units"] if digits == 0 else full.cast("long"))
        text = whole.cast("string") if digits == 0 else F.concat(whole.cast("string"), F.lit("."), F.lpad(F.when(full, 0).otherwise(p["units"]).cast("string"), digits, "0"))
        return F.when((p["x"] < 0) | (p["x"].cast("string") == "-0.0"), -text.cast("double")).otherwise(text.cast("double"))

    x = c.cast("double")
    fits = ~(x.isNull() | F.isnan(x) | (F.abs(x) >= float(_TWO53 // 2)))
    # each step is a function of one value, so that what it is made of is computed once
    out = F.array(F.when(fits, x))
    for step in (cut, scaled, rounded, value):
        out = F.transform(out, step)
    return F.when(fits, out[0]).otherwise(x)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)
