"""Small column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def finite(c: Column | str) -> Column:
    """NULL for NaN and infinities, the value otherwise."""
    c = as_col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is zero."""
    return F.when(den != 0, num.cast("double") / den)


def share(cond: Column) -> Column:
    """Mean of a boolean over the rows where it is not NULL."""
    return F.avg(cond.cast("double"))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Report form: doubles rounded without negative zero, integers as bigint."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if t in ("double", "float"):
            # First to nine digits, so that summation noise cannot decide a tie at the last
            # reported digit; scaled, so that halves round away from zero on the double.
            c = finite(c)
            for d in (digits + 3, digits):
                scale = F.lit(10.0**d)
                c = F.round(c * scale, 0) / scale
            c = c + F.lit(0.0)
        elif t in ("integer", "short", "byte"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def hash_key(seed, *cols) -> Column:
    """Uniform hexadecimal key of the given columns under a seed (md5, 32 digits)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_col(c).cast("string") for c in cols]))


def hash_uniform(key: Column, n: Column) -> Column:
    """Integer in [0, n) from the first eight digits of a hexadecimal key."""
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"), n)
