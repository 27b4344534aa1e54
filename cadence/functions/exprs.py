"""Column-level helpers, all built from JVM-side Spark functions (codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accepted plain-number syntax (optional sign, digits with an
# optional fraction, optional exponent).  Text such as '1d', 'inf', 'NaN',
# '1,000' or '..' is rejected, as a strict numeric parser would.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Coerce text/number to DOUBLE; anything unparsable becomes NULL."""
    s = F.trim(_c(c).cast("string"))
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def whole_number(c: Column | str) -> Column:
    """Coerce to BIGINT; NULL for text that is no number, for fractions and
    for numbers out of range."""
    x = to_number(c)
    return F.when(x == F.floor(x), x.try_cast("bigint"))


def finite(c: Column | str) -> Column:
    """NaN and +-infinity become NULL."""
    x = _c(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is 0 or NULL (never +-inf, never an ANSI error)."""
    return F.try_divide(_c(a), _c(b))


def log10_pos(c: Column | str) -> Column:
    """log10 of positive values; non-positive -> NULL."""
    x = _c(c)
    return F.log10(F.when(x > 0, x))


def nonblank(c: Column | str) -> Column:
    """trim + blank-to-NULL."""
    return F.nullif(F.trim(_c(c)), F.lit(""))


def default_text(c: Column | str, default: str) -> Column:
    """NULL or blank text -> a default label."""
    return F.coalesce(nonblank(c), F.lit(default))


def combine_text(*cols: Column | str, sep: str = " | ") -> Column:
    """Merge texts (J3): trim, skip empty and 'nan', keep first occurrence of
    duplicates, join in argument order."""
    arr = F.transform(F.array(*[_c(c).cast("string") for c in cols]), lambda x: F.trim(x))
    kept = F.filter(arr, lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "nan"))
    return F.array_join(F.array_distinct(kept), sep)


def guarded_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation on pairwise-complete rows that returns NULL (instead
    of raising under ANSI mode) when either side is constant."""
    x, y = _c(x), _c(y)
    xx = F.when(y.isNotNull(), x)
    yy = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))


def pair_count(x: Column | str, y: Column | str) -> Column:
    return F.count(F.when(_c(x).isNotNull() & _c(y).isNotNull(), F.lit(1)))
