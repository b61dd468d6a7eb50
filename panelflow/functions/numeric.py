"""Numeric helpers shared by every operator.

* ``np_round``: NumPy-style rounding (scale, round half to even, unscale).
  Spark's ``round`` is HALF_UP and ``bround`` rounds the decimal text, so
  neither equals NumPy's result on binary doubles.
* ``safe_div``: division that yields NULL instead of raising under ANSI.
* ``to_num``: numeric coercion where bad text becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def np_round(x, decimals: int = 2) -> Column:
    """``np.round(x, decimals)``: rint(x * 10^d) / 10^d."""
    scale = float(10 ** decimals)
    return F.rint(_c(x) * F.lit(scale)) / F.lit(scale)


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (never raises)."""
    return F.try_divide(_c(num), _c(den))


def to_num(x, dtype: str = "double") -> Column:
    """Coerce text to a number; unparsable text gives NULL."""
    return F.expr(f"try_cast({x} as {dtype})") if isinstance(x, str) else x.try_cast(dtype)


def first_non_null(x, order) -> Column:
    """Value of ``x`` at the smallest ``order`` among rows where ``x`` is
    not NULL (pandas ``first`` skips missing values).  ``min_by`` ignores
    rows whose ordering is NULL, so masking the ordering does the skip."""
    x = _c(x)
    return F.min_by(x, F.when(x.isNotNull(), _c(order)))


def clip(x, lo, hi) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (``greatest``/``least`` skip NULLs,
    so guard explicitly)."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def non_negative(x) -> Column:
    """max(x, 0) with NULL kept as NULL."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(x, F.lit(0.0)))
