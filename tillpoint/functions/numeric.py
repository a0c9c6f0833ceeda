"""Exact decimal ratios.

``num / den`` with the result rounded HALF_UP to a declared DECIMAL(p, s),
computed in decimal arithmetic (no float step), so the value never depends
on summation order or on binary rounding of the quotient.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_ratio(num: Column, den: Column, precision: int, scale: int,
                  num_scale: int = 0, den_scale: int = 0) -> Column:
    """HALF_UP(num / den) as DECIMAL(precision, scale); NULL when den = 0.

    ``num`` / ``den`` are integers or DECIMALs with ``num_scale`` /
    ``den_scale`` fraction digits.  Operand precisions are kept small so Spark's decimal division
    keeps enough digits that its intermediate rounding cannot move a value
    across the final rounding boundary.
    """
    n = num.cast(f"decimal({20 + num_scale},{num_scale})")
    d = F.nullif(den, F.lit(0)).cast(f"decimal({16 + den_scale},{den_scale})")
    return (n / d).cast(f"decimal({precision},{scale})")


def checked(value: Column, within: Column, message: str) -> Column:
    """``value`` where ``within`` holds; the job fails with ``message`` where
    it does not, rather than going on with a number that means something else."""
    return F.when(F.coalesce(within, F.lit(True)), value).otherwise(F.raise_error(F.lit(message)).cast("bigint"))
