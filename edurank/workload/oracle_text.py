"""Building blocks for the checking statements (DuckDB dialect)."""

from __future__ import annotations


def half_up(total: str, count: str, shift: int = 0) -> str:
    """``total / count`` as an integer in units of ``10**-shift``, rounded half up (non-negative)."""
    return f"((2 * ({total}) * {10**shift} + ({count})) // nullif(2 * ({count}), 0))"


def scaled(units: str, digits: int) -> str:
    """Integer units of ``10**-digits`` as a double."""
    return f"(cast({units} as double) / {10**digits}e0)"


def round_even(x: str, digits: int) -> str:
    """Half to even on the exact binary value of the double ``x``."""
    t = f"{10**digits}e0"
    product = f"(({x}) * {t})"
    spread = f"(({x}) * 134217729e0)"
    high = f"({spread} - ({spread} - ({x})))"
    error = f"((({high}) * {t} - {product}) + (({x}) - {high}) * {t})"
    low = f"floor({product})"
    excess = f"((({product} - {low}) - 0.5e0) + {error})"
    up = f"({excess} > 0 or ({excess} = 0 and {low} % 2 <> 0))"
    return f"(({low} + case when {up} then 1 else 0 end) / {t})"


def ids(values) -> str:
    return "(" + ", ".join(str(v) for v in values) + ")"
