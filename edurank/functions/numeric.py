"""Exact averages and rounding, as SQL expressions.

Two rounding rules live side by side in the data model:

* database figures are exact numerics rounded half up -> :func:`exact_ratio`;
* application figures are IEEE doubles rounded half to even on their *binary*
  value -> :func:`round_even`.

Spark's own ``bround`` on doubles works on the shortest decimal text of the
double, which differs on near ties, hence the explicit form below.

Arguments and results are SQL text: one parsed expression costs a single call
into the JVM where a tree of Column objects costs one per node.
"""

from __future__ import annotations

# Splits a double into two 26-bit halves (2^27 + 1).
_SPLIT = "134217729D"


def exact_ratio(total: str, count: str, scale: int) -> str:
    """``total / count`` in wide decimals, rounded half up; null for an empty count."""
    quotient = f"cast({total} as decimal(24,10)) / cast(nullif({count}, 0) as decimal(12,0))"
    return f"cast(round({quotient}, {scale}) as decimal({12 + scale},{scale}))"


def exact_avg(value: str, scale: int) -> str:
    """Half-up mean of an integer or decimal column (aggregate)."""
    return exact_ratio(f"sum({value})", f"count({value})", scale)


def round_even(value: str, scale: int) -> str:
    """Round a double column half to even on its exact binary value.

    ``value * 10**scale`` is taken together with the rounding error of that
    product (error-free multiplication), so a tie is only a tie when the double
    really lies on the midpoint.  ``value`` has to be a column, not a formula:
    it is used several times.
    """
    if scale == 0:
        return f"rint({value})"
    factor = f"{10**scale}D"
    product = f"({value} * {factor})"
    spread = f"({value} * {_SPLIT})"
    high = f"({spread} - ({spread} - {value}))"
    error = f"(({high} * {factor} - {product}) + ({value} - {high}) * {factor})"
    low = f"floor({product})"
    excess = f"((({product} - cast({low} as double)) - 0.5D) + {error})"
    up = f"({excess} > 0 or ({excess} = 0 and pmod({low}, 2) = 1))"
    return f"cast({low} + case when {up} then 1 else 0 end as double) / {factor}"


def to_int_even(value: str) -> str:
    """Nearest integer, ties to even."""
    return f"cast(rint(cast({value} as double)) as bigint)"


def clamp(value: str, low, high) -> str:
    """Bound a value; null stays null."""
    return f"case when {value} is not null then least(greatest({value}, {low}), {high}) end"


def to_number_5_2(value: str) -> str:
    """Fit a double column into decimal(5,2)."""
    fitted = f"case when {value} > 999.99D then 999.99D when {value} < -999.99D then -999.99D else %s end"
    return f"cast({fitted % round_even(value, 2)} as decimal(5,2))"


def to_number_10_6(value: str) -> str:
    """Six digits of a double column as decimal(10,6)."""
    return f"cast({round_even(value, 6)} as decimal(10,6))"


def people(participants: str = "participants_cnt", chosen: str = "chosen_cnt") -> str:
    """Number of people behind a statistics row."""
    return f"coalesce({participants}, {chosen}, 0)"


# True when the row stands for at least one person.
HAS_PEOPLE = f"{people()} > 0"
