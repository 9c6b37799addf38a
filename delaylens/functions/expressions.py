"""Column expressions for rates, intervals and tail probabilities; all run inside Spark's code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054

#: The published Chebyshev fit of the complementary error function (relative error about 1e-7).
ERFC_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def num(value: float) -> Column:
    return F.lit(float(value))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column) -> Column:
    return ratio(a.cast("double") * 100.0, b)


def wilson(successes: Column, n: Column, z: float = Z95, upper: bool = False, clip: bool = True) -> Column:
    """A bound of the Wilson interval of a proportion (0 to 1); null where n is 0."""
    p = ratio(successes, n)
    centre = p + ratio(num(z * z / 2), n)
    half = num(z) * F.sqrt(ratio(p * (1 - p), n) + ratio(num(z * z / 4), n * n))
    bound = ratio(centre + half if upper else centre - half, 1 + ratio(num(z * z), n))
    return F.when(n > 0, F.least(num(1), F.greatest(num(0), bound)) if clip else bound)


def erfc(x: Column) -> Column:
    t = num(1) / (1 + 0.5 * F.abs(x))
    poly = num(ERFC_FIT[-1])
    for c in reversed(ERFC_FIT[:-1]):
        poly = num(c) + t * poly
    tail = t * F.exp(-x * x + poly)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def two_sided_p(z: Column) -> Column:
    """The two-sided tail probability of a standard normal value."""
    return F.when(z.isNotNull(), F.least(num(1), erfc(F.abs(z) / num(2**0.5))))


def two_proportion_z(s1: Column, n1: Column, s2: Column, n2: Column) -> Column:
    """The pooled z statistic of two proportions; 0 where the pooled error is 0, null where a group is empty."""
    pooled = ratio(s1 + s2, n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (ratio(num(1), n1) + ratio(num(1), n2)))
    return F.when((n1 > 0) & (n2 > 0), F.when(se > 0, (ratio(s1, n1) - ratio(s2, n2)) / se).otherwise(num(0)))


def student_t_p(t: Column, df: Column) -> Column:
    """The two-sided tail probability of Student's t for a whole number of degrees of freedom, by its finite series."""
    angle = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos2 = F.cos(angle) * F.cos(angle)
    odd = df % 2 == 1
    steps = F.greatest(F.floor((df - F.when(odd, 3).otherwise(2)) / 2).cast("int"), F.lit(0))
    first = F.struct(num(1).alias("term"), num(1).alias("total"))
    grow = lambda acc, k: F.struct((acc.term * cos2 * F.when(odd, (2.0 * k) / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))).alias("term"), (acc.total + acc.term * cos2 * F.when(odd, (2.0 * k) / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))).alias("total"))
    total = F.aggregate(F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), first, grow).total
    inside = F.when(df == 1, 2 * angle / num(3.141592653589793)).when(odd, 2 / num(3.141592653589793) * (angle + F.sin(angle) * F.cos(angle) * total)).otherwise(F.sin(angle) * total)
    return F.when(df >= 1, F.greatest(num(0), 1 - inside))


def chi2_p(x: Column, df: int) -> Column:
    """The upper tail of chi-square for a fixed whole number of degrees of freedom, in closed form."""
    half = x / 2
    if df % 2 == 0:
        total, term = num(1), num(1)
        for k in range(1, df // 2):
            term = term * half / k
            total = total + term
        return F.exp(-half) * total
    total, term = num(0), F.sqrt(2 * x / num(3.141592653589793))
    for k in range(1, (df - 1) // 2 + 1):
        total = total + term
        term = term * x / (2 * k + 1)
    return erfc(F.sqrt(half)) + F.exp(-half) * total


def register_sql_functions(spark) -> None:
    """SQL names for the scalar statistics, as SQL functions that the analyser inlines."""
    fit = repr(ERFC_FIT[-1]) + "D"
    for c in reversed(ERFC_FIT[:-1]):
        fit = f"({c!r}D + t * {fit})"
    spark.sql(f"create or replace temporary function erfc_fit(x double) returns double return (select case when x >= 0 then e else 2 - e end from (select t * exp(-x * x + {fit}) as e from (select 1 / (1 + 0.5D * abs(x)) as t)))")
    spark.sql(f"create or replace temporary function wilson_low(s double, n double) returns double return case when n > 0 then greatest(0D, (s / n + {Z95 ** 2 / 2!r}D / n - {Z95!r}D * sqrt(s / n * (1 - s / n) / n + {Z95 ** 2 / 4!r}D / (n * n))) / (1 + {Z95 ** 2!r}D / n)) end")
    spark.sql(f"create or replace temporary function wilson_high(s double, n double) returns double return case when n > 0 then least(1D, (s / n + {Z95 ** 2 / 2!r}D / n + {Z95!r}D * sqrt(s / n * (1 - s / n) / n + {Z95 ** 2 / 4!r}D / (n * n))) / (1 + {Z95 ** 2!r}D / n)) end")
