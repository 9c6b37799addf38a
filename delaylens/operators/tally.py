"""Running totals and exact quantiles from counted values: no window over all rows, no buffer of a group's values.

Rows are counted by key, measure and value first, which Spark combines before
the shuffle; what is left grows with the distinct values.  Totals below each
value then say which values hold the wanted ranks.  Without keys the values
are cut into ranges, each range is summed by itself, and the ranges' sums are
added up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import num, ratio


def with_range(counted: DataFrame, value: str) -> DataFrame:
    """``_range``: the place of a value among about as many ranges as the session has shuffle partitions, ascending and evenly filled.

    The bounds are one row of approximate quantiles; a value is found among
    them in two steps of about the square root of their number.  Rows without
    a value are dealt over the ranges.
    """
    k = _side(counted)
    v = F.col(value).cast("double")
    bounds = counted.agg(F.percentile_approx(v, F.array(*[num(i / (k * k)) for i in range(1, k * k)]), F.lit(10_000)).alias("_bounds"))
    coarse = F.size(F.filter(F.array(*[F.col("_bounds")[i] for i in range(k - 1, k * k - 1, k)]), lambda b: b < F.col("_v")))
    fine = F.size(F.filter(F.slice("_bounds", F.col("_coarse") * k + 1, k - 1), lambda b: b < F.col("_v")))
    # one row; without values there are no bounds
    placed = counted.withColumn("_v", v).join(F.broadcast(bounds)).withColumn("_coarse", coarse)
    spread = F.pmod(F.xxhash64(*counted.columns), F.lit(k * k)).cast("int")
    return placed.withColumn("_range", F.when(F.col("_v").isNull() | F.col("_bounds").isNull(), spread).otherwise(F.col("_coarse") * k + fine)).drop("_v", "_bounds", "_coarse")


def _side(df: DataFrame) -> int:
    """The square root of the number of ranges."""
    return max(2, ceil(sqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))))


def heard(placed: DataFrame, order: str, told: dict[str, tuple[Callable[[Column], Column], Column]]) -> DataFrame:
    """``placed`` (see ``with_range``) with aggregates, each given as (function, value), over what all ranges say.

    The first row of a range goes to every range as a message; ``_from`` is
    the sender's range, ``_range`` the hearer's.  So rows are not worked out
    again for totals, which could then be those of slightly other values.
    """
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    ways = F.when(F.col("_place") == 1, F.sequence(F.lit(-1), F.lit(_side(placed) ** 2 - 1))).otherwise(F.array(F.lit(-1)))
    sent = placed.withColumn("_place", place).withColumn("_to", F.explode(ways)).withColumnRenamed("_range", "_from")
    sent = sent.withColumn("_range", F.when(F.col("_to") < 0, F.col("_from")).otherwise(F.col("_to")))
    here = Window.partitionBy("_range")
    heard = {name: f(F.when(F.col("_to") >= 0, value)).over(here) for name, (f, value) in told.items()}
    return sent.withColumns(heard).where("_to < 0").drop("_place", "_to", "_from")


def running_totals(counted: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), ranges: bool | None = None) -> DataFrame:
    """``counted``, which has each value once (for each ``by``), with ``{s}_before``, the sum over smaller values, and ``{s}_total`` for each of ``sums``.

    With ``ranges`` (always so without ``by``) no window holds more than a
    range of values; otherwise it holds the values of one key.
    """
    by, kinds = list(by), dict(counted.dtypes)
    zero = {s: F.lit(0).cast("double" if kinds[s] in ("double", "float") else "long") for s in sums}
    if not (ranges or not by):
        own = Window.partitionBy(*by)
        before = own.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counted.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(before), zero[s]) for s in sums} | {f"{s}_total": F.sum(s).over(own) for s in sums})
    placed = with_range(counted, value)
    before = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(before), zero[s]) for s in sums})
    each = placed.groupBy(*by, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    line = each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_range", *sums))).alias("_line"))  # an entry for each range
    upto = lambda s, line: F.aggregate(line, zero[s], lambda total, x: total + x[s])
    entries = F.transform("_line", lambda x, i: F.struct(x["_range"].alias("r"), *[upto(s, F.slice("_line", F.lit(1), i)).alias(f"_{s}0") for s in sums]))
    offsets = line.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(by)], F.explode(entries).alias("e"), *[upto(s, F.col("_line")).alias(f"{s}_total") for s in sums]).select("*", "e.*").drop("e")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(by)], F.col("_range") == F.col("r"))
    joined = inside.join(offsets, same)
    return joined.withColumns({f"{s}_before": F.col(f"{s}_before") + F.col(f"_{s}0") for s in sums}).drop("_range", "r", *[f"_k{n}" for n in range(len(by))], *[f"_{s}0" for s in sums])


def gathered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows brought together by key, in as many parts as the session has shuffle partitions.

    For keys that are many, with few rows each: there nothing is saved by
    counting before the shuffle, and a row is narrower than its counts.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *keys)


def ranked(rows: DataFrame, keys: Sequence[str], value: str, parts: dict[str, Column]) -> DataFrame:
    """``rows`` with the place ``_at_{p}`` by value, from 0, and the number ``_of_{p}`` of rows of its key, for each of ``parts`` (conditions that may overlap).

    One sort by key and value serves all parts, so a task holds each row once
    and spills; for rows that are ``gathered`` nothing is shuffled.
    """
    own = Window.partitionBy(*keys)
    upto = own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"_at_{p}": F.count_if(c).over(upto) - 1 for p, c in parts.items()} | {f"_of_{p}": F.count_if(c).over(own) for p, c in parts.items()})


def ranked_quantile(value: str, part: str, cond: Column, q: float) -> Column:
    """The exact interpolated quantile of a part of rows that are ``ranked``, as an aggregate; null without rows."""
    at = num(q) * (F.col(f"_of_{part}") - 1)
    holds = lambda place: F.max(F.when(cond & (F.col(f"_at_{part}") == place), F.col(value).cast("double")))
    place, low, high = F.max(F.when(cond, at)), holds(F.floor(at)), holds(F.ceil(at))
    return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


def counted_quantile(value: str, n: str, q: float) -> Column:
    """The exact interpolated quantile over counts ``n`` of values that have ``running_totals``, as an aggregate; null without rows."""
    below, at = F.col(f"{n}_before"), num(q) * (F.col(f"{n}_total") - 1)
    holds = lambda rank: F.max(F.when((rank >= below) & (rank < below + F.col(n)), F.col(value).cast("double")))
    place, low, high = F.max(at), holds(F.floor(at)), holds(F.ceil(at))
    return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


class Tally:
    """Counts by key, measure and value, and the statistics that follow from them.

    ``values`` are numeric measures, ``distinct`` are columns whose different
    values count (over several columns, where these are given as a list),
    ``marks`` are conditions counted beside the first measure.  Null values do
    not count.  ``together`` says that no two partitions hold rows of one key
    (``gathered``); then nothing is shuffled any more.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], values: dict[str, Column], distinct: dict[str, Column | list[Column]] | None = None, marks: dict[str, Column] | None = None, together: bool = False):
        distinct = {n: c if isinstance(c, list) else [c] for n, c in (distinct or {}).items()}
        self.keys, self.marks, self.together = list(keys), list(marks or {}), together
        self.codes = {name: k for k, name in enumerate([*values, *distinct])}
        # days and small integers are told apart as numbers, all else as text
        kinds = dict(df.select(*[c[0].alias(n) for n, c in distinct.items()]).dtypes) if distinct else {}
        small = {"date": F.unix_date, "int": lambda c: c, "smallint": lambda c: c, "tinyint": lambda c: c}
        self.cell = ["measure", "value", *(["label"] if any(k not in small for k in kinds.values()) else [])]
        mark = lambda name: [(c if name == next(iter(values)) else F.lit(False)).alias(m) for m, c in (marks or {}).items()]
        cell = lambda name, v, label: F.struct(F.lit(self.codes[name]).alias("measure"), v.cast("double").alias("value"), *([label.cast("string").alias("label")] if "label" in self.cell else []), *mark(name))
        cells = [cell(n, c, F.lit(None)) for n, c in values.items()] + [cell(n, small[kinds[n]](c), F.lit(None)) if kinds[n] in small else cell(n, F.lit(None), c) for n, several in distinct.items() for c in several]
        each = df.select(*self.keys, F.explode(F.array(*cells)).alias("c")).select(*self.keys, "c.*").where(" or ".join(f"{c} is not null" for c in self.cell[1:]))
        self.counted = each.groupBy(*self.keys, *self.cell).agg(F.count("*").alias("n"), *[F.count_if(m).alias(m) for m in self.marks])

    def spread(self, name: str, cells: Column, drop: Sequence[str]) -> Tally:
        """The counts with key ``name`` from each entry of the array ``cells`` in place of the keys ``drop``."""
        out = object.__new__(Tally)
        out.codes, out.marks, out.cell, out.together, out.keys = self.codes, self.marks, self.cell, False, [name, *[k for k in self.keys if k not in drop]]
        out.counted = self.counted.withColumn(name, F.explode(cells)).groupBy(*out.keys, *self.cell).agg(*[F.sum(c).alias(c) for c in ("n", *self.marks)])
        return out

    def _is(self, name: str) -> Column:
        return F.col("measure") == self.codes[name]

    def rows(self, name: str, cond: Column | None = None) -> Column:
        """Rows that have the measure (and, with a condition on ``value``, meet it)."""
        own = self._is(name) if cond is None else self._is(name) & cond
        return F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).cast("long")

    def total(self, name: str, value: Column | None = None) -> Column:
        """The sum of the measure, or of an expression of ``value``, over rows; null without rows."""
        return F.sum(F.when(self._is(name), F.col("n") * (F.col("value") if value is None else value)))

    def mean(self, name: str) -> Column:
        return ratio(self.total(name), self.rows(name))

    def differing(self, name: str) -> Column:
        """How many different values the column has."""
        return F.count_if(self._is(name)).cast("long")

    def concentration(self, name: str) -> Column:
        """The sum of squared shares of the column's different values."""
        n = F.when(self._is(name), F.col("n").cast("double"))
        return F.sum(n * n) / (F.sum(n) * F.sum(n))

    def marked(self, mark: str) -> Column:
        return F.coalesce(F.sum(mark), F.lit(0)).cast("long")

    def quantile(self, name: str, q: float) -> Column:
        """The exact interpolated quantile, as Spark's ``percentile``; null without rows."""
        own, at = self._is(name), num(q) * (F.col("n_total") - 1)
        holds = lambda rank: F.max(F.when(own & (rank >= F.col("n_before")) & (rank < F.col("n_before") + F.col("n")), F.col("value")))
        place, low, high = F.max(F.when(own, at)), holds(F.floor(at)), holds(F.ceil(at))
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    def agg(self, columns: dict[str, Column]) -> DataFrame:
        """A row for each key with the statistics named."""
        if self.keys:  # one shuffle by key serves the window and the sums
            placed = running_totals(self.counted if self.together else self.counted.repartition(*self.keys), "value", ["n"], [*self.keys, "measure"])
            return placed.groupBy(*self.keys).agg(*[c.alias(k) for k, c in columns.items()])
        placed = running_totals(self.counted, "value", ["n"], ["measure"], ranges=True)
        return placed.agg(*[c.alias(k) for k, c in columns.items()])


def counted_quantiles(counts: DataFrame, keys: Sequence[str], value: str, n: str, wanted: dict[str, float], rows: str) -> DataFrame:
    """From counts ``n`` of values (a value may come several times for a key): each key's number of ``rows`` and exact quantiles."""
    keys = list(keys)
    own = counts.select(*keys, F.col(value).cast("double").alias("_value"), F.col(n).alias("_n"))
    if keys:  # partitioned by key first: the sums by value, the window and the last sums need no further shuffle
        summed = own.repartition(*keys).groupBy(*keys, "_value").agg(F.sum("_n").alias("n"))
    else:
        summed = own.groupBy("_value").agg(F.sum("_n").alias("n"))
    placed = running_totals(summed, "_value", ["n"], keys).withColumn("measure", F.lit(0)).withColumnRenamed("_value", "value")
    t = object.__new__(Tally)
    t.codes = {"value": 0}
    columns = [t.rows("value").alias(rows), *[t.quantile("value", q).alias(name) for name, q in wanted.items()]]
    return placed.groupBy(*keys).agg(*columns) if keys else placed.agg(*columns)


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the exact median of each column as ``_{column}``."""
    t = Tally(df, [], {c: F.col(c) for c in columns})
    return t.agg({f"_{c}": t.quantile(c, 0.5) for c in columns})
