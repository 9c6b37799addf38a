"""Data-quality profiles: nulls, cohorts, cardinality, outliers, contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import num, percent
from .tally import Tally


def _tall(df: DataFrame, columns: Sequence[str], make, keys: Sequence[str]) -> DataFrame:
    """One aggregation, then a row for each column."""
    own = df.groupBy(*keys).agg(F.count("*").alias("rows"), *[make(c).alias(f"_{k}") for k, c in enumerate(columns)])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{k}").alias("v")) for k, c in enumerate(columns)])).alias("c")
    return own.select(*keys, "rows", cells).select(*keys, "rows", "c.column", "c.v")


def null_profile(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Null or blank values of each column (and period, split or file)."""
    blank = lambda c: F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""))
    return _tall(df, columns, blank, keys).withColumnRenamed("v", "nulls").withColumn("null_pct", percent(F.col("nulls"), F.col("rows")))


def null_cohorts(profile: DataFrame, key: str, new: Sequence[str], material: float = 2.0) -> DataFrame:
    """Null shares of the old against the new cohort, weighted by rows; ``material`` from 2 points on."""
    is_new = F.col(key).isin(*new)
    side = lambda c, cond: F.sum(F.when(cond, F.col(c)))
    out = profile.groupBy("column").agg(percent(side("nulls", ~is_new), side("rows", ~is_new)).alias("old_pct"), percent(side("nulls", is_new), side("rows", is_new)).alias("new_pct"))
    return out.withColumn("delta", F.col("new_pct") - F.col("old_pct")).withColumn("material", F.coalesce(F.abs("delta") >= material, F.lit(False)))


def column_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, nulls and distinct values of each column."""
    kinds = dict(df.dtypes)
    nulls = _tall(df, columns, lambda c: F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(F.col(c)).alias("distinct")), ())
    types = F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])])
    return nulls.select("column", types[F.col("column")].alias("type"), "rows", "v.nulls", "v.distinct").withColumn("null_pct", percent(F.col("nulls"), F.col("rows")))


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles and the rows beyond 1.5 interquartile ranges, for each column."""
    t = Tally(df, [], {c: F.col(c) for c in columns})
    q = t.agg({f"_q{k}": F.array(t.quantile(c, 0.25), t.quantile(c, 0.75)) for k, c in enumerate(columns)})
    own = df.select(*columns).join(F.broadcast(q))
    low = lambda k: F.col(f"_q{k}")[0] - 1.5 * (F.col(f"_q{k}")[1] - F.col(f"_q{k}")[0])
    high = lambda k: F.col(f"_q{k}")[1] + 1.5 * (F.col(f"_q{k}")[1] - F.col(f"_q{k}")[0])
    one = own.agg(*[F.struct(F.count(c).alias("n"), F.first(F.col(f"_q{k}")[0]).alias("q1"), F.first(F.col(f"_q{k}")[1]).alias("q3"), F.count_if((F.col(c) < low(k)) | (F.col(c) > high(k))).alias("outliers")).alias(f"_c{k}") for k, c in enumerate(columns)])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_c{k}").alias("v")) for k, c in enumerate(columns)])).alias("c")
    return one.select(cells).select("c.column", "c.v.*").withColumn("outlier_pct", percent(F.col("outliers"), F.col("n")))


def cardinality(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """Distinct values, rare ones, coverage of the ten most frequent, and the mode (smallest of equals) of each column."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    counted = df.select(each).where("p.value is not null").groupBy("p.column", "p.value").count()
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value")))
    own = counted.withColumn("_n", place).groupBy("column").agg(F.sum("count").alias("rows"), F.count("*").alias("distinct"), F.count_if(F.col("count") < 100).alias("below_100"), F.count_if(F.col("count") < 1000).alias("below_1000"), F.sum(F.when(F.col("_n") <= top, F.col("count"))).alias("_top"), F.max(F.when(F.col("_n") == 1, F.col("value"))).alias("mode"))
    return own.withColumns({"ratio": F.col("distinct") / F.col("rows"), "top_pct": percent(F.col("_top"), F.col("rows"))}).drop("_top")


def hash_sizes(tokens: DataFrame, powers: Sequence[int] = (12, 13, 14, 15, 16)) -> DataFrame:
    """For a number of tokens (column ``tokens``): expected occupied bins, collision share and load for each table size."""
    each = tokens.withColumn("bins", F.explode(F.array(*[num(2**p) for p in powers])))
    n, m = F.col("tokens").cast("double"), F.col("bins")
    full = m * (1 - F.pow(1 - 1 / m, n))
    return each.withColumns({"occupied": full, "collision_pct": percent(n - full, n), "load": n / m})


def column_profile(df: DataFrame, columns: Sequence[str], top: int = 3, samples: int = 3) -> DataFrame:
    """Type, rows, nulls, how many texts read as numbers or times, shortest and longest text, distinct values, the ``top`` frequent values and ``samples`` of each column.

    Counts are exact.  ``distinct`` is a HyperLogLog estimate (2 % standard
    error) and ``frequent`` comes from a sketch of heavy hitters, exact while a
    column has no more values than it tracks (10,000); both merge across tasks.
    Samples are the values of the smallest hashes, so they do not hang on
    partitions.
    """
    kinds = dict(df.dtypes)

    def made(c: str) -> Column:
        v = F.col(c).cast("string")
        text = f"nullif(trim(cast(`{c}` as string)), '')"
        said = F.when(F.trim(v) != "", v)
        return F.struct(F.count(said).alias("filled"), F.count(F.expr(f"try_cast({text} as double)")).alias("numbers"), F.count(F.expr(f"try_cast({text} as timestamp)")).alias("times"), F.min(F.char_length(said)).alias("shortest"), F.max(F.char_length(said)).alias("longest"), F.approx_count_distinct(said, 0.02).alias("distinct"), F.expr(f"approx_top_k({text}, {int(top)})").alias("frequent"))

    own = _tall(df, columns, made, ())
    types = F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])])
    frequent = F.transform(F.filter("v.frequent", lambda x: x["item"].isNotNull()), lambda x: x["item"])
    out = own.select("column", types[F.col("column")].alias("type"), "rows", (F.col("rows") - F.col("v.filled")).alias("nulls"), "v.numbers", "v.times", "v.shortest", "v.longest", "v.distinct", frequent.alias("frequent"))
    return out.join(_samples(df, columns, samples), "column", "left")


def _samples(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """The values of each column with the ``n`` smallest hashes: minima are taken in 64 cells, which each task combines."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("c")
    each = df.select(cells).select("c.*").where("trim(value) <> ''").withColumn("h", F.xxhash64("value"))
    least = each.groupBy("column", F.pmod(F.col("h"), F.lit(64)).alias("cell")).agg(F.min(F.struct("h", "value")).alias("m"))
    return least.groupBy("column").agg(F.transform(F.slice(F.sort_array(F.collect_list("m")), 1, n), lambda x: x["value"]).alias("samples"))


def column_roles(df: DataFrame, columns: Sequence[str], ratio: float = 0.05, sure: float = 0.98) -> DataFrame:
    """``column_profile`` with a ``role`` for each column and the ``cast`` that gives it.

    Times and numbers go by type, or by what at least ``sure`` of a text
    column's values read as; the others are categories up to ``ratio``
    distinct values a row, else text.  Columns without a value are ``empty``.
    """
    own = column_profile(df, columns)
    filled = F.col("rows") - F.col("nulls")
    few = F.col("distinct") <= ratio * filled
    number = F.col("type").rlike("^(tinyint|smallint|int|bigint|double|float|decimal)")
    reads = lambda c: (F.col("type") == "string") & (F.col(c) >= sure * filled)
    role = F.when(filled == 0, "empty").when(F.col("type").rlike("^(timestamp|date)"), "datetime").when(number & ~few, "numeric").when(number, "category").when(reads("numbers") & ~few, "numeric").when(reads("times") & ~reads("numbers"), "datetime").when(few, "category").otherwise("text")
    cast = F.when((F.col("type") == "string") & (role == "numeric"), "double").when((F.col("type") == "string") & (role == "datetime"), "timestamp").when((F.col("type") != "string") & (role == "category"), "string")
    return own.withColumns({"ratio": ratio_of(F.col("distinct"), filled), "role": role, "cast": cast})


def ratio_of(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b)


def coerce_by_profile(df: DataFrame, roles: DataFrame) -> DataFrame:
    """``df`` with the casts of its roles; values that do not fit become null."""
    casts = {r["column"]: r["cast"] for r in roles.where("cast is not null").select("column", "cast").collect()}  # a row for each column
    return df.select(*[F.col(f"`{c}`").try_cast(casts[c]).alias(c) if c in casts else F.col(f"`{c}`") for c in df.columns])


def split_contract(df: DataFrame, split: str, target: str) -> DataFrame:
    """Rows and rows without a target in each split."""
    return df.groupBy(split).agg(F.count("*").alias("rows"), F.count_if(F.col(target).isNull()).alias("null_targets"))


def history_contract(df: DataFrame, key: str, registration: str, unknown: str = "Unknown") -> DataFrame:
    """Whether ids are unique, and the share of rows with a known aircraft."""
    known = F.col(registration).isNotNull() & (F.col(registration).cast("string") != unknown)
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("ids"), percent(F.count_if(known), F.count("*")).alias("known_pct")).withColumn("unique", F.col("rows") == F.col("ids"))
