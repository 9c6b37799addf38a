"""Joins with small dimensions, coordinate filling, vocabularies and merged dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most rows of a dimension that is sent to every executor; a larger one is joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few enough."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= MAX_BROADCAST_ROWS else df


def left_join_dimension(df: DataFrame, dimension: DataFrame, key: str, dim_key: str, suffix: str, columns: Sequence[str] | None = None, check_rows: bool = False) -> DataFrame:
    """Many-to-one left join; the dimension's columns get ``suffix``.  Repeated dimension keys raise; null keys join nothing."""
    dim = dimension.where(F.col(dim_key).isNotNull())
    rows, keys = dim.agg(F.count("*"), F.count_distinct(dim_key)).first()
    if rows != keys:
        raise ValueError(f"{rows - keys} rows of the dimension repeat a key")
    own = [c for c in (columns or dimension.columns) if c != dim_key]
    dim = dim.select(F.col(dim_key).alias("_key"), *[F.col(c).alias(f"{c}{suffix}") for c in own])
    out = df.join(small(dim, rows), F.col(key) == F.col("_key"), "left").drop("_key")
    if check_rows and out.count() != df.count():
        raise ValueError("the join changed the number of rows")
    return out


def impute_coordinates(df: DataFrame, places: DataFrame, key: str, latitude: str, longitude: str, place_key: str, place_lat: str, place_lon: str) -> DataFrame:
    """Null coordinates from the place's; of a place with several rows the smallest pair counts."""
    best = places.groupBy(F.col(place_key).alias("_key")).agg(F.min(F.struct(F.col(place_lat).alias("a"), F.col(place_lon).alias("b"))).alias("_at"))
    joined = df.join(small(best), F.col(key) == F.col("_key"), "left")
    return joined.withColumns({latitude: F.coalesce(latitude, "_at.a"), longitude: F.coalesce(longitude, "_at.b")}).drop("_key", "_at")


def validate_dimension(df: DataFrame, key: str, dimension: DataFrame, dim_key: str) -> DataFrame:
    """One row: dimension rows, distinct keys, excess and involved duplicate rows, coverage of the fact's distinct keys and rows."""
    dims = dimension.where(F.col(dim_key).isNotNull()).groupBy(F.col(dim_key).alias("_key")).count()
    shape = dims.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("dimension_rows"), F.count("*").alias("dimension_keys"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("excess_rows"), F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("duplicate_rows"))
    facts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_fact")).count()
    met = facts.join(dims.select("_key"), F.col("_fact") == F.col("_key"), "left").agg(F.count("*").alias("fact_keys"), F.count("_key").alias("matched_keys"), F.coalesce(F.sum("count"), F.lit(0)).alias("fact_rows"), F.coalesce(F.sum(F.when(F.col("_key").isNotNull(), F.col("count"))), F.lit(0)).alias("matched_rows"))
    out = shape.join(F.broadcast(met))  # one row each
    return out.withColumns({"key_coverage_pct": F.try_divide(100.0 * F.col("matched_keys"), F.col("fact_keys")), "row_coverage_pct": F.try_divide(100.0 * F.col("matched_rows"), F.col("fact_rows"))})


def unseen_combinations(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose combination of keys is not among the known ones."""
    return df.join(known.select(*keys).distinct(), list(keys), "left_anti")


def restrict_to(df: DataFrame, eligible: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(eligible.select(*keys).distinct(), list(keys), "left_semi")


def label_places(df: DataFrame, places: DataFrame, key: str, place_key: str, name: str, out: str) -> DataFrame:
    """The place's name, or its code where it has none."""
    names = places.groupBy(F.col(place_key).alias("_key")).agg(F.min(name).alias("_name"))
    return df.join(small(names), F.col(key) == F.col("_key"), "left").withColumn(out, F.coalesce("_name", F.col(key).cast("string"))).drop("_key", "_name")


def opposite_direction(routes: DataFrame, origin: str, destination: str, columns: Sequence[str]) -> DataFrame:
    """Each route with ``columns`` of the opposite direction as ``opposite_*``; null where nobody flies it."""
    back = routes.select(F.col(destination).alias("_o"), F.col(origin).alias("_d"), *[F.col(c).alias(f"opposite_{c}") for c in columns])
    return routes.join(back, (F.col(origin) == F.col("_o")) & (F.col(destination) == F.col("_d")), "left").drop("_o", "_d")


def assemble_blocks(base: DataFrame, blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """Feature blocks side by side, one row for each id of ``base``."""
    for block in blocks:
        base = base.join(block, key, "left")
    return base


def look_up(df: DataFrame, history: DataFrame, key: str, value: str, missing: str = "Unknown") -> DataFrame:
    """``value`` from history by id (the smallest of several), ``missing`` where there is none."""
    own = history.groupBy(key).agg(F.min(value).alias(value))
    return df.join(own, key, "left").fillna(missing, [value])


def role_union(df: DataFrame, origin: str, destination: str, name: str = "airport") -> DataFrame:
    """A row for each end of a leg, with its ``role``."""
    ends = F.explode(F.array(F.struct(F.col(origin).alias("place"), F.lit("origin").alias("role")), F.struct(F.col(destination).alias("place"), F.lit("destination").alias("role"))))
    return df.withColumn("_end", ends).withColumns({name: F.col("_end.place"), "role": F.col("_end.role")}).drop("_end")


def frequent_vocabulary(df: DataFrame, column: str, min_count: int) -> DataFrame:
    """The values seen at least ``min_count`` times; kept as a table."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).count().where(F.col("count") >= min_count).select("value")


def map_rare(df: DataFrame, column: str, vocabulary: DataFrame, other: str = "OTHER") -> DataFrame:
    """Rare, null and unseen values become ``other``."""
    known = small(vocabulary.select(F.col("value").alias("_v")).distinct())
    return df.join(known, F.col(column) == F.col("_v"), "left").withColumn(column, F.coalesce("_v", F.lit(other))).drop("_v")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys that several rows have, with their number."""
    return df.groupBy(key).count().where("count > 1").withColumnRenamed("count", "rows")


def dedupe_by_field(df: DataFrame, key: str, whole_row: bool = True) -> DataFrame:
    """One row for each key: the smallest row, or (``whole_row=False``) the smallest value of every field."""
    rest = [c for c in df.columns if c != key]
    if whole_row:
        return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*")
    return df.groupBy(key).agg(*[F.min(c).alias(c) for c in rest])


def merged_dimension(sources: Sequence[tuple[str, DataFrame]], key: str, fields: Sequence[str]) -> DataFrame:
    """One row for each key: every field from the first source (in order) that has it, and the ``sources`` that have the key."""
    every = None
    for k, (name, df) in enumerate(sources):
        one = df.select(F.col(key), *fields).withColumns({"_p": F.lit(k), "_s": F.lit(name)})
        every = one if every is None else every.unionByName(one)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("_p", c))).getField(c).alias(c)
    return every.where(F.col(key).isNotNull()).groupBy(key).agg(*[first(c) for c in fields], F.array_join(F.sort_array(F.collect_set("_s")), "+").alias("sources"))


def by_candidate_code(df: DataFrame, candidates: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows keyed by the first candidate column that names them; of several rows for a code the one with the earlier candidate counts."""
    codes = F.explode(F.array(*[F.struct(F.col(c).cast("string").alias("code"), F.lit(k).alias("_p")) for k, c in enumerate(candidates)]))
    each = df.select(codes.alias("_c"), *fields).where("_c.code is not null").select("_c.code", "_c._p", *fields)
    return first_row(each, ["code"], [F.col("_p"), *map(F.col, fields)]).drop("_p")


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def fill_by_code(df: DataFrame, column: str, code: str, values: dict[str, Sequence[str]]) -> DataFrame:
    """Nulls and blanks of ``column`` filled by a country code: ``values`` names the codes of each value (a continent's countries)."""
    known = F.when(F.trim(F.col(column).cast("string")) != "", F.col(column))
    found = None
    for value, codes in values.items():
        found = (F if found is None else found).when(F.col(code).isin(*codes), F.lit(value))
    return df.withColumn(column, F.coalesce(known, found))
