"""Reading monthly raw files and dimensions, sampling, and writing tables."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TIME_COLUMNS
from ..operators.enrich import first_row
from ..operators.evaluate import align

_TEXT = ("ADEP", "ADES", "AC Type", "AC Operator", "AC Registration", "ICAO Flight Type", "STATFOR Market Segment", *TIME_COLUMNS)
#: The columns of a raw file, in order.
RAW_COLUMNS = (
    "ECTRL ID", "ADEP", "ADEP Latitude", "ADEP Longitude", "ADES", "ADES Latitude", "ADES Longitude", "FILED OFF BLOCK TIME", "FILED ARRIVAL TIME",
    "ACTUAL OFF BLOCK TIME", "ACTUAL ARRIVAL TIME", "AC Type", "AC Operator", "AC Registration", "ICAO Flight Type", "STATFOR Market Segment", "Requested FL", "Actual Distance Flown (nm)",
)
RAW_SCHEMA = T.StructType([T.StructField(c, T.LongType() if c == "ECTRL ID" else T.StringType() if c in _TEXT else T.DoubleType()) for c in RAW_COLUMNS])

_NAME = re.compile(r"Flights_(\d{6})\d{2}_(\d{6})\d{2}\.csv(?:\.gz)?$")


def read_flights(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Raw files under the fixed schema; a line that does not fit fails the read."""
    return spark.read.schema(RAW_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(paths if isinstance(paths, str) else list(paths))


def read_dimension(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def monthly_files(spark: SparkSession, files: Sequence[str], legacy: str = "flights") -> DataFrame:
    """One file for each month: ``month``, ``path``, ``from_legacy``.

    The month is in the file's name, where first and last day must agree; a
    file in a month's folder goes before one in the legacy folder.
    """
    rows = []
    for path in files:
        if (m := _NAME.search(path)) and m[1] == m[2]:
            rows.append((m[1], path, path.rstrip("/").split("/")[-2] == legacy))
    found = spark.createDataFrame(rows, "month string, path string, from_legacy boolean")
    return first_row(found, ["month"], [F.asc("from_legacy"), F.asc("path")])


def paths_between(months: DataFrame, start: str, end: str) -> list[str]:
    """The files of months from ``start`` up to before ``end`` (yyyyMM); none is an error."""
    own = [r["path"] for r in months.where((F.col("month") >= start) & (F.col("month") < end)).orderBy("month").collect()]  # one path a month
    if not own:
        raise FileNotFoundError(f"no monthly file from {start} to {end}")
    return own


def schema_audit(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Each file's header against the first one's: columns, whether equal, missing and additional ones."""
    heads = [(p, spark.read.option("header", True).csv(p).columns) for p in paths]
    rows = spark.createDataFrame(heads, "path string, columns array<string>")
    first = F.array(*map(F.lit, heads[0][1]))
    return rows.select("path", F.size("columns").alias("n_columns"), (F.col("columns") == first).alias("equal"), F.array_except(first, "columns").alias("missing"), F.array_except("columns", first).alias("extra"))


def smoke_read(spark: SparkSession, paths: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of every file."""
    out = None
    for p in paths:
        one = read_flights(spark, p).limit(n)
        out = one if out is None else out.unionByName(one)
    return out


def rows_by_file(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))


def bernoulli_sample(df: DataFrame, fraction: float = 0.15, seed: int = 42) -> DataFrame:
    return df.sample(fraction, seed=seed)


def hash_percent(key: str) -> Column:
    """0 to 99 from the first seven hexadecimal digits of the MD5 of an id as text; any engine can repeat it."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(100))


def percent_sample(df: DataFrame, percent: float, key: str) -> DataFrame:
    """A stable sample by the hash of an id; smaller percentages are parts of larger ones."""
    if not 0 < percent <= 100:
        raise ValueError("the percentage must lie in (0, 100]")
    return df.where(hash_percent(key) < percent)


def stratified_sample(df: DataFrame, label: str, percents: dict, key: str) -> DataFrame:
    """``percent_sample`` with a percentage for each label; labels not named are left out."""
    if any(not 0 < p <= 100 for p in percents.values()):
        raise ValueError("percentages must lie in (0, 100]")
    limit = None
    for value, p in percents.items():
        limit = (F if limit is None else limit).when(F.col(label) == value, p)
    return df.where(hash_percent(key) < limit)


def write_split(df: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Write Parquet (partitioned by ``by``) and read it back."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A block that was written whole: its name, where it is, how many rows, and a hash of them that their order does not change.
_MANIFEST = "block string, path string, rows long, content string, columns array<string>, at_us long"


def content_of(df: DataFrame) -> tuple[int, str]:
    """Number of rows and the sum of their hashes; map columns do not count."""
    hashed = [c for c, kind in df.dtypes if not kind.startswith("map<")]
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*hashed).cast("decimal(38,0)")) if hashed else F.lit(None)).first()
    return n, str(total or 0)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The blocks of a folder that were committed; none if there is no manifest yet."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{root}/_manifest").where("block is not null")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def _commit(df: DataFrame, root: str, block: str, write) -> tuple[str, int, str]:
    """Write a block to a path of its own, then name it in the manifest: the row there is what makes it exist."""
    spark, path = df.sparkSession, f"{root}/{block}-{uuid.uuid4().hex}"
    write(df, path)
    rows, content = content_of(df.sparkSession.read.schema(df.schema).option("header", True).format("csv" if write is _as_csv else "parquet").load(path))
    spark.createDataFrame([(block, path, rows, content, df.columns, time.time_ns() // 1000)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/_manifest")
    return path, rows, content


def _as_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def _as_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def resumable_block(spark: SparkSession, root: str, block: str, build, expected_rows: int | None = None, verify: bool = False) -> DataFrame:
    """The block named in the manifest of ``root``, else ``build()`` written there and committed; a wrong number of rows raises.

    A build that was interrupted left files that no manifest names: they are
    never read, and the block is built again.  ``verify`` reads a committed
    block through and raises if its rows are not those that were written.
    """
    found = read_manifest(spark, root).where(F.col("block") == block).orderBy("at_us", "path").first()
    path, rows, content = (found["path"], found["rows"], found["content"]) if found else _commit(build(), root, block, _as_parquet)
    out = spark.read.parquet(path)
    if expected_rows is not None and rows != expected_rows:
        raise ValueError(f"block {block!r} has {rows} rows, {expected_rows} are expected")
    if verify and content_of(out) != (rows, content):
        raise ValueError(f"block {block!r} does not hold what was written")
    return out


# What the published measures mean.
METRICS = (
    ("flights", "legs with an observed arrival delay", "count"), ("late_15_pct", "legs that arrive more than 15 minutes late", "percent of flights"),
    ("late_60_pct", "legs that arrive more than 60 minutes late", "percent of flights"), ("otp15_pct", "legs that arrive at most 15 minutes late", "percent of flights"),
    ("arrival_median", "median arrival delay", "minutes"), ("arrival_p90", "ninth decile of the arrival delay", "minutes"),
    ("late_hours", "sum of positive arrival delays", "hours"), ("late_15_low_pct", "lower end of the 95 % Wilson interval", "percent of flights"), ("late_15_high_pct", "upper end of the 95 % Wilson interval", "percent of flights"),
)


def write_bundle(tables: dict[str, DataFrame], folder: str, digits: int = 4, metadata: dict[str, str] | None = None, methodology: Sequence[tuple[str, str]] = ()) -> None:
    """Tables as CSV with headers, floating values rounded, with three more: ``metadata`` (the caller's facts, and rows and content of each table), ``metric_definitions`` of the measures that occur, and ``methodology``.

    A table counts as published once the folder's manifest names it.
    """
    spark = next(iter(tables.values())).sparkSession
    facts = [("", k, str(v)) for k, v in (metadata or {}).items()]
    seen: set[str] = set()
    for name, df in tables.items():
        rounded = [F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
        _, rows, content = _commit(df.select(*rounded), folder, name, _as_csv)
        facts += [(name, "rows", str(rows)), (name, "content", content), (name, "columns", " ".join(df.columns))]
        seen |= set(df.columns)
    _commit(spark.createDataFrame(facts, "tbl string, fact string, value string"), folder, "metadata", _as_csv)
    _commit(spark.createDataFrame([m for m in METRICS if m[0] in seen], "metric string, meaning string, unit string"), folder, "metric_definitions", _as_csv)
    _commit(spark.createDataFrame(list(methodology), "step string, text string"), folder, "methodology", _as_csv)


def read_bundle(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The latest published state of the tables named; missing ones raise."""
    paths = {r["block"]: r["path"] for r in read_manifest(spark, folder).where(F.col("block").isin(*names)).orderBy("at_us", "path").collect()}  # a row for each table
    if missing := [n for n in names if n not in paths]:
        raise FileNotFoundError(f"the bundle lacks {missing}")
    return {n: spark.read.option("header", True).option("inferSchema", True).csv(paths[n]) for n in names}


def prediction_table(scored: Sequence[DataFrame], key: str) -> DataFrame:
    """Scored frames side by side by id; repeated ids, and ids that a frame lacks, raise."""
    out = scored[0]
    for one in scored[1:]:
        out = align(out, one, key)
    return out
