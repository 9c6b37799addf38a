"""What several corpus operators share: scratch tables, sizes, components, packed numbers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Bytes of text that one Python task holds at a time.
BLOCK_BYTES = 4 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 1000

#: What stands for a missing document id inside an operator: the smallest long, which is no id of its own.
NO_ID = -(1 << 63)

#: Most keys of a join that count as hot.
HOT_KEYS = 20_000

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder.

    Rows can be long texts, so the session's Arrow batches are limited to
    ``BATCH_ROWS`` rows (a lower limit stays): JVM and Python hold a batch
    outside of the heap.
    """
    if int(spark.conf.get(_BATCH, "10000")) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset, a
    session in local mode (tests, one machine) gets a temporary folder; on a
    cluster it is an error, as executors could not share one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back (cuts the lineage).

    The shuffle files of the write go as soon as it has ended.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with further fields at its end."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def known_id(doc_id: str) -> Column:
    """The id as a long, ``NO_ID`` where it is missing."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id")


def with_missing_ids(df: DataFrame) -> DataFrame:
    """``df`` with null again where its ``doc_id`` is ``NO_ID``."""
    return df.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def shards_for(spark: SparkSession, amount: int, per_shard: int) -> int:
    """How many shards keep ``amount`` within ``per_shard`` each; never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // per_shard), 1)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut and join record batches so that ``column`` holds about ``limit`` bytes in each; a longer row stays whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        width = "<i8" if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else "<i4"
        ends = np.frombuffer(col.buffers()[1], dtype=width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit - size, side="right")) - 1
            if stop <= start and held:
                yield _joined(held)
                held, size = [], 0
                continue
            stop = min(max(stop, start + 1), batch.num_rows)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop] - ends[start])
            start = stop
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A column's texts as UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative integers below 2**28, seven bits to a byte, the last byte of each with its top bit clear."""
    v = np.asarray(numbers, dtype=np.uint32)
    size = 1 + (v >= 1 << 7).astype(np.int64) + (v >= 1 << 14) + (v >= 1 << 21)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), dtype=np.uint8)
    for k in range(4):
        has = size > k
        out[at[has] + k] = ((v[has] >> np.uint32(7 * k)) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The numbers that ``pack`` wrote."""
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(raw < 128).astype(np.int32)
    size = np.diff(ends, prepend=np.int32(-1))
    out = raw[ends].astype(np.int32) << (7 * (size - 1))
    for k in range(3):
        has = np.flatnonzero(size > k + 1)
        out[has] |= (raw[ends[has] - size[has] + 1 + k].astype(np.int32) & 127) << (7 * k)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give rows linked by the pairs ``i``, ``j``, directly or through others, the smallest of their labels."""
    while True:
        low = np.minimum(label[i], label[j])
        if (label[i] == low).all() and (label[j] == low).all():
            return
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)


class WordNumbers(dict):
    """Word -> 64-bit hash, remembered; forgets all once it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= self.limit:
            self.clear()
        self[word] = number = xxh3_64_intdigest(word)
        return number


def spread_join(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int, salt: str | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has each key once and says in ``n`` how many rows of ``left`` have it.

    ``total`` is the number of rows of ``left``.  Keys with more than a
    20,000th of them (64 at least) are split over as many copies of their row
    as that share goes into ``n``, so no key makes one long task.  Only those
    keys are broadcast, 20,000 at most whatever the input; all rows of
    ``right`` together get 20,000 copies more at most.  Rows of ``left`` are
    told apart by a hash of their columns, or of the one named ``salt``.
    """
    limit = max(64, total // HOT_KEYS)
    copies = F.ceil(F.col(n) / limit).cast("int")
    hot = F.broadcast(right.where(F.col(n) > limit).select(*on, copies.alias("_copies")))
    rest = [salt] if salt else [c for c in left.columns if c not in on]
    dealt = left.join(hot, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*rest), F.col("_copies")).cast("int"), F.lit(0))).drop("_copies")
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.join(copied, [*on, "_salt"]).drop("_salt", n)


def named_classes(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """``classes`` (``rep``, a class's number; ``first``, its smallest id; more) with ``component`` in place of both: the smallest id of all classes in their group.

    ``groups`` (``id``, ``component``) holds numbers; a class that it does not
    name is a group by itself.
    """
    grouped = written(classes.join(groups.withColumnRenamed("id", "rep"), "rep"), "grouped")
    low = grouped.groupBy("component").agg(F.min("first").alias("low"), F.count("*").alias("n"))
    named = spread_join(grouped, low, ["component"], "n", grouped.count()).select("rep", F.col("low").alias("component"))
    return classes.join(named, "rep", "left").withColumn("component", F.coalesce("component", "first")).drop("rep", "first")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest id that each end of an edge can reach: columns ``id``, ``component``.

    Alternates large-star and small-star steps until the edges are stars
    around each component's smallest id.  Minima are aggregated before the
    shuffle and joined back with the edges of hubs split over tasks; each
    step is a written table, so nothing is recomputed after a lost executor.
    Edges with a null end or equal ends add nothing; no edges, no rows.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n, mark = e.count(), None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, low, ["u"], "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, ["u"], "n", n).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        e = written(small, "edges")
        found = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == mark:
            break
        n, mark = found[0], found
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


#: A space between two characters that are no white space: where texts can be cut without changing their tokens.
GAP = re.compile(r"(?<=\S) (?=\S)")


def stretches(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """A text cut at gaps into stretches of about ``limit`` characters; the spaces at the cuts fall out."""
    start = 0
    while len(text) - start > limit and (cut := GAP.search(text, start + limit)):
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def in_order(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, nulls first.

    A random last key splits rows that repeat exactly, so no value makes one
    long task; such rows are interchangeable.
    """
    keys = [*[F.asc_nulls_first(c) for c in order], F.asc("_tie")]
    return df.withColumn("_tie", F.rand(0)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")


def numbered(df: DataFrame, by: list[str], order: list[str], parts: int, name: str) -> DataFrame:
    """``df`` with ``position``, a row's place from 0 among the rows of equal ``by`` in ``order`` (nulls first), and ``n``, their number.

    A distributed prefix sum: rows are range-partitioned, sorted and written,
    then each partition's rows are counted, and only these counts (one for
    each partition and key) meet in a window.  ``by`` must not be null.
    """
    own = written(in_order(df, [*by, *order], parts).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)
    runs = own.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    every = Window.partitionBy(*(by or [F.lit(0)]))
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.select("_part", *by, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_base"), F.sum("_rows").over(every).alias("n"))
    return own.join(base, ["_part", *by]).withColumn("position", F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")
