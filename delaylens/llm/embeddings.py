"""Near-duplicate embeddings by random-hyperplane sign hashing in several tables.

Vectors with equal components are one class with a weight.  Each table takes
the signs of a class's products with its own random hyperplanes as a bucket;
buckets with company are cut into tiles of bounded size and every pair inside
a tile is held against the exact cosine.  A pair that meets in several tables
counts only in the first of them, so link counts need no list of pairs: a tile
reports, for each vector, its links there and the smallest id it hangs
together with.  Components join those reports.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, named_classes, shards_for, spread_labels, written

COSINE = 0.95
#: Chance that a pair just at the threshold meets in no table.
MISS = 1e-5
#: Random vectors of a bucket: products are cheap beside sending each vector to more tables.
BUCKET = 128
#: Tables for which vectors are sent at a time, which bounds the disk that their shuffle takes.
ROUND = 4
#: Vectors of a tile's side; a larger bucket is cut into more tiles.
TILE = 1024
#: Bytes of vectors that one task compares.
SHARD_BYTES = 16 << 20


def tables_for(vectors: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Hyperplanes of a table and number of tables: about ``BUCKET`` random vectors a bucket, and ``miss`` at the threshold."""
    bits = min(60, max(8, math.ceil(math.log2(max(2, vectors / BUCKET)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def sign_codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Each vector's bucket number in each table (a row for each vector)."""
    dim = vectors.shape[1]
    planes = np.random.default_rng(dim * 7919 + 17).standard_normal((dim, tables * bits))
    out = np.empty((len(vectors), tables), dtype=np.int64)
    weight = 1 << np.arange(bits, dtype=np.int64)
    for start in range(0, len(vectors), 4096):
        sign = vectors[start : start + 4096] @ planes >= 0
        out[start : start + 4096] = sign.reshape(-1, tables, bits) @ weight
    return out


def usable(embedding: str = "embedding"):
    """Whether a vector can be compared: not null or empty, all components finite, not all zero."""
    fine = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(F.col(embedding).isNotNull() & (F.size(embedding) > 0) & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)
    return x / np.abs(x).max(axis=1, keepdims=True)  # squares stay finite and above zero


def _buckets(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("dim"))
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                codes = sign_codes(_matrix(part.column("vec"), dim), bits, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("dim"), lists], names=["rep", "dim", "codes"])

    coded = classes.select("rep", "dim", "vec").mapInArrow(code, "rep long, dim int, codes array<long>")
    return coded.select("rep", F.posexplode("codes").alias("t", "code"), "dim").select("rep", "dim", "t", "code")


def _hold(cosine: float, bits: int, tables: int, dim: int):
    """What a task does with its tiles."""

    def pairs_of(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows, at least ``cosine`` alike, of the same tile."""
        size = ends - starts
        for s, e in zip(starts[size > 48].tolist(), ends[size > 48].tolist()):
            for row in range(s, e, 512):
                i, j = np.nonzero(x[row : min(row + 512, e)] @ x[row:e].T >= cosine)
                own = j > i
                yield row + i[own], row + j[own]
        few = size <= 48
        rows = np.concatenate([np.arange(s, e) for s, e in zip(starts[few].tolist(), ends[few].tolist())] or [np.empty(0, np.int64)])
        left = np.repeat(ends[few], size[few]) - rows - 1
        for start in range(0, len(rows), 2000):
            r, n = rows[start : start + 2000], left[start : start + 2000]
            i = np.repeat(r, n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            alike = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            yield i[alike], j[alike]

    def hold(group: pa.Table) -> pa.Table:
        none = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "label": pa.array([], pa.int64())})
        if group["dim"][0].as_py() != dim:
            return none
        names = ["t", "code", "ti", "tj", "block", "rep"]
        cols = [np.asarray(group[c]) for c in names]
        order = np.lexsort(cols[::-1])
        t, code, ti, tj, block, rep = (c[order] for c in cols)
        x = _matrix(group["vec"], dim)[order]
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        copies = np.asarray(group["copies"])[order]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(t) != 0) | (np.diff(code) != 0) | (np.diff(ti) != 0) | (np.diff(tj) != 0))))
        links, label = np.zeros(len(t), dtype=np.int64), rep.copy()
        codes: dict[int, np.ndarray] = {}
        for i, j in pairs_of(x, new, np.concatenate((new[1:], [len(t)]))):
            cross = (ti[i] == tj[i]) | (block[i] != block[j])  # pairs of one block belong to that block's own tile
            i, j = i[cross], j[cross]
            if not len(i):
                continue
            spread_labels(label, i, j)
            who, at = np.unique(np.concatenate((i, j)), return_inverse=True)
            own = sign_codes(x[who], bits, tables)
            for s in range(0, len(i), 20_000):
                a, b = own[at[: len(i)][s : s + 20_000]], own[at[len(i) :][s : s + 20_000]]
                first = np.argmax(a == b, axis=1) == t[i[s : s + 20_000]]
                np.add.at(links, i[s : s + 20_000][first], copies[j[s : s + 20_000][first]])
                np.add.at(links, j[s : s + 20_000][first], copies[i[s : s + 20_000][first]])
        some = (links > 0) | (label != rep)
        return pa.table({"id": rep[some], "links": links[some], "label": label[some]})

    return hold


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Each vector's links: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; vectors of different lengths never link.  Equal vectors
    link with each other.  Every input row gives a row; rows without an id
    have no component and are kept; rows of one id with different vectors are
    told apart.  Every link reported is exact; a pair just
    at ``cosine`` is overlooked with a chance of ``miss``.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec"), usable(embedding).alias("usable"))
    spark = vectors.sparkSession
    keyed = rows.withColumn("key", F.when(F.col("usable") & F.col("vec_id").isNotNull(), F.col("vec")))
    # a class is one vector; it goes by a number of its own, as ids can repeat with other vectors
    classes = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("rep"), "first", "copies", F.size("key").alias("dim"), F.col("key").alias("vec")), "vectors")
    found = None
    for dim, n in classes.groupBy("dim").count().collect():  # a row for each length of vector
        bits, tables = tables_for(n, cosine, miss)
        own = classes.where(F.col("dim") == dim)
        buckets = written(_buckets(own, bits, tables), "codes")
        crowded = buckets.groupBy("t", "code").count().where("count > 1").select("t", "code", F.ceil(F.col("count") / TILE).cast("int").alias("blocks"))
        met = buckets.join(crowded, ["t", "code"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        tiles = met.select("rep", "dim", "t", "code", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("rep", "dim", "t", "code", "block", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"))
        tiles = written(tiles, "tiles")
        shards = shards_for(spark, -(-tiles.count() * ROUND // tables) * (dim * 4 + 64), SHARD_BYTES)
        for start in range(0, tables, ROUND):
            dealt = tiles.where(F.col("t").between(start, start + ROUND - 1)).join(own.select("rep", "copies", "vec"), "rep").withColumn("shard", F.pmod(F.xxhash64("t", "code", "ti", "tj"), F.lit(shards)))
            part = written(dealt.groupBy("shard").applyInArrow(_hold(cosine, bits, tables, dim), "id long, links long, label long"), "links")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "id long, links long, label long")
    groups = connected_components(found.select("id", "label"), "id", "label")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = classes.join(links.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "first", F.col("vec").alias("key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = named_classes(linked, groups)
    out = keyed.select("vec_id", "key").join(named, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
