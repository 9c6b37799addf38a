"""Near-duplicate documents by circulant MinHash.

Two permutations of the 32-bit integers give every coordinate of a signature:
the first scatters the shingles, the second is applied to the scattered
values shifted by 0, 1, 2, ... round the circle, and a coordinate is the
smallest image.  Bands of coordinates propose pairs, which are confirmed on
the full shingle sets; connected components of the confirmed links are the
groups of near duplicates.

With 32 bands of 6 coordinates, a pair of similarity 0.85 shares no band with
a chance of 3e-7.  Inside a band's bucket not all pairs are formed: documents
with equal word sequences are one class; each class is first held against the
member that has the least of its own, and only classes that are still in different components, share a
bucket and have enough shingles in common with anyone are then compared with
each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordNumbers, blocks, byte_texts, connected_components, mix64, named_classes, shards_for, spread_join, spread_labels, written

SHINGLE = 5
#: Link when 100 * common >= PERCENT * all shingles of the two.
PERCENT = 85
BANDS, ROWS = 32, 6
#: Documents of a tile's side and their shingles; a larger bucket is cut into more tiles.
TILE, TILE_SHINGLES = 512, 400_000
#: Bytes of shingles that one task compares.
SHARD_BYTES = 16 << 20

_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def shingle_hashes(numbers: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the runs of ``size`` words, given the words' hashes; fewer words are one run."""
    n = len(numbers)
    if not n:
        return np.empty(0, dtype=np.uint64)
    size = min(size, n)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = (out + numbers[k : n - size + 1 + k]) * np.uint64(_ODD[k % 5])
    return np.unique(mix64(out))


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation: of 64-bit hashes, read as 32-bit ones."""
    return (mix64(x ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def _permute(x: np.ndarray) -> np.ndarray:
    """The second permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def circulant_signatures(hashes: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Signatures of the sets that begin at ``starts`` in ``hashes`` (none empty): a row for each set."""
    x = _scatter(hashes)
    out = np.empty((coordinates, len(starts)), dtype=np.uint32)
    for k in range(coordinates):
        out[k] = np.minimum.reduceat(_permute(x + np.uint32(k)), starts)
    return out.T


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; different bands never share keys but by chance."""
    s = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), s.shape[:2]).copy()
    for k in range(rows):
        out = mix64(out * np.uint64(_ODD[k % 5]) + s[:, :, k])
    return out.view(np.int64)


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, the word sequence's 128-bit hash ``k1``, ``k2`` and the band keys ``bands``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        number = WordNumbers()
        for batch in blocks(batches, "text", 1 << 20):
            sets, keys = [], []
            for t in byte_texts(batch, "text"):
                words = t.lower().split()
                sets.append(shingle_hashes(np.array([number[w] for w in words], dtype=np.uint64), shingle))
                keys.append(np.frombuffer(xxh3_128_digest(b" ".join(words)), dtype=np.int64))
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            found = np.zeros((len(sets), bands), dtype=np.int64)
            if len(full):
                made = circulant_signatures(np.concatenate(sets), (np.cumsum(sizes) - sizes)[full], bands * rows)
                found[full] = band_keys(made, bands, rows)
            offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, bands, 0)))).astype(np.int32)
            keys = np.array(keys)
            cols = [batch.column(0), pa.array(sizes), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[full].ravel()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "k1", "k2", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(sign, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def shingle_sets(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``shingles``, the packed sorted shingle hashes, of the rows whose text is the word sequence ``k1``, ``k2``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        number = WordNumbers()
        for batch in blocks(batches, "text", 1 << 20):
            ids, sets = [], []
            for i, k1, k2, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k1", "k2")), byte_texts(batch, "text")):
                words = t.lower().split()
                if np.frombuffer(xxh3_128_digest(b" ".join(words)), dtype=np.int64).tolist() == [k1, k2]:
                    ids.append(i)
                    sets.append(shingle_hashes(np.array([number[w] for w in words], dtype=np.uint64), shingle).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return rows.select("doc_id", "k1", "k2", "text").mapInArrow(cut, "doc_id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a``, ``b`` whose full shingle sets are similar enough."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < percent * len(large):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "sb", "sa").mapInArrow(hold, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's group: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id of the group), ``kept``.

    Words are runs of anything but ASCII white space, A-Z in lower case.
    Texts of fewer than ``shingle`` words are one shingle; null and empty
    texts have none and are linked with nothing.  Every input row gives a
    row; rows without an id have no group and are kept.  Rows of one id with
    different texts are told apart: each has the group of its own text.
    """
    signed = written(signatures(docs, shingle, bands, rows, doc_id, text), "signatures")
    whole = signed.where("n_shingles > 0 and doc_id is not null")
    # a class is one word sequence; it goes by a number of its own, as ids can repeat with other texts
    classes = whole.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    buckets = classes.select(F.col("rep").alias("doc_id"), "n_shingles", F.explode("bands").alias("bucket"))
    crowded = written(buckets.join(_lowest(buckets), "bucket").select("bucket", "doc_id", "n_shingles"), "buckets")

    texts = docs.select(F.col(doc_id).cast("long").alias("first"), F.col(text).cast("string").alias("text"))
    wanted = classes.join(crowded.select(F.col("doc_id").alias("rep")), "rep", "left_semi").select("first", F.col("rep").alias("doc_id"), "k1", "k2")
    sets = written(shingle_sets(texts.join(wanted, "first").select("doc_id", "k1", "k2", "text"), shingle).dropDuplicates(["doc_id"]), "sets")
    able = crowded.join(_lonely(sets), "doc_id", "left").withColumn("shared", F.col("n_shingles") - F.coalesce("lonely", F.lit(0))).drop("lonely").where(f"100 * shared >= {percent} * n_shingles")
    able = written(able, "able")

    central = F.struct((F.col("shared") / F.col("n_shingles")).alias("part"), (-F.col("doc_id")).alias("id"))
    centres = able.groupBy("bucket").agg(F.max(central).alias("c"), F.count("*").alias("n")).where("n > 1").select("bucket", "c")
    stars = able.join(centres, "bucket").groupBy("doc_id").agg((-F.max("c").id).alias("a")).where("a <> doc_id")
    stars = stars.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct()
    stars = written(stars, "stars")
    links = written(confirmed(stars, sets, percent), "links")
    groups = connected_components(links)
    groups = connected_components(links.unionByName(_cross_links(able, groups, sets, percent)))
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(named_classes(classes.select("k1", "k2", "rep", "first"), groups), ["k1", "k2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component"))
    found = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(own, F.col("doc_id"))).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _lowest(buckets: DataFrame) -> DataFrame:
    """The smallest id ``a`` of each bucket that has company."""
    return buckets.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a <> z").select("bucket", "a")


def _lonely(sets: DataFrame) -> DataFrame:
    """How many of a document's shingles no other candidate has (``doc_id``, ``lonely``).

    They are common to no pair, which bounds what a document can share.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "shingles"):
            own = [np.frombuffer(x, dtype=np.int64) for x in batch.column("shingles").to_pylist()]
            ids = np.repeat(np.asarray(batch.column("doc_id")), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(own))], names=["doc_id", "shingle"])

    each = sets.select("doc_id", "shingles").mapInArrow(spread, "doc_id long, shingle long")
    return each.groupBy("shingle").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id")).where("c = 1").groupBy("doc_id").agg(F.count("*").alias("lonely"))


def _cross_links(able: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """What links documents that share a bucket but are not yet in one group: each with the smallest it hangs together with.

    Every pair of a bucket that lies in two groups is held against the full
    sets, but inside the tasks: the members of the bucket's largest group and
    the rest are cut into blocks of about TILE documents each; a tile is a
    block of the rest with another or with one of the largest group, and
    reports one row a document at most.  So a bucket's rows grow with the
    largest group's size, not with its square.
    """
    member = able.join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("g", F.coalesce("component", "doc_id")).drop("component")
    own = member.groupBy("bucket", "g").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("amount"))
    mixed = own.groupBy("bucket").agg(F.max(F.struct("n", "g", "amount")).alias("big"), F.sum("n").alias("n"), F.sum("amount").alias("amount")).where("n > big.n")
    sides = lambda n, amount: F.greatest(F.ceil(n / TILE), F.ceil(amount / TILE_SHINGLES)).cast("int")
    mixed = mixed.select("bucket", F.col("big.g").alias("big"), F.col("n").alias("in_bucket"), sides(F.col("n") - F.col("big.n"), F.col("amount") - F.col("big.amount")).alias("rest"), sides(F.col("big.n"), F.col("big.amount")).alias("most"))
    met = spread_join(member, mixed, ["bucket"], "in_bucket", able.count())
    block = F.when(F.col("g") == F.col("big"), F.col("rest") + F.pmod(F.xxhash64("doc_id"), F.col("most"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("rest"))).cast("int")
    last = F.when(F.col("g") == F.col("big"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("most") - 1)
    met = met.select("bucket", "doc_id", "g", "n_shingles", block.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    tiles = written(met.select("bucket", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"), "block", "doc_id", "g", "n_shingles"), "tiles")
    amount = tiles.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)) * 8 + F.count("*") * 64).first()[0]
    shards = shards_for(able.sparkSession, amount, SHARD_BYTES)

    def hold(group: pa.Table) -> pa.Table:
        names = ["bucket", "ti", "tj", "block", "doc_id"]
        cols = [np.asarray(group[c]) for c in names]
        order = np.lexsort(cols[::-1])
        bucket, ti, tj, block, ids = (c[order] for c in cols)
        g, raw = np.asarray(group["g"])[order], group["shingles"].take(pa.array(order))
        label = ids.copy()
        new = np.flatnonzero(np.concatenate(([True], (np.diff(bucket) != 0) | (np.diff(ti) != 0) | (np.diff(tj) != 0))))
        for s, e in zip(new.tolist(), [*new[1:].tolist(), len(ids)]):
            own = [np.frombuffer(x, dtype=np.uint64) for x in raw[s:e].to_pylist()]
            i, j = similar_pairs(own, percent)
            cross = (g[s + i] != g[s + j]) & ((ti[s] == tj[s]) | (block[s + i] != block[s + j]))
            spread_labels(label, s + i[cross], s + j[cross])
        some = label != ids
        return pa.table({"a": label[some], "b": ids[some]})

    dealt = tiles.join(sets.select("doc_id", "shingles"), "doc_id").withColumn("shard", F.pmod(F.xxhash64("bucket", "ti", "tj"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(hold, "a long, b long").distinct()


def similar_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of sorted distinct hashes that are similar enough, by exact counts.

    Hashes of one set alone are left out of the counting; a set of too many
    such hashes pairs with nothing and is left out too.
    """
    sizes = np.array([len(x) for x in sets])
    hashes, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(row[counts[inverse] > 1], minlength=len(sets))
    able = 100 * shared >= percent * sizes
    number = np.cumsum(counts > 1) - 1
    use = (counts[inverse] > 1) & able[row]
    place = np.cumsum(able) - 1
    r, c = place[row[use]], number[inverse[use]]
    n, width = int(able.sum()), int((counts > 1).sum())
    both = np.zeros((n, n), dtype=np.float32)
    for start in range(0, width, 4096):
        part = (c >= start) & (c < start + 4096)
        has = np.zeros((n, min(4096, width - start)), dtype=np.float32)
        has[r[part], c[part] - start] = 1
        both += has @ has.T
    both = both.astype(np.int64)
    size = sizes[able]
    i, j = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))
    back = np.flatnonzero(able)
    return back[i], back[j]


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """Only the first document of each group, with its own columns; rows without an id stay."""
    gone = near_duplicates(docs, doc_id=doc_id, **how).where("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col(doc_id).cast("long") == F.col("_gone"), "left_anti")
