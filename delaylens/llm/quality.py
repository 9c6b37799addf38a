"""Document quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over the UTF-8 bytes of a text, five at a time, each text
preceded by four zero bytes.  Counts come from all trusted documents and stay
in shards of n-grams: each task reports the distinct n-grams of a block of
documents, the shards add them up, the levels of the model are joins between
the shards' tables, and the probabilities travel back to the blocks, which sum
them by document.  One trusted document in five trains nothing: a language's
threshold is a quantile of these documents' perplexities.

Text that repeats itself is likely under so short a context.  Each text is
therefore deflated too, in pieces of 2 KB so that its length does not matter,
and must not shrink more than nearly all of the held-out documents.
"""

from __future__ import annotations

import bz2
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, byte_texts, mix64, pack, shards_for, text_bytes, unpack, written

ORDER = 5
#: Share of a language's held-out trusted documents that its threshold lets pass.
QUANTILE = 0.99
#: One in so many trusted documents, by a hash of the id, is held out of training for the thresholds.
HELD_OUT = 5
#: Bytes of a text that are deflated together.
PIECE = 2048
#: Most ids of trusted documents that are broadcast; beyond, the documents are joined with them by a shuffle.
MAX_BROADCAST_IDS = 5_000_000
#: Bytes of text in a block, and of the texts whose n-grams are listed at a time.
BLOCK, PART = 8 << 20, 1 << 20

_PIECES = "block long, shard int, numbers binary, counts binary, data binary"


def ngrams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the texts, one after the other, as big-endian integers; and each text's number of them."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    pad = b"\0" * (order - 1)
    raw = np.frombuffer(pad + pad.join(texts), dtype=np.uint8)
    keys = np.zeros(max(len(raw) - order + 1, 0), dtype=np.uint64)
    for k in range(order):
        keys <<= np.uint64(8)
        keys |= raw[k : len(raw) - order + 1 + k]
    # windows that end in the padding before a text belong to none
    ends = np.cumsum(sizes + order - 1)[:-1] - (order - 1)
    drop = (ends[:, None] + np.arange(order - 1)[None, :]).ravel()
    use = np.ones(len(keys), dtype=bool)
    use[drop[drop < len(keys)]] = False
    return keys[use], sizes


def distinct_ngrams(texts: list[bytes], trusted: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-grams of the texts and how often each is in the trusted ones.

    Texts are taken a few at a time, so that only distinct n-grams pile up.
    """
    ends = np.cumsum([len(t) for t in texts])
    found, start = [], 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PART, side="right")))
        keys, sizes = ngrams(texts[start:stop], order)
        use = np.repeat(trusted[start:stop], sizes)
        for part, own in ((keys[use], True), (keys[~use], False)):
            part.sort()
            first = np.flatnonzero(np.concatenate((np.ones(min(len(part), 1), bool), part[1:] != part[:-1])))
            found.append((part[first], np.diff(first, append=len(part)) if own else np.zeros(len(first), np.int64)))
        start = stop
    keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    counts = np.zeros(len(keys), dtype=np.int64)
    np.add.at(counts, inverse, np.concatenate([n for _, n in found]))
    return keys, counts


def _split(docs: DataFrame, order: int, shards: int, grams: bool) -> DataFrame:
    """Blocks of documents: either their distinct n-grams by shard (with counts in trusted texts), or the documents (shard -1)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64

        place = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, "text", BLOCK):
            texts = byte_texts(batch)
            named = batch.column(0).is_valid().to_pylist()
            ids = np.array([i or 0 for i in batch.column(0).to_pylist()], dtype=np.int64)
            content = xxh3_64(ids.tobytes(), seed=place)
            whole = b"".join(texts)
            content.update(whole)
            block = content.intdigest() - (1 << 63)
            place += 1
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            if not grams:
                head = zlib.compress(json.dumps([named, batch.column(3).to_pylist()]).encode())
                rows = [(block, -1, ids.tobytes(), sizes.tobytes(), len(head).to_bytes(8, "little") + head + bz2.compress(whole))]
            else:
                keys, c = distinct_ngrams(texts, np.array(batch.column(2).to_pylist(), dtype=bool), order)
                shard = (mix64(keys) % np.uint64(shards)).astype(np.int32)
                rows = []
                for s in np.unique(shard).tolist():
                    mine = shard == s
                    rows.append((block, s, _dump(keys[mine]), pack(c[mine]), b""))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "shard", "numbers", "counts", "data"])

    return docs.select("doc_id", "text", "trusted", "lang").mapInArrow(split, _PIECES)


def _dump(keys: np.ndarray) -> bytes:
    """Sorted n-grams: their differences, byte by byte from the lowest, compressed."""
    return zlib.compress(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 6)


def _keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _add_up(group: pa.Table) -> pa.Table:
    """A shard's distinct n-grams with their counts in trusted text (0: only in others)."""
    keys = np.concatenate([_keys(x) for x in group["numbers"].to_pylist()])
    counts = np.concatenate([unpack(x) for x in group["counts"].to_pylist()])
    own, inverse = np.unique(keys, return_inverse=True)
    total = np.zeros(len(own), dtype=np.int64)
    np.add.at(total, inverse, counts)
    return pa.table({"shard": pa.array(np.full(len(own), group["shard"][0].as_py(), dtype=np.int32)), "key": own.view(np.int64), "c": total})


def discounts(n: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of n-grams seen once to four times, kept within 0.05 and 1, 2 and 3: lower orders always have a say."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    return tuple(min(max(k - (k + 1) * y * b / a if a else 0.5 * k, 0.05), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def model_levels(grams: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, tuple[float, float, float]]]:
    """For each order from 1 up: its n-grams ``key`` with counts ``c`` (continuation counts below the highest), and discounts.

    Each level is written once: it is read for the next lower one, for the
    discounts, for its contexts and for its probabilities, and a plan that
    worked it out each time would double with every order.
    """
    tables = [grams.select("key", "c")]
    for k in range(order - 1, 0, -1):
        lower = tables[-1].groupBy(F.col("key").bitwiseAND((1 << 8 * k) - 1).alias("key")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c"))
        tables.append(written(lower, f"level-{k}"))
    tables.reverse()
    tally = None
    for k, t in enumerate(tables):
        one = t.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).withColumn("k", F.lit(k))
        tally = one if tally is None else tally.unionByName(one)
    seen = {r["k"]: discounts((r["n1"], r["n2"], r["n3"], r["n4"])) for r in tally.collect()}  # a row for each order
    return [(t, seen[k]) for k, t in enumerate(tables)]


def probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """``shard``, ``key`` and the logarithm ``lp`` of the last byte's probability after the others."""
    p = None
    for k, (level, (d1, d2, d3)) in enumerate(model_levels(grams, order)):
        off = F.when(F.col("c") >= 3, d3).when(F.col("c") == 2, d2).when(F.col("c") == 1, d1).otherwise(0.0)
        level = level.withColumn("context", F.shiftright("key", 8))
        around = level.where("c > 0").groupBy("context").agg(F.sum("c").alias("s"), F.sum(off).alias("g"))
        lower = F.lit(1 / 256) if p is None else F.col("p")
        joined = level.join(around, "context", "left")
        if p is not None:
            joined = joined.withColumn("low", F.col("key").bitwiseAND((1 << 8 * k) - 1)).join(p.withColumnRenamed("key", "low"), "low")
        own = F.when(F.col("s") > 0, (F.col("c") - off + F.col("g") * lower) / F.col("s")).otherwise(lower)
        p = joined.select("key", own.alias("p"))
    return grams.select("shard", "key").join(p, "key").select("shard", "key", F.log("p").cast("float").alias("lp"))


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """The log probabilities of a shard's n-grams, for each block in its own order."""
    key, lp = np.asarray(known["key"]).view(np.uint64), np.asarray(known["lp"])
    order = np.argsort(key)
    key, lp = key[order], lp[order]
    out = [lp[np.searchsorted(key, _keys(x))].astype(np.float32).tobytes() for x in asked["numbers"].to_pylist()]
    return pa.table({"block": asked["block"], "shard": asked["shard"], "numbers": asked["numbers"], "counts": asked["counts"], "data": pa.array(out, pa.binary())})


def least_trusted(quantile: float) -> int:
    """Fewest held-out documents of which neither the quantile nor its opposite is the extreme; languages with fewer use the thresholds of all together."""
    return math.floor(1 / (1 - quantile) + 1e-6) + 1 if quantile < 1 else 1


def density(text: bytes) -> float | None:
    """What deflating leaves of a text, as a share; None for an empty one."""
    if not text:
        return None
    left = 0
    for k in range(0, len(text), PIECE):
        packer = zlib.compressobj(6, wbits=-15)
        left += len(packer.compress(text[k : k + PIECE])) + len(packer.flush())
    return left / len(text)


def _summer(order: int):
    def add(group: pa.Table) -> pa.Table:
        from xxhash import xxh64_intdigest

        shard = np.asarray(group["shard"])
        own = np.flatnonzero(shard < 0).tolist()
        if len(own) != 1:
            raise ValueError("the documents changed between two reads: write them to a table first")
        numbers, counts, data = (group[c].to_pylist() for c in ("numbers", "counts", "data"))
        ids, sizes = np.frombuffer(numbers[own[0]], dtype=np.int64), np.frombuffer(counts[own[0]], dtype=np.int64)
        head = int.from_bytes(data[own[0]][:8], "little") + 8
        named, langs = json.loads(zlib.decompress(data[own[0]][8:head]))
        whole, ends = bz2.decompress(data[own[0]][head:]), np.cumsum(sizes)
        rest = np.flatnonzero(shard >= 0).tolist()
        keys = np.concatenate([_keys(numbers[i]) for i in rest]) if rest else np.empty(0, np.uint64)
        lp = np.concatenate([np.frombuffer(data[i], dtype=np.float32) for i in rest]) if rest else np.empty(0, np.float32)
        at = np.argsort(keys)
        keys, lp = keys[at], lp[at]
        sums = np.zeros(len(sizes))
        start = 0
        while start < len(sizes):  # a few texts at a time
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PART, side="right")))
            grams, n = ngrams([whole[e - s : e] for s, e in zip(sizes[start:stop].tolist(), ends[start:stop].tolist())], order)
            total = np.concatenate(([0.0], np.cumsum(lp[np.searchsorted(keys, grams)], dtype=np.float64)))
            e = np.cumsum(n)
            sums[start:stop] = total[e] - total[e - n]
            start = stop
        texts = [whole[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]
        marks = np.array([xxh64_intdigest(t, seed=42) for t in texts], dtype=np.uint64).view(np.int64)  # what Spark's xxhash64 gives
        left = pa.array([density(t) for t in texts], pa.float64())
        return pa.table({"doc_id": pa.array(ids, mask=~np.array(named, dtype=bool)), "lang": pa.array(langs, pa.string()), "text_hash": marks, "n_bytes": sizes, "log_p": sums, "density": left})

    return add


def score(docs: DataFrame, trusted: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Every document's perplexity: ``doc_id``, ``lang``, ``text_hash``, ``role``, ``n_bytes``, ``perplexity`` and ``density`` (null for an empty text).

    ``trusted`` holds the ids of the documents to learn from; their ``role``
    is ``trains`` or ``held_out``.  Every row is scored by itself: repeated
    ids keep their own text and language, null ids stay null (and are never
    trusted), a null language is "".  Documents are read twice and should come
    from files or a table; rows that differ between the two are an error.
    """
    spark = docs.sparkSession
    ids = written(trusted.select(F.col(doc_id).cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("role", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0, "held_out").otherwise("trains")), "trusted")
    known = ids.select("doc_id", (F.col("role") == "trains").alias("_t"))
    if ids.count() <= MAX_BROADCAST_IDS:
        known = F.broadcast(known)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang"))
    rows = rows.join(known, "doc_id", "left").select("doc_id", "text", F.coalesce("_t", F.lit(False)).alias("trusted"), "lang")
    shards = shards_for(spark, text_bytes(docs, text), 256 << 20)
    asked = written(_split(rows, order, shards, True), "ngrams")
    grams = written(asked.groupBy("shard").applyInArrow(_add_up, "shard int, key long, c long"), "counts")
    answered = asked.groupBy("shard").cogroup(probabilities(grams, order).groupBy("shard")).applyInArrow(_answer, _PIECES)
    sums = _split(rows, order, shards, False).unionByName(answered).groupBy("block").applyInArrow(_summer(order), "doc_id long, lang string, text_hash long, n_bytes long, log_p double, density double")
    sums = written(sums.withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_p") / F.col("n_bytes")))), "perplexity")
    return sums.join(ids, "doc_id", "left").select("doc_id", "lang", "text_hash", "role", "n_bytes", "perplexity", "density")


def thresholds(scores: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Each language's ``threshold`` of perplexity and least density ``floor``, and those of all together under the language null."""
    of = F.percentile_approx(F.when(F.col("role") == "held_out", F.col("perplexity")), F.lit(quantile), F.lit(10_000)).alias("threshold")
    low = F.percentile_approx(F.when(F.col("role") == "held_out", F.col("density")), F.lit(1 - quantile), F.lit(10_000)).alias("floor")
    n = F.count_if((F.col("role") == "held_out") & F.col("perplexity").isNotNull()).alias("n")
    own = scores.groupBy("lang").agg(of, low, n).where(F.col("n") >= least_trusted(quantile)).select("lang", "threshold", "floor")
    return own.unionByName(scores.agg(of, low).select(F.lit(None).cast("string").alias("lang"), "threshold", "floor"))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, order: int = ORDER, **columns) -> DataFrame:
    """``score`` with ``threshold``, ``floor`` and ``kept``: perplexity no higher and density no lower than those of the document's language.

    Empty and null texts are not kept.  A language with too few trusted
    documents, the missing one included, takes the threshold of all together;
    without trusted documents there is no threshold and every text is kept.
    """
    scores = score(docs, trusted, order, **columns)
    limits = written(thresholds(scores, quantile), "thresholds")
    every = limits.where("lang is null").select(F.col("threshold").alias("_all"), F.col("floor").alias("_low"))
    own = limits.where("lang is not null")
    out = scores.join(own, "lang", "left").join(F.broadcast(every)).withColumn("threshold", F.coalesce("threshold", "_all")).withColumn("floor", F.coalesce("floor", "_low")).drop("_all", "_low")
    return out.withColumn("kept", F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)) & F.coalesce(F.col("density") >= F.col("floor"), F.lit(True)))


def drop_low_quality(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """Only the documents that ``classify`` keeps, with their own columns; each row goes by its own text and language, whatever its id."""
    gone = classify(docs, trusted, doc_id=doc_id, text=text, lang=lang, **how).where("not kept").select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_id")) & (F.coalesce(F.col(lang), F.lit("")) == F.col("_lang")) & (F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))) == F.col("_hash"))
    return docs.join(gone, same, "left_anti")
