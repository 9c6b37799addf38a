"""Benchmark decontamination by a broadcast set of benchmark windows.

The distinct windows of the benchmark (ten words; an item of fewer words is
one window) are hashed once and sent to every task; each task hashes the
windows of its documents in one pass and checks every hit word by word.  The
benchmark's windows are counted and measured first.  Beyond ``max_windows`` or
``MAX_BYTES`` they are not broadcast: documents' windows are joined with them
instead, with the same result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordNumbers, blocks, byte_texts, mix64, spread_join, with_fields, written

#: Words of a window.
WINDOW = 10
#: Most benchmark windows that are broadcast, and most bytes of their words and item ids.
MAX_WINDOWS, MAX_BYTES = 500_000, 64 << 20

#: The columns that are added.
FOUND = ("n_words", "n_hit", "hit_items", "hit_words")

#: A-Z becomes a-z, and every ASCII byte that is no letter or digit becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of letters, digits and whatever lies outside ASCII."""
    return text.translate(_FOLD).split()


def window_hashes(numbers: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words, from their hashes."""
    n = len(numbers) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + numbers[k : n + k]
    return mix64(out)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Each distinct window of the benchmark: ``size``, ``hash``, ``words`` and the ``items`` that have it (none named for a null id)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = WordNumbers()
        for batch in blocks(batches, text):
            rows = []
            for item, t in zip(batch.column(0).to_pylist(), byte_texts(batch, text)):
                words = words_of(t)
                size = min(window, len(words))
                if size:
                    hashes = window_hashes(np.array([number[w] for w in words], dtype=np.uint64), size).view(np.int64).tolist()
                    rows += [(size, h, b" ".join(words[k : k + size]), item) for k, h in enumerate(hashes)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.string()))], names=["size", "hash", "words", "item"])

    rows = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("string").alias(text)).mapInArrow(cut, "size int, hash long, words binary, item string")
    return rows.groupBy("size", "hash", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))



#: Windows of one text in a record batch of the join.
CUT = 10_000


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every document with the benchmark windows found in it.

    Returns the columns of ``keep`` (all of ``docs`` by default) and
    ``n_words``, ``n_hit`` (words inside any hit), ``hit_items`` (sorted item
    ids) and ``hit_words`` (numbers of the hit words, by position); columns of
    these names in ``keep`` are replaced.  Null or empty texts and items have
    no words and no hits; items without an id give hits but no ``hit_items``.
    Every row is looked at by itself, so ids may repeat or be null.
    """
    keep = docs.columns if keep is None else keep
    out = _hits(docs, benchmark, window, max_windows, doc_id, text, item_id, item_text, keep)
    return out.select(*[F.col(f"_row.`{c}`") for c in keep if c not in FOUND], "n_words", "n_hit", "hit_items", "hit_words")


def _hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``find_hits`` with the document's own columns in one, ``_row``, where no name can clash."""
    wanted = benchmark_windows(benchmark, window, item_id, item_text)
    size = F.octet_length("words") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 8)
    n, amount = wanted.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("_row")
    rows = docs.select(row, F.col(text).cast("string").alias("_text"))
    if n > max_windows or amount > MAX_BYTES:
        return _joined(rows, wanted, window)
    found: dict[int, dict[int, dict[bytes, list[str]]]] = defaultdict(lambda: defaultdict(dict))
    for size, h, words, items in wanted.collect():  # at most max_windows rows and MAX_BYTES, measured above
        found[size][h][bytes(words)] = items
    return _scanned(rows, {s: dict(x) for s, x in found.items()})


def _scanned(rows: DataFrame, found: dict) -> DataFrame:
    windows = rows.sparkSession.sparkContext.broadcast(found)
    schema = with_fields(rows.select("_row"), "n_words long, n_hit long, hit_items array<string>, hit_words array<int>")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, wanted = WordNumbers(), windows.value
        arrays = {size: np.sort(np.array(list(x), dtype=np.int64)) for size, x in wanted.items()}
        for batch in blocks(batches, "_text"):
            out: list[tuple] = []
            for t in byte_texts(batch, "_text"):
                words = words_of(t)
                numbers = np.array([number[w] for w in words], dtype=np.uint64)
                items: set[str] = set()
                covered = np.zeros(len(words) + 1, dtype=np.int32)
                for size, have in arrays.items():
                    hashes = window_hashes(numbers, size).view(np.int64)
                    at = np.minimum(np.searchsorted(have, hashes), len(have) - 1)
                    for k in np.flatnonzero(have[at] == hashes).tolist():
                        if (own := wanted[size][int(hashes[k])].get(b" ".join(words[k : k + size]))) is not None:
                            items.update(own)
                            covered[k] += 1
                            covered[k + size] -= 1
                hit = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
                out.append((len(words), len(hit), sorted(items), hit.tolist()))
            cols = [pa.array(x, type=k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["_row", "n_words", "n_hit", "hit_items", "hit_words"])

    return rows.select("_row", "_text").mapInArrow(scan, schema)


def _joined(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The same by a join of windows, for a benchmark too large to broadcast; hits come back by a number of the row, written with it."""
    rows = written(rows.select("_row", F.monotonically_increasing_id().alias("_id"), "_text"), "numbered")
    wanted = written(wanted, "windows")
    sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())  # at most `window` rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = WordNumbers()
        for batch in blocks(batches, "_text", 1 << 20):
            ids = batch.column(0).to_pylist()
            for i, t in zip(ids, byte_texts(batch, "_text")):
                words = words_of(t)
                numbers = np.array([number[w] for w in words], dtype=np.uint64)
                for size in (s for s in sizes if s <= len(words)):
                    hashes = window_hashes(numbers, size).view(np.int64)
                    for start in range(0, len(hashes), CUT):  # a long text is many batches
                        n = len(own := hashes[start : start + CUT])
                        yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array(np.arange(start, start + n, dtype=np.int32)), pa.array([size] * n, pa.int32()), pa.array(own), pa.array([b" ".join(words[k : k + size]) for k in range(start, start + n)], pa.binary())], names=["doc_id", "at", "size", "hash", "words"])

    cuts = rows.select(F.col("_id").alias("doc_id"), "_text").mapInArrow(cut, "doc_id long, at int, size int, hash long, words binary")
    # how often each wanted window occurs is combined in the tasks; frequent ones are split over tasks
    often = written(cuts.groupBy("size", "hash").count().join(wanted.select("size", "hash").distinct(), ["size", "hash"], "left_semi"), "window-counts")
    total = often.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hits = spread_join(cuts, wanted.join(often, ["size", "hash"]), ["size", "hash", "words"], "count", total)
    spans = hits.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("size") - 1))))).alias("hit_words"))
    items = hits.select("doc_id", F.explode("items").alias("item")).groupBy("doc_id").agg(F.sort_array(F.collect_set("item")).alias("hit_items"))
    own = spans.join(items, "doc_id", "left").withColumnRenamed("doc_id", "_hit_id")
    n_words = F.size(F.filter(F.split(F.translate(F.coalesce("_text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""))
    return rows.join(own, F.col("_id") == F.col("_hit_id"), "left").select("_row", n_words.cast("long").alias("n_words"), F.coalesce(F.size("hit_words"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"), F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Only the documents in which no benchmark window occurs, with their own columns."""
    return _hits(docs, benchmark, **how).where("n_hit = 0").select("_row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """All documents, with the words inside hits cut out of ``text``; what stood between words stays.

    Untouched documents keep their text to the byte; null stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[0-9a-zA-Z\x80-\xff]+")
        for batch in batches:
            texts = []
            for t, hit in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if hit:
                    drop, raw, at, parts = set(hit), t.encode(), 0, []
                    for k, m in enumerate(word.finditer(raw)):
                        if k in drop:
                            parts.append(raw[at : m.start()])
                            at = m.end()
                    t = b"".join([*parts, raw[at:]]).decode()
                texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_row", "_text"])

    hits = _hits(docs, benchmark, text=text, **how).select("_row", F.col(f"_row.`{text}`").cast("string").alias("_text"), "hit_words")
    done = hits.mapInArrow(cut, with_fields(hits.select("_row"), "_text string"))
    return done.select(*[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns])


def report(hits: DataFrame) -> DataFrame:
    """What the query reports of each document."""
    return hits.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
