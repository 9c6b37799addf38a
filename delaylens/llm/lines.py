"""Reversible line deduplication: exact reference counts, guarded by sharded cuckoo filters.

``LineIndex`` holds, for every normalised line of at least ``min_chars`` code
points, which documents have it (one row for each line and document: the
exact table that makes deletions possible) and, for every shard of line keys,
a cuckoo filter of the lines found in two documents or more.  A line that the
filter does not know is kept without a look at the exact table; the others
are settled by it.  Cuckoo filters support deletion, so taking documents out
again turns the index back to what it was without them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mix64, spread_join, with_fields, written

MIN_CHARS = 10
#: Keys of one filter; a filter has room for twice as many 16-bit fingerprints.
KEYS_PER_SHARD = 4096
#: Parts that the lines of one shard are dealt over when they meet their filter.
PARTS = 16
_SLOTS = 4


class CuckooFilter:
    """A set of 64-bit keys in buckets of four 16-bit fingerprints; a fingerprint has two possible buckets.

    Answers "maybe" for every key inserted and, for others, with a chance of
    about 8 / 2**16.  A key inserted n times must be deleted n times.  When a
    fingerprint finds no room the filter doubles by rebuilding, which the
    caller does from the exact table (``insert`` returns False).
    """

    def __init__(self, buckets: int, cells: bytes | None = None):
        self.buckets = 1 << max(2, (buckets - 1).bit_length())
        self.cells = np.zeros((self.buckets, _SLOTS), dtype=np.uint16) if cells is None else np.frombuffer(cells, dtype=np.uint16).reshape(-1, _SLOTS).copy()

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        buckets = max(4, len(keys) // 2)
        while True:
            made = cls(buckets)
            if made.insert(keys):
                return made
            buckets *= 2

    def _where(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix64(np.asarray(keys).astype(np.int64).view(np.uint64))
        mark = ((h & np.uint64(0xFFFF)) % np.uint64(0xFFFF) + np.uint64(1)).astype(np.uint16)
        first = ((h >> np.uint64(20)) & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, first ^ self._other(mark)

    def _other(self, mark: np.ndarray) -> np.ndarray:
        return (mix64(mark.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """Add each key once; False when one finds no room (the filter is then of no more use)."""
        cells = self.cells
        for mark, a, b in zip(*(x.tolist() for x in self._where(keys))):
            for at in (a, b):
                if not cells[at].all():
                    cells[at, int(np.flatnonzero(cells[at] == 0)[0])] = mark
                    break
            else:
                at = b
                for turn in range(500):
                    slot = (mark + turn) % _SLOTS
                    mark, cells[at, slot] = int(cells[at, slot]), mark
                    at ^= int(self._other(np.array([mark], dtype=np.uint16))[0])
                    if not cells[at].all():
                        cells[at, int(np.flatnonzero(cells[at] == 0)[0])] = mark
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Take each key out once; keys that were never inserted must not be given."""
        for mark, a, b in zip(*(x.tolist() for x in self._where(keys))):
            for at in (a, b):
                if len(slot := np.flatnonzero(self.cells[at] == mark)):
                    self.cells[at, int(slot[0])] = 0
                    break

    def __contains__(self, key: int) -> bool:
        return bool(self.maybe(np.array([key], dtype=np.int64))[0])

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """For each key, whether it may be in the set."""
        mark, a, b = self._where(keys)
        return (self.cells[a] == mark[:, None]).any(axis=1) | (self.cells[b] == mark[:, None]).any(axis=1)

    def __bytes__(self) -> bytes:
        return self.cells.tobytes()


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    ends = "\t\n\x0b\x0c\r "
    return F.translate(F.btrim(line, F.lit(ends)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_hashes(keys: Column) -> Column:
    """The 128-bit key of each line key: two seeds over its SHA-256, so that lines cannot be chosen to share both."""
    return F.transform(F.transform(keys, lambda k: F.sha2(k, 256)), lambda h: F.struct(F.xxhash64(h).alias("k1"), F.xxhash64(F.lit(1), h).alias("k2")))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def document_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Each document's distinct lines of at least ``min_chars``, as 128-bit keys ``k1``, ``k2``."""
    keys = F.filter(F.transform(_lines(text), line_key), lambda k: F.char_length(k) >= min_chars)
    key = F.explode(key_hashes(F.array_distinct(keys)))  # strings are told apart by hash, structs one by one
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("k")).select("doc_id", "k.k1", "k.k2")


def reference_counts(lines: DataFrame) -> DataFrame:
    """For each line key the smallest document that has it and whether another has it too."""
    return lines.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("refs"))


def build_filters(repeated: DataFrame, shards: int) -> DataFrame:
    """One cuckoo filter for each shard of the keys given: ``shard``, ``filter``."""

    def build(group: pa.Table) -> pa.Table:
        return pa.table({"shard": group["shard"][:1], "filter": pa.array([bytes(CuckooFilter.of(np.array(group["k1"])))], pa.binary())})

    return repeated.select(_shard("k1", shards).alias("shard"), "k1").groupBy("shard").applyInArrow(build, "shard int, filter binary")


def _shard(key: str, shards: int) -> Column:
    return F.pmod(F.col(key), F.lit(shards)).cast("int")


def probe(lines: DataFrame, filters: DataFrame, shards: int, parts: int = PARTS) -> DataFrame:
    """The lines that their shard's filter may hold.

    A shard's lines are dealt over ``parts`` by document, each part with a
    copy of the filter (a few KB), so one very common line does not make one
    long task.
    """

    def look(group: pa.Table, own: pa.Table) -> pa.Table:
        if not own.num_rows:
            return group.select(["doc_id", "k1", "k2"]).slice(0, 0)
        known = CuckooFilter(4, own["filter"][0].as_py())
        known.buckets = len(known.cells)
        return group.select(["doc_id", "k1", "k2"]).filter(pa.array(known.maybe(np.array(group["k1"]))))

    dealt = lines.select(_shard("k1", shards).alias("shard"), F.pmod(F.hash("doc_id"), F.lit(parts)).alias("part"), "doc_id", "k1", "k2")
    copies = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "filter")
    return dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(look, "doc_id long, k1 long, k2 long")


@dataclass
class LineIndex:
    """The state of line deduplication, as tables: lines by document, reference counts, filters."""

    lines: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS

    @classmethod
    def _from(cls, lines: DataFrame, min_chars: int) -> LineIndex:
        counts = written(reference_counts(lines), "line-counts")
        repeated = counts.where("first_doc <> last_doc")
        shards = max(1, -(-repeated.count() // KEYS_PER_SHARD))
        return cls(lines, counts, written(build_filters(repeated, shards), "line-filters"), shards, min_chars)

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> LineIndex:
        """The index of a first batch of documents."""
        return cls._from(written(document_lines(docs, doc_id, text, min_chars), "lines"), min_chars)

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        """The index with further documents; a document id that it has already is an error of the caller."""
        new = written(document_lines(docs, doc_id, text, self.min_chars), "lines")
        return self._changed(self.lines.unionByName(new), new)

    def delete(self, doc_ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
        """The index without the documents named; lines left in one document are no longer repeated."""
        gone = doc_ids.select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
        return self._changed(self.lines.join(gone, "doc_id", "left_anti"), self.lines.join(gone, "doc_id", "left_semi"))

    def _changed(self, lines: DataFrame, touched: DataFrame) -> LineIndex:
        """Recount the touched keys, and put into or take out of each shard's filter those that became or ceased to be repeated."""
        lines = written(lines, "lines")
        keys = touched.select("k1", "k2").distinct()
        new = reference_counts(lines.join(keys, ["k1", "k2"], "left_semi"))
        counts = written(self.counts.join(keys, ["k1", "k2"], "left_anti").unionByName(new), "line-counts")
        flag = lambda c: c.join(keys, ["k1", "k2"], "left_semi").select("k1", "k2", (F.col("first_doc") != F.col("last_doc")).alias("many"))
        moved = flag(self.counts).withColumnRenamed("many", "was").join(flag(counts).withColumnRenamed("many", "now"), ["k1", "k2"], "full").select("k1", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("now", F.lit(False)).alias("now")).where("was <> now")
        shards = self.shards

        def update(own: pa.Table, change: pa.Table) -> pa.Table:
            shard = (own if own.num_rows else change)["shard"][0].as_py()
            made = CuckooFilter(4, own["filter"][0].as_py()) if own.num_rows else CuckooFilter(KEYS_PER_SHARD)
            made.buckets = len(made.cells)
            key, now = np.array(change["k1"]), np.array(change["now"], dtype=bool)
            made.delete(key[~now])
            full = not made.insert(key[now])
            return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([None if full else bytes(made)], pa.binary())})

        change = moved.select(_shard("k1", shards).alias("shard"), "k1", "now")
        filters = written(self.filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInArrow(update, "shard int, filter binary"), "line-filters")
        if filters.where("filter is null").limit(1).count():  # one is full: deal the keys over more shards
            return LineIndex._from(lines, self.min_chars)
        return LineIndex(lines, counts, filters, shards, self.min_chars)

    def repeats(self) -> DataFrame:
        """The lines to drop: ``doc_id``, ``k1``, ``k2`` of repeated lines outside their first document."""
        maybe = probe(self.lines, self.filters, self.shards)
        many = self.counts.where("first_doc <> last_doc").select("k1", "k2", "first_doc", "refs")
        total = many.agg(F.coalesce(F.sum("refs"), F.lit(0))).first()[0]
        return spread_join(maybe, many, ["k1", "k2"], "refs", total).where("doc_id <> first_doc").select("doc_id", "k1", "k2")


def dedup_lines(docs: DataFrame, index: LineIndex, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their repeated lines taken out: all columns, and ``n_lines``, ``n_dropped``.

    A line of at least ``min_chars`` code points that two documents have stays
    only in the smaller doc_id; all its copies inside that one stay.  Null and
    empty texts are one empty line and come back as they are; untouched texts
    are returned to the byte.  Rows without id are never deduplicated; rows of
    one id are one document.  Columns ``n_lines`` and ``n_dropped`` of
    ``docs`` are replaced.
    """
    drops = index.repeats().groupBy("doc_id").agg(F.collect_list("k1").alias("_d1"), F.collect_list("k2").alias("_d2")).withColumnRenamed("doc_id", "_doc")
    joined = docs.drop("n_lines", "n_dropped").join(drops, F.col(doc_id).cast("long") == F.col("_doc"), "left").drop("_doc")
    own = F.when(F.col("_d1").isNotNull(), key_hashes(F.transform(_lines(text), line_key)))
    marked = joined.withColumn("n_lines", F.size(_lines(text)).cast("long")).withColumns({"_o1": own.k1, "_o2": own.k2})
    keys = ["_o1", "_o2", "_d1", "_d2"]
    rest = marked.drop(*keys)
    names = rest.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts, dropped = batch.column(at).to_pylist(), [0] * batch.num_rows
            o1, o2, d1, d2 = (batch.column(batch.schema.get_field_index(c)) for c in keys)
            for k in np.flatnonzero(np.asarray(d1.is_valid())).tolist():
                gone = set(zip(d1[k].values.to_pylist(), d2[k].values.to_pylist()))
                lines = (texts[k] or "").split("\n")
                kept = [line for line, key in zip(lines, zip(o1[k].values.to_pylist(), o2[k].values.to_pylist())) if key not in gone]
                texts[k], dropped[k] = "\n".join(kept), len(lines) - len(kept)
            own = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type)).select(names)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(dropped, pa.int64())], names=[*names, "n_dropped"])

    return marked.mapInArrow(cut, with_fields(rest, "n_dropped long"))


def report(deduped: DataFrame) -> DataFrame:
    """What the query reports of each document."""
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("kept_sha256"))
