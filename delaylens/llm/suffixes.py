"""Repeated passages: bytes covered by a 50-byte string that an earlier document has too.

The suffixes of the whole corpus fall into groups that never share a passage:
every 50-byte window is led by its rarest-hashed 16-byte string (its anchor),
and equal windows have equal anchors and equal 17 bytes on one side of it at
least.  Anchors are dealt over shards with a fingerprint of the text that they
lead, which settles text that is the same everywhere, and of the 17 bytes on
either side, which leaves out what can share nothing.  What differs goes on,
by anchor and side: the Burrows-Wheeler transforms of parts of a shard are
merged by refining their interleave, two symbols in a round, and the common
prefixes found on the way bound the intervals of suffixes that share 50 bytes:
the repeated windows, with their first document.  No suffixes are sorted
across parts.  Groups with very many texts are halved by the bytes next to
what they share until few texts, or equal ones, are left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, byte_texts, known_id, mix64, shards_for, spread_join, text_bytes, written

LENGTH, ANCHOR = 50, 16
BLOCK = 2 << 20
#: Text of a part whose transform is built by sorting, and of a shard whose parts are merged.
PART, SHARD = 1 << 17, 2 << 20
#: Bytes on a side of an anchor of which one side at least is inside every window.
SIDE = (LENGTH - ANCHOR) // 2
#: Texts that share an anchor and side and go into one shard; groups of more are halved first.
VARIANTS = 1000
#: Places that are hashed together, to stay in the processor's cache.
STEP = 1 << 15

_PIECES = "block long, shard int, ids binary, sizes binary, data binary"
_MARKED = "block long, kind int, anchor long, doc_id long, start int, lead int, ids binary, sizes binary, data binary, marks binary"
_SPANS = "block long, start int, stop int"
_HALVES = "block long, anchor long, doc_id long, start int, lead int, low int, high int, data binary"


_WEIGHT = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the fingerprints' base, and of its inverse."""
    if len(_powers[0]) < n:
        for k, x in enumerate((_WEIGHT, np.uint64(pow(int(_WEIGHT), -1, 1 << 64)))):
            each = np.full(n, x)
            each[0] = 1
            _powers[k] = np.cumprod(each)
    return _powers[0][:n], _powers[1][:n]


def _hash16(word: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place on, given the 8 bytes from there on as integers."""
    out = np.empty(max(len(word) - 8, 0), dtype=np.uint64)
    for c in range(0, len(out), STEP):
        stop = min(c + STEP, len(out))
        out[c:stop] = mix64(word[c:stop] * np.uint64(0x9E3779B97F4A7C15) + mix64(word[c + 8 : stop + 8]))
    return out


def _leaders(h: np.ndarray) -> np.ndarray:
    """For each window's place the place of its anchor: the least hash of ``LENGTH - ANCHOR + 1`` = 35 places."""
    out = np.empty(max(len(h) - (LENGTH - ANCHOR), 0), dtype=np.int32)
    mask = np.uint64(0xFFFFFFFF)
    for c in range(0, len(out), STEP):
        stop = min(c + STEP, len(out))
        part = h[c : stop + LENGTH - ANCHOR]
        low = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16):
            low = np.minimum(low[:-step], low[step:])
        out[c:stop] = (np.minimum(low[:-3], low[3:]) & mask).astype(np.int32) + c
    return out


class Anchors:
    """The anchors of a block of texts: ``lead`` (place), ``mark`` (40 bits of hash), ``print`` (56 bits), and the windows they lead, ``first`` to ``last``.

    ``left`` and ``right`` (24 bits, 0 where there are too few bytes) stand
    for the 17 bytes on either side of the anchor.  Windows that begin 17 or
    more bytes before the anchor have the left ones, the others the right ones.
    """

    def __init__(self, whole: bytes, sizes: np.ndarray):
        raw = np.frombuffer(whole, dtype=np.uint8)
        n = len(raw)
        self.mark = self.print = self.left = self.right = np.empty(0, np.uint64)
        self.first = self.last = self.lead = np.empty(0, np.int64)
        if n < LENGTH:
            return
        word = np.ndarray((n - 7,), dtype="<u8", buffer=whole, strides=(1,))
        h = _hash16(word)
        at = _leaders(h)
        ends = np.cumsum(sizes)
        bad = np.zeros(n + 1, dtype=np.int32)
        np.add.at(bad, np.maximum(ends - LENGTH + 1, ends - sizes), 1)
        np.add.at(bad, ends, -1)
        inside = np.cumsum(bad, dtype=np.int32)[: len(at)] == 0
        same = at[1:] == at[:-1]
        new = inside.copy()
        new[1:] &= ~(inside[:-1] & same)
        self.first = np.flatnonzero(new)
        over = inside.copy()
        over[:-1] &= ~(inside[1:] & same)
        self.last = np.flatnonzero(over)
        self.lead = lead = at[self.first].astype(np.int64)
        power, back = _weights(n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)))
        span = (total[self.last + LENGTH - ANCHOR + 1] - total[self.first]) * back[self.first]
        shape = ((self.last - self.first) * 64 + lead - self.first).astype(np.uint64)
        self.mark = mix64(h[lead]) >> np.uint64(24)
        self.print = mix64(span + mix64(shape)) >> np.uint64(8)
        side = lambda at, ok: np.where(ok, (mix64(word[np.where(ok, at, 0)] + mix64(word[np.where(ok, at + 8, 0)] + mix64(raw[np.where(ok, at + 16, 0)].astype(np.uint64)))) >> np.uint64(40)) | np.uint64(1), np.uint64(0))
        self.left = side(lead - SIDE, lead - self.first >= SIDE)
        self.right = side(lead + ANCHOR, self.last + LENGTH >= lead + ANCHOR + SIDE)

    def combined(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One anchor for each text that the block has round one: its number, in the smallest document; and for every anchor which of these stands for it, and whether it is in a later document than that."""
        order = np.lexsort((doc, self.print, self.mark))
        mark, kind = self.mark[order], self.print[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (mark[1:] != mark[:-1]) | (kind[1:] != kind[:-1])
        chosen = order[new]
        stands = np.empty(len(order), dtype=np.int64)
        stands[order] = np.cumsum(new) - 1
        return chosen, stands, doc > doc[chosen][stands]

    def document(self, sizes: np.ndarray) -> np.ndarray:
        """The number of the text that each anchor is in."""
        return np.searchsorted(np.cumsum(sizes), self.first, side="right")


def _dump(numbers: np.ndarray) -> bytes:
    return zlib.compress(np.diff(numbers.astype(np.int64), prepend=0).tobytes(), 1)


def _load(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), dtype=np.int64))


def _split(docs: DataFrame, shards: int, anchors: bool) -> DataFrame:
    """Blocks of documents: either their anchors by shard, or the documents themselves (shard -1)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64

        place = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, "text", BLOCK):
            texts = byte_texts(batch)
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            whole = b"".join(texts)
            content = xxh3_64(ids.tobytes() + sizes.tobytes(), seed=place)
            content.update(whole)
            block = content.intdigest() - (1 << 63)
            place += 1
            rows = []
            if anchors:
                found = Anchors(whole, sizes)
                every = ids[found.document(sizes)] if len(found.mark) else ids[:0]
                chosen, _, _ = found.combined(every)
                shard, doc = (found.mark[chosen] % np.uint64(shards)).astype(np.int64), every[chosen]
                for s in np.unique(shard).tolist():
                    mine = shard == s
                    own = chosen[mine]
                    packed = np.concatenate((found.mark[own].view(np.uint8).reshape(-1, 8)[:, :5], found.print[own].view(np.uint8).reshape(-1, 8)[:, :7], found.left[own].view(np.uint8).reshape(-1, 8)[:, :3], found.right[own].view(np.uint8).reshape(-1, 8)[:, :3]), axis=1)
                    rows.append((block, s, _dump(doc[mine]), b"", packed.tobytes()))
            else:
                rows.append((block, -1, ids.tobytes(), sizes.tobytes(), zlib.compress(whole, 1)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "shard", "ids", "sizes", "data"])

    return docs.mapInArrow(split, _PIECES)


def _wide(packed: np.ndarray) -> np.ndarray:
    out = np.zeros((len(packed), 8), dtype=np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64).ravel()


def _settle(group: pa.Table) -> pa.Table:
    """What becomes of each anchor's windows: 0 nothing, 1 all repeated, 2 those with the left side to be compared, 4 those with the right one, 6 both."""
    docs = [_load(x) for x in group["ids"].to_pylist()]
    packed = np.frombuffer(b"".join(group["data"].to_pylist()), dtype=np.uint8).reshape(-1, 18)
    mark, kind, doc = _wide(packed[:, :5]), _wide(packed[:, 5:12]), np.concatenate(docs)
    order = np.lexsort((doc, kind, mark))
    mark, kind, doc = mark[order], kind[order], doc[order]
    one = np.concatenate(([True], mark[1:] != mark[:-1]))
    variant = one | np.concatenate(([True], kind[1:] != kind[:-1]))
    firsts, in_variant = np.flatnonzero(variant), np.cumsum(variant) - 1
    earliest = doc[firsts]
    group_of = (np.cumsum(one) - 1)[firsts].astype(np.uint64) << np.uint64(24)
    verdict = np.zeros(len(firsts), dtype=np.uint8)
    for bit, k in ((2, 12), (4, 15)):  # texts of different documents that are equal on this side of one anchor
        side = _wide(packed[order[firsts], k : k + 3])
        by = np.lexsort((earliest, group_of | side))
        same = (group_of | side)[by]
        starts = np.flatnonzero(np.concatenate((np.ones(min(len(same), 1), bool), same[1:] != same[:-1])))
        sizes = np.diff(starts, append=len(same))
        differ = earliest[by][starts] != earliest[by][starts + sizes - 1]
        verdict[by] |= np.where(np.repeat(differ, sizes) & (side[by] > 0), np.uint8(bit), np.uint8(0))
    back = np.empty(len(order), dtype=np.uint8)
    back[order] = np.where(doc > earliest[in_variant], np.uint8(1), verdict[in_variant])
    cuts = np.cumsum([len(d) for d in docs])[:-1]
    return pa.table({"block": group["block"], "shard": group["shard"], "ids": pa.array([b""] * len(docs), pa.binary()), "sizes": pa.array([b""] * len(docs), pa.binary()), "data": pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(back, cuts)], pa.binary())})


def _marker(shards: int):
    def mark(group: pa.Table) -> pa.Table:
        shard = np.asarray(group["shard"])
        own = np.flatnonzero(shard < 0).tolist()
        if len(own) != 1:
            raise ValueError("the documents changed between two reads: write them to a table first")
        ids_, sizes_, data = (group[c].to_pylist() for c in ("ids", "sizes", "data"))
        ids, sizes = np.frombuffer(ids_[own[0]], dtype=np.int64), np.frombuffer(sizes_[own[0]], dtype=np.int64)
        whole = zlib.decompress(data[own[0]])
        found = Anchors(whole, sizes)
        doc = ids[found.document(sizes)] if len(found.mark) else ids[:0]
        chosen, stands, later = found.combined(doc)
        answer = np.zeros(len(chosen), dtype=np.uint8)
        dealt = (found.mark[chosen] % np.uint64(shards)).astype(np.int64)
        for i in np.flatnonzero(shard >= 0).tolist():
            answer[dealt == shard[i]] = np.frombuffer(zlib.decompress(data[i]), dtype=np.uint8)
        verdict = np.where(later, np.uint8(1), answer[stands])
        cover = np.zeros(len(whole) + 1, dtype=np.int32)
        np.add.at(cover, found.first[verdict == 1], 1)
        np.add.at(cover, found.last[verdict == 1] + LENGTH, -1)
        block = group["block"][0].as_py()
        left, right = np.flatnonzero(verdict & 2), np.flatnonzero(verdict & 4)
        start = np.concatenate((found.first[left], np.maximum(found.first[right], found.lead[right] - SIDE + 1)))
        stop = np.concatenate((np.minimum(found.last[left], found.lead[left] - SIDE), found.last[right])) + LENGTH
        both = np.concatenate((left, right))
        side = np.concatenate((found.left[left] << np.uint64(1), (found.right[right] << np.uint64(1)) | np.uint64(1)))
        use = start + LENGTH <= stop
        both, side, start, stop = both[use], side[use], start[use], stop[use]
        n, none = len(both), [None] * len(both)
        cols = [
            np.full(n + 1, block), np.array([0] + [1] * n, dtype=np.int32), np.concatenate((np.zeros(1, np.int64), mix64(found.mark[both] * np.uint64(0x9E3779B97F4A7C15) + mix64(side)).view(np.int64))), np.concatenate(([0], doc[both])), np.concatenate(([0], start)), np.concatenate(([0], found.lead[both] - start)),
            [ids_[own[0]], *none], [sizes_[own[0]], *none], [data[own[0]], *(whole[a:b] for a, b in zip(start.tolist(), stop.tolist()))], [zlib.compress(np.packbits(np.cumsum(cover[:-1]) > 0).tobytes(), 1), *none],
        ]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(x, type=k) for x, k in zip(cols, kinds)], names=["block", "kind", "anchor", "doc_id", "start", "lead", "ids", "sizes", "data", "marks"])

    return mark


def transform(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a circular text in order of their first symbols (``length`` + 8 at least), and its two-symbol Burrows-Wheeler transform.

    Ranks by eight symbols are doubled until they cover enough.
    """
    n = len(text)
    round_ = np.concatenate((text, np.resize(text, 8)))
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | round_[k : k + n]
    covered = 8
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(np.concatenate((np.zeros(1, np.int64), ranked[1:] != ranked[:-1]))).astype(np.uint64)
        if covered >= length + 8:
            return order, (text[order - 2].astype(np.uint16) << np.uint16(8)) | text[order - 1]
        step = min(covered, length + 8 - covered)
        key = (rank << np.uint64(32)) | np.roll(rank, -step)
        covered += step


def merge_transforms(transforms: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Merge two-symbol Burrows-Wheeler transforms by refining their interleave ``length`` / 2 times (``length`` is even).

    Returns, for each suffix of each transform (one transform after the
    other, each in its own order), its place in the merged order; and for each
    place the number of symbols shared with the suffix before it, rounded down
    to an even number (``length`` or more: length).
    """
    symbols = np.concatenate(transforms)
    source = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    block = np.zeros(len(symbols), dtype=np.int32)
    common = np.full(len(symbols), length, dtype=np.int16)
    here = np.empty_like(symbols)
    new = np.ones(len(symbols), dtype=bool)
    for k in range(0, length, 2):
        here[np.argsort(source, kind="stable")] = symbols
        order = np.argsort(here, kind="stable")
        source, block, ordered = source[order], block[order], here[order]
        new[1:] = (ordered[1:] != ordered[:-1]) | (block[1:] != block[:-1])
        common[new & (common == length)] = k
        block = np.cumsum(new, dtype=np.int32)
    return np.argsort(source, kind="stable"), common


def _compare(group: pa.Table) -> pa.Table:
    """The windows of a shard's variants that an earlier document has too, as spans of their blocks."""
    order = np.argsort(np.asarray(group["anchor"]), kind="stable")
    group = group.take(pa.array(order))
    texts = group["data"].to_pylist()
    sizes = np.array([len(t) for t in texts])
    whole = np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8) + np.uint8(1)  # UTF-8 has no byte 255; 0 ends a text
    ends = np.cumsum(sizes + 1)
    whole[ends - 1] = 0
    parts, start = [], 0
    for end in [*ends[np.searchsorted(ends, np.arange(PART, ends[-1], PART))].tolist(), int(ends[-1])]:
        if end > start:
            parts.append((start, *transform(whole[start:end])))
        start = max(start, end)
    place_of, common = merge_transforms([t for _, _, t in parts])
    suffix = np.concatenate([start + order for start, order, _ in parts])
    same = np.empty(len(whole), dtype=np.int32)
    same[suffix] = np.cumsum(common < LENGTH, dtype=np.int32)[place_of]  # intervals of suffixes with the window in common
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    place = np.arange(len(whole))
    full = place + LENGTH < ends[text]  # the window ends before the text does
    doc = np.asarray(group["doc_id"])[text]
    earliest = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(earliest, same[full], doc[full])
    gone = full & (doc > earliest[same])
    at = np.flatnonzero(gone & ~np.concatenate(([False], gone[:-1])))
    to = np.flatnonzero(gone & ~np.concatenate((gone[1:], [False])))
    own = text[at]
    offset = np.asarray(group["start"])[own] - (ends[own] - sizes[own] - 1)
    return pa.table({"block": np.asarray(group["block"])[own], "start": (at + offset).astype(np.int32), "stop": (to + LENGTH + offset).astype(np.int32)})


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text in two: its windows that begin ``low`` to ``middle`` bytes before the anchor, and those up to ``high``; the bytes that all windows of a half hold name its group."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        rows = []
        for block, anchor, doc, start, lead, low, high, text in zip(*(batch.column(c).to_pylist() for c in ("block", "anchor", "doc_id", "start", "lead", "low", "high", "data"))):
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                begin, end = lead - min(b, lead), max(a, lead - len(text) + LENGTH)
                if lead - begin >= end:
                    name = xxh3_64_intdigest(anchor.to_bytes(8, "little", signed=True) + bytes((a, b)) + text[lead - a : lead - b + LENGTH]) - (1 << 63)
                    rows.append((block, name, doc, start + begin, lead - begin, a, b, text[begin : lead - end + LENGTH]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["block", "anchor", "doc_id", "start", "lead", "low", "high", "data"])


def _divide(hot: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Texts of groups with more than ``VARIANTS``: the spans that are settled, and the texts in groups of fewer.

    In each round a text that an earlier document has too is settled whole;
    the others are halved, and halves that meet no other document fall out.
    After five rounds a text is one window, so that equal texts are all there is.
    """
    spans, few = [], []
    hot = hot.withColumn("low", F.when(F.col("lead") < SIDE, 0).otherwise(SIDE)).withColumn("high", F.when(F.col("lead") < SIDE, SIDE - 1).otherwise(2 * SIDE))
    span = SIDE + 1
    while n := hot.count():
        first = hot.groupBy("anchor", "data").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
        told = written(spread_join(hot, first, ["anchor", "data"], "n", n), "told")
        spans.append(told.where("doc_id > first").select("block", "start", (F.col("start") + F.octet_length("data")).alias("stop")))
        if span == 1:
            break
        span = -(-span // 2)
        halves = written(told.where("doc_id = first").select(*hot.columns).mapInArrow(_halves, _HALVES), "halves")
        groups = halves.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first <> last").select("anchor", "n", (F.col("n") > VARIANTS).alias("many"))
        left = written(spread_join(halves, groups, ["anchor"], "n", halves.count()), "left")
        few.append(left.where("not many"))
        hot = left.where("many").drop("many")
    return spans, few


def _finish(own: pa.Table, spans: pa.Table) -> pa.Table:
    """The documents of a block without their repeated bytes."""
    ids, sizes = (np.frombuffer(own[c][0].as_py(), dtype=np.int64) for c in ("ids", "sizes"))
    whole = np.frombuffer(zlib.decompress(own["data"][0].as_py()), dtype=np.uint8)
    gone = np.unpackbits(np.frombuffer(zlib.decompress(own["marks"][0].as_py()), dtype=np.uint8), count=len(whole)).astype(bool)
    cover = np.zeros(len(whole) + 1, dtype=np.int32)
    np.add.at(cover, np.asarray(spans["start"]), 1)
    np.add.at(cover, np.asarray(spans["stop"]), -1)
    gone |= np.cumsum(cover[:-1]) > 0
    rows, start = [], 0
    for i, size in zip(ids.tolist(), sizes.tolist()):
        g = gone[start : start + size]
        runs = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
        rows.append((i, size, int(g.sum()), runs, whole[start : start + size][~g].tobytes()))
        start += size
    return pa.Table.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document without repeated bytes: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (bytes).

    A byte goes if a 50-byte string that covers it also starts in a document
    with a smaller id; repeats inside one document stay.  Null and empty texts
    have no bytes; rows without an id neither take nor lose text, as nothing is
    smaller than no id; rows of one id are one document.
    Documents are read twice and should come from files or a table.
    """
    spark = docs.sparkSession
    nameless = docs.where(F.col(doc_id).isNull()).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.where(F.col(doc_id).isNotNull())
    rows = docs.select(known_id(doc_id), F.col(text).cast("string").alias("text"))
    shards = shards_for(spark, text_bytes(docs, text), 32 << 20)
    verdicts = written(_split(rows, shards, True).groupBy("shard").applyInArrow(_settle, _PIECES), "verdicts")
    marked = written(_split(rows, shards, False).unionByName(verdicts).groupBy("block").applyInArrow(_marker(shards), _MARKED), "marked")

    variants = marked.where("kind = 1").select("block", "anchor", "doc_id", "start", "lead", "data")
    many = written(variants.groupBy("anchor").count().where(F.col("count") > VARIANTS).select("anchor"), "many")
    settled, divided = _divide(written(variants.join(many, "anchor", "left_semi"), "hot"))
    few = variants.join(many, "anchor", "left_anti").drop("lead")
    for part in divided:
        few = few.unionByName(part.select(*few.columns))
    amount = few.agg(F.coalesce(F.sum(F.octet_length("data") + 1), F.lit(0))).first()[0]
    spans = few.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards_for(spark, amount, SHARD)))).groupBy("shard").applyInArrow(_compare, _SPANS)
    for part in settled:
        spans = spans.unionByName(part)
    spans = written(spans, "spans")
    whole = marked.where("kind = 0").select("block", "ids", "sizes", "data", "marks")
    out = whole.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    size, none = F.octet_length("text").cast("long"), F.lit(0).cast("long")
    return out.unionByName(nameless.select(F.lit(None).cast("long").alias("doc_id"), size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.encode("text", "utf-8").alias("kept")))


def report(removed: DataFrame) -> DataFrame:
    """What the query reports of each document."""
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
