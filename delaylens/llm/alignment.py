"""Which tokens of two tokenizers end together, and how often each pair of ids does so in the whole corpus.

External counting in sorted runs.  Each task cuts its documents into runs;
pair-document records of a run are combined by pair, radix-partitioned by the
id of side B and leave as zstandard pages sorted by B, then A.  Within a radix
partition Spark delivers pages in order of their first pair; a heap of open
pages merges them, sums each pair and, as all pairs of a B id come together,
knows that id's maximum when it leaves it.  What each record is worth streams
back to its page, and pages to the documents of their run.  A frequent pair
costs one record a run, however many documents hold it.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import GAP, blocks, mix64, shards_for, stretches, text_bytes, written

#: Bytes of text whose pairs make one run.
RUN_BYTES = 8 << 20
#: Records in a page.
PAGE = 1 << 14
#: Records that a merge holds before it passes on what is complete.
HELD = 1 << 21
#: Bytes of text for each radix.
RADIX_BYTES = 256 << 20
#: Stretches of text that a task remembers with their tokens.
REMEMBERED = 500_000

_ROWS = "block long, radix int, seq int, first long, doc_ids binary, stats binary, digests binary, data binary"
_BACK = "block long, radix int, seq int, data binary"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def squeeze(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(x.tobytes(), 1)


def expand(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), dtype=kind)


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


# Characters whose classes all regular-expression engines see alike.
_PLAIN = re.compile("[!-~\u00c0-\u017e]+").fullmatch
# the cut of byte-level tokenizers, as their files name it by "use_regex"
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER_SPACE = re.compile(r"[^\S \n]").search


def parts_of(text: str) -> list[str]:
    """A text cut at its gaps."""
    if text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text or _OTHER_SPACE(text):
        return GAP.split(text)
    return text.split(" ")  # every space is a gap


def _merger(tokenizer_json: str, token_bytes: dict[int, bytes]):
    """A faster encoder of plain words with the same merges, if the file's merges come in the order of the ids they make; else None."""
    import tiktoken

    made = json.loads(tokenizer_json)
    model, cut = made["model"], made["pre_tokenizer"]
    special = {t["id"] for t in made["added_tokens"]}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    in_order = all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(pairs))
    if not in_order or made["normalizer"] or cut["type"] != "ByteLevel" or not cut["use_regex"] or cut["add_prefix_space"]:
        return None
    ranks = {t: i for i, t in token_bytes.items() if i not in special}
    return tiktoken.Encoding("merges", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


class Pieces(dict):
    """Stretches between gaps -> their tokens' alignment, each distinct one worked out once.

    Both tokenizers must let no token cross a gap (``check`` tests their
    vocabularies); then a text's tokens are those of its stretches in order.
    A value is (A tokens, B tokens, groups as text, pair keys as bytes), or
    None where the tokens' bytes are not those of the text.
    """

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        super().__init__()
        self.a, self.b = Tokenizer.from_str(a_json), sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True
        as_byte = byte_level()
        self.a_bytes = {i: bytes(map(as_byte.__getitem__, t)) if set(t) <= as_byte.keys() else t.encode() for t, i in self.a.get_vocab().items()}
        self.fast = _merger(a_json, self.a_bytes)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) else p.replace("▁", " ").encode() for p in names]
        if any(re.search("[^▁]▁", p) for p in names):
            raise ValueError("pieces of this model cross the space after a word")
        if not all(self.a_bytes.values()) or not all(self.b_bytes):
            raise ValueError("a token has no bytes")

    def learn(self, parts: list[str]) -> None:
        new = [p for p in dict.fromkeys(parts) if p not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(dict.fromkeys(parts))
        for k in range(0, len(new), 10_000):
            some = new[k : k + 10_000]
            quick = [p for p in some if self.fast and _PLAIN(p)]
            slow = [p for p in some if not (self.fast and _PLAIN(p))]
            a_ids = {p: self.fast(f" {p}") for p in quick} | {p: x.ids for p, x in zip(slow, self.a.encode_batch_fast([f" {p}" for p in slow], add_special_tokens=False))}
            for part, b in zip(some, self.b.encode(some, num_threads=1)):
                self[part] = self.align(f" {part}".encode(), a_ids[part], b)

    def align(self, whole: bytes, a: list[int], b: list[int]) -> tuple[int, int, bytes, bytes] | None:
        left, right = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(left) != whole or b"".join(right) != whole:
            return None
        groups, keys = [], []
        i = j = from_i = from_j = end_a = end_b = 0
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                end_a += len(left[i])
                i += 1
            else:
                end_b += len(right[j])
                j += 1
            if end_a == end_b:
                groups.append(f"{a[from_i]}|{b[from_j]}" if i - from_i == j - from_j == 1 else f"{','.join(map(str, a[from_i:i]))}|{','.join(map(str, b[from_j:j]))}")
                keys.append(b[j - 1] << 32 | a[i - 1])
                from_i, from_j = i, j
        return len(a), len(b), ";".join(groups).encode(), struct.pack(f"<{len(keys)}q", *keys)

    def learn_all(self, texts: list[str | None]) -> None:
        """Learn the stretches of many texts at once; what is forgotten again is learnt as it is met."""
        unknown: set[str] = set()
        for text in texts:
            unknown.update(parts_of(text or ""))
        unknown.difference_update(self.keys())
        self.learn(list(unknown))

    def text(self, text: str) -> tuple[int, int, bytes, np.ndarray]:
        """A whole text: A tokens, B tokens, digest of the groups, pair keys in order of place."""
        n_a = n_b = 0
        digest, keys = sha256(), []
        for k, stretch in enumerate(stretches(text) if text else ()):
            parts = parts_of(stretch)
            try:
                got = list(map(self.__getitem__, parts))
            except KeyError:
                self.learn(parts)
                got = list(map(self.__getitem__, parts))
            if None in got:
                return 0, 0, b"", np.empty(0, np.int64)
            a, b, groups, pairs = zip(*got)
            n_a += sum(a)
            n_b += sum(b)
            digest.update(b";" * (k > 0) + b";".join(groups))
            keys.extend(pairs)
        return n_a, n_b, digest.digest() if n_a else b"", np.frombuffer(b"".join(keys), np.int64)


@lru_cache(maxsize=1)
def pieces_of(a_json: str, b_model: bytes) -> Pieces:
    """The stretches that this Python worker knows already; its next task goes on from them."""
    return Pieces(a_json, b_model)


def runs(docs: DataFrame, a_json: str, b_model: bytes, radixes: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as runs: pages of pair records by radix, and one row for each run (radix -1) with its documents' records."""
    given = docs.sparkSession.sparkContext.broadcast((a_json, b_model))  # as large as the vocabularies, whatever the corpus

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(*given.value)
        block = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, text, RUN_BYTES):
            stats, digests, records, times = [], [], [], []
            texts = batch.column(1).to_pylist()
            pieces.learn_all(texts)
            for t in texts:
                n_a, n_b, digest, keys = pieces.text(t or "")
                own, n = np.unique(keys, return_counts=True)
                stats.append((n_a, n_b, len(keys), len(own)))
                digests.append(digest or bytes(32))
                records.append(own)
                times.append(n)
            every, n = np.concatenate(records), np.concatenate(times)
            pairs, place = np.unique(every, return_inverse=True)
            count = np.bincount(place, weights=n, minlength=len(pairs)).astype(np.int64)
            radix = (mix64((pairs >> 32).astype(np.uint64)) % np.uint64(radixes)).astype(np.int64)
            order = np.argsort(radix, kind="stable")  # by radix, then B, then A
            rank = np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            ids = batch.column(0)
            own_ids = np.array([(i is None, i or 0) for i in ids.to_pylist()], dtype="<i8").tobytes()
            rows = [(block, -1, 0, 0, own_ids, np.array(stats, dtype="<i8").tobytes(), b"".join(digests), squeeze(np.concatenate((rank[place], n.astype(np.int32)))))]
            starts = np.flatnonzero(np.diff(radix[order], prepend=-1)).tolist()
            for a, b in zip(starts, [*starts[1:], len(order)]):
                for seq, k in enumerate(range(a, b, PAGE)):
                    at = order[k : min(k + PAGE, b)]
                    rows.append((block, int(radix[at[0]]), seq, int(pairs[at[0]]), b"", b"", b"", squeeze(np.concatenate((np.diff(pairs[at], prepend=0), count[at])))))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "radix", "seq", "first", "doc_ids", "stats", "digests", "data"])
            block += 1

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias(text)).mapInArrow(cut, _ROWS)


class _Page:
    """A page in the merge: its keys and counts, how far it has been read, and what its records are worth."""

    def __init__(self, name: tuple[int, int, int], data: bytes):
        both = expand(data, "<i8")
        half = len(both) // 2
        self.name, self.keys, self.counts, self.at, self.worth = name, np.cumsum(both[:half]), both[half:], 0, []


def _settle(heap: list, limit: int) -> Iterator[_Page]:
    """Sum what lies below ``limit`` over all open pages; give back pages that are through."""
    taken = []
    while heap and heap[0][0] < limit:
        page = heappop(heap)[2]
        stop = int(np.searchsorted(page.keys, limit))
        taken.append((page, page.at, stop))
    if not taken:
        return
    keys, place = np.unique(np.concatenate([p.keys[a:b] for p, a, b in taken]), return_inverse=True)
    total = np.zeros(len(keys), dtype=np.int64)
    np.add.at(total, place, np.concatenate([p.counts[a:b] for p, a, b in taken]))
    side = keys >> 32
    first = np.flatnonzero(np.diff(side, prepend=-1))
    best = total == np.repeat(np.maximum.reduceat(total, first), np.diff(np.append(first, len(side))))
    worth = np.where(best, -total, total)[place]  # a B id's highest counts carry a minus sign
    base = 0
    for k, (page, a, b) in enumerate(taken):
        page.worth.append(worth[base : base + b - a])
        base += b - a
        page.at = b
        if b == len(page.keys):
            yield page
        else:
            heappush(heap, (int(page.keys[b]), page.name, page))


def count_pairs(pages: DataFrame, parts: int) -> DataFrame:
    """For each page its records' worth: the pair's count in the corpus, negative where it is its B id's highest."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple[int, tuple[int, int, int], _Page]] = []
        now, held = -1, 0

        def back(done: list[_Page]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*[(*p.name, squeeze(np.concatenate(p.worth))) for p in done]), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["block", "radix", "seq", "data"])

        for batch in batches:
            for block, radix, seq, first, data in zip(*(c.to_pylist() for c in batch.columns)):
                limit = first >> 32 << 32 if radix == now else np.iinfo(np.int64).max
                if radix != now or held > HELD:
                    if done := list(_settle(heap, limit)):
                        yield back(done)
                    now, held = radix, sum(len(p.keys) - p.at for _, _, p in heap)
                page = _Page((block, radix, seq), data)
                held += len(page.keys)
                heappush(heap, (int(page.keys[0]), page.name, page))
        if done := list(_settle(heap, np.iinfo(np.int64).max)):
            yield back(done)

    dealt = pages.select("block", "radix", "seq", "first", "data").repartition(parts, "radix").sortWithinPartitions("radix", "first", "block", "seq")
    return dealt.mapInArrow(merge, _BACK)


def _assemble(group: pa.Table) -> pa.Table:
    """A run's documents with the worth of their records."""
    rows = sorted(group.select(["radix", "seq", "doc_ids", "stats", "digests", "data"]).to_pylist(), key=lambda r: (r["radix"], r["seq"]))
    own, worth = rows[0], np.concatenate([np.empty(0, np.int64), *[expand(r["data"], "<i8") for r in rows[1:]]])
    ids, stats = np.frombuffer(own["doc_ids"], "<i8").reshape(-1, 2), np.frombuffer(own["stats"], "<i8").reshape(-1, 4)
    both = expand(own["data"], "<i4")
    place, times = both[: len(both) // 2], both[len(both) // 2 :].astype(np.int64)
    value = worth[place]
    ends = np.concatenate(([0], np.cumsum(stats[:, 3])))
    upto = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[ends])  # noqa: E731  sums by document
    digests = [own["digests"][32 * k : 32 * k + 32].hex() if n else "" for k, n in enumerate(stats[:, 0].tolist())]
    best = upto(np.where(value < 0, times, 0))
    return pa.table({"doc_id": pa.array([None if m else i for m, i in ids.tolist()], pa.int64()), "n_a": stats[:, 0], "n_b": stats[:, 1], "n_groups": stats[:, 2], "n_links": stats[:, 2], "n_best": best, "count_sum": upto(np.abs(value) * times), "groups_sha256": pa.array(digests, pa.string())})


def align(docs: DataFrame, a_json: str, b_model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its tokens, groups, links, and what the corpus says of these links.

    Null and empty texts, and texts that the tokens of either side do not
    spell, have zeros and an empty digest.  Repeated rows count each; a null
    id stays null; an empty table gives no rows; other columns are not read.
    """
    size = text_bytes(docs, text)
    parts = shards_for(docs.sparkSession, size, RADIX_BYTES)
    made = written(runs(docs, a_json, b_model, parts, doc_id, text), "pair-runs")
    back = count_pairs(made.where("radix >= 0"), parts)
    empty = F.lit(None).cast("binary")
    own = made.where("radix < 0").drop("first")
    return own.unionByName(back.withColumns({c: empty for c in ("doc_ids", "stats", "digests")})).groupBy("block").applyInArrow(_assemble, _RESULT)
