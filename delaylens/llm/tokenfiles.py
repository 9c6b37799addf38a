"""Token ids on disk: each document compressed by itself with one shared dictionary, behind an index of offsets.

A folder holds three Parquet tables.  ``dictionary`` has the zstandard
dictionary and its SHA-256.  ``segments`` has a row for each run of documents
in ascending order of id: their frames joined into one byte string, the ends
of the frames, ids and token numbers, and the hash of the dictionary that
they need.  ``starts`` has the number of tokens before each range partition.
A document is read by slicing its own frame; its neighbours stay compressed.
Spark commits the tables, so a task that is lost is simply run again.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import blocks, in_order, shards_for, stretches, written

#: Bytes of a trained dictionary.
DICTIONARY_BYTES = 64 << 10
#: The dictionary is trained on at most so many pieces of serialized ids, drawn by hash from all documents alike.
TRAINING_PIECES = 4096
#: Bytes of such a piece.
PIECE_BYTES = 4096
#: Bytes of compressed ids in a segment; a longer document is a segment of its own.
SEGMENT_BYTES = 4 << 20
#: Bytes of serialized ids in a range partition.
PARTITION_BYTES = 64 << 20
#: Words that a task remembers with their ids.
REMEMBERED = 1_000_000
LEVEL = 3

_ENCODED = "doc_id long, n_tokens long, ids binary"
_SEGMENT = "part int, start long, n_docs long, n_tokens long, first_id long, last_id long, dictionary string, doc_ids binary, counts binary, ends binary, frames binary"


def width_of(vocabulary: int) -> np.dtype:
    """The little-endian type that serialized ids of a vocabulary take."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def vocabulary_size(tokenizer_json: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer_json).get_vocab_size()


# Characters whose classes Python and the tokenizer see alike, that stay themselves when composed and turn into one when lower-cased; no "<", which opens special tokens.
_PLAIN = re.compile("[!-;=-~\u00c0-\u012f\u0131-\u0148\u014a-\u017e]+").fullmatch
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall


#: A byte that no UTF-8 text has; it stands for the mark at a word's end.
_END = b"\xff"


def word_merger(tokenizer_json: str):
    """A faster encoder of one lower-cased part of a word, given as bytes, with the file's own merges; None if the file is of another kind.

    Ids must run from bytes over bytes that end a word to merges in their
    order.  With the mark as a byte of its own, a word's last byte and the mark
    then merge before all else, which is how the tokenizer starts.
    """
    import tiktoken

    from .alignment import byte_level

    made = json.loads(tokenizer_json)
    model, special = made["model"], {t["id"] for t in made["added_tokens"]}
    suffix, as_byte = model.get("end_of_word_suffix"), byte_level()
    if not suffix or model["type"] != "BPE" or model.get("continuing_subword_prefix"):
        return None
    tokens = {t: i for t, i in model["vocab"].items() if i not in special}
    spelt = {t: bytes(map(as_byte.__getitem__, t.removesuffix(suffix))) + _END * t.endswith(suffix) for t in tokens if set(t.removesuffix(suffix)) <= as_byte.keys()}
    ranks = {raw: tokens[t] for t, raw in spelt.items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    in_order = all(tokens.get(a + b) == 512 + k for k, (a, b) in enumerate(pairs)) and all(ranks.get(bytes([b]), 999) < 256 <= ranks.get(bytes([b]) + _END, 999) < 512 for b in range(256))
    if not in_order or len(ranks) != len(tokens):
        return None
    return tiktoken.Encoding("merges", pat_str="(?s).", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class WordIds(dict):
    """Words between white space -> their serialized ids, as the tokenizer makes them.

    The tokenizer must drop white space and let no token cross it; then a
    text's ids are those of its words in order, and each distinct word is
    encoded once.  Plain words are cut into their parts here and merged by
    ``word_merger``; all others go through the tokenizer.
    """

    def __init__(self, tokenizer_json: str, width: np.dtype):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.width, self.merge = Tokenizer.from_str(tokenizer_json), width, word_merger(tokenizer_json)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(words)
        self[""] = b""
        plain = [w for w in new if _PLAIN(w)] if self.merge else []
        ids, ends = [], []
        for w in plain:
            for part in _PARTS(w.lower()):
                ids += self.merge(part.encode() + _END)
            ends.append(len(ids) * self.width.itemsize)
        raw, start = np.array(ids, dtype=self.width).tobytes(), 0
        for w, end in zip(plain, ends):
            self[w] = raw[start:end]
            start = end
        new = [w for w in new if w not in self]
        for k in range(0, len(new), 10_000):
            some = new[k : k + 10_000]
            for word, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self[word] = np.array(got.ids, dtype=self.width).tobytes()

    def learn_all(self, texts: list[str | None]) -> None:
        """Learn the words of many texts at once; what is forgotten again is learnt as it is met."""
        unknown: set[str] = set()
        for text in texts:
            unknown.update((text or "").replace("\n", " ").split(" "))
        unknown.difference_update(self.keys())
        if unknown:
            self.learn(unknown)

    def encode(self, text: str) -> bytes:
        out = []
        for part in stretches(text):
            words = part.replace("\n", " ").split(" ")
            try:
                out += list(map(self.__getitem__, words))
            except KeyError:
                self.learn(set(words))
                out += list(map(self.__getitem__, words))
        return b"".join(out)


@lru_cache(maxsize=1)
def words_of(tokenizer_json: str, width: str) -> WordIds:
    """The words that this Python worker knows already; its next task goes on from them."""
    return WordIds(tokenizer_json, np.dtype(width))


def encode_ids(docs: DataFrame, tokenizer_json: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and serialized ``ids`` of every text, with ``end_id`` after each; null is empty."""
    given = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # as large as the vocabulary, whatever the corpus
    width = width_of(max(vocabulary_size(tokenizer_json), (end_id or 0) + 1))
    end = b"" if end_id is None else np.array([end_id], dtype=width).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(given.value, width.str)
        for batch in blocks(batches, text):
            texts = batch.column(1).to_pylist()
            words.learn_all(texts)
            ids = [words.encode(t or "") + end for t in texts]
            n = pa.array([len(x) // width.itemsize for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias(text)).mapInArrow(encode, _ENCODED)


def train_dictionary(encoded: DataFrame, pieces: int = TRAINING_PIECES) -> bytes:
    """A zstandard dictionary for serialized ids; empty if there are none.

    Every document's ids are cut into pieces of ``PIECE_BYTES``; the
    ``pieces`` with the smallest hashes, of all documents and places alike,
    go to one task.  This bound is the documented size of a training set; what
    is compressed with the dictionary is everything.
    """
    cut = encoded.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length("ids"), F.lit(1)) - 1) / PIECE_BYTES).cast("int"))))
    total = encoded.agg(F.sum(F.floor((F.greatest(F.octet_length("ids"), F.lit(1)) - 1) / PIECE_BYTES) + 1)).first()[0] or 0
    drawn = cut.withColumn("h", F.xxhash64("doc_id", "n_tokens", "k"))
    if total > 4 * pieces:  # about twice as many as are needed pass; the limit below is exact
        drawn = drawn.where(F.col("h") < -(1 << 63) + int(2 * pieces / total * 2**64))
    some = drawn.select("h", F.expr(f"substring(ids, k * {PIECE_BYTES} + 1, {PIECE_BYTES})").alias("piece")).orderBy("h", "piece").limit(pieces)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own = [x for b in batches for x in b.column(1).to_pylist() if x]
        if own:
            try:
                made = zstandard.train_dictionary(DICTIONARY_BYTES, own).as_bytes()
            except zstandard.ZstdError:  # too few or too even: what there is serves as it stands
                made = b"".join(own)[-DICTIONARY_BYTES:]
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["dictionary"])

    made = some.coalesce(1).mapInArrow(train, "dictionary binary").collect()  # one row of DICTIONARY_BYTES at most
    return bytes(made[0][0]) if made else b""


def write_tokens(encoded: DataFrame, path: str, dictionary: bytes, width: np.dtype) -> None:
    """Write ``encoded`` (``doc_id``, ``n_tokens``, ``ids``; from a table) to a folder in ascending order of id, nulls first."""
    spark = encoded.sparkSession
    known = hashlib.sha256(dictionary).hexdigest()
    total = encoded.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    given = spark.sparkContext.broadcast(dictionary)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(given.value)).compress
        part, start, held, size = TaskContext.get().partitionId(), 0, [], 0

        def segment() -> pa.RecordBatch:
            ids, counts, frames = zip(*held)
            known_ids = [i for i in ids if i is not None]
            row = {"part": part, "start": start, "n_docs": len(ids), "n_tokens": sum(counts), "first_id": min(known_ids, default=None), "last_id": max(known_ids, default=None), "dictionary": known, "doc_ids": np.array([(i is None, i or 0) for i in ids], dtype="<i8").tobytes(), "counts": np.array(counts, dtype="<i8").tobytes(), "ends": np.cumsum([len(f) for f in frames], dtype="<i8").tobytes(), "frames": b"".join(frames)}
            return pa.RecordBatch.from_pylist([row], schema=_arrow_schema())

        for batch in batches:
            for i, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                frame = squeeze(ids)
                if held and size + len(frame) > SEGMENT_BYTES:
                    yield segment()
                    start += sum(n for _, n, _ in held)
                    held, size = [], 0
                held.append((i, n, frame))
                size += len(frame)
        if held:
            yield segment()

    in_order(encoded, ["doc_id"], shards_for(spark, total, PARTITION_BYTES)).mapInArrow(pack, _SEGMENT).write.parquet(f"{path}/segments")
    spark.createDataFrame([(known, dictionary, width.itemsize)], "hash string, dictionary binary, width int").write.parquet(f"{path}/dictionary")
    # a row for each range partition, 64 MB of ids
    sums = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("own"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before")).write.parquet(f"{path}/starts")


def _arrow_schema() -> pa.Schema:
    kind = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kind[k]) for name, k in (c.split() for c in _SEGMENT.split(", "))])


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def read_tokens(spark: SparkSession, path: str, ids: Sequence[int] | None = None) -> DataFrame:
    """The documents of a folder: ``doc_id``, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers).

    With ``ids`` only segments whose range of ids can hold one of these are
    read, and only these documents' frames are decompressed.  A dictionary
    whose hash is not the one a segment names is an error.
    """
    known, dictionary, size = spark.read.parquet(f"{path}/dictionary").first()
    given = spark.sparkContext.broadcast(bytes(dictionary))
    width, wanted = np.dtype(f"<u{size}"), None if ids is None else set(ids)
    if hashlib.sha256(given.value).hexdigest() != known:
        raise ValueError("the dictionary does not have the hash that it was written with")
    segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments")
    if wanted is not None:
        near = F.lit(False)
        for i in sorted(wanted):
            near = near | F.lit(i).between(F.col("first_id"), F.col("last_id"))
        segments = segments.where(near)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(given.value)).decompress
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != known:
                    raise ValueError("a segment was written with another dictionary")
                doc_ids, counts, ends = np.frombuffer(row["doc_ids"], "<i8").reshape(-1, 2), np.frombuffer(row["counts"], "<i8"), np.frombuffer(row["ends"], "<i8")
                starts = row["before"] + row["start"] + np.cumsum(counts) - counts
                out = []
                for k, (missing, i) in enumerate(doc_ids.tolist()):
                    if wanted is None or not missing and i in wanted:
                        got = np.frombuffer(expand(row["frames"][ends[k - 1] if k else 0 : ends[k]]), width)
                        out.append((None if missing else i, starts[k], len(got), got.astype("<u4").tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])

    return segments.join(spark.read.schema("part int, before long").parquet(f"{path}/starts"), "part").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, path: str, tokenizer_json: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text and write the folder ``path``.

    Null and empty texts hold ``end_id`` alone; rows without an id come first
    and keep their null id; repeated rows are each written; an empty table
    gives an empty folder.  Other columns are not read, whatever their names.
    """
    encoded = written(encode_ids(docs, tokenizer_json, end_id, doc_id, text), "token-ids")
    write_tokens(encoded, path, train_dictionary(encoded), width_of(max(vocabulary_size(tokenizer_json), (end_id or 0) + 1)))


def report(tokens: DataFrame) -> DataFrame:
    """What the query reports of documents read back."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
