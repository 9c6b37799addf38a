"""Byte-level BPE encoding and decoding by one global shuffle of distinct words.

Each task splits its texts into pre-tokens and numbers the distinct ones
within a block of documents.  Only those distinct words travel: dealt by word
hash, every distinct word of the corpus meets in one shard and is merged once;
the ids travel back to each block, where they replace the word numbers by
position.  However often a word occurs it travels once per block, so frequent
words make no hot shard.  Decoding joins ids with the token-byte table, whose
size is fixed by the vocabulary.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, known_id, pack, shards_for, text_bytes, unpack, with_fields, with_missing_ids

#: Bytes of text in a block.
BLOCK = 4 << 20

_PIECES = "block long, shard int, doc_ids binary, numbers binary, data binary"


#: Characters for which the classes of both regular-expression modules agree; a text with others takes the slower one.
_ODD = re.compile("[^\t\n\r -~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u017f\u2010-\u2027]")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that cuts a text into the matches of ``pattern``."""
    import regex

    slow = regex.compile(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    if "\\p" in plain:
        return slow
    fast, odd = re.compile(plain).findall, _ODD.search
    return lambda text: slow(text) if odd(text) else fast(text)


def _squeeze(data: bytes) -> bytes:
    """What travels is compressed in the tasks; word numbers shrink by a third beyond what shuffles do."""
    return zlib.compress(data, 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from a rank file (a base64 token and its id on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def split_words(docs: DataFrame, pattern: str, shards: int, words_too: bool, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts as blocks of numbered words: either the blocks' distinct words or their documents.

    With ``words_too`` there is a row for each block and shard, with the
    distinct words of that shard; without, one row for each block holds its
    documents (shard -1: ids, pre-token counts, word numbers by position).  A
    block's key is a hash of its place and content, so the two only meet if
    both were made from the same rows.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64, xxh3_64_intdigest

        find = splitter(pattern)
        place = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, text, BLOCK):
            words: defaultdict[str, int] = defaultdict(count().__next__)
            counts, numbers = [], []
            for t in batch.column(1).to_pylist():
                got = find(t) if t else ()
                counts.append(len(got))
                numbers.append(np.array(list(map(words.__getitem__, got)), dtype=np.uint32))
            ids, every = np.array(batch.column(0).to_pylist(), dtype=np.int64), np.concatenate(numbers)
            use = np.argsort(-np.bincount(every, minlength=len(words)), kind="stable")  # frequent words get the short numbers
            rank = np.empty(len(words), dtype=np.uint32)
            rank[use] = np.arange(len(words))
            content = xxh3_64(ids.tobytes(), seed=place)
            content.update(every.tobytes())
            content.update("\0".join(words).encode())
            block = content.intdigest() - (1 << 63)
            place += 1
            if words_too:
                names, spread = list(words), {}
                for n, k in enumerate(use.tolist()):
                    raw = names[k].encode()
                    spread.setdefault(xxh3_64_intdigest(raw) % shards, []).append((n, raw))
                rows = []
                for shard, own in spread.items():
                    n = np.array([n for n, _ in own])
                    rows.append((block, shard, pack(np.array([len(w) for _, w in own])), pack(np.diff(n, prepend=0)), _squeeze(b"".join(w for _, w in own))))
            else:
                rows = [(block, -1, ids.tobytes(), np.array(counts, dtype=np.int32).tobytes(), _squeeze(pack(rank[every])))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "shard", "doc_ids", "numbers", "data"])

    return docs.select(known_id(doc_id), F.col(text).cast("string").alias(text)).mapInArrow(split, _PIECES)


def encode_words(words: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The ids of each shard's words: every distinct word of a shard is merged once."""
    table = words.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary, whatever the corpus

    def encode(group: pa.Table) -> pa.Table:
        import tiktoken

        merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table.value, special_tokens={})._core_bpe.encode_single_piece
        known: dict[bytes, list[int]] = {}
        lengths, ids = [], []
        for sizes, data in zip(group["doc_ids"].to_pylist(), group["data"].to_pylist()):
            ends = np.cumsum(unpack(sizes)).tolist()
            data = zlib.decompress(data)
            out, start = [], 0
            for end in ends:
                word = data[start:end]
                start = end
                if (got := known.get(word)) is None:
                    known[word] = got = merge(word)
                out.append(got)
            lengths.append(pack(np.array([len(x) for x in out])))
            ids.append(_squeeze(pack(np.array([i for x in out for i in x]))))
        return pa.table({"block": group["block"], "shard": group["shard"], "doc_ids": pa.array(lengths, pa.binary()), "numbers": group["numbers"], "data": pa.array(ids, pa.binary())})

    return words.groupBy("shard").applyInArrow(encode, _PIECES)


def _assemble(group: pa.Table) -> pa.Table:
    """A block's documents with ids in place of word numbers."""
    shard = np.array(group["shard"])
    sizes, data, numbers = (group[c].to_pylist() for c in ("doc_ids", "data", "numbers"))
    own = np.flatnonzero(shard < 0).tolist()
    if len(own) != 1:
        raise ValueError("the documents changed between two reads: write them to a table first")
    own = own[0]
    parts = [(np.cumsum(unpack(numbers[i])), unpack(sizes[i]), unpack(zlib.decompress(data[i]))) for i in np.flatnonzero(shard >= 0)]
    total = sum(len(n) for n, _, _ in parts)
    size, start = np.zeros(total, dtype=np.int32), np.zeros(total, dtype=np.int32)
    flat = np.concatenate([ids for _, _, ids in parts]) if parts else np.empty(0, dtype=np.int32)
    base = 0
    for n, length, ids in parts:
        size[n], start[n] = length, base + np.cumsum(length) - length
        base += len(ids)
    doc_ids, counts = np.frombuffer(sizes[own], dtype=np.int64), np.frombuffer(numbers[own], dtype=np.int32)
    words = unpack(zlib.decompress(data[own]))
    ends = np.concatenate(([0], np.cumsum(counts)))
    lists, offsets = [], [0]
    for a, b in zip(ends[:-1], ends[1:]):
        w = words[a:b]
        long = size[w]
        at = np.repeat(start[w] - (np.cumsum(long) - long), long) + np.arange(long.sum())
        lists.append(flat[at])
        offsets.append(offsets[-1] + len(at))
    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
    return pa.table({"doc_id": pa.array(doc_ids), "token_ids": ids})


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every text: ``doc_id``, ``token_ids``, a row for each input row.

    Null and empty texts get an empty list; repeated rows each get their own;
    a null id stays null.  Special-token strings are ordinary text.
    A block holds 4 MB of text, a longer text is a block of its own.  The
    documents are read twice, once for their words and once for positions, so
    they should come from files or a table; rows that differ between the two
    are an error.
    """
    shards = shards_for(docs.sparkSession, text_bytes(docs, text), 256 << 20)
    coded = encode_words(split_words(docs, pattern, shards, True, doc_id, text), ranks, pattern)
    out = split_words(docs, pattern, shards, False, doc_id, text).unionByName(coded).groupBy("block").applyInArrow(_assemble, "doc_id long, token_ids array<int>")
    return with_missing_ids(out)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids") -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids``; a null list has none.  An id outside the vocabulary is an error."""
    table = encoded.sparkSession.sparkContext.broadcast(sorted((i, t) for t, i in ranks.items()))  # as large as the vocabulary

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.full(table.value[-1][0] + 1, -1, dtype=np.int64)
        size[[i for i, _ in table.value]] = [len(t) for _, t in table.value]
        start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        token_bytes = np.frombuffer(b"".join(t for _, t in table.value), dtype=np.uint8)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            out = []
            for k in range(len(col)):
                x = np.asarray(col[k].values) if col[k].is_valid else np.empty(0, dtype=np.int32)
                long = size[x]
                if (long < 0).any():
                    raise ValueError("an id is not in the vocabulary")
                out.append(token_bytes[np.repeat(start[x] - (np.cumsum(long) - long), long) + np.arange(long.sum())].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(join, with_fields(encoded, "decoded binary"))


def digests(decoded: DataFrame) -> DataFrame:
    """What the query reports of encoded and decoded documents."""
    return decoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
