"""Chat formatting as a prefix tree: turns that conversations share at their beginning are emitted once.

A node of the forest is a distinct beginning of conversations; its segment is
its last turn in the template.  In the order of their paths of node keys, each
conversation emits the turns that none before it has: that is depth-first
order, and each conversation's new turns are one run of the emitted sequence.
Position ids go on from the parent's.  A node attends to its own run up to
itself and to the ends of earlier runs in which its other ancestors lie, so
attention takes one interval for each branching above it, not for each turn.
Ranks and places come from range-partitioned sorts with running totals, so a
tree that many conversations share is spread over tasks like any other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import spread_join, with_fields, written

START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are learnt.
LEARNT = "assistant"
#: Stands for a missing conversation id inside the operator.
_NO_ID = -(1 << 62)


def unescape(text: Column) -> Column:
    """Texts as they were before ``_formatted`` took every ``<|`` out of them."""
    return F.regexp_replace(text, r"\\(\\|\|)", "$1")


def _unescape_role(role: Column) -> Column:
    mark = "<|"  # never in escaped text
    return F.replace(F.regexp_replace(F.replace(F.replace(role, F.lit("\\\\"), F.lit(mark)), F.lit("\\n"), F.lit("\n")), r"\\\|", "|"), F.lit(mark), F.lit("\\"))


def conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: ``conv_id`` and its ``turns`` (role, text) in order.

    Null roles and texts are empty; equal turn numbers are ordered by role and
    text; rows without ``conv_id`` are one conversation.  Other columns are
    left out; no rows give no conversations.
    """
    own = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(own)), lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    return rows.groupBy(F.col(conv_id).cast("long").alias("conv_id")).agg(turns.alias("turns"))


def with_paths(convs: DataFrame) -> DataFrame:
    """Conversations with ``path``, the 128-bit key of each beginning (a hash of the parent's key, the role and the text), and ``sizes``, the code points of each turn in the template."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128

        for batch in batches:
            paths, sizes = [], []
            for turns in batch.column("turns").to_pylist():
                key, own, long = b"", [], []
                for t in turns:
                    role, text = t["role"].encode(), t["text"].encode()
                    h = xxh3_128(key)
                    h.update(len(role).to_bytes(8, "little") + role + text)
                    key = h.digest()
                    own.append(key)
                    long.append(sum(map(len, _formatted(t["role"], t["text"]))))
                paths.append(own)
                sizes.append(long)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64()))], names=[*batch.schema.names, "path", "sizes"])

    return convs.mapInArrow(chain, with_fields(convs, "path array<binary>, sizes array<long>"))


def _formatted(role: str, text: str) -> tuple[str, str, str]:
    """A turn in the template: what stands before its text, the text, and what stands after it."""
    escaped = lambda x: x.replace("\\", "\\\\").replace("<|", "<\\|")
    return START + escaped(role).replace("\n", "\\n") + "\n", escaped(text), END + "\n"


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over all rows that come before in ``order`` (unique values).

    A range-partitioned sort sums inside each partition; the partitions' sums,
    one row each, give the offsets.
    """
    ordered = df.repartitionByRange(order).sortWithinPartitions(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = np.asarray(batch.column(value))
            before = total + np.cumsum(own) - own
            total += int(own.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part, dtype=np.int32)), pa.array(before.astype(np.int64))], names=[*batch.schema.names, "_part", "_before"])

    placed = written(ordered.mapInArrow(run, with_fields(ordered, "_part int, _before long")), "totals")
    offsets, total = [], 0
    for part, amount in sorted(tuple(r) for r in placed.groupBy("_part").agg(F.sum(value)).collect()):  # a row for each partition
        offsets.append((part, total))
        total += amount
    base = placed.sparkSession.createDataFrame(offsets, "_part int, _base long")
    return placed.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_before")).drop("_part", "_before", "_base")


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The new turns of each conversation as segments with their places."""
    for batch in batches:
        rows = []
        for tree, path, turns, sizes, shared, run_start, above in zip(*(batch.column(c).to_pylist() for c in ("tree", "path", "turns", "sizes", "shared", "run_start", "above"))):
            position, at = sum(sizes[:shared]), run_start
            for depth in range(shared, len(path)):
                head, body, tail = _formatted(turns[depth]["role"], turns[depth]["text"])
                end, loss = at + sizes[depth], at + len(head)
                rows.append((path[depth], tree, depth + 1, turns[depth]["role"], head + body + tail, at, end, position, [*above, {"start": run_start, "end": end}], loss, loss + (len(body) if turns[depth]["role"] == LEARNT else 0)))
                position, at = position + sizes[depth], end
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), span, pa.int64(), pa.int64())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows), kinds)], names=["node", "tree", "depth", "role", "segment", "start", "end", "position", "attends", "loss_start", "loss_end"])


_NODES = "node binary, tree binary, depth int, role string, segment string, start long, end long, position long, attends array<struct<start: long, end: long>>, loss_start long, loss_end long"


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the run of each node begins and the node itself ends in its tree's emitted sequence."""
    for batch in batches:
        nodes, starts, ends = [], [], []
        for path, sizes, shared, run_start in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "shared", "run_start"))):
            nodes += path[shared:]
            starts += [run_start] * (len(path) - shared)
            ends += (run_start + np.cumsum(sizes[shared:])).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["node", "from", "to"])


def prefix_forest(paths: DataFrame) -> DataFrame:
    """Every node once, with its place.

    ``node``, ``tree`` (its root's key), ``depth``, ``role``, ``segment``
    (formatted text), ``start`` and ``end`` in the tree's emitted sequence
    (code points), ``position`` (id of its first code point; the rest count
    on), ``attends`` (intervals of the sequence that its ancestors and itself
    take up) and ``loss_start``, ``loss_end`` (learnt code points, equal if
    none).  Places are worked out from keys and sizes alone; texts travel
    once, to the conversation that emits them.  No conversations, no nodes.
    """
    own = F.coalesce("conv_id", F.lit(_NO_ID))
    # conversations that say the same are one
    one = written(paths.groupBy(F.element_at("path", -1).alias("leaf")).agg(F.min(own).alias("id"), F.min_by(F.struct("path", "sizes"), own).alias("p")).select("id", "p.path", "p.sizes", F.lit(1).alias("one")), "distinct")
    ranked = written(running_total(one, "path", "one", "rank").drop("one"), "ranked")

    each = ranked.select("rank", F.posexplode("path").alias("depth", "node"))
    owner = each.groupBy("node").agg(F.min("rank").alias("owner"), F.count("*").alias("n"))
    total = ranked.agg(F.coalesce(F.sum(F.size("path")), F.lit(0))).first()[0]
    owned = written(spread_join(each, owner, ["node"], "n", total), "owned")
    new = owned.where("owner = rank").groupBy("rank").agg(F.min("depth").alias("shared"))
    # the last turn of each earlier run on a path
    ends = written(owned.where("owner <> rank").groupBy("rank", "owner").agg(F.max(F.struct("depth", "node")).alias("e")).select("rank", "e.node"), "ends")

    runs = ranked.join(new, "rank").withColumn("tree", F.element_at("path", 1))
    runs = runs.withColumn("length", F.aggregate(F.slice("sizes", F.col("shared") + 1, F.size("sizes")), F.lit(0).cast("long"), lambda a, x: a + x))
    placed = written(running_total(runs, "rank", "length", "at"), "places")
    roots = placed.groupBy("tree").agg(F.min("at").alias("tree_at"), F.count("*").alias("n"))
    placed = written(spread_join(placed, roots, ["tree"], "n", placed.count()).select("id", "rank", "tree", "shared", "path", "sizes", (F.col("at") - F.col("tree_at")).alias("run_start")), "runs")

    spot = placed.select("path", "sizes", "shared", "run_start").mapInArrow(_spots, "node binary, from long, to long").join(ends.groupBy("node").agg(F.count("*").alias("n")), "node")
    above = spread_join(ends, spot, ["node"], "n", ends.count()).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct(F.col("from").alias("start"), F.col("to").alias("end")))).alias("above"))
    out = placed.join(above, "rank", "left").select("id", "tree", "shared", "run_start", F.coalesce("above", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("above"))
    return paths.withColumn("id", own).join(out, "id").mapInArrow(_emit, _NODES)


def read_back(paths: DataFrame, forest: DataFrame) -> DataFrame:
    """Conversations as the forest holds them: ``conv_id``, ``turns`` (role, text, learnt, length in the template), in order.

    Everything is taken from the emitted segments; conversations give only
    their id and the keys of their path.
    """
    each = paths.select("conv_id", F.posexplode("path").alias("k", "node"))
    total = paths.agg(F.coalesce(F.sum(F.size("path")), F.lit(0))).first()[0]
    parts = forest.select("node", "segment", (F.col("loss_start") - F.col("start")).cast("int").alias("from"), (F.col("loss_end") - F.col("loss_start")).cast("int").alias("long"))
    parts = parts.join(each.groupBy("node").agg(F.count("*").alias("n")), "node")
    turns = spread_join(each, parts, ["node"], "n", total).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "segment", "from", "long"))).alias("turns"))

    def turn(t: Column) -> Column:
        mark = F.regexp_extract(t["segment"], r"(?s)^<\|im_start\|>([^\n]*)\n", 1)
        head = F.char_length(mark) + len(START) + 1
        body = F.substr(t["segment"], head + 1, F.char_length(t["segment"]) - head - len(END) - 1)
        learnt = F.when(t["long"] > 0, F.substr(t["segment"], t["from"] + 1, t["long"])).otherwise(F.lit(""))
        return F.struct(_unescape_role(mark).alias("role"), unescape(body).alias("text"), unescape(learnt).alias("learnt"), F.char_length(t["segment"]).alias("length"))

    return turns.select("conv_id", F.transform("turns", turn).alias("turns"))


def report(back: DataFrame) -> DataFrame:
    """What the query reports of each conversation."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learnt = F.array_join(F.transform("turns", lambda t: t.learnt), "")
    length = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["length"])
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), length.alias("formatted_chars"))
