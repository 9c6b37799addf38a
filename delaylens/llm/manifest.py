"""A Merkle manifest of a dataset: a tree of each source's rows, and one over the sources.

Time-forward processing: nodes are labelled by level and place, every digest
is sent to its parent's label, and parents are worked off in order of label.
A task does so for a subtree of ``FAN ** HEIGHT`` nodes with a priority queue;
between subtrees Spark's sorted shuffle is the queue, which spills to disk, so
no source, however large, is held by one task.  A reversed sweep hands each
node the siblings on its way to the root, down to the leaves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import numbered, shards_for, written

#: Children of a node.
FAN = 16
#: Levels that one sweep settles inside a task.
HEIGHT = 2
SPAN = FAN**HEIGHT

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as it is hashed: its UTF-8 byte count, a colon and itself; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def depth(n: int) -> int:
    """Levels above ``n`` leaves."""
    d = 0
    while n > 1:
        n, d = -(-n // FAN), d + 1
    return d


def _up(nodes: list[str], levels: int) -> tuple[list[str], dict[tuple[int, int], str]]:
    """Digests of the nodes ``levels`` above a subtree's ``nodes``, and every digest by label (level, place)."""
    queue = [((0, k), k, digest) for k, digest in enumerate(nodes)]  # label, child, digest; in order, so a heap
    done: dict[tuple[int, int], str] = {}
    while queue:
        (level, k), _, digest = heappop(queue)
        parts = [digest]
        while queue and queue[0][0] == (level, k):
            parts.append(heappop(queue)[2])
        done[level, k] = own = digest if level == 0 else sha256("".join(parts).encode()).hexdigest()
        if level < levels:
            heappush(queue, ((level + 1, k // FAN), k, own))
    return [d for (level, _), d in sorted(done.items()) if level == levels], done


def _down(nodes: list[str], levels: int, suffix: str) -> list[str]:
    """For each node of a subtree the digests beside its way up, own level first, then ``suffix``."""
    _, done = _up(nodes, levels)
    queue = [((-level, -k), suffix) for level, k in done if level == levels]
    queue.sort()
    out = [""] * len(nodes)
    while queue:
        (level, k), above = heappop(queue)
        level, k = -level, -k
        if level == 0:
            out[k] = above
            continue
        children = [c for c in range(k * FAN, k * FAN + FAN) if (level - 1, c) in done]
        for c in children:
            beside = "".join(done[level - 1, x] for x in children if x != c)
            heappush(queue, ((1 - level, -c), beside + above))
    return out


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one subtree after another, from rows sorted by tree, chunk and position."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["chunk"]) != (held[0]["tree"], held[0]["chunk"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _dealt(nodes: DataFrame, parts: int) -> DataFrame:
    """Every subtree whole in one partition, in order of label."""
    return nodes.repartition(parts, "tree", "chunk").sortWithinPartitions("tree", "chunk", "position")


def _chunk() -> Column:
    return F.floor(F.col("position") / SPAN).cast("long")


_NODE = "tree string, position long, n long, digest string"


def sweep_up(nodes: DataFrame, parts: int) -> DataFrame:
    """From the nodes of a level (``tree``, ``position``, ``n`` of the tree, ``digest``) those ``HEIGHT`` levels above, or a tree's root."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for own in _subtrees(batches):
            n = own[0]["n"]
            (top,), _ = _up([r["digest"] for r in own], min(HEIGHT, depth(n)))
            rows.append((own[0]["tree"], own[0]["chunk"], -(-n // SPAN), top))
            if len(rows) >= 1000:
                yield _batch(rows, _NODE)
                rows = []
        if rows:
            yield _batch(rows, _NODE)

    return _dealt(nodes.select("tree", "position", "n", "digest", _chunk().alias("chunk")), parts).mapInArrow(sweep, _NODE)


_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in ddl.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(x, _KINDS[k]) for x, k in zip(zip(*rows), kinds)], names=list(names))


def tree_levels(nodes: DataFrame, parts: int, name: str) -> list[DataFrame]:
    """The nodes given and, after each upward sweep, what is above them; in the last every tree is its root."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [nodes]
    while most > 1:
        out.append(written(sweep_up(out[-1], parts), name))
        most = -(-most // SPAN)
    return out


_WAY = "tree string, position long, suffix string"


def sweep_down(nodes: DataFrame, above: DataFrame, parts: int) -> DataFrame:
    """``suffix`` of each of ``nodes`` from the suffixes ``above`` (``tree``, ``position`` of the chunk, ``suffix``)."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, *own in _subtrees(batches):
            n = own[0]["n"]
            ways = _down([r["digest"] for r in own], min(HEIGHT, depth(n)), top["suffix"])
            yield _batch([(r["tree"], r["position"], w) for r, w in zip(own, ways)], _WAY)

    return _dealt(_with_tops(nodes, above), parts).mapInArrow(sweep, _WAY)


def _with_tops(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes and, before each subtree, the row of what is above it (position -1)."""
    own = nodes.withColumn("chunk", _chunk())
    tops = above.withColumn("chunk", F.col("position")).withColumn("position", F.lit(-1).cast("long"))
    return own.unionByName(tops, allowMissingColumns=True)


def fold(leaf: str, proof: str, places: Sequence[tuple[int, int]]) -> str:
    """The root that a leaf and the digests beside its way give; ``places`` are (position, n) of the trees passed, from the leaf up."""
    own, at = leaf, 0
    for position, n in places:
        while n > 1:
            k, size = position % FAN, min(FAN, n - position // FAN * FAN)
            beside = proof[at : at + 64 * (size - 1)]
            at += 64 * (size - 1)
            own = sha256((beside[: 64 * k] + own + beside[64 * k :]).encode()).hexdigest()
            position, n = position // FAN, -(-n // FAN)
    return own


_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """For each row its leaf, its source's root, the dataset's root, the digest of its proof, and what tampering does to it.

    A row is tampered with where five divides the CRC of its id: its text's
    A-Z are lower-cased.  ``folded_root`` is worked out from the (tampered)
    leaf and the stored siblings.  Rows of a source are in order of id, nulls
    first, equal ids by leaf; rows that repeat exactly are leaves each.  A row
    without an id is not tampered with; a null source is a source, the first.
    An empty table gives no rows.  Only ``columns`` are read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), leaf_digest([F.col(c) for c in columns]).alias("digest"), leaf_digest([F.translate(text, _UPPER, _LOWER) if c == text else F.col(c) for c in columns]).alias("lowered"))
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))  # a null source sorts before all others
    leaves = rows.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), "digest", F.when(hit, F.col("lowered")).otherwise(F.col("digest")).alias("tampered"))
    spark = docs.sparkSession
    leaves = written(leaves, "leaves")
    parts = shards_for(spark, 200 * leaves.count(), 64 << 20)
    own = written(numbered(leaves, ["tree"], ["doc_id", "digest"], parts, "leaves-in-order"), "numbered-leaves")
    levels = tree_levels(own.select("tree", "position", "n", "digest"), parts, "nodes")
    # the roots of the sources are the leaves of the last tree
    subroots = levels[-1].select(F.col("tree").alias("source"), "digest")
    sources = written(numbered(subroots, [], ["source"], parts, "sources"), "numbered-sources")
    top = tree_levels(sources.select(F.lit("").alias("tree"), "position", "n", "digest"), parts, "top-nodes")
    root = top[-1].select(F.col("digest").alias("root"))
    ways = top[-1].select("tree", F.lit(0).cast("long").alias("position"), F.lit("").alias("suffix"))
    for nodes in reversed(top[:-1]):
        ways = sweep_down(nodes, ways, parts)
    tops = ways.withColumnRenamed("position", "place").select("place", "suffix").join(sources.select(F.col("source").alias("tree"), F.col("position").alias("place"), F.col("n").alias("sources"), F.col("digest").alias("subroot")), "place").join(F.broadcast(root))  # one row
    tops = written(tops, "tops")
    ways = tops.select("tree", F.lit(0).cast("long").alias("position"), "suffix")
    for nodes in reversed(levels[1:-1]):
        ways = sweep_down(nodes, ways, parts)
    known = ways.join(tops.drop("suffix"), "tree")
    return _verified(own, known, parts)


def _verified(own: DataFrame, known: DataFrame, parts: int) -> DataFrame:
    """The last downward sweep: leaves get their proofs, which are hashed and folded at once and never stored."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, *leaves in _subtrees(batches):
            n, root = leaves[0]["n"], top["root"]
            proofs = _down([r["digest"] for r in leaves], min(HEIGHT, depth(n)), top["suffix"])
            out = []
            for r, proof in zip(leaves, proofs):
                folded = fold(r["tampered"], proof, ((r["position"], n), (top["place"], top["sources"])))
                out.append((r["doc_id"], r["digest"], top["subroot"], root, sha256(proof.encode()).hexdigest(), folded, folded == root))
            yield _batch(out, _RESULT)

    return _dealt(_with_tops(own, known), parts).mapInArrow(sweep, _RESULT)
