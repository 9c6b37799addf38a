"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

Every stage works on all that its predecessor kept, and all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.llm import bpe, decontaminate, lines, minhash, quality
from delaylens.llm.queries import RANK_FILE, trusted_ids
from delaylens.llm.shared import table, written

#: Link documents when 100 * common >= NEAR_PERCENT * all shingles of the two.
NEAR_PERCENT = 80
#: So many bands of six miss a pair just at NEAR_PERCENT with 5e-7.
NEAR_BANDS = 48


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less likely than nearly all trusted ones of their language go."""
    return quality.drop_low_quality(docs, trusted_ids(spark, sf_dir))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; no document goes, ``n_chars`` follows the text."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    deduped = lines.dedup_lines(rows, lines.LineIndex.build(docs))
    length = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("_row.n_chars"))
    new = {"text": F.col("text"), "n_chars": length}
    return deduped.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (similarity 0.8 or more) the document with the smallest id stays."""
    return minhash.drop_near_duplicates(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ``token_ids``, their number, and the digest of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return coded.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicate removal", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", token_stage),
]

#: SQL cannot express the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
