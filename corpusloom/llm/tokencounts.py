"""Exact token counts by the histogram of encoded lengths.

Every text is encoded in whole with a public byte-level BPE vocabulary; documents are grouped by encoded length, and
suffix sums over that small table give totals, quantiles and what is left of the corpus at every context limit.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Where the public vocabulary files are, and which one counts.
TOKENIZERS, VOCABULARY = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken"
#: How byte-level BPE vocabularies of this kind cut a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Number of tokens of a whole text."""

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
        self.encode = encoder(folder, vocabulary).encode_ordinary

    def __call__(self, text: str | None) -> int:
        return len(self.encode(text)) if text else 0


def token_lengths(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for every row; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(folder, vocabulary)
        for batch in batches:
            n = [count(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    common.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")


def length_histogram(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length. Partial counts are summed before the shuffle."""
    return token_lengths(docs, folder, vocabulary).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


#: Lengths of a block of the two-level prefix sum.
_BLOCK = 1024


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each occurring length: documents and tokens at least that long, the share of documents not longer, and the corpus's tokens if every text were cut to that length.

    Sums are taken within blocks of lengths and over the few block totals, so that no single task sorts all lengths.
    """
    h = common.materialise(histogram, "length-histogram").withColumn("block", F.floor(F.col("n_tokens") / _BLOCK))
    w = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    inner = h.withColumn("docs_in", F.sum("n_docs").over(w)).withColumn("tokens_in", F.sum(F.col("n_docs") * F.col("n_tokens")).over(w))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("bt"))
    up = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = blocks.select("block", F.coalesce(F.sum("bd").over(up), F.lit(0)).alias("da"), F.coalesce(F.sum("bt").over(up), F.lit(0)).alias("ta"), F.sum("bd").over(whole).alias("all_docs"), F.sum("bt").over(whole).alias("all_tokens"))
    joined = inner.join(totals, "block")
    docs_at_least, tokens_at_least = F.col("docs_in") + F.col("da"), F.col("tokens_in") + F.col("ta")
    return joined.select(
        "n_tokens", "n_docs",
        docs_at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        (F.col("all_docs") - docs_at_least + F.col("n_docs")).alias("docs_at_most"),
        ((F.col("all_docs") - docs_at_least + F.col("n_docs")) / F.col("all_docs")).alias("share_at_most"),
        (F.col("all_tokens") - tokens_at_least + docs_at_least * F.col("n_tokens")).alias("tokens_if_cut_here"),
        F.col("all_tokens").alias("tokens_total"),
    )


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that at least a share q of the documents doesn't exceed; None for an empty table."""
    row = sums.filter(F.col("share_at_most") >= q - 1e-12).agg(F.min("n_tokens").alias("n")).first()
    return row.n


def tokens_if_cut(sums: DataFrame, limit: int) -> int:
    """Tokens of the corpus if every text is cut to `limit` tokens, for any limit."""
    total = F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(limit)))
    return sums.agg(total.alias("n")).first().n or 0


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """with_suffix_sums() of the documents' encoded lengths.

    Every row counts: null and empty texts with length 0, repeated rows each for itself, ids of any kind. Ties share a
    row. Further columns are ignored. An empty table gives no row.
    """
    return with_suffix_sums(length_histogram(docs, folder, vocabulary))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE: dict[str, str] = {}
