"""Token counts as an exact histogram of encoded lengths.

Documents are encoded once and aggregated by their length; the histogram is small and grows with the number of different
lengths only. Suffix sums over it (made bucket by bucket, then joined by the buckets' own sums) answer totals, quantiles and
truncated totals for every context limit.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tables import saved

#: Fixed value: how the byte-level vocabulary cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths whose suffix sums are made in one group.
BUCKET = 1024


def load_ranks(spark: SparkSession, path: str):
    """The vocabulary (lines of a base64 token and its rank) of a fixed size, broadcast; read by the driver."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _lengths(ranks):
    """(text) rows to (n_tokens, n_docs), added up in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        for batch in batches:
            count = Counter(len(encoding.encode_ordinary(x)) if x else 0 for x in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.int64()), pa.array(count.values(), pa.int64())], ["n_tokens", "n_docs"])

    return run


def length_histogram(docs: DataFrame, ranks, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many rows encode to each length; written once, so that texts are encoded once however often it is read.

    Null and empty texts have length 0; repeated rows count; other columns are ignored; an empty table gives an empty histogram."""
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_lengths(ranks), "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    return saved(counts)


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """(n_tokens, n_docs, docs_from, tokens_from): rows of at least this length, and their tokens."""
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BUCKET).alias("bucket"))
    after = W.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    whole = h.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    whole = whole.select("bucket", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t"))
    own = W.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    return h.join(whole, "bucket").select(
        "n_tokens", "n_docs", (F.sum("n_docs").over(own) + F.col("d")).alias("docs_from"), (F.sum("tokens").over(own) + F.col("t")).alias("tokens_from")
    )


def context_answers(sums: DataFrame) -> DataFrame:
    """For each length as a context limit: rows that fit and tokens in them, tokens left when longer rows are cut to the limit, and
    the share of rows that fit (so that the least length of a share q or more is the q-quantile)."""
    total = sums.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("all_tokens"))
    longer, above = F.col("docs_from") - F.col("n_docs"), F.col("tokens_from") - F.col("n_docs") * F.col("n_tokens")
    return sums.crossJoin(F.broadcast(total)).select(  # one row
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("all_docs") - longer).alias("docs_within"),
        (F.col("all_tokens") - above).alias("tokens_within"),
        (F.col("all_tokens") - above + longer * F.col("n_tokens")).alias("tokens_truncated"),
        ((F.col("all_docs") - longer) / F.col("all_docs")).alias("share_within"),
    )


def quantile(answers: DataFrame, q: float) -> DataFrame:
    """One row, n_tokens: the least length that a share q of the rows does not exceed; null for an empty histogram."""
    return answers.filter(F.col("share_within") >= q - 1e-12).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row, tokens: of all rows, each cut to `limit` tokens, for any limit."""
    return sums.agg(F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens"))
