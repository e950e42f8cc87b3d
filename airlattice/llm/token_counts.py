"""Token counts by an exact histogram of encoded lengths.

Documents are encoded and only their length is kept; documents are counted by length, and suffix
sums over the lengths answer totals, quantiles and truncated totals for every context limit.

Cases: a null or empty text has length 0 (plus the end token, if one is counted); repeated rows
count each; documents without an id count like others; an empty table gives no rows.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airlattice.llm.common import arrow_rows
from airlattice.llm.encode import batch_slices, encoder, vocabulary


def lengths(docs: DataFrame, tokenizer_path: str, extra: int = 0) -> DataFrame:
    """n_tokens of each row: ids of the whole text, and ``extra`` end tokens."""
    words = vocabulary(docs.sparkSession, tokenizer_path)

    def make():
        own = encoder(words)

        def step(batch):
            found = []
            for part in batch_slices(batch):
                texts = part.column("text").to_pylist()
                found += [len(ids) // 4 + extra for ids in own.encode([t or "" for t in texts])]
            return {"n_tokens": pa.array(found, pa.int64())}

        return step

    return arrow_rows(docs.select(F.col("text").cast("string").alias("text")), "n_tokens long", make)


def histogram(lengths: DataFrame) -> DataFrame:
    """One row per length: documents of it, and for the length taken as context limit

    docs_longer (documents that it would cut), total_tokens (of all documents), kept_tokens (with
    every document truncated at it), cut_tokens, and share (documents of at most this length).

    The histogram has one row per distinct length, so its running sums need no more than one task:
    its size is bounded by the longest document, not by the number of documents.
    """
    counts = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    at_most = W.orderBy("n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    longer = W.orderBy("n_tokens").rowsBetween(1, W.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("n_docs")
    summed = counts.select(
        "n_tokens",
        "n_docs",
        F.coalesce(F.sum("n_docs").over(longer), F.lit(0)).alias("docs_longer"),
        F.coalesce(F.sum(tokens).over(longer), F.lit(0)).alias("tokens_longer"),
        F.sum(tokens).over(at_most).alias("tokens_at_most"),
        F.sum("n_docs").over(at_most).alias("docs_at_most"),
    )
    kept = F.col("tokens_at_most") + F.col("docs_longer") * F.col("n_tokens")
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_longer",
        (F.col("tokens_at_most") + F.col("tokens_longer")).alias("total_tokens"),
        kept.alias("kept_tokens"),
        (F.col("tokens_at_most") + F.col("tokens_longer") - kept).alias("cut_tokens"),
        (F.col("docs_at_most") / (F.col("docs_at_most") + F.col("docs_longer"))).alias("share"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """max_tokens, n_docs_cut, kept_tokens for any context limits, from the histogram alone."""
    spark = hist.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "max_tokens long")
    capped = hist.crossJoin(F.broadcast(wanted))
    return capped.groupBy("max_tokens").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("max_tokens"), F.col("n_docs")).otherwise(0)).alias("n_docs_cut"),
        F.sum(F.least("n_tokens", "max_tokens") * F.col("n_docs")).alias("kept_tokens"),
    )


def quantile(hist: DataFrame, share: float) -> DataFrame:
    """n_tokens: the least length that at least ``share`` of the documents do not exceed."""
    return hist.where(F.col("share") >= share).agg(F.min("n_tokens").alias("n_tokens"))
