"""A part of the corpus drawn to look like a target: importance resampling on hashed word features.

Texts are written once as arrays of feature buckets. Bucket counts of corpus and target give a gain
per bucket, and a document's weight is the mean gain of its features, looked up in that array. With a
fixed random number per document added, the highest scores are a draw without replacement. No sort of
all rows finds them: the cutoff is closed in on by counting the persisted rows above some values,
again and again, first by score, then among its ties by id, and only rows above it are ranked, by
ranges.

Cases: a null or empty text has no features and weight 0; a row without an id has the number of an
empty id and comes after all ids; of rows with one score and id those with more features come first,
and rows alike in that too are drawn in any order, each with a rank of its own; an empty table gives
no rows, an empty target counts as one without features; extra columns are not looked at.
"""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.llm.common import arrow_rows, byte_texts, stage
from airlattice.llm.numbering import running_total

# Letters and digits of ASCII after lower-casing, and every byte of other characters.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS = 10_000
MIN_WORDS = 20
SHARE = (10, 100)
SEED = 2024
# Words whose bucket a worker keeps; values whose counts one job takes.
KEPT_WORDS = 500_000
WAYS = 16
LEAST = -(1 << 63)


class _Buckets(dict):
    """Feature to bucket; a feature is looked up far more often than it is new."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features(text: bytes, longest: int = 1) -> list[bytes]:
    """All runs of 1 to ``longest`` words, joined by a space."""
    words = WORDS.findall(text.lower())
    runs = words
    for size in range(2, longest + 1):
        runs = runs + [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    return runs


def bucketed(docs: DataFrame, key: str, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """key, n_words, features: the bucket of every feature, 32 bits each."""

    def make():
        known = _Buckets(buckets)

        def step(batch):
            rows, words = [], []
            for text in byte_texts(batch.column("text")):
                found = features(text, longest)
                rows.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)).tobytes())
                # runs of 1 to k of n words are n + (n - 1) + ... of them
                words.append(len(found) if longest == 1 else len(WORDS.findall(text.lower())))
            return {"key": batch.column("key"), "n_words": pa.array(words, pa.int64()), "features": pa.array(rows, pa.binary())}

        return step

    columns = docs.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    return arrow_rows(columns, "key long, n_words long, features binary", make)


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows: each task counts its own, the tasks' counts are added."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for cell in batch.column("features"):
                total += np.bincount(np.frombuffer(cell.as_buffer(), np.uint32), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    counted = rows.select("features").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(buckets, np.int64)
    for row in counted.collect():  # at most one row per bucket
        found[row["bucket"]] = row["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's share of a bucket and the corpus's, smoothed by one."""
    size, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(float((t + 1) * (all_source + size)) / float((s + 1) * (all_target + size))))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, n_words, n_features, weight: the floored mean gain. The gains are an array of fixed size."""
    table = rows.sparkSession.sparkContext.broadcast(gain)

    def make():
        gain = table.value

        def step(batch):
            sizes, means = [], []
            for cell in batch.column("features"):
                found = np.frombuffer(cell.as_buffer(), np.uint32)
                sizes.append(len(found))
                means.append(int(gain[found].sum()) // len(found) if len(found) else 0)
            return {
                "key": batch.column("key"), "n_words": batch.column("n_words"),
                "n_features": pa.array(sizes, pa.int64()), "weight": pa.array(means, pa.int64()),
            }

        return step

    return arrow_rows(rows, "key long, n_words long, n_features long, weight long", make)


def chance(key: Column, seed: int = SEED) -> Column:
    """A fixed standard Gumbel number per document, in thousandths: the highest of weight and chance
    are a draw in proportion to exp(weight), without replacement."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    number = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((number + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _better(order: list[str], cut: tuple) -> Column:
    """Rows before or at ``cut``, a value of each column of a descending order."""
    here = F.col(order[-1]) >= cut[-1]
    for name, value in zip(reversed(order[:-1]), reversed(cut[:-1])):
        here = (F.col(name) > value) | ((F.col(name) == value) & here)
    return here


def cutoff(rows: DataFrame, order: list[str], wanted: int, ways: int = WAYS) -> tuple | None:
    """The values of whole-number columns ``order`` (each descending, together unique) at which just
    ``wanted`` rows are before or at the cut; None if no row is wanted.

    Column by column: the greatest value that leaves at least as many rows as are still wanted, closed
    in on by jobs that each count the rows at or above ``ways`` values between the bounds. Rows above
    it are in; among its ties the next column decides.
    """
    found, missing = [], wanted
    if wanted <= 0:
        return None
    for name in order:
        low, high, reached = rows.agg(F.min(name), F.max(name), F.count(F.lit(1))).first()
        # At or above low there are ``reached`` rows, enough of them; above high there are ``above``, too few.
        above = 0
        while low < high:
            steps = sorted({low + (high - low) * i // ways for i in range(1, ways + 1)} - {low})
            counts = rows.agg(*[F.count_if(F.col(name) >= v) for v in steps]).first()
            for value, n in zip(steps, counts):
                if n >= missing:
                    low, reached = value, n
                elif value <= high:
                    high, above = value - 1, n
        found.append(low)
        if reached == missing:
            return (*found, *[LEAST] * (len(order) - len(found)))
        missing -= above
        rows = rows.where(F.col(name) == low)
    return tuple(found)


def draw(scored: DataFrame, wanted: int, eligible: Column) -> DataFrame:
    """``scored`` (key, n_features, score and others) with rank: 1, 2, 3... by score for the ``wanted``
    highest eligible rows, null for all others."""
    rows = scored.withColumns(
        {
            "by_id": F.when(F.col("key").isNull(), F.lit(LEAST).cast("long")).otherwise(-1 - F.col("key")),
            "by_row": F.monotonically_increasing_id(),
            "eligible": F.coalesce(eligible, F.lit(False)),
        }
    )
    rows = stage(rows, "scores")
    order = ["score", "by_id", "n_features", "by_row"]
    cut = cutoff(rows.where("eligible"), order, wanted)
    chosen = F.col("eligible") & (_better(order, cut) if cut else F.lit(False))
    drawn = running_total(rows.where(chosen), [F.col(c).desc() for c in order], F.lit(1), "before")
    drawn = drawn.select(*scored.columns, (F.col("before") + 1).alias("rank"))
    return drawn.unionByName(rows.where(~chosen).select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resampled(
    docs: DataFrame, target: DataFrame, target_key: str = "item_id", buckets: int = BUCKETS, longest: int = 1,
    min_words: int = MIN_WORDS, share=SHARE, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank: the share of the documents with at least ``min_words``
    words that is drawn towards ``target`` has ranks."""
    rows = stage(bucketed(docs, "doc_id", buckets, longest), "features")
    aims = bucketed(target, target_key, buckets, longest)
    weighted = weights(rows, gains(bucket_counts(rows, buckets), bucket_counts(aims, buckets)))
    scored = weighted.withColumn("score", F.col("weight") + chance(F.col("key"), seed))
    long_enough = rows.where(F.col("n_words") >= min_words).count()
    found = draw(scored, share[0] * long_enough // share[1], F.col("n_words") >= min_words)
    return found.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")
