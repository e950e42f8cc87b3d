"""Quality rules by robust multivariate outliers.

Each text is counted (words, symbols, repeated lines and windows), the counts are transformed to a
vector, and for each language and source a minimum-covariance-determinant estimate of centre and
spread is found: from a robust start, concentration steps keep the half of the group's documents
nearest to the estimate and estimate again from them. Documents at a large Mahalanobis distance
from their group's estimate are rejected, and so are those that fail the base rules.

Every step covers all documents: a step is an aggregate of sums per group, and the half is found
from counts per group and distance bin, so a group with a third of all rows is pre-aggregated like
any other and nothing is gathered. Groups of few documents borrow the estimate of their language,
or of all documents.

Cases: a null text has no words and fails the base; null language or source is a group of its own;
rows without an id are judged; repeated rows are judged each and count each; an empty table gives
no rows. A group whose documents are all alike keeps them: spreads have a floor.
"""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airlattice.llm.common import return_memory, stage, whole_row

WORD = re.compile(r"[^ \t-\r]+")
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

FEATURES = 5
# Share of a group that the estimate rests on: up to the rest of it may be junk. CONSISTENCY makes the
# spread of the nearest half that of the whole for normal vectors: HALF / P(chi-square(7) <= median of
# chi-square(5)). Steps, and documents that a group needs of its own.
HALF, CONSISTENCY = 0.5, 1.9122
STEPS = 6
MIN_GROUP = 200
# Least spread per feature (standard deviations on the transformed scale): text lengths and word
# lengths may differ that much, and a few symbols or repeated lines are no fault.
FLOORS = (0.5, 0.15, 0.35, 0.35, 0.45)
# Squared distance beyond which a document is rejected: twice the 1 - 1e-6 quantile of chi-square
# with five degrees of freedom, as transformed counts have heavier tails than normal ones.
REJECT = 60.0
# Distance bins: logarithmic, so that the half is found to within 2 % of the squared distance.
BINS_PER_E = 50


def counts_of(text: str | None) -> tuple:
    """COUNTS of a text; n_repeat_words counts words in windows of three that occur twice or more."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = WORD.findall(text)
    n = len(words)
    seen, repeated, lines = set(), 0, 0
    for line in text.split("\n"):
        if line and WORD.search(line):
            lines += 1
            if line in seen:
                repeated += 1
            seen.add(line)
    in_windows = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:]))
        often = Counter(windows)
        if len(often) < len(windows):
            covered = 0  # words before this place are counted already
            for i, window in enumerate(windows):
                if often[window] > 1:
                    in_windows += i + 3 - max(i, covered)
                    covered = i + 3
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated, in_windows, lines


def counts(text: Column) -> Column:
    """The COUNTS of a text as a struct."""
    schema = ", ".join(f"{name} long" for name in COUNTS)

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        return_memory()
        return pd.DataFrame([counts_of(t) for t in texts], columns=list(COUNTS), dtype="int64")

    return run(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def features(prefix: str = "") -> Column:
    """Transformed counts: length, word length, and shares of symbols, lines and windows on a log scale
    that is flat near zero."""
    n_words, chars, symbols, lines, repeats, all_lines = (F.col(prefix + name).cast("double") for name in COUNTS)
    words = F.greatest(n_words, F.lit(1.0))
    return F.array(
        F.log(words),
        F.log((chars + 1.0) / words),
        F.log1p(100.0 * symbols / words),
        F.log1p(10.0 * lines / F.greatest(all_lines, F.lit(1.0))),
        F.log1p(10.0 * repeats / words),
    )


# --- estimates ------------------------------------------------------------------------------


def _sums(x: str = "x") -> list[Column]:
    """n, sums and sums of products of the features, as one array."""
    parts = [F.sum(F.element_at(x, i + 1)) for i in range(FEATURES)]
    parts += [F.sum(F.element_at(x, i + 1) * F.element_at(x, j + 1)) for i in range(FEATURES) for j in range(i, FEATURES)]
    return [F.count(F.lit(1)).alias("n"), F.array(*parts).alias("sums")]


def _estimates(sums: DataFrame) -> DataFrame:
    """lang, source, level, n, centre and the inverse spread (row by row) from sums."""

    def run(batches):
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in ("lang", "source", "level", "n", "sums")}
            found = [_estimate(n, s) for n, s in zip(columns["n"], columns["sums"])]
            columns["centre"] = [c for c, _ in found]
            columns["inverse"] = [m for _, m in found]
            del columns["sums"]
            yield pa.RecordBatch.from_pydict(columns, schema=kinds)

    doubles = pa.list_(pa.float64())
    kinds = pa.schema(
        [("lang", pa.string()), ("source", pa.string()), ("level", pa.int32()), ("n", pa.int64()), ("centre", doubles), ("inverse", doubles)]
    )
    schema = "lang string, source string, level int, n long, centre array<double>, inverse array<double>"
    return sums.select("lang", "source", "level", "n", "sums").mapInArrow(run, schema)


def _estimate(n: int, sums: list) -> tuple:
    s = np.array(sums)
    centre = s[:FEATURES] / n
    spread = np.zeros((FEATURES, FEATURES))
    spread[np.triu_indices(FEATURES)] = s[FEATURES:] / n
    spread = spread + np.triu(spread, 1).T - np.outer(centre, centre)
    # The mean of the nearest HALF has too small a spread; the floor is added, so it is never singular.
    spread = spread * CONSISTENCY + np.diag(np.square(FLOORS))
    return centre.tolist(), np.linalg.inv(spread).ravel().tolist()


def _distance(x: str = "x", centre: str = "centre", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance."""
    d = [F.element_at(x, i + 1) - F.element_at(centre, i + 1) for i in range(FEATURES)]
    total = F.lit(0.0)
    for i in range(FEATURES):
        for j in range(FEATURES):
            total = total + d[i] * d[j] * F.element_at(inverse, FEATURES * i + j + 1)
    return F.greatest(total, F.lit(0.0))


def _levels(vectors: DataFrame) -> DataFrame:
    """Each vector for its group (level 0), its language (1) and all documents (2)."""
    return vectors.select("x", "lang", "source", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level")).select(
        "x",
        F.when(F.col("level") < 2, F.col("lang")).alias("lang"),
        F.when(F.col("level") == 0, F.col("source")).alias("source"),
        "level",
    )


def _keyed(found: DataFrame) -> DataFrame:
    """Estimates with their keys renamed, so that joins say which side they mean."""
    return found.select(*[F.col(k).alias(f"g_{k}") for k in ("lang", "source", "level")], "centre", "inverse")


def _same_group(prefix: str = "") -> Column:
    lang, source = F.col(f"{prefix}lang"), F.col(f"{prefix}source")
    return (F.col(f"{prefix}level") == F.col("g_level")) & lang.eqNullSafe(F.col("g_lang")) & source.eqNullSafe(F.col("g_source"))


def estimates(vectors: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates of ``vectors`` (lang, source, x): lang, source, level, n,
    centre, inverse."""
    rows = _levels(vectors)
    keys = ["lang", "source", "level"]
    # Start: medians, and a diagonal spread from the quartiles.
    thirds = [F.percentile_approx(F.element_at("x", i + 1), [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i in range(FEATURES)]
    start = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *thirds)
    centre = F.array(*[F.element_at(f"p{i}", 2) for i in range(FEATURES)])
    spreads = [F.pow((F.element_at(f"p{i}", 3) - F.element_at(f"p{i}", 1)) / 1.349, 2) + FLOORS[i] ** 2 for i in range(FEATURES)]
    inverse = F.array(*[1.0 / spreads[i] if i == j else F.lit(0.0) for i in range(FEATURES) for j in range(FEATURES)])
    current = stage(start.select(*keys, "n", centre.alias("centre"), inverse.alias("inverse")), "estimates")
    for _ in range(STEPS):
        current = stage(_concentrated(rows, current), "estimates")
    return current


def _concentrated(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Estimates from the nearest part of each group."""
    keys = ["lang", "source", "level"]
    placed = rows.join(_keyed(current), _same_group()).select(*keys, "x", F.floor(F.log(_distance() + 1e-12) * BINS_PER_E).cast("int").alias("bin"))
    # Sums per group and bin; the bins up to the one that holds the last of the part make the part.
    binned = placed.groupBy(*keys, "bin").agg(*_sums())
    return _estimates(_nearest_bins(binned))


def _nearest_bins(binned: DataFrame) -> DataFrame:
    """Sums of the nearest bins with at least HALF of a group's rows. A group has some thousand bins at
    most, whatever its rows."""
    group = W.partitionBy("lang", "source", "level")
    before = group.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    near = binned.withColumn("all_n", F.sum("n").over(group)).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    near = near.where(F.col("before") < F.ceil(F.col("all_n") * HALF))
    width = FEATURES + FEATURES * (FEATURES + 1) // 2
    totals = [F.sum(F.element_at("sums", i + 1)) for i in range(width)]
    return near.groupBy("lang", "source", "level").agg(F.sum("n").alias("n"), F.array(*totals).alias("sums"))


def group_estimates(vectors: DataFrame) -> DataFrame:
    """lang, source, centre, inverse for each group: its own estimate, or with fewer than MIN_GROUP rows
    that of its language, or with too few of those that of all documents."""
    found = estimates(vectors)
    sizes = vectors.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    langs = sizes.groupBy(F.col("lang").alias("l_lang")).agg(F.sum("n").alias("n_lang"))
    joined = sizes.join(langs, F.col("lang").eqNullSafe(F.col("l_lang")))
    level = F.when(F.col("n") >= MIN_GROUP, 0).when(F.col("n_lang") >= MIN_GROUP, 1).otherwise(2)
    wanted = joined.select(
        "lang",
        "source",
        level.alias("w_level"),
        F.when(level < 2, F.col("lang")).alias("w_lang"),
        F.when(level == 0, F.col("source")).alias("w_source"),
    )
    return wanted.join(_keyed(found), _same_group("w_")).select("lang", "source", "centre", "inverse")


# --- verdicts -------------------------------------------------------------------------------


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts, written once: a small row per document."""
    wanted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        counts(F.col("text").cast("string")).alias("c"),
    )
    return stage(wanted.select("doc_id", "lang", "source", "c.*"), "counts")


def fit(stats: DataFrame) -> DataFrame:
    """Group estimates from counted documents that pass the base rules."""
    sound = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return stage(group_estimates(sound.select("lang", "source", features().alias("x"))), "estimates")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, distance (null without an estimate) and kept."""
    stats = counted(docs)
    found = fit(stats).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "centre", "inverse")
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    judged = stats.withColumn("x", features()).join(found, same, "left").withColumn("distance", _distance())
    return judged.select(
        "doc_id",
        *COUNTS,
        failed.alias("base_failed"),
        "distance",
        (~failed & (F.coalesce(F.col("distance"), F.lit(0.0)) <= REJECT)).alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep. Texts are counted anew rather
    than written with their counts: they do not move."""
    found = fit(counted(docs)).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "centre", "inverse")
    rows = docs.select(whole_row(docs), counts(F.col("text").cast("string")).alias("c"))
    judged = rows.where(~base_failed(F.col("c.n_words"), F.col("c.n_repeat_words"))).withColumn("x", features("c."))
    lang, source = F.col("row.lang").cast("string"), F.col("row.source").cast("string")
    same = lang.eqNullSafe(F.col("g_lang")) & source.eqNullSafe(F.col("g_source"))
    kept = judged.join(found, same, "left").where(F.coalesce(_distance(), F.lit(0.0)) <= REJECT)
    return kept.select("row.*")
