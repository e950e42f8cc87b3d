"""What each filter of a set removes in every order of applying them.

A document fails some of the filters: its mask. In one order it is removed by the first filter of
its mask, and the orders that begin alike stand together in lexicographic order: all that share their
first ``s`` filters are one interval of ranks. So a mask's removals at step ``s`` are a few
intervals; its documents are added at one end and taken away at the other, and a running sum over
the ranks gives the counts of every order. The work is one pass over the texts and then one row per
part and mask.

Cases: a null text is empty, a null source the part of the empty string; a row without an id has no
smaller id, so it is never a repeat, and others are no repeats of it; rows that repeat an id with its
text are no repeats of each other; several labels of one id count as their greatest; an empty table
gives no rows; extra columns are not looked at.
"""

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airlattice.joins import MAX_BROADCAST_KEYS, broadcast_if_small
from airlattice.llm.common import stage

SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ("docs", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """The filters that look at one text, as conditions of failing."""
    words = F.array_remove(F.split(text, SPACES), "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _bits(filters: list[Column]) -> Column:
    mask = F.lit(0)
    for i, fails in enumerate(filters):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    return mask


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (a bit per filter of ``text_filters``), and the text's digest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
    )
    mask = _bits(list(text_filters(F.col("text")).values()))
    return rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add good and toxic (0 or 1). Rows without an id have no label and stay out of the join."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    marks = broadcast_if_small(marks, MAX_BROADCAST_KEYS)
    known = rows.where(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left")
    flagged = known.unionByName(rows.where(F.col("doc_id").isNull()), allowMissingColumns=True)
    return flagged.select(*rows.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


def _counted(rows: DataFrame) -> DataFrame:
    sums = {"docs": F.count(F.lit(1)), "good": F.sum("good"), "toxic": F.sum("toxic")}
    return rows.groupBy("part", "mask").agg(*[sums[c].cast("long").alias(c) for c in COUNTS])


def mask_counts(rows: DataFrame, repeat_bit: int) -> DataFrame:
    """part, mask, docs, good, toxic: with the bit of those whose text a smaller id has too.

    The first of each text are found by joining (digest, smallest id), so a text that a third of all
    rows share is one row of that join; all rows less those first ones are the repeats.
    """
    rows = stage(rows, "failures")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull())
    first = rows.join(least, ["digest", "doc_id"], "left_semi")
    single = _counted(first.unionByName(rows.where(F.col("doc_id").isNull())))
    taken = single.select("part", "mask", *[(-F.col(c)).alias(c) for c in COUNTS])
    repeats = _counted(rows).unionByName(taken).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])
    repeats = repeats.where("docs > 0").withColumn("mask", F.col("mask") + (1 << repeat_bit))
    return single.unionByName(repeats)


def removal_intervals(names: str) -> list[tuple[int, int, int, int]]:
    """(mask, step, rank, sign): where the orders in which ``mask`` is removed at ``step`` begin (1) and
    end (-1). The rank of a beginning is its Lehmer code: for each place, the number of smaller
    filters still unused, times the orders of the rest."""
    size, found = len(names), []
    for step in range(1, size + 1):
        orders_of_rest = math.factorial(size - step)
        for prefix in itertools.permutations(range(size), step):
            smaller = [sum(f < prefix[i] for f in set(range(size)) - set(prefix[:i])) for i in range(step)]
            rank = sum(s * math.factorial(size - 1 - i) for i, s in enumerate(smaller))
            passed, last = sum(1 << f for f in prefix[:-1]), 1 << prefix[-1]
            for mask in range(1 << size):
                if mask & last and not mask & passed:
                    found += [(mask, step, rank, 1), (mask, step, rank + orders_of_rest, -1)]
    return found


def audit(counts: DataFrame, names: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row
    per part, order and step, from the counts per part and mask.

    Bit i of a mask is filter i of ``names``, which are in alphabetical order. The orders are a fixed
    number of rows per part, and so is every window.
    """
    spark, size = counts.sparkSession, len(names)
    ends = spark.createDataFrame(removal_intervals(names), "mask int, step int, rank int, sign int")
    changes = counts.join(F.broadcast(ends), "mask").groupBy("part", "step", "rank").agg(
        *[F.sum(F.col("sign") * F.col(c)).alias(c) for c in COUNTS]
    )
    orders = list(enumerate(itertools.permutations(range(size))))
    rows = [(r * size + s, r, s + 1, order[s], "".join(names[f] for f in order)) for r, order in orders for s in range(size)]
    grid = spark.createDataFrame(rows, "place int, rank int, step int, filter int, filter_order string")

    failing = [F.col("mask").bitwiseAND(F.lit(1 << f)) > 0 for f in range(size)]
    alone = [F.col("mask") == 1 << f for f in range(size)]
    per_part = counts.groupBy("part").agg(
        F.sum("docs").alias("all_docs"),
        *[F.array(*[F.sum(F.when(c, F.col("docs")).otherwise(0)) for c in conditions]).alias(name)
          for name, conditions in (("fails", failing), ("only", alone))],
    )
    places = per_part.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1)))).join(F.broadcast(grid), "place")

    ranks = W.partitionBy("part", "step").orderBy("rank")
    steps = W.partitionBy("part", "rank").orderBy("step")
    removed = places.join(changes, ["part", "step", "rank"], "left").withColumns(
        {c: F.sum(F.coalesce(c, F.lit(0))).over(ranks) for c in COUNTS}
    )
    return removed.select(
        "part", "filter_order", "step",
        (F.col("all_docs") - F.sum("docs").over(steps)).alias("kept"),
        F.col("docs").alias("removed"),
        (F.get("fails", F.col("filter")) - F.col("docs")).alias("redundant"),
        F.get("only", F.col("filter")).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("docs").over(W.partitionBy("part", "filter")).alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the four text filters (A to D) and of repeated texts (E), per source."""
    return audit(mask_counts(with_labels(failures(docs), labels), 4), "ABCDE")
