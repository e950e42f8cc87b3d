import hashlib
import itertools
import math
import os
import random
import re
import sys
import zlib

import pytest
from helpers import SF_DIR, docs, low, odd_docs, table_rows
from pyspark.sql import functions as F

sys.path.append(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import connect, differences

from airlattice.llm import filter_audit, queries, resampling


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_resampling"])
def test_whole_table_against_sql(spark, name):
    run, sql = queries.QUERIES[name]
    extra, missing, n = differences(spark, connect(SF_DIR), run, sql, SF_DIR)
    assert not extra and not missing and n > 0


# --- filter audit ---------------------------------------------------------------------------


def masks(rows, labels):
    """(part, mask as a set of letters, good, toxic) of (doc_id, text, source) rows."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": any(c in text for c in "#$%&*|"),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        found.append((source or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    return found


def brute_audit(rows, labels):
    judged, found = masks(rows, labels), []
    for part in {p for p, *_ in judged}:
        own = [j for j in judged if j[0] == part]
        table, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                out = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(out)
                failing = sum(f in d[1] for d in own)
                unique = sum(d[1] == {f} for d in own)
                table.append((part, "".join(order), step, f, len(left), len(out), failing - len(out), unique,
                              sum(d[2] for d in out), sum(d[3] for d in out)))
        found += [(*row[:3], *row[4:], shapley[row[3]]) for row in table]
    return sorted(found)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_odd_rows(spark):
    rng = random.Random(3)
    frame = odd_docs(spark)
    more = [(100 + i, rng.choice(["# " * 60, "Plain WORDS " * 30, "some words", " ".join(f"w{j}" for j in range(60)), None]), "en", rng.choice("pq")) for i in range(40)]
    frame = frame.unionByName(docs(spark, more))
    labels = [(4, 1, 0), (4, 0, 1), (5, None, 1), (None, 1, 1), (100, 1, None), (101, 0, 1), (9999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash"))
    found = filter_audit.audited(frame, marks)
    assert found.columns == COLUMNS
    rows = [tuple(r) for r in frame.select("doc_id", "text", "source").collect()]
    assert sorted(map(tuple, found.collect())) == brute_audit(rows, labels)
    assert filter_audit.audited(docs(spark, []), marks).count() == 0
    assert filter_audit.audited(frame, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_intervals_are_the_orders_that_begin_so():
    """For each mask, every rank is in exactly one step's intervals, that of its first failing filter."""
    for names in ("AB", "ABCDE"):
        orders = list(itertools.permutations(range(len(names))))
        covered = {}
        for mask, step, rank, sign in filter_audit.removal_intervals(names):
            row = covered.setdefault((mask, step), [0] * (len(orders) + 1))
            row[rank] += sign
        for mask in range(1, 1 << len(names)):
            first = [next(s for s, f in enumerate(order, 1) if mask >> f & 1) for order in orders]
            for step in range(1, len(names) + 1):
                sums = list(itertools.accumulate(covered.get((mask, step), [0] * len(orders))))[: len(orders)]
                assert sums == [int(s == step) for s in first]


# --- resampling -----------------------------------------------------------------------------


def brute_resampled(rows, targets, share=(10, 100), min_words=20, buckets=10_000):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))

    def counts(texts):
        found = [0] * buckets
        for text in texts:
            for w in words(text):
                found[zlib.crc32(w.encode()) % buckets] += 1
        return found

    s, t = counts(r[1] for r in rows), counts(targets)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    scored = []
    for i, text in rows:
        own = [gain[zlib.crc32(w.encode()) % buckets] for w in words(text)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    drawn = share[0] * len(able) // share[1]
    short = [(*r, None) for r in scored if r[1] < min_words]
    return sorted([*((*r, n if n <= drawn else None) for n, r in enumerate(able, 1)), *short], key=str)


def test_resampling_of_odd_rows_and_ties(spark):
    rng = random.Random(5)
    long = lambda: " ".join(rng.choice(["sun", "Moon", "star", "x1", "日本", "é"]) for _ in range(rng.randrange(15, 40)))
    rows = [(i, long()) for i in range(80)] + [(7, "a b " * 15)] * 9 + [(None, "no id " * 12)] * 6
    frame = odd_docs(spark).unionByName(docs(spark, rows))
    targets = spark.createDataFrame([(1, "sun and moon"), (2, None), (None, "Star!")], "item_id long, text string")
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    for share in ((10, 100), (1, 1), (97, 100)):
        found = sorted(map(tuple, resampling.resampled(frame, targets, share=share).collect()), key=str)
        assert found == brute_resampled(rows, ["sun and moon", None, "Star!"], share)
    none = resampling.resampled(docs(spark, []), targets)
    assert none.columns == ["doc_id", "n_features", "weight", "score", "rank"] and none.count() == 0
    assert resampling.resampled(frame, targets.limit(0)).count() == len(rows)


@pytest.mark.parametrize("wanted", [0, 1, 5, 137, 399, 400])
def test_cutoff_counts_exactly(spark, wanted):
    rng = random.Random(wanted)
    rows = [(rng.randrange(-3, 3), rng.choice([-(1 << 63), -5, (1 << 63) - 1]), i) for i in range(400)]
    frame = spark.createDataFrame(rows, "x long, y long, z long")
    cut = resampling.cutoff(frame, ["x", "y", "z"], wanted, ways=3)
    chosen = [r for r in rows if cut and r >= cut]
    assert len(chosen) == wanted and sorted(rows, reverse=True)[:wanted] == sorted(chosen, reverse=True)


def test_runs_of_words_are_features():
    assert resampling.features(b"One two-THREE", 2) == [b"one", b"two", b"three", b"one two", b"two three"]
    assert resampling.features("".encode()) == []
