import random

import numpy as np
import pytest
from helpers import SF_DIR, WORD, docs, low, odd_docs, table_rows
from pyspark.sql import functions as F

from airlattice.llm import minhash, queries
from airlattice.llm.hot_keys import join_hot


def shingles(text, size=4):
    words = WORD.findall(low(text))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows):
    """(doc_id, n_shingles, smallest reachable id, kept), sorted; each distinct set compared with each."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    distinct = [s for s in dict.fromkeys(sets) if s]
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    holders = {}
    for i, s in enumerate(distinct):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(distinct):
        common = {}
        for x in s:
            for j in holders[x]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(distinct[j]) - n):
                root[find(distinct[j])] = find(s)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            r = find(s)
            least[r] = min(i, least.get(r, i))
    found = []
    for (i, _), s in zip(rows, sets):
        component = least.get(find(s)) if s else i
        found.append((i, len(s), component, i == component))
    return sorted(found, key=str)


def rows_of(frame):
    return sorted(map(tuple, frame.select("doc_id", "n", "component_id", "kept").collect()), key=str)


def test_whole_table_against_brute_force(spark):
    found = sorted(map(tuple, queries.op11_minhash(spark, SF_DIR).collect()), key=str)
    assert found == brute(table_rows(columns="doc_id, text"))
    assert 0 < sum(not kept for *_, kept in found) < len(found)


def test_odd_rows(spark):
    frame = odd_docs(spark)
    assert rows_of(minhash.near_copies(frame)) == brute([tuple(r) for r in frame.select("doc_id", "text").collect()])
    assert minhash.near_copies(docs(spark, [])).count() == 0
    alone = minhash.near_copies(docs(spark, [(None, "some words without any id"), (None, "some words without any id")]))
    assert rows_of(alone) == [(None, 2, None, True)] * 2


def varied(rng, base, share):
    return [f"v{rng.random()}" if rng.random() < share else w for w in base]


def planted(seed):
    """Chains and stars of near copies around the threshold, passages that most texts share, copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    texts = [[word() for _ in range(rng.choice([1, 3, 4, 5, 30, 90]))] + passage + [word() for _ in range(rng.randrange(40))] for _ in range(120)]
    for length in (8, 40, 200, 900):
        base = [word() for _ in range(length)]
        texts += [varied(rng, base, share) for share in (0, 0.01, 0.02, 0.03, 0.05, 0.08) for _ in range(8)]
        for _ in range(12):
            base = varied(rng, base, 0.03)
            texts.append(base)
    texts += texts[::17]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("stars", [0, 5])
def test_near_copies_passages_and_chains(spark, monkeypatch, stars):
    """Whichever way lists are taken apart, in small blocks too, no link is lost."""
    monkeypatch.setattr(minhash, "MAX_STARS", stars)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(minhash, "PAIRS_PER_POSTING", 1)
    rows = planted(stars)
    found = rows_of(minhash.near_copies(docs(spark, rows)))
    assert found == brute(rows)
    assert len({c for _, _, c, _ in found}) < len(found) - 100


def test_threshold_is_exact(spark):
    """Exactly 80 in 100 are linked, one word less alike is not; within the sketch and beyond it."""
    rows = []
    for scale in (1, 5, 20, 60):
        for more in (0, 1):
            shared = [f"s{scale}m{more}n{i}" for i in range(4 * scale + 3)]
            rows += [" ".join(shared), " ".join(shared + [f"x{i}" for i in range(scale + more)])]
    rows = list(enumerate(rows))
    found = rows_of(minhash.near_copies(docs(spark, rows)))
    assert found == brute(rows)
    assert [i for i, _, _, kept in sorted(found) if not kept] == [1, 5, 9, 13]


def test_fewer_values_than_certain_are_unlikely():
    """Pairs just at the threshold share more sketch values than what is called certain."""
    certain = minhash.certain_overlap(64)
    assert 25 <= certain <= 35 and minhash.certain_overlap(64, loss=1e-3) > certain
    rng = np.random.default_rng(1)
    # of a union of 2,000 shingles, the first 1,600 are shared
    assert min((rng.permutation(2000)[:64] < 1600).sum() for _ in range(500)) > certain


def tied_roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        root[find(int(i))] = find(int(j))
    return [find(x) for x in range(n)]


def partition(roots):
    groups = {}
    for i, r in enumerate(roots):
        groups.setdefault(r, set()).add(i)
    return {frozenset(g) for g in groups.values()}


def test_nothing_is_ruled_out_that_is_linked():
    """Random families of sets: the links found tie together what all links do, and are no more than needed."""
    rng = np.random.default_rng(4)
    hashes = minhash._WordHashes()
    for _ in range(8):
        size = int(rng.choice([3, 20, 70, 400]))
        base = rng.integers(0, 1 << 60, size)
        sets = []
        for share in np.repeat([0, 0.02, 0.05, 0.1, 0.2, 0.4], 8):
            changed = np.where(rng.random(size) < share, rng.integers(0, 1 << 60, size), base)
            sets.append(minhash.shingle_set(" ".join(map(str, changed)).encode(), hashes))
        roots = rng.integers(0, 6, len(sets)) if rng.random() < 0.5 else np.arange(len(sets))
        before = [(i, int(np.flatnonzero(roots == r)[0])) for i, r in enumerate(roots)]
        every = [
            (i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
        ]
        found = minhash.linked_pairs(sets, sets, roots, roots, True)
        assert set(found) <= set(every) and len(found) < len(set(roots))
        assert partition(tied_roots(len(sets), before + found)) == partition(tied_roots(len(sets), before + every))
        half = len(sets) // 2
        crossed = [(i, j + half) for i, j in minhash.linked_pairs(sets[:half], sets[half:], roots[:half], roots[half:], False)]
        want = [(i, j) for i, j in every if i < half <= j]
        assert partition(tied_roots(len(sets), before + crossed)) == partition(tied_roots(len(sets), before + want))


def test_hot_keys_stay_apart(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = sorted(map(tuple, rows.join(table, "k").select("k", "id", "v").collect()))
    assert sorted(map(tuple, join_hot(rows, table, "k", share=0.1, least=100).select("k", "id", "v").collect())) == plain
    assert sorted(map(tuple, join_hot(rows, table, "k").select("k", "id", "v").collect())) == plain
