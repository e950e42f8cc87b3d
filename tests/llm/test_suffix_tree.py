import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF_DIR, WORD, docs, fold, low, odd_docs, table_rows
from pyspark.sql import functions as F

from airlattice.llm import queries, suffix_tree

END = None


def tokens(text):
    return [*WORD.findall(low(text)), END]


def brute(rows, trains, depth=suffix_tree.MAX_DEPTH):
    """(doc_id, n_tokens, n_known, N, base, score) per row, from plain dictionaries of word tuples."""
    lists = [tokens(t) for _, t in rows]
    training = [t for (i, _), t in zip(rows, lists) if trains(i)]
    count = Counter(w for t in training for w in t)
    total = sum(count.values())
    root = lambda w: (count[w] + 1) / (total + len(count) + 1)
    follow = defaultdict(Counter)
    for t in training:
        for i, w in enumerate(t):
            for k in range(1, depth + 1):
                if i >= k:
                    follow[tuple(t[i - k : i])][w] += 1

    states: dict = {}

    def prob(context, w):
        """Of a word after a retained context."""
        if not context:
            return root(w)
        often, mass, followers = states[context]
        n = follow[context][w]
        own = max(n - suffix_tree.DISCOUNT, 0) if n >= 2 else 0
        left = 1 - (mass - suffix_tree.DISCOUNT * followers) / often
        return own / often + left * prob(context[1:], w)

    for k in range(1, depth + 1):
        for context, after in [(c, a) for c, a in follow.items() if len(c) == k]:
            often = sum(after.values())
            if often < suffix_tree.MIN_CONTEXT or (k > 1 and context[1:] not in states):
                continue
            twice = {w: n for w, n in after.items() if n >= 2}
            gain = sum(n * math.log(n / (often * prob(context[1:], w))) - 0.5 * math.log(often) for w, n in twice.items())
            if gain >= suffix_tree.MIN_DIVERGENCE * often:
                states[context] = often, sum(twice.values()), len(twice)
    found = []
    for (i, _), t in zip(rows, lists):
        base = score = 0.0
        for at, w in enumerate(t):
            k = 0
            while k < min(depth, at) and tuple(t[at - k - 1 : at]) in states:
                k += 1
            base += math.log10(root(w))
            score += math.log10(prob(tuple(t[at - k : at]), w))
        found.append((i, len(t), sum(count[w] > 0 for w in t), total, base, score))
    return found, states


def same(found, want):
    assert len(found) == len(want)
    for a, b in zip(sorted(found, key=str), sorted(want, key=str)):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)


def rows_of(frame):
    columns = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return [tuple(r[c] for c in columns) for r in frame.collect()]


def test_whole_table_against_brute_force(spark):
    rows = table_rows(columns="doc_id, text")
    found = queries.op8_suffix_tree(spark, SF_DIR)
    want, states = brute(rows, lambda i: fold(i, 7) != 2)
    assert any(len(s) > 1 for s in states)
    same(rows_of(found), want)
    held = {r["doc_id"]: r["held_out"] for r in found.collect()}
    assert held == {i: fold(i, 7) == 2 for i, _ in rows}
    # Passages repeat across documents, so contexts help on texts that were not learned from.
    out = [(b, s) for i, _, _, _, b, s in want if held[i]]
    assert sum(s for _, s in out) > sum(b for b, _ in out)


def test_many_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(suffix_tree, "BUCKET_TOKENS", 50)
    rng = random.Random(1)
    phrases = ["the cat sat on the mat .", "the dog sat on the rug .", "a cat and a dog", "once upon a time there was"]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    same(rows_of(suffix_tree.held_out_scores(docs(spark, rows))), brute(rows, lambda i: fold(i, 7) != 2)[0])


def test_contexts_of_a_few_documents_count(spark):
    """A passage that ten documents share is a state, one that six share is not."""
    for shared, learned in ((10, True), (6, False)):
        rows = [(i, f"first{i} green apples last{i}") for i in range(shared)]
        found = rows_of(suffix_tree.scored(docs(spark, rows), F.lit(True)))
        assert len(found) == shared
        assert all((score > base + 0.1) == learned for *_, base, score in found)
        same(found, brute(rows, lambda i: True)[0])


def test_states_behind_a_common_word(spark):
    """(b) is followed by anything and no state, yet (b, c) and (a, b, c) are."""
    texts = [f"b r{i}" for i in range(4000)] + ["a b c d"] * 60 + ["e b c f"] * 300 + ["c g"] * 3000
    want, states = brute(list(enumerate(texts)), lambda i: True)
    assert ("a", "b", "c") in states and ("b",) not in states
    same(rows_of(suffix_tree.scored(docs(spark, list(enumerate(texts))), F.lit(True))), want)


@pytest.mark.parametrize("seed", [2, 3])
def test_few_common_words(spark, monkeypatch, seed):
    """Phrases with words that stand everywhere, so that these are no states, in many blocks."""
    monkeypatch.setattr(suffix_tree, "BLOCK_TOKENS", 2000)
    monkeypatch.setattr(suffix_tree, "BUCKET_TOKENS", 1000)
    rng = random.Random(seed)
    common, rare = ["the", "of", "a"], [f"w{i}" for i in range(25)]
    phrases = [[rng.choice(common if rng.random() < 0.5 else rare) for _ in range(rng.randint(3, 6))] for _ in range(30)]
    word = lambda: [rng.choice(common), f"x{rng.randrange(4000)}"]
    rows = [(i, " ".join(w for _ in range(rng.randint(1, 8)) for w in (rng.choice(phrases) if rng.random() < 0.15 else word()))) for i in range(1500)]
    want, states = brute(rows, lambda i: fold(i, 7) != 2)
    assert any(len(c) == 3 and c[1:2] not in states for c in states)
    same(rows_of(suffix_tree.held_out_scores(docs(spark, rows))), want)


def test_odd_rows(spark):
    frame = odd_docs(spark)
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    same(rows_of(suffix_tree.held_out_scores(frame)), brute(rows, lambda i: fold(i, 7) != 2)[0])
    nothing = suffix_tree.scored(frame, F.lit(False))
    same(rows_of(nothing), brute(rows, lambda i: False)[0])
    assert suffix_tree.held_out_scores(docs(spark, [])).count() == 0


def test_packed_arrays():
    for values in (np.arange(300), np.array([], np.int64), np.array([0.5, -2.0]), np.array([2**40])):
        assert suffix_tree.unpacked(suffix_tree.packed(values)).tolist() == values.tolist()


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_ranked_keys(n):
    keys = np.random.default_rng(n).integers(0, 300, n).astype(np.uint64)
    for found, want in zip(suffix_tree.ranked(keys), np.unique(keys, return_index=True, return_inverse=True)):
        assert found.tolist() == want.tolist()


def test_answers_hold_what_blocks_use():
    """Of contexts that are no states a bucket answers about a bit, of states also their mass and followers."""
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    size = len(keys)
    often = rng.integers(8, 100, size)
    gain = np.where(np.arange(size) % 10 == 0, 1.0, rng.random(size) * 0.01) * often
    mass, followers = rng.integers(0, 8, size), rng.integers(0, 3, size)
    asked = [r for block in (1, 2) for r in suffix_tree.requests(block, keys, [mass, followers, gain / 2, often], 1)]
    answers = suffix_tree._add_up(pa.Table.from_batches([suffix_tree._asked(asked)]), 2).to_pylist()
    assert sum(len(c) for r in answers for c in r["columns"]) < 2 * size
    states = np.arange(size) % 10 == 0
    for row in answers:
        (kept, own_mass, own_followers), _ = suffix_tree.answered([row], size)
        assert kept.astype(bool).tolist() == states.tolist()
        assert own_mass.tolist() == (2 * mass[states]).tolist() and own_followers.tolist() == (2 * followers[states]).tolist()


def test_word_hashes_follow_words(monkeypatch):
    """Equal words have equal hashes wherever they stand, in windows of any size; others have others."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))).encode() for _ in range(3000)]
    words += [b"x" * n for n in range(1, 150)] + [b"y" * 5000]
    text = b" " + b"".join(w + b" " * rng.randint(1, 3) for w in words)
    for size in (64, 1 << 16):
        monkeypatch.setattr(suffix_tree, "PIECE_BYTES", size)
        monkeypatch.setattr(suffix_tree, "_powers", {})
        starts, hashes = suffix_tree.word_hashes(text)
        assert [text[a : a + len(w)] for a, w in zip(starts.tolist(), words)] == words and len(starts) == len(words)
        assert len(set(hashes.tolist())) == len(set(words)) == len(set(zip(words, hashes.tolist())))


@pytest.mark.parametrize("bits", [1, 2, 7, 12])
def test_scrambled_is_a_permutation(bits):
    assert sorted(suffix_tree.scrambled(np.arange(1 << bits, dtype=np.uint64), bits).tolist()) == list(range(1 << bits))


def test_keys_are_sent_in_few_bytes():
    """Pairs of words go as pairs of the words' numbers, not as 64-bit hashes, which take six bytes each."""
    rng = np.random.default_rng(7)
    block = suffix_tree.BlockBuilder(0)
    for doc in range(300):
        block.add([doc], [True], [b" ".join(b"w%d" % n for n in rng.integers(0, 1000, 100))])
    row = block.row()
    add_up = lambda asked, step: suffix_tree._add_up(pa.Table.from_batches([suffix_tree._asked(list(asked))]), step).to_pylist()
    words = add_up(suffix_tree.requests(0, suffix_tree.unpacked_keys(row["words"]), [suffix_tree.unpacked(row["counts"])], 1), 0)
    walk = suffix_tree.Walk(row, [words], sum(r["total"] for r in words), 1001, 1, [words[0]["ranks"]])
    pairs, (counts,), span = walk.ask(1)
    assert len(pairs) > 20_000 and counts.sum() > 29_000 and int(pairs.max()) < span
    asked = list(suffix_tree.requests(0, pairs, [counts], 1, span))
    assert sum(len(r["keys"]) for r in asked) < 2 * len(pairs)
    contexts, _, span = suffix_tree.Walk(row, [words, add_up(asked, 1)], 30_300, 1001, 1, [words[0]["ranks"]]).ask(2)
    assert sum(len(r["keys"]) for r in suffix_tree.requests(0, contexts, [], 1, span)) < len(contexts)
