from collections import Counter

import numpy as np
from helpers import CLASHING, ODD_TEXTS, SF_DIR, WORD, docs, odd_docs, table_rows

from airlattice.llm import quality, queries


def brute_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), symbols, dup, len(repeated), len(lines)


def brute_vector(c):
    n, chars, symbols, dup, repeated, lines = c
    w = max(n, 1)
    return np.array([np.log(w), np.log((chars + 1) / w), np.log1p(100 * symbols / w), np.log1p(10 * dup / max(lines, 1)), np.log1p(10 * repeated / w)])


def brute_estimate(x):
    """Concentration steps on one group's vectors, whole sorting in place of bins."""
    floors = np.diag(np.square(quality.FLOORS))
    quartiles = [np.sort(x, axis=0)[int(np.ceil(q * len(x))) - 1] for q in (0.25, 0.5, 0.75)]
    centre, inverse = quartiles[1], np.linalg.inv(np.diag(((quartiles[2] - quartiles[0]) / 1.349) ** 2) + floors)
    for _ in range(quality.STEPS):
        d = np.einsum("ni,ij,nj->n", x - centre, inverse, x - centre)
        near = x[d <= np.sort(d)[int(np.ceil(quality.HALF * len(x))) - 1]]
        centre = near.mean(axis=0)
        inverse = np.linalg.inv(np.cov(near.T, bias=True) / quality.HALF + floors)
    return centre, inverse


def brute_verdicts(rows):
    """rows: (doc_id, text, lang, source); doc_id to (counts, failed, distance)."""
    stats = {r[0]: brute_counts(r[1]) for r in rows}
    failed = {i: c[0] < 50 or 100 * c[4] > 50 * c[0] for i, c in stats.items()}
    sound = [r for r in rows if not failed[r[0]]]
    groups = {}
    for i, _, lang, source in sound:
        for key in ((lang, source), (lang,), ()):
            groups.setdefault(key, []).append(brute_vector(stats[i]))
    found = {}
    for i, _, lang, source in rows:
        key = next((k for k in ((lang, source), (lang,), ()) if len(groups.get(k, [])) >= quality.MIN_GROUP), ())
        centre, inverse = brute_estimate(np.array(groups[key]))
        x = brute_vector(stats[i]) - centre
        found[i] = stats[i], failed[i], x @ inverse @ x
    return found


def test_counts():
    rng = np.random.default_rng(1)
    texts = ["\n".join(" ".join(rng.choice(["a", "b", "c|", "#d"], rng.integers(0, 9))) for _ in range(rng.integers(0, 9))) for _ in range(300)]
    for text in [*ODD_TEXTS, *texts]:
        assert quality.counts_of(text) == brute_counts(text)


def test_whole_table_against_brute_force(spark):
    rows = table_rows(columns="doc_id, text, lang, source", sf_dir=SF_DIR)
    labels = dict(table_rows("labels", "doc_id, quality"))
    found = {r["doc_id"]: r for r in queries.op3_quality(spark, SF_DIR).collect()}
    want = brute_verdicts(rows)
    assert set(found) == set(want)
    for i, (counts, failed, distance) in want.items():
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts[:5]
        assert r["base_failed"] == failed
        # Bins take a few rows more than the sort does.
        assert failed or abs(r["distance"] - distance) <= 0.25 * distance + 0.5
        assert r["kept"] == (not failed and r["distance"] <= quality.REJECT)
        if not failed and i in labels:
            assert r["kept"] == (labels[i] == 1)


def group(n, seed, bad=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(60, 300))) for _ in range(n)]
    return [t if i >= bad else t.replace(" ", " %%% ## ") for i, t in enumerate(texts)]


def test_outliers_within_groups_of_all_sizes(spark):
    """A third of a large group is junk, and a small group borrows; junk goes, the rest stays."""
    rows = [(i, t, "en", "hot") for i, t in enumerate(group(300, 1, bad=90))]
    rows += [(1000 + i, t, "en", "small") for i, t in enumerate(group(9, 2, bad=2))]
    rows += [(2000 + i, t, None, None) for i, t in enumerate(group(5, 3, bad=1))]
    found = {r["doc_id"]: r["kept"] for r in quality.verdicts(docs(spark, rows)).collect()}
    assert found == {i: "%%%" not in t for i, t, _, _ in rows}


def test_two_fifths_of_a_group_may_be_junk(spark):
    """Junk that passes the base rules goes from groups of which it is 35 and 40 %, all rows in copies or not."""
    rows, junk = [], set()
    for g, (bad, copies) in enumerate([(105, False), (120, False), (120, True)]):
        texts = group(300, 10 + g)
        texts = [t.replace(" ", "%## ") if i < bad else t for i, t in enumerate(texts)]
        texts = [texts[0] if copies and i < bad else t for i, t in enumerate(texts)]
        rows += [(1000 * g + i, t, "en", f"hot{g}") for i, t in enumerate(texts)]
        junk.update(1000 * g + i for i in range(bad))
    found = quality.verdicts(docs(spark, rows)).collect()
    assert len(found) == len(rows) and not any(r["base_failed"] for r in found)
    assert {r["doc_id"] for r in found if not r["kept"]} == junk


def test_odd_rows_and_kept_columns(spark):
    frame = odd_docs(spark)
    assert quality.verdicts(frame).count() == frame.count()
    good = " ".join(f"word{i}" for i in range(80))
    more = frame.unionByName(docs(spark, [(50, good, "en", "s"), (50, good, "en", "s"), (None, good)]))
    kept = quality.keep_good(more)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    assert sorted([r["doc_id"] for r in kept.where(kept.text == good).collect()], key=str) == [50, 50, None]
    verdicts = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality.verdicts(more).collect()}
    assert kept.count() == sum(r["kept"] for r in quality.verdicts(more).collect()) and verdicts
    assert quality.verdicts(docs(spark, [])).count() == 0 and quality.keep_good(docs(spark, [])).count() == 0
